"""Operators 11 to 13 against plain loops, on nulls, ties, repeated rows, clashing names, empty tables and long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import op5_licence, op11_merkle, op12_urls, op13_infill

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# -- 11 ------------------------------------------------------------------------


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels of a tree, and for each first node its (left, right) siblings from the bottom up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[k : k + 3]) for k in range(0, len(below), 3)])
    proofs = []
    for k in range(len(nodes)):
        steps = []
        for level in levels[:-1]:
            run = level[k // 3 * 3 : k // 3 * 3 + 3]
            steps.append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
            k //= 3
        proofs.append(steps)
    return levels[-1][0], proofs


def manifest_of(rows):
    if not rows:
        return []
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        made[name] = own, *tree([leaf_of(r) for r in own])
    root, above = tree([made[n][1] for n in names])
    out = []
    for name, top in zip(names, above, strict=True):
        own, subroot, proofs = made[name]
        for row, steps in zip(own, proofs, strict=True):
            steps = steps + top
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            x = leaf_of((*row[:4], text))
            for left, right in steps:
                x = sha(left, x, right)
            out.append((row[0], leaf_of(row), subroot, root, sha(*(a + b for a, b in steps)), x, x == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {None: 1, "a": 1}, {None: 4, "": 1, "a": 2, "é": 3, "z": 28, "b": 9, "c": 10}, {f"s{k}": k % 3 + 1 for k in range(11)}])
def test_op11(spark, tmp_path, sizes):
    rng = random.Random(1)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((rng.choice([None, *range(40)]), source, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "é\n\n", "x" * 50])))
    rows += rows[: len(rows) // 4]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("group", "place", "digest", "proof")})
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op11_merkle.op11_merkle(spark, str(tmp_path)).collect()), key=repr)
    assert got == manifest_of(rows)


def test_op11_on_given_rows(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*op11_merkle.COLUMNS).collect()]
    got = sorted((tuple(r) for r in op11_merkle.op11_merkle(spark, sf_dir).collect()), key=repr)
    assert got == manifest_of(rows) and {r[-1] for r in got} == {True, False}


def test_op11_proofs_fold_to_the_root(spark):
    """The operator's own interface: other columns are carried, proofs have a step for each level."""
    leaves = spark.createDataFrame([(k, "g", k * 2, sha(str(k))) for k in range(30)], "k int, g string, note int, digest string")
    out = op11_merkle.manifest(leaves, F.col("g"), "k")
    assert out.columns == ["k", "g", "note", "digest", "proof", "subroot", "root"]
    rows = out.withColumn("ok", op11_merkle.fold(F.col("digest"), F.col("proof")) == F.col("root")).collect()
    assert len(rows) == 30 and all(r["ok"] and len(r["proof"]) == 4 and r["note"] == 2 * r["k"] and r["root"] == r["subroot"] for r in rows)


# -- 12 ------------------------------------------------------------------------


def glob_regex(glob):
    out, k = "", 0
    while k < len(glob):
        stars = len(glob[k:]) - len(glob[k:].lstrip("*"))
        if stars:
            out, k = out + (r"[^/?#]*" if stars == 1 else r"(?s:.*)"), k + stars
        elif glob[k] == "?":
            out, k = out + r"[^/?#]", k + 1
        else:
            k += glob[k] == "\\" and k + 1 < len(glob)
            out, k = out + re.escape(glob[k]), k + 1
    return re.compile(out)


def test_op12_automaton_by_regular_expressions():
    rng = random.Random(2)
    globs = ["", "*", "**", "a", "?", "a**b*", "\\*", "a\\", "**" + "ab" * 60 + "*", *("".join(rng.choices(["a", "b", "/", "*", "**", "?", "\\?", "é"], k=rng.randint(1, 9))) for _ in range(150))]
    urls = ["", "a", "*", "ab" * 60, *("".join(rng.choices("aab/?é", k=rng.randint(0, 14))) for _ in range(300))]
    raw = [u.encode() for u in urls]
    end = np.cumsum([len(r) for r in raw])
    begin, data = end - [len(r) for r in raw], np.frombuffer(b"".join(raw), np.uint8)
    plain = [g for g in globs if "é" not in g or "?" not in g.replace("\\?", "")]
    for words in (1, 3, 64):
        masks = op12_urls.packed(plain, words)
        fits = np.concatenate([m.run(data, begin, end) for m in masks], 1)
        for k, g in enumerate(plain):
            regex = glob_regex(g)
            one = "?" in g.replace("\\?", "")  # ? is one byte
            assert [bool(f) for f, u in zip(fits[:, k], urls, strict=True) if not (one and "é" in u)] == [regex.fullmatch(u) is not None for u in urls if not (one and "é" in u)], g
        won = op12_urls.winners(masks, data, begin, end)
        assert [int(w) for w in won] == [next((k for k in range(len(plain)) if fits[i, k]), -1) for i in range(len(urls))]


def judged(url, rules, globs, default):
    host = path = query = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1].split("#", 1)[0]
        host = re.split("[/?]", rest, maxsplit=1)[0]
        path, _, q = rest[len(host) :].partition("?")
        query = "?" + q if "?" in rest else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    key = lambda r: (-len(r[1]), r[0] != "block", r[1])
    for verdict, rule in sorted(rules, key=key):
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            return host, path, rule, None, verdict
    for verdict, glob in sorted(globs, key=key):
        if glob_regex(glob).fullmatch(host + path + query):
            return host, path, None, glob, verdict
    return host, path, None, None, default


def test_op12(spark):
    urls = [None, "", "x", "http://", "://com/", "http://com/", "http://a.com/x", "http://a.com", "http://a.com?x.com/", "http://acom/x", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/", "http://example.com/EN/", "https://m.b.net/es/1?q#f", "http://b.net/fr", "http://casino.org/", "http://x.org/casino", "http://x.org/a?utm_source=f", "http://x.org/a?b=1&utm_source=f#utm_source=", "http://m.a.org/x/1.html", "http://x.org/de://com/", "http://Ünï.org/é", "http://x.org/" + "a" * 100_000 + "?utm_source=", "http://a.com/\n/x", "http://x#/com/", "http://www.b.org/de/abcd"]
    urls += urls[5:9]
    pages = spark.createDataFrame([(k, u, "c", "c", "c") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string, verdict string")
    got = {r["id"]: tuple(r)[1:] for r in op12_urls.judge_urls(pages, op12_urls.RULES, op12_urls.GLOBS).collect()}
    assert got == {k: judged(u, op12_urls.RULES, op12_urls.GLOBS, "allow") for k, u in enumerate(urls)}
    assert op12_urls.judge_urls(pages.limit(0), op12_urls.RULES, op12_urls.GLOBS).count() == 0
    none = op12_urls.judge_urls(pages, (), (), "block").collect()
    assert all(r["verdict"] == "block" and r["rule"] is None and r["pattern"] is None for r in none)


def test_op12_many_rules_and_ties(spark):
    rng = random.Random(3)
    hosts = ["".join(rng.choices("abc", k=2)) + "." + rng.choice(["x", "y"]) for _ in range(60)]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts + ["x", "y", "c.d"]) + rng.choice(["/", "/a", "/a/b", "/*"])) for _ in range(300)]
    globs = [(rng.choice(["allow", "block"]), rng.choice(["*", "**", "?"]) + rng.choice("abc") + rng.choice(["*", "**", "/**"])) for _ in range(60)]
    urls = [f"http://{rng.choice(['', 's.', 'ab.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/a/b/c', '/*x', '/z?a=1'])}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["id"]: tuple(r)[1:] for r in op12_urls.judge_urls(pages, rules, globs, "block").collect()}
    want = {k: judged(u, rules, globs, "block") for k, u in enumerate(urls)}
    assert got == want and len({w[4] for w in want.values()}) == 2


# -- 13 ------------------------------------------------------------------------


def test_elias_fano():
    rng = random.Random(4)
    for _ in range(200):
        values = sorted(rng.choices(range(rng.choice([1, 10, 1000, 10**9])), k=rng.randint(0, 60)))
        packed = op13_infill.elias_fano(np.array(values, np.int64))
        assert [op13_infill.select(packed, k) for k in range(len(values))] == values
    ends = np.arange(60, 60_001, 60)
    assert len(op13_infill.elias_fano(ends)) < 1100  # about 8 bits each


def infilled(key, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return key, n, "plain", text, None, None
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:lo], lines[lo:hi], lines[hi:]))
    if h[3] % 100 < spm:
        return key, n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return key, n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_op13(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op13_infill, "REMEMBERED", 8)
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n", "no end", "end\n", "<P>", "a<M>\nb", "<P\n>", "é日😀\n\n😀", "\r\n x\n", "x" * 200_000 + "\n" + "y\n" * 50_000]
    texts += ["".join(rng.choices("ab é😀\n\n<", k=rng.randint(0, 60))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[9]) for k in range(60)] + [(3, texts[9]), (3, texts[9]), (None, "a\nb\nc"), (-5, "a\nb\nc")]
    docs = spark.createDataFrame([(k, t, 1, "c") for k, t in rows], "doc_id long, text string, n int, digest string").repartition(5)
    got = sorted((tuple(r) for r in op13_infill.infill(docs).collect()), key=repr)
    assert got == sorted((infilled(k, t) for k, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    half = sorted((tuple(r) for r in op13_infill.infill(docs, rate=40, suffix_first=10, seed=3).collect()), key=repr)
    assert half == sorted((infilled(k, t, 3, 40, 10) for k, t in rows), key=repr)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for r in op13_infill.op13_infill(spark, str(tmp_path)).collect():
        assert r["restored_sha256"] in {sha(t or "") for k, t in rows if k == r["doc_id"]}
    assert op13_infill.infill(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        op13_infill.infill(docs, sentinels=("<P>", "<P>x", "<M>"))


def test_op13_index_has_a_row_for_each_distinct_text(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a\nb", "a\nb", "c", None, "", "c"] * 20)], "doc_id long, text string").repartition(6)
    index = op13_infill.distinct_index(op13_infill.keyed(docs, "doc_id", "text")).collect()
    assert sorted((r["size"], r["n"]) for r in index) == [(0, 0), (1, 1), (3, 2)]


# -- 5 -------------------------------------------------------------------------


def test_op5_versions_and_terms_decide(spark):
    other = ["Licensed under the Apache License, Version 1.1", "Apache-1.1", "Licensed under the Mozilla Public License 1.1", "Released under MPL v1.1", "Released under the Artistic License 1.0", "This work is licensed under CC BY-NC-SA 4.0", "Available under the CC BY-ND 3.0 license", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"]
    own = [("Licensed under the Apache License, Version 2.0", "Apache-2.0"), ("Tool version 1.1, licensed under the Apache License, Version 2.0", "Apache-2.0"), ("Licensed under the Mozilla Public License 2.0", "MPL-2.0"), ("Released under the Artistic License 2.0", "Artistic-2.0"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA"), ("Licensed under CC BY 4.0", "CC-BY"), ("Licensed under the GNU General Public License version 2", "GPL")]
    docs = spark.createDataFrame([(k, t, "c", 1.0) for k, t in enumerate([*other, *(t for t, _ in own)])], "doc_id long, text string, family string, probability double").drop("probability")
    got = [r["family"] for r in op5_licence.scan_licences(docs).orderBy("doc_id").collect()]
    assert got == ["none"] * len(other) + [f for _, f in own]


# -- 3 -------------------------------------------------------------------------


def test_op3_threshold_and_kept_by_every_cut(spark):
    """The threshold against the balanced accuracy of every cut; rows at it and repeated rows are kept or not by their score."""
    from lodestone.llm import op3_quality

    rng = random.Random(9)
    rows = [(k / 400 - 0.3 + rng.random() * 0.4, int(rng.random() < k / 200), rng.random() < 0.1) for k in range(200)] + [(50.0, 1, False), (-50.0, 0, False)] * 2
    df = spark.createDataFrame(rows, "score double, quality int, base_failed boolean")
    least = op3_quality.best_threshold(df, step=0.005)
    held = [(np.floor(np.clip(s, -10, 10) / 0.005), q) for s, q, failed in rows if not failed]
    good, bad = sum(q for _, q in held), sum(1 - q for _, q in held)
    worth = lambda b: sum(q for s, q in held if s >= b) / good + sum(1 - q for s, q in held if s < b) / bad
    best = max(worth(b) for b in range(-2001, 2003))
    assert worth(round(least / 0.005)) == pytest.approx(best)
    docs = [(k, " ".join(rng.choices(["good", "fine", "well"] if k % 3 else ["bad", "junk", "spam"], k=40)) + f" w{k}" * (k % 2)) for k in range(60)]
    docs += docs[:5] + [(60, None), (61, "")]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(40)], "doc_id long, quality int, toxic int")
    got = op3_quality.quality(spark.createDataFrame([(k, t, 1, "c") for k, t in docs], "doc_id long, text string, score int, kept string"), labels).collect()
    assert len(got) == len(docs) and all(r["kept"] == (not r["base_failed"] and r["score"] >= r["threshold"]) for r in got)
    assert {r["doc_id"] for r in got if r["score"] >= r["threshold"]} >= {k for k, _ in docs[:60] if k % 3}
    assert not {r["doc_id"] for r in got if r["score"] >= r["threshold"]} & {k for k, _ in docs[:40] if k % 3 == 0}
