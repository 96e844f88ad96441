"""Ranked retrieval: lexical, vector, hybrid, multi-query, similarity, and grounding (R, G, A08-A16, W06, L07-L08)."""

from __future__ import annotations

import math
import os
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..adapters import CONCEPT_SQL, EDGE_SQL, EMBEDDING_SQL, NODE_SQL, concepts, edges, embeddings, nodes, table
from ..functions.text import ACCENTED, PLAIN, TITLE_STOP, citations, fold_tokens, markdown_links, matched_fields, title_boost, type_weight
from ..plans.registry import Registry
from .relational import latest_per_key, ranked, shared_term_peers
from .search import _TOK, hash_vectors_sql, lexical_hits, lexical_sql, tokens, words_sql

registry = Registry()
query = registry
#: Fusion constants, the vector arm's floor, and the boost of official sources.
HYBRID_K, MULTI_K, SIMILAR_K, FLOOR, OFFICIAL = 60, 5, 60, 0.05, 1.15
#: Texts that a Python worker holds as strings at once.
TEXTS_READ = 512
#: Stems that add a subquery to a question, in order, and whether they are in use.
VOCABULARY_ENTRIES = (
    (("estorn", "devolu", "refund"), "devolução pix refund", True),
    (("webhook", "notific", "avis"), "webhook notificação pix", True),
    (("chave", "dict", "evp"), "chave DICT pix", True),
    (("endpoint", "api"), "endpoint API", True),
    (("certific", "mtls", "icp"), "certificado mTLS ICP-Brasil", True),
    (("qr",), "QR Code Pix BR Code", True),
    (("liquida", "spi"), "liquidação SPI settlement", True),
    (("txid", "transac"), "consultar cobrança por txid", True),
    (("e2eid", "endtoend", "fim"), "pix e2eid endToEndId identificador fim a fim", True),
    (("pacs",), "pacs.008 customer credit transfer ordem de crédito", False),
    (("pacs",), "pacs.004 payment return devolução entre instituições", False),
    (("camt",), "camt.054 account notification extrato lançamento", False),
)
VOCABULARY = tuple((stems, subquery) for stems, subquery, in_use in VOCABULARY_ENTRIES if in_use)
#: Types that belong to the same subject.
ADJACENT = {"ApiEndpoint": ("PacsMessage", "CamtMessage", "Reference", "ManualSection"), "PacsMessage": ("ApiEndpoint", "CamtMessage"), "CamtMessage": ("ApiEndpoint", "PacsMessage"), "Reference": ("ApiEndpoint", "ManualSection"), "ManualSection": ("ApiEndpoint", "Reference")}


# -- arms ------------------------------------------------------------------


def lexical(df: DataFrame, question: str, limit: int = 20) -> DataFrame:
    """(id, type, title, score, rank): rows that the question finds, best first, ranked by cover density."""
    found = lexical_hits(df, question, limit)
    return df.select("id", "type", "title").join(F.broadcast(found), "id").select("id", "type", "title", "score", "rank")  # at most the limit


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector(latest: DataFrame, asked: list[float], limit: int = 20, least: float | None = None) -> DataFrame:
    """(id, score, rank): exact nearest rows by cosine. ``least`` cuts after the limit, and ranks are packed again."""
    q = F.array(*[F.lit(float(v)) for v in asked])
    norm = math.sqrt(sum(float(v) ** 2 for v in asked))
    dot = F.aggregate(F.zip_with("vec", q, lambda p, s: p.cast("double") * s), F.lit(0.0), lambda a, v: a + v)
    own = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    rows = latest.select("id", F.round(dot / (own * F.lit(norm)), 6).alias("score"))
    out = ranked(rows, limit, F.desc("score"), F.col("id"))
    return out if least is None else ranked(out.drop("rank").where((F.col("score") >= least) | F.isnan("score")), limit, F.desc("score"), F.col("id"))


def hash_rows(texts: list[str], dim: int = 256) -> np.ndarray:
    """For each text the counts of its lower-cased character trigrams, hashed by FNV-1a (32 bit) modulo ``dim``, at unit length.

    All trigrams of a text are hashed at once, byte by byte of their UTF-8.
    """
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts, strict=True):
        low = text.lower()
        point = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(point) < 3:
            continue
        if low.isascii():
            bytes_of = [(point, None)]
        else:
            size = 1 + (point > 0x7F).astype(int) + (point > 0x7FF) + (point > 0xFFFF)
            lead = np.choose(size - 1, [point, 0xC0 | point >> 6, 0xE0 | point >> 12, 0xF0 | point >> 18])
            bytes_of = [(lead, None)] + [(0x80 | point >> (6 * np.maximum(size - 1 - k, 0)).astype(np.uint32) & 0x3F, size > k) for k in (1, 2, 3)]
        n = len(point) - 2
        h = np.full(n, 2166136261, np.uint32)
        for k in range(3):
            for value, has in bytes_of:
                grown = (h ^ value[k : k + n].astype(np.uint32)) * np.uint32(16777619)
                h = grown if has is None else np.where(has[k : k + n], grown, h)
        row += np.bincount(h % dim, minlength=dim)
        row /= np.float32(np.sqrt((row.astype(np.float64) ** 2).sum()))
    return out


def hash_vector(text: str, dim: int = 256) -> np.ndarray:
    return hash_rows([text], dim)[0]


def hash_vectors(text: Column, dim: int = 256) -> Column:
    """Hashed trigram vectors of a text column, made in Arrow batches; null is as an empty text, whose vector is zero."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [hash_rows(texts.slice(k, TEXTS_READ).fill_null("").to_pylist(), dim) for k in range(0, len(texts), TEXTS_READ)]
        flat = np.concatenate(rows).ravel() if rows else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(flat))

    return run(text)


def embed(df: DataFrame, text: Column, dim: int = 256) -> DataFrame:
    """``df`` with the hashed trigram vector of a text column."""
    return df.withColumn("vec", hash_vectors(text, dim)).withColumn("dim", F.lit(dim))


# -- fusion ----------------------------------------------------------------


def fuse(arms: list[DataFrame], k: int, base: int) -> DataFrame:
    """(id, score, first_seen, arms): reciprocal ranks summed in the arms' order.

    Arms have (id, rank) with ranks from 1; ``base`` 0 counts them from 0.
    """
    all_ = reduce(DataFrame.unionAll, [a.select("id", F.lit(n).alias("arm"), F.col("rank")) for n, a in enumerate(arms)])
    parts = F.array_sort(F.collect_list(F.struct("arm", "rank")))
    one = lambda x: F.lit(1.0) / (F.lit(float(k)) + x.rank - (1 - base))
    out = all_.groupBy("id").agg(parts.alias("parts"), F.min(F.struct("arm", "rank")).alias("first_seen"))
    return out.select("id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + one(x)).alias("score"), "first_seen", F.col("parts.arm").alias("arms"))


def hybrid(df: DataFrame, latest: DataFrame, question: str, asked: list[float], limit: int = 20) -> DataFrame:
    """Both arms to the same limit, the vector arm above its floor, fused and boosted, with the parts of the score."""
    words, near = lexical(df, question, limit), vector(latest, asked, limit).where(F.col("score") >= FLOOR)
    fused = fuse([words, near], HYBRID_K, 0).withColumnRenamed("score", "rrf")
    info = df.select("id", "type", "title", F.coalesce(F.array_contains("tags", "trusted:official"), F.lit(False)).alias("official"))
    out = info.join(F.broadcast(fused), "id")  # at most twice the limit
    title, kind, source = title_boost(F.lit(question), F.col("title")), type_weight(F.col("type")), F.when(F.col("official"), OFFICIAL).otherwise(1.0)
    label = F.when(F.size("arms") > 1, "both").when(F.get("arms", F.lit(0)) == 0, "fts").otherwise("vector")
    out = out.select("id", "type", "title", "official", "rrf", title.alias("title_boost"), kind.alias("type_weight"), source.alias("official_boost"), label.alias("arm"), "first_seen", (F.col("rrf") * kind * title * source).alias("score"))
    return ranked(out, limit, F.desc("score"), F.col("first_seen"), F.col("id")).drop("first_seen")


def fold_words(text: str) -> list[str]:
    import re

    plain = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return [w for w in re.findall("[a-z0-9]+", plain) if len(w) > 1 and w not in TITLE_STOP]


def expand_question(question: str, vocabulary=VOCABULARY) -> list[str]:
    """The question, its folded words, and all subqueries whose stems begin one of them; each once."""
    words = fold_words(question)
    more = [] if os.environ.get("LODESTONE_NO_VOCABULARY") else [s for stems, s in vocabulary if any(w.startswith(stems) for w in words)]
    out = {question.lower().strip(): question}
    for q in [" ".join(words), *more]:
        if q.strip():
            out.setdefault(q.lower().strip(), q.strip())
    return list(out.values())


def select_vocabulary(domains: dict[str, list[dict]], domain: str | None = None) -> list[tuple]:
    """Enabled entries of one domain, or of all in the order of their names."""
    return [(tuple(e["stems"]), e["subquery"]) for name in sorted(domains) if domain in (None, name) for e in domains[name] if e.get("enabled", True)]


def multi(lists: list[tuple[str, DataFrame]], limit: int = 20) -> DataFrame:
    """(id, score, provenance, rank): hits of subqueries (id, rank, arm), fused from rank 1, with where each was found."""
    all_ = reduce(DataFrame.unionAll, [d.select("id", "rank", "arm", F.lit(n).alias("sub_no"), F.lit(q).alias("query")) for n, (q, d) in enumerate(lists)])
    found = all_.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sub_no", "query", "arm", "rank"))).alias("found"))
    score = F.aggregate("found", F.lit(0.0), lambda s, x: s + F.lit(1.0) / (MULTI_K + x["rank"]))
    out = found.select("id", score.alias("score"), F.transform("found", lambda x: F.struct(x.query.alias("query"), x.arm.alias("arm"), x["rank"].alias("rank"))).alias("provenance"), F.col("found")[0].alias("first_seen"))
    return ranked(out, limit, F.desc("score"), F.col("first_seen.sub_no"), F.col("first_seen.rank"), F.col("id")).drop("first_seen")


def similar(signals: dict[str, DataFrame], seed: str, seed_type: str, types: DataFrame, limit: int = 10) -> DataFrame:
    """(id, score, why, rank): signals (id, rank) of a seed fused from rank 1, the seed left out; why names the signals."""
    names = list(signals)
    kept = [ranked(d.where(F.col("id") != seed).drop("rank") if "score" in d.columns else d.where(F.col("id") != seed).withColumn("score", -F.col("rank").cast("double")).drop("rank"), limit, F.desc("score"), F.col("id")) for d in signals.values()]
    out = fuse(kept, SIMILAR_K, 1).join(types.select("id", "type"), "id")
    named = F.array_sort(F.array_distinct(F.transform("arms", lambda a: F.get(F.array(*map(F.lit, names)), a))))
    near = F.col("type").isin(*ADJACENT.get(seed_type, ())) if ADJACENT.get(seed_type) else F.lit(False)
    out = out.select("id", "type", "score", "first_seen", F.when(near, F.array_append(named, F.lit("domain"))).otherwise(named).alias("why"))
    return ranked(out, limit, F.desc("score"), F.col("first_seen"), F.col("id")).drop("first_seen")


# -- grounding -------------------------------------------------------------


def diversify(hits: DataFrame, *by: str) -> DataFrame:
    """``hits`` (rank, type) with each type's first hit ahead of the rest; hits without a type are never held back."""
    w = Window.partitionBy(*by, "type").orderBy("rank")
    again = F.when(F.coalesce("type", F.lit("")) == "", 0).otherwise((F.row_number().over(w) > 1).cast("int"))
    order = Window.partitionBy(*by).orderBy("_again", "rank") if by else Window.orderBy("_again", "rank")
    return hits.withColumn("_again", again).withColumn("rank", F.row_number().over(order).cast("long")).drop("_again")


def within_budget(chunks: DataFrame, size: Column, budget: int, *by: str, order: str = "ord") -> DataFrame:
    """Chunks in order up to the first that goes over the budget; the first always stays."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    over = (F.sum(size).over(w) > budget) & (F.row_number().over(w) > 1)
    return chunks.withColumn("_over", over.cast("int")).withColumn("_cut", F.max("_over").over(w)).where("_cut = 0").drop("_over", "_cut")


def grounding_text(chunks: DataFrame, *by: str) -> DataFrame:
    """Chunks (ord, id, title, body) as one fenced text; fence marks inside bodies are taken out."""
    clean = F.regexp_replace(F.col("body"), "<{3,}|>{3,}", "")
    one = F.concat(F.lit("<<<source "), "id", F.lit(" | "), "title", F.lit("\n"), clean, F.lit("\n>>>"))
    return chunks.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x.t), "\n\n").alias("grounding"))


def cited_in_context(answer: DataFrame, context: DataFrame) -> DataFrame:
    """Citations (ord, id) that are in the context, each once, in order."""
    return answer.join(context.select("id"), "id", "left_semi").groupBy("id").agg(F.min("ord").alias("ord"))


# -- graph -----------------------------------------------------------------


def neighbours(links: DataFrame, vertices: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, direction, id, kind, title, type) one step away, both ways; ends without a vertex stay, with blanks."""
    s = seeds.select(F.col("id").alias("seed")).distinct()
    out = links.join(s, links.src == s.seed).select("seed", F.lit("out").alias("direction"), F.col("dst").alias("id"), "kind")
    into = links.join(s, links.dst == s.seed).select("seed", F.lit("in").alias("direction"), F.col("src").alias("id"), "kind")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.union(into).distinct().join(vertices.select("id", "title", "type"), "id", "left").select("seed", "direction", "id", "kind", blank("title"), blank("type"))


def replace_edges(links: DataFrame, new: DataFrame) -> DataFrame:
    """All edges of the new edges' sources go, citations too, and the new ones come."""
    return links.join(new.select("src").distinct(), "src", "left_anti").select("src", "dst", "kind").unionByName(new.select("src", "dst", "kind"))


def add_edges(links: DataFrame, new: DataFrame) -> DataFrame:
    """New edges that are not there yet are added, each once."""
    fresh = new.select("src", "dst", "kind").distinct().join(links, ["src", "dst", "kind"], "left_anti")
    return links.select("src", "dst", "kind").unionByName(fresh)


def citation_edges(df: DataFrame) -> DataFrame:
    """(src, dst, norm_ref, kind) from rows that cite a norm to the row that is its text, without regard to the date."""
    base = lambda c: F.regexp_replace(c, "^([A-Z]+(?:-[A-Z]+)?-\\d+)-\\d{4}$", "$1")
    cited = df.select(F.col("id").alias("src"), F.explode(F.array_distinct(F.transform(citations(F.col("body")), base))).alias("norm_ref"))
    targets = df.where("norm_ref <> ''").select(base(F.col("norm_ref")).alias("norm_ref"), "id").groupBy("norm_ref").agg(F.max("id").alias("dst"))
    return cited.join(targets, "norm_ref").where("src <> dst").select("src", "dst", "norm_ref", F.lit("cites").alias("kind"))


def cross_link(df: DataFrame, terms: DataFrame, cap: int = 25, top: int = 6) -> DataFrame:
    """``df`` with a Related section of up to ``top`` peers by shared terms, and the body's hash made anew."""
    peers = shared_term_peers(terms, cap, top).join(df.select(F.col("id").alias("peer"), F.col("title").alias("peer_title")), "peer")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "peer", "peer_title"))), lambda x: F.concat(F.lit("- ["), x.peer_title, F.lit("]("), x.peer, F.lit(")"))), "\n")
    section = peers.groupBy("id").agg(lines.alias("_lines"))
    body = F.when(F.col("_lines").isNull(), F.col("body")).otherwise(F.concat("body", F.lit("\n\n## Related\n\n"), "_lines"))
    return df.join(section, "id", "left").withColumn("body", body).withColumn("content_sha", F.sha2("body", 256)).drop("_lines")


# -- queries ---------------------------------------------------------------
_COS = "list_cosine_similarity(vec::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
_LATEST = f"{EMBEDDING_SQL}, latest AS (SELECT id, vec FROM emb WHERE epoch = 2)"
def latest_vectors(spark, d) -> DataFrame:
    return latest_per_key(embeddings(spark, d).select("id", "epoch", "vec"), "id", "epoch")


def _first_vector(spark, d) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


@query("R01_all_words_recall", f"WITH {CONCEPT_SQL} SELECT id FROM (SELECT id, {_TOK.format("title || ' ' || intent_terms || ' ' || body")} AS t FROM concept) WHERE list_has_all(t, ['the', 'with', 'that'])")
def r01(spark, d):
    words = ["the", "with", "that"]
    rows = concepts(spark, d).select("id", tokens(F.col("title"), F.col("intent_terms"), F.col("body")).alias("t"))
    return rows.where(reduce(lambda a, b: a & b, [F.array_contains("t", w) for w in words])).select("id")


@query("R02_lexical_rank", f"WITH {CONCEPT_SQL}, {words_sql()}, {lexical_sql(['that', 'from'], 20)} SELECT id, score, rank FROM lex")
def r02(spark, d):
    return lexical(concepts(spark, d), "that from").select("id", "score", "rank")


@query("R03_indexed_words", f"WITH {CONCEPT_SQL} SELECT id, len({_TOK.format("title || ' ' || intent_terms || ' ' || body")})::BIGINT AS words FROM concept")
def r03(spark, d):
    return concepts(spark, d).select("id", F.size(tokens(F.col("title"), F.col("intent_terms"), F.col("body"))).cast("long").alias("words"))


@query("R04_vector_knn", f"WITH {_LATEST} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round({_COS}, 6) AS score FROM latest) QUALIFY rank <= 20")
def r04(spark, d):
    return vector(latest_vectors(spark, d), _first_vector(spark, d))


@query("P25_min_score_after_limit", f"WITH {_LATEST}, k AS (SELECT id, round({_COS}, 6) AS score FROM latest ORDER BY score DESC, id LIMIT 20) SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM k WHERE score >= 0.5")
def p25(spark, d):
    return vector(latest_vectors(spark, d), _first_vector(spark, d), least=0.5)


@query("P19_filter_before_rank", f"WITH {CONCEPT_SQL}, c AS (SELECT * FROM concept WHERE type = 'Reference' AND list_contains(tags, 'domain:en')), {words_sql('c')}, {lexical_sql(['was', 'with'], 10)} SELECT id, rank FROM lex")
def p19(spark, d):
    from ..plans.filterql import parse, predicate

    return lexical(concepts(spark, d).where(predicate(parse("type = Reference AND domain = en").where)), "was with", 10).select("id", "rank")


_HYBRID_SQL = f"""WITH {CONCEPT_SQL}, {_LATEST}, {words_sql()}, {lexical_sql(['that', 'from'], 20)},
near AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, score FROM (SELECT id, round({_COS}, 6) AS score FROM latest) QUALIFY rank <= 20),
arms AS (SELECT id, 0 AS arm, rank FROM lex UNION ALL SELECT id, 1, rank FROM near WHERE score >= 0.05),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank - 1)) AS rrf, min({{'a': arm, 'r': rank}}) AS first_seen, count(*) AS n, min(arm) AS arm FROM arms GROUP BY id),
s AS (SELECT c.id, CASE WHEN n > 1 THEN 'both' WHEN arm = 0 THEN 'fts' ELSE 'vector' END AS arm, rrf, first_seen,
  CASE WHEN type IN ('ApiEndpoint', 'PacsMessage', 'CamtMessage') THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS type_weight, CASE WHEN list_contains(tags, 'trusted:official') THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS official_boost,
  1 + 0.5::DOUBLE * len(list_intersect(['that', 'from'], string_split(trim(regexp_replace(translate(lower(title), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' ', 'g')), ' '))) / 2 AS title_boost
  FROM f JOIN concept c USING (id))"""


@query("R05_hybrid", _HYBRID_SQL + " SELECT id, round(rrf * type_weight * title_boost * official_boost, 9) AS score, row_number() OVER (ORDER BY rrf * type_weight * title_boost * official_boost DESC, first_seen, id) AS rank FROM s QUALIFY rank <= 20")
def r05(spark, d):
    return hybrid(concepts(spark, d), latest_vectors(spark, d), "that from", _first_vector(spark, d)).select("id", F.round("score", 9).alias("score"), "rank")


@query("R06_explain", _HYBRID_SQL + " SELECT id, round(rrf, 9) AS rrf, type_weight, title_boost, official_boost FROM s ORDER BY rrf * type_weight * title_boost * official_boost DESC, first_seen, id LIMIT 20")
def r06(spark, d):
    return hybrid(concepts(spark, d), latest_vectors(spark, d), "that from", _first_vector(spark, d)).select("id", F.round("rrf", 9).alias("rrf"), "type_weight", "title_boost", "official_boost")


@query("R07_arm_label", _HYBRID_SQL + " SELECT id, arm FROM s ORDER BY rrf * type_weight * title_boost * official_boost DESC, first_seen, id LIMIT 20")
def r07(spark, d):
    return hybrid(concepts(spark, d), latest_vectors(spark, d), "that from", _first_vector(spark, d)).select("id", "arm")


@query("A08_reciprocal_rank_fusion", "WITH a AS (SELECT s_suppkey AS id, 0 AS arm, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier UNION ALL SELECT s_suppkey, 1, row_number() OVER (ORDER BY s_name DESC, s_suppkey) FROM supplier) SELECT id, round(sum(1.0::DOUBLE / (60 + rank - 1)), 12) AS score FROM a WHERE rank <= 50 GROUP BY id")
def a08(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal", "s_name")
    return fuse([ranked(s, 50, F.desc("s_acctbal"), F.col("id")), ranked(s, 50, F.desc("s_name"), F.col("id"))], HYBRID_K, 0).select("id", F.round("score", 12).alias("score"))


@query("A09_provenance_lists", "SELECT l_suppkey AS id, array_to_string(list(l_orderkey ORDER BY l_orderkey, l_linenumber), ',') AS found FROM lineitem WHERE l_quantity = 50 GROUP BY l_suppkey")
def a09(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity = 50")
    return li.groupBy(F.col("l_suppkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda x: x.l_orderkey.cast("string")), ",").alias("found"))


@query("A10_sorted_sets", "SELECT l_suppkey AS id, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS why FROM lineitem GROUP BY l_suppkey")
def a10(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("why"))


@query("A16_budget_prefix_sum", "WITH s AS (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS cum FROM conversations) SELECT conv_id, turn, cum::BIGINT AS cum FROM s")
def a16(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.octet_length("text")).over(w).alias("cum"))


@query("R13_budget_packing", "WITH s AS (SELECT conv_id, turn, sum(strlen(text)) OVER w > 800 AND row_number() OVER w > 1 AS over FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn FROM (SELECT conv_id, turn, max(over::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS cut FROM s) WHERE cut = 0")
def r13(spark, d):
    return within_budget(table(spark, d, "conversations"), F.octet_length("text"), 800, "conv_id", order="turn").select("conv_id", "turn")


@query("R14_grounding_text", "SELECT conv_id, array_to_string(list('<<<source ' || turn || ' | ' || role || chr(10) || regexp_replace(text, '<{3,}|>{3,}', '', 'g') || chr(10) || '>>>' ORDER BY turn), chr(10) || chr(10)) AS grounding FROM conversations GROUP BY conv_id")
def r14(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("turn").cast("string").alias("id"), F.col("role").alias("title"), F.col("text").alias("body"))
    return grounding_text(c, "conv_id")


@query("W06_first_of_type", "WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) > 1 AS again FROM conversations) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY again, turn) AS rank FROM s")
def w06(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("rank"), F.col("role").alias("type"))
    return diversify(c, "conv_id").select("conv_id", "turn", "rank")


@query("G01_neighbours", f"WITH {EDGE_SQL}, {NODE_SQL}, e AS (SELECT 'n1' AS seed, 'out' AS direction, dst AS id, kind FROM edge WHERE src = 'n1' UNION SELECT 'n1', 'in', src, kind FROM edge WHERE dst = 'n1') SELECT seed, direction, e.id, kind, coalesce(title, '') AS title, coalesce(type, '') AS type FROM e LEFT JOIN node USING (id)")
def g01(spark, d):
    return neighbours(edges(spark, d), nodes(spark, d), spark.createDataFrame([("n1",)], "id string"))


@query("G02_isolated", f"WITH {EDGE_SQL}, {NODE_SQL} SELECT type, count(*) AS n FROM node WHERE id NOT IN (SELECT src FROM edge) AND id NOT IN (SELECT dst FROM edge) GROUP BY type")
def g02(spark, d):
    from .relational import without_edges

    return without_edges(nodes(spark, d), edges(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@query("G03_edge_replace", f"WITH {EDGE_SQL} SELECT src, dst, kind FROM edge WHERE src NOT IN ('c7', 's1') UNION ALL SELECT * FROM (VALUES ('c7', 'n0', 'link'), ('s1', 'n2', 'link')) t")
def g03(spark, d):
    return replace_edges(edges(spark, d), spark.createDataFrame([("c7", "n0", "link"), ("s1", "n2", "link")], "src string, dst string, kind string"))


@query("G04_edge_insert", f"WITH {EDGE_SQL}, n AS (SELECT * FROM (VALUES ('n0', 'r9', 'link'), ('n0', 'r9', 'link'), ('c7', 's7', 'cites')) t(src, dst, kind)) SELECT src, dst, kind FROM edge UNION ALL SELECT DISTINCT src, dst, kind FROM n WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.src = n.src AND e.dst = n.dst AND e.kind = n.kind)")
def g04(spark, d):
    return add_edges(edges(spark, d), spark.createDataFrame([("n0", "r9", "link"), ("n0", "r9", "link"), ("c7", "s7", "cites")], "src string, dst string, kind string"))


@query("G07_seed_expansion", f"WITH {EDGE_SQL}, s AS (SELECT 'c' || c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 2) SELECT DISTINCT s.id AS seed, dst AS id FROM edge JOIN s ON src = s.id")
def g07(spark, d):
    seeds = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(2).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return neighbours(edges(spark, d), nodes(spark, d), seeds).where("direction = 'out'").select("seed", "id").distinct()


@query("F05_hash_embedding", f"WITH {CONCEPT_SQL}, t AS (SELECT id AS q, concat_ws(' ', title, intent_terms, body) AS question FROM concept), {hash_vectors_sql('t', 256, 'v')} SELECT q AS id, 256::INTEGER AS dim, vec FROM v")
def f05(spark, d):
    return embed(concepts(spark, d), F.concat_ws(" ", "title", "intent_terms", "body")).select("id", "dim", "vec")


@query("F04_matched_fields", f"WITH {CONCEPT_SQL} SELECT id, array_to_string(list_filter([CASE WHEN contains(lower(title), 'from') OR contains(lower(title), 'que') THEN 'title' END, CASE WHEN contains(lower(intent_terms), 'from') OR contains(lower(intent_terms), 'que') THEN 'intent_terms' END, CASE WHEN contains(lower(body), 'from') OR contains(lower(body), 'que') THEN 'body' END], lambda x: x IS NOT NULL), ',') AS fields FROM concept")
def f04(spark, d):
    return concepts(spark, d).select("id", F.array_join(matched_fields(F.lit("From que?"), title=F.col("title"), intent_terms=F.col("intent_terms"), body=F.col("body")), ",").alias("fields"))


def citing(spark, d) -> DataFrame:
    """Rows of which the even ones are norms, dated or not, and each odd one cites the norm before it and one that is not there."""
    k = F.substring("id", 5, 8).cast("long")
    ref = F.when(k % 2 == 0, F.concat(F.lit("RES-BCB-"), k.cast("string"), F.when(k % 4 == 0, "-2020").otherwise("")))
    text = F.when(k % 2 == 1, F.concat(F.lit("ver Resolução BCB nº "), (k - 1).cast("string"), F.when(k % 3 == 0, ", de 12 de agosto de 2021").otherwise(""), F.lit(" e a Circular nº 3.682")))
    return concepts(spark, d).select("id", F.concat_ws("\n", "title", text).alias("body"), ref.alias("norm_ref"))


_CITE_SQL = f"{CONCEPT_SQL}, k AS (SELECT id, substr(id, 5, 8)::BIGINT AS k FROM concept), cite AS (SELECT a.id AS src, b.id AS dst, 'RES-BCB-' || b.k AS norm_ref FROM k a JOIN k b ON b.k = a.k - 1 WHERE a.k % 2 = 1)"


@query("J10_citation_join", f"WITH {_CITE_SQL} SELECT src, dst, norm_ref, 'cites' AS kind FROM cite")
def j10(spark, d):
    return citation_edges(citing(spark, d))


@query("G06_citation_graph", f"WITH {_CITE_SQL} SELECT count(*) AS matched, count(*) FILTER (src NOT IN (SELECT id FROM concept WHERE type = 'LegalArticle')) AS new FROM cite")
def g06(spark, d):
    """Citations of rows of one type are in the graph already."""
    found = citation_edges(citing(spark, d)).select("src", "dst", "kind")
    held = found.join(concepts(spark, d).where("type = 'LegalArticle'").select(F.col("id").alias("src")), "src", "left_semi")
    fresh = found.join(held, ["src", "dst", "kind"], "left_anti")
    parts = found.select(F.lit(1).alias("m"), F.lit(0).alias("n")).unionAll(fresh.select(F.lit(0), F.lit(1)))
    return parts.agg(F.sum("m").alias("matched"), F.sum("n").alias("new"))


@query("G05_cross_links", """WITH t AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS term FROM lineitem), u AS (SELECT term FROM t GROUP BY term HAVING count(*) <= 25),
p AS (SELECT a.id, b.id AS peer, count(*) AS shared FROM t a JOIN t b USING (term) SEMI JOIN u USING (term) WHERE a.id <> b.id GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, peer) AS rank FROM p) WHERE rank <= 6)
SELECT t.id::VARCHAR AS id, sha256(t.id || coalesce(chr(10) || chr(10) || '## Related' || chr(10) || chr(10) || any_value(l), '')) AS content_sha FROM (SELECT DISTINCT id FROM t) t LEFT JOIN (SELECT id, array_to_string(list('- [' || peer || '](' || peer || ')' ORDER BY rank), chr(10)) AS l FROM r GROUP BY id) x USING (id) GROUP BY t.id""")
def g05(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("term")).distinct()
    peers = shared_term_peers(t)
    docs = t.select(F.col("id").cast("string").alias("id")).distinct().select("id", F.col("id").alias("title"), F.col("id").alias("body"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "peer"))), lambda x: F.concat(F.lit("- ["), x.peer.cast("string"), F.lit("]("), x.peer.cast("string"), F.lit(")"))), "\n")
    section = peers.groupBy(F.col("id").cast("string").alias("id")).agg(lines.alias("l"))
    return docs.join(section, "id", "left").select("id", F.sha2(F.concat("body", F.coalesce(F.concat(F.lit("\n\n## Related\n\n"), "l"), F.lit(""))), 256).alias("content_sha"))


__all__ = ["fold_tokens", "markdown_links"]
QUERIES, SQL = registry.queries, registry.sql
