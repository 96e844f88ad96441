"""URL rules by a bit-parallel automaton: all glob rules run at once over each canonical URL.

A glob is a row of bits in a multiword mask, one for each number of its tokens
that have been read. A byte moves the bits on by one place where the next
token accepts it (Shift-And), and bits in front of a wildcard stay. The batch's
URLs take each step together. Rules are packed in the order in which they win, in
blocks of BLOCK_WORDS words, and a URL that has its winner leaves; so many rules
need more passes over what is left, not more memory. No rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import read
from .textkit import slabs

BLOCK_WORDS = 64
#: URLs that are simulated together.
TOGETHER = 4096
#: Rules of the query: a host with its subdomains, and the start of a path. Fixed values.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Globs for URLs that no rule fits: spam hosts, feeds' copies of a page, and pages of the main site.
GLOBS = (("block", "*casino**"), ("block", "*pills**"), ("block", "*spam-farm**"), ("block", "**\\?**utm_source=**"), ("block", "m.*/*/*.html"), ("allow", "www.*/de/???**"))
DEFAULT = "allow"
_ANY = np.ones(256, bool)
#: What ? and * do not match: the ends of a host, a part of a path, and a path.
_PART = _ANY.copy()
_PART[[ord(c) for c in "/?#"]] = False


def tokens(glob: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each token the bytes that it accepts, and for each number of tokens read the bytes that a wildcard there takes.

    ``*`` is any run without / ? #, ``**`` any run, ``?`` one byte that is none of those, and a
    backslash makes the next character plain.
    """
    accepts, loops = [], [~_ANY]
    rest = glob
    while rest:
        if rest[0] == "*":
            stars = len(rest) - len(rest.lstrip("*"))
            loops[-1] = loops[-1] | (_ANY if stars > 1 else _PART)
            rest = rest[stars:]
            continue
        if rest[0] == "?":
            found, rest = [_PART], rest[1:]
        else:
            plain = rest[1] if rest[0] == "\\" and len(rest) > 1 else rest[0]
            rest = rest[2:] if rest[0] == "\\" and len(rest) > 1 else rest[1:]
            found = [np.arange(256) == b for b in plain.encode()]
        accepts += found
        loops += [~_ANY] * len(found)
    return accepts, loops


class Masks:
    """Globs packed into ``words`` words of 64 bits: what each byte moves on, what stays, where all begin, and where each ends."""

    def __init__(self, globs: Sequence[str]):
        parsed = [tokens(g) for g in globs]
        size = np.array([len(loops) for _, loops in parsed])
        first = np.cumsum(size) - size
        bits = -(-int(size.sum()) // 64) * 64
        moves, stays = np.zeros((256, bits), bool), np.zeros((256, bits), bool)
        for at, (accepts, loops) in zip(first, parsed, strict=True):
            if accepts:
                moves[:, at + 1 : at + 1 + len(accepts)] = np.stack(accepts, 1)
            stays[:, at : at + len(loops)] = np.stack(loops, 1)
        start = np.zeros((1, bits), bool)
        start[0, first] = True
        self.moves, self.stays, self.start = (np.packbits(x, 1, "little").view("<u8") for x in (moves, stays, start))
        self.word, self.bit = np.divmod(first + size - 1, 64)

    def run(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each byte span, whether each glob fits all of it."""
        order = np.argsort(begin - end, kind="stable")
        begin, size = begin[order], (end - begin)[order]
        state = np.repeat(self.start, len(begin), 0)
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t))  # the longer ones stand first
            byte, now = data[begin[:live] + t], state[:live]
            on = now << np.uint64(1)
            on[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = on & self.moves[byte] | now & self.stays[byte]
        fits = np.empty((len(begin), len(self.word)), bool)
        fits[order] = (state[:, self.word] >> self.bit.astype(np.uint64)) & np.uint64(1) == 1
        return fits


def packed(globs: Sequence[str], words: int = BLOCK_WORDS) -> list[Masks]:
    """Masks of at most ``words`` words each (one longer glob has its own), in order."""
    out, block, bits = [], [], 0
    for g in globs:
        n = len(tokens(g)[1])
        if block and bits + n > 64 * words:
            out.append(Masks(block))
            block, bits = [], 0
        block.append(g)
        bits += n
    return [*out, Masks(block)] if block else out


def winners(masks: list[Masks], data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of the first glob that fits each span; -1 where none does."""
    won, base, left = np.full(len(begin), -1), 0, np.arange(len(begin))
    for m in masks:
        hit = np.empty(len(left), np.int64)
        for k in range(0, len(left), TOGETHER):
            part = left[k : k + TOGETHER]
            fits = m.run(data, begin[part], end[part])
            hit[k : k + TOGETHER] = np.where(fits.any(1), fits.argmax(1), -1)
        won[left[hit >= 0]] = hit[hit >= 0] + base
        left, base = left[hit < 0], base + len(m.word)
        if not len(left):
            break
    return won


def in_order(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """(verdict, text), the longest first; of equal lengths block before allow, then by text."""
    return sorted(set(rules), key=lambda r: (-len(r[1]), r[0] != "block", r[1]))


def rule_globs(rule: str) -> list[str]:
    """Globs of a host with a path's start: the host itself, and its subdomains."""
    plain = "".join("\\" + c if c in "*?\\" else c for c in rule)
    return [f"{plain}**", f"*.{plain}**"]


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, canonical URL): without scheme and fragment, A-Z in the host lower-cased; empty without a scheme."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path, F.concat(host, path, F.regexp_extract(rest, "^[^?#]*(\\?[^#]*)?", 1))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], globs: Sequence[tuple[str, str]], default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, pattern, verdict) for each row of ``pages``.

    A rule (verdict, ``host/path``) fits its host and all subdomains where the
    URL's path starts with the rule's path; the longest that fits wins, of equal
    ones block, then the smaller text. Where none fits, the longest glob (verdict,
    glob over host, path and query) decides, with the same ties; where none does, ``default``.
    Null URLs, and those without ``://``, have empty host and path. URLs of any
    length are read whole. Repeated rows give repeated results; an empty table gives an
    empty result; other columns are not read. The rules go with the task.
    """
    ruled, globbed = in_order(rules), in_order(globs)
    host, path, canonical = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), canonical.alias("canonical"))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = packed([g for _, r in ruled for g in rule_globs(r)]), packed([g for _, g in globbed])
        for batch in batches:
            by_rule, by_glob = [], []
            for slab in slabs(batch.column(3)):
                begin, end = slab.offsets[:-1], slab.offsets[1:]
                won = winners(first, slab.data, begin, end) // 2  # two globs a rule
                other = np.full(len(won), -1)
                other[won < 0] = winners(second, slab.data, begin[won < 0], end[won < 0])
                by_rule += won.tolist()
                by_glob += other.tolist()
            rule = [ruled[k][1] if k >= 0 else None for k in by_rule]
            glob = [globbed[k][1] if k >= 0 else None for k in by_glob]
            verdict = [ruled[a][0] if a >= 0 else globbed[b][0] if b >= 0 else default for a, b in zip(by_rule, by_glob, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.string()) for x in (rule, glob, verdict))], ["id", "host", "path", "rule", "pattern", "verdict"])

    return rows.mapInArrow(run, f"id {kind.simpleString()}, host string, path string, rule string, pattern string, verdict string")


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_urls(read(spark, sf_dir, "pages", "page_id", "url"), RULES, GLOBS)
    return found.withColumnRenamed("id", "page_id")


QUERIES = {"op12_urls": op12_urls}


def _regex(glob: str) -> str:
    """The glob as a regular expression, for the SQL."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] in "*?":
            out, k = out + ("[^/?#]*" if glob[k] == "*" else "[^/?#]"), k + 1
        else:
            k += glob[k] == "\\"
            out, k = out + ("[" + glob[k] + "]" if glob[k] in "?.*" else glob[k]), k + 1
    return f"^{out}$"


def _sql_case(rules, fits, value) -> str:
    return "CASE " + " ".join(f"WHEN {fits(r[1])} THEN {value(r)}" for r in rules) + " END"


def _fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}'))"


_MATCHES = lambda g: f"regexp_matches(host || path || query, '{_regex(g)}', 's')"
SQL = {
    "op12_urls": f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*([?][^#]*)?', 1) AS query FROM r),
w AS (SELECT *, {_sql_case(in_order(RULES), _fits, lambda r: f"'{r[1]}'")} AS rule, {_sql_case(in_order(GLOBS), _MATCHES, lambda r: f"'{r[1]}'")} AS any_glob FROM p),
g AS (SELECT *, CASE WHEN rule IS NULL THEN any_glob END AS pattern FROM w)
SELECT page_id, host, path, rule, pattern,
  coalesce({_sql_case(RULES, lambda r: f"rule = '{r}'", lambda r: f"'{r[0]}'")}, {_sql_case(GLOBS, lambda g: f"pattern = '{g}'", lambda r: f"'{r[0]}'")}, '{DEFAULT}') AS verdict
FROM g"""
}
