"""Fill-in-the-middle by an index of distinct texts: line boundaries as Elias-Fano lists, joined back to the documents.

Texts are identical if SHA-256, a second 64-bit hash and the byte count agree. The
lists of a text are made when a task first meets it, and the shuffle keeps one
row for each distinct text, so the index holds no text. Documents meet the index
by those three values, in a join whose skewed partitions adaptive execution splits,
so a text that a third of all rows repeat is spread over tasks. A document's seed
then selects its two cuts from the lists, without a scan of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut, read
from .textkit import slabs

SENTINELS = ("<P>", "<S>", "<M>")
#: Share of texts that are cut, and of these, share with the suffix first; in percent.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7
#: So many distinct texts a task remembers to have sent; a forgotten one is sent again, and the shuffle drops it.
REMEMBERED = 1 << 16
KEY = ("digest", "check", "size")


def elias_fano(values: np.ndarray) -> bytes:
    """Ascending whole numbers: their count and number of low bits, then the low bits packed, then the high parts in unary."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    head = np.array([n, low], "<u4").tobytes()
    lows = (values[:, None] >> np.arange(low)) & 1
    highs = np.zeros((top >> low) + n + 1, np.uint8)
    highs[(values >> low) + np.arange(n)] = 1
    return head + np.packbits(lows.astype(np.uint8), bitorder="little").tobytes() + np.packbits(highs, bitorder="little").tobytes()


def select(packed: bytes, k: int) -> int:
    """The k-th number (from 0) of an Elias-Fano list: its low bits, and the place of the k-th one among the high ones."""
    n, low = (int(x) for x in np.frombuffer(packed, "<u4", 2))
    end = 8 + (n * low + 7) // 8
    bits = np.frombuffer(packed, np.uint8, end - 8, 8)
    at, value = k * low, 0
    for b in range(low):
        value |= int(bits[(at + b) >> 3] >> ((at + b) & 7) & 1) << b
    high = np.frombuffer(packed, np.uint8, -1, end)
    ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
    byte = int(np.searchsorted(ones, k, "right"))
    left = k - (int(ones[byte - 1]) if byte else 0)
    place = int(np.flatnonzero(np.unpackbits(high[byte : byte + 1], bitorder="little"))[left])
    return (8 * byte + place - k) << low | value


def boundaries(data: np.ndarray) -> tuple[int, bytes, bytes]:
    """Number of lines of a text's UTF-8 bytes, and the lines' ends as bytes and as code points."""
    ends = np.flatnonzero(data == 10) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    packed = elias_fano(ends)
    inner = (data & 0xC0) == 0x80
    if not inner.any():
        return len(ends), packed, packed
    return len(ends), packed, elias_fano(ends - np.cumsum(inner)[ends - 1])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumns({"digest": F.unhex(F.sha2("text", 256)), "check": F.xxhash64("text"), "size": F.octet_length("text").cast("long")})


def distinct_index(texts: DataFrame) -> DataFrame:
    """(digest, check, size, n, ends, points): a row for each distinct text of ``keyed`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            own = batch.column(0).to_pylist()
            new, made = [], []
            for slab in slabs(batch.column(3)):
                for k in range(slab.n):
                    if own[slab.lo + k] not in sent:
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(own[slab.lo + k])
                        new.append(slab.lo + k)
                        made.append(boundaries(slab.data[slab.offsets[k] : slab.offsets[k + 1]]))
            n, ends, points = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(new, pa.int64())) for c in range(3)), pa.array(n, pa.int64()), pa.array(ends, pa.binary()), pa.array(points, pa.binary())], [*KEY, "n", "ends", "points"])

    rows = texts.select(*KEY, "text").mapInArrow(run, "digest binary, check long, size long, n long, ends binary, points binary")
    return cut(rows.dropDuplicates([*KEY]))


def draw(seed: int, key) -> list[int]:
    """Four 32-bit numbers of a document: the first four groups of eight digits of the hash of ``seed:id``."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(id, n, form, output, prefix_chars, middle_chars) for each row of ``docs``.

    n is the number of lines. The cuts stand after two seeded numbers of lines.
    form is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain: the text
    as it is, for empty and null texts (null is empty), for those that hold a
    sentinel, and for those beyond ``rate``; it has no lengths. Rows without an id are
    drawn by the seed alone. Repeated rows give repeated results, texts of any
    length are read whole, an empty table gives an empty result, and other columns
    are not read. Raises if a sentinel is empty or part of another.
    """
    if any(not a or any(a in b for b in sentinels[:k] + sentinels[k + 1 :]) for k, a in enumerate(sentinels)):
        raise ValueError("sentinels must be told apart")
    texts = keyed(docs, id_col, text_col)
    joined = texts.join(distinct_index(texts).hint("shuffle_hash"), [*KEY]).select("id", "text", "n", "ends", "points")
    kind = texts.schema["id"].dataType
    marks = [x.encode() for x in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, n, ends, points in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1).cast(pa.binary()), *batch.columns[2:])), strict=True):
                a, b, c, d = draw(seed, key)
                if not text or c % 100 >= rate or any(m in text for m in marks):
                    out.append(("plain", text, None, None))
                    continue
                lo, hi = sorted((a % (n + 1), b % (n + 1)))
                at, to = (select(ends, k - 1) if k else 0 for k in (lo, hi))
                first, second = (select(points, k - 1) if k else 0 for k in (lo, hi))
                prefix, middle, suffix = marks[0] + text[:at], marks[2] + text[at:to], marks[1] + text[to:]
                spm = d % 100 < suffix_first
                out.append(("spm" if spm else "psm", b"".join([suffix, prefix, middle] if spm else [prefix, suffix, middle]), first, second - first))
            form, output, first, second = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(form, pa.string()), pa.array(output, pa.binary()).cast(pa.string()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["id", "n", "form", "output", "prefix_chars", "middle_chars"])

    return joined.mapInArrow(run, f"id {kind.simpleString()}, n long, form string, output string, prefix_chars long, middle_chars long")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of, read from the output and its form alone."""
    p, s, m = sentinels
    middle, head = F.substring_index(output, m, -1), F.substring_index(output, m, 1)
    after, between = lambda x: F.substring_index(head, x, -1), lambda x, y: F.substring_index(F.substring_index(head, y, 1), x, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, after(s))).when(form == "spm", F.concat(after(p), middle, between(s, p))).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {"op13_infill": op13_infill}
_HEAD = "CASE WHEN {0} = 0 THEN '' WHEN {0} < len(parts) THEN array_to_string(parts[1 : {0}], chr(10)) || chr(10) ELSE t END"
_P, _S, _M = SENTINELS
SQL = {
    "op13_infill": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS parts,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), i, 8))::UBIGINT::BIGINT) AS h
  FROM documents),
n AS (SELECT *, (len(parts) - (parts[-1] = '')::INT)::BIGINT AS n FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '{_P}') OR contains(t, '{_S}') OR contains(t, '{_M}') OR h[3] % 100 >= {RATE} THEN 'plain' WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM n),
x AS (SELECT *, {_HEAD.format('lo')} AS prefix, {_HEAD.format('hi')} AS head FROM c),
y AS (SELECT *, substr(head, length(prefix) + 1) AS middle, substr(t, length(head) + 1) AS suffix FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{_P}' || prefix || '{_S}' || suffix || '{_M}' || middle ELSE '{_S}' || suffix || '{_P}' || prefix || '{_M}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM y"""
}
