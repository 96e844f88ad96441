"""Merkle manifest of a table: a tree of digests for each group of rows, and one over the groups' roots.

Bottom-up build: rows are numbered inside their group by a range partitioning
(so a group of a third of all rows is spread over tasks), and each level joins
runs of ARITY neighbours into their parent; every level is persisted. Top-down
push: from the root, each persisted level is joined to the level above it, and each
child prepends its own siblings to the proof that its parent has inherited. No
node ever holds more than ARITY children, and a proof grows with the logarithm
of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut, fold_of, read

ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(column: Column) -> Column:
    """A key that is never null, and orders null before all texts and texts by their bytes."""
    return F.when(column.isNull(), "0").otherwise(F.concat(F.lit("1"), column.cast("string")))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with place (from 0) in their group by ``order``, and n, the group's size.

    Rows have a group that is never null. They are dealt by ranges of (group, order),
    counted for each range, and numbered inside the ranges.
    """
    dealt = cut(rows.repartitionByRange("group", *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("group", "part").agg(F.count("*").alias("own"))
    parts = Window.partitionBy("group").orderBy("part")  # a row for each range that a group touches
    before = F.coalesce(F.sum("own").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.select("group", "part", before.alias("before"), F.sum("own").over(Window.partitionBy("group")).alias("n")))
    inside = Window.partitionBy("group", "part").orderBy(*order)
    placed = dealt.withColumn("at", F.row_number().over(inside) - 1)
    return placed.join(counts, ["group", "part"]).withColumn("place", F.col("before") + F.col("at")).drop("part", "before", "at")


def build(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """Persisted levels (group, place, n, digest, children), the leaves (with n nodes in their group) first.

    A level has the parents of the groups that still had several nodes; the
    root of a group is the node with n = 1. A last run may be shorter, even one node.
    """
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = levels[-1].where("n > 1").groupBy("group", F.floor(F.col("place") / arity).alias("place"))
        run = runs.agg(F.ceil(F.max("n") / arity).alias("n"), F.array_sort(F.collect_list(F.struct((F.col("place") % arity).alias("at"), "digest"))).digest.alias("children"))
        levels.append(cut(run.select("group", "place", "n", F.sha2(F.array_join("children", ""), 256).alias("digest"), "children")))
        most = -(-most // arity)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(group, digest) of each group's root."""
    found = [level.where("n = 1").select("group", "digest") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def push(levels: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with their proofs, and what ``tops`` (group, proof, ...) has of their group.

    A proof is an array of (left, right), the siblings' digests on both sides
    of a node, from the leaf's own level up.
    """
    carried = [c for c in tops.columns if c not in ("group", "proof")]
    above = None
    for k in reversed(range(len(levels))):
        level = levels[k]
        now = level.where("n = 1").join(tops, "group")
        if above is not None:
            parents = above.select("group", F.col("place").alias("up"), F.col("children").alias("run"), F.col("proof").alias("inherited"), *carried)
            children = level.where("n > 1").withColumns({"up": F.floor(F.col("place") / arity), "at": (F.col("place") % arity).cast("int")}).join(parents, ["group", "up"])
            left, right = F.slice("run", F.lit(1), F.col("at")), F.slice("run", F.col("at") + 2, F.lit(arity))
            siblings = F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
            now = now.unionByName(children.withColumn("proof", F.concat(siblings, "inherited")).select(now.columns))
        above = cut(now.select("group", "place", "children", "proof", *carried)) if k else now
    return above


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, leaf, lambda x, s: sha(s.left, x, s.right))


def manifest(leaves: DataFrame, group: Column, *order: str) -> DataFrame:
    """Each row of ``leaves`` (digest, ...) with proof, subroot (its group's root) and root.

    Leaves ascend by ``order`` inside a group (nulls first; equal ones by their digest,
    and rows alike in both are alike in all that follows). Groups are ordered by their
    bytes, null first. A lone leaf is its group's root, a lone group's root is
    the root. An empty table gives an empty result.
    """
    own = [c for c in leaves.columns if c != "digest"]
    rows = cut(leaves.select(group_key(group).alias("group"), F.lit(None).cast("array<string>").alias("children"), "digest", F.struct(*order).alias("by"), F.struct(*own).alias("row"), F.monotonically_increasing_id().alias("seq")))
    levels = build(cut(numbered(rows, "by", "digest", "seq").drop("by", "seq")))
    top = roots(levels).select(F.lit("").alias("group"), F.lit(None).cast("array<string>").alias("children"), "digest", F.col("group").alias("key"))
    top_levels = build(cut(numbered(cut(top), "key")))
    ends = roots(top_levels).select("group", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
    tops = cut(push(top_levels, ends).select(F.col("key").alias("group"), "proof", F.col("digest").alias("subroot"), "root"))
    return push(levels, tops).select("row.*", "digest", "proof", "subroot", "root")


def row_digest(values: dict[str, Column]) -> Column:
    return sha(*[encoded(values[c]) for c in COLUMNS])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``, repeated ones too; nulls are ``-`` in a leaf, texts of any length are read whole."""
    docs = read(spark, sf_dir, "documents", *COLUMNS)
    values = {c: F.col(c) for c in COLUMNS}
    tampered = F.when(fold_of("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", row_digest(values).alias("digest"), row_digest(values | {"text": tampered}).alias("changed"))
    found = manifest(leaves, F.col("source"), "doc_id").withColumn("folded_root", fold(F.col("changed"), F.col("proof")))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s.left, s.right)), "")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op11_merkle": op11_merkle}
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in COLUMNS)
_RUNS = f"list_transform(range(0, len(nodes), {ARITY}), lambda i: sha256(array_to_string(nodes[i + 1 : i + {ARITY}], '')))"
# crc32 of the id's decimal text, bit by bit; proofs level by level from lists of each group's nodes
SQL = {
    "op11_merkle": f"""
WITH RECURSIVE b AS (
  SELECT *, xor(4294967295::UBIGINT, list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER, 1))::UBIGINT),
      lambda c, x: list_reduce(range(8)::UBIGINT[], lambda y, i: xor(y >> 1, 3988292384::UBIGINT * (y & 1)), xor(c, x)), 4294967295::UBIGINT)) AS crc
  FROM documents),
l AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS grp, sha256({_LEAF}) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256({_LEAF.replace(_FIELD.format("text"), _FIELD.format("replace(text, chr(10), '')"))}) ELSE sha256({_LEAF}) END AS changed
  FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
v AS (
  SELECT grp, 0 AS k, list(leaf ORDER BY place) AS nodes FROM p GROUP BY grp
  UNION ALL SELECT grp, k + 1, {_RUNS} FROM v WHERE len(nodes) > 1),
s AS (SELECT grp, nodes[1] AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place FROM v WHERE len(nodes) = 1),
t AS (
  SELECT 0 AS k, list(subroot ORDER BY place) AS nodes FROM s
  UNION ALL SELECT k + 1, {_RUNS} FROM t WHERE len(nodes) > 1),
steps AS (
  SELECT p.doc_id, p.grp, p.place, v.k, p.place // ({ARITY} ** v.k)::BIGINT AS pos, v.nodes FROM p JOIN v USING (grp) WHERE len(v.nodes) > 1
  UNION ALL SELECT p.doc_id, p.grp, p.place, 1000 + t.k, s.place // ({ARITY} ** t.k)::BIGINT, t.nodes FROM p JOIN s USING (grp), t WHERE len(t.nodes) > 1),
sides AS (
  SELECT grp, place, k, array_to_string(nodes[pos - pos % {ARITY} + 1 : pos], '') || '|' || array_to_string(nodes[pos + 2 : pos - pos % {ARITY} + {ARITY}], '') AS side FROM steps),
proofs AS (SELECT grp, place, list(side ORDER BY k) AS proof FROM sides GROUP BY grp, place),
f AS (
  SELECT p.*, s.subroot, (SELECT nodes[1] FROM t WHERE len(nodes) = 1) AS root, coalesce(proof, []) AS proof
  FROM p JOIN s USING (grp) LEFT JOIN proofs ON p.grp = proofs.grp AND p.place = proofs.place)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(proof, ''), '|', '')) AS proof_sha256,
  list_reduce(proof, lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2)), changed) AS folded_root, folded_root = root AS verified
FROM f"""
}
