"""Temperature mixing of sources to target weights, realised as block permutations.

A source's weight is its share of tokens to a power, normalised. The power is
bisected so that the weights have the wanted entropy, or so that no source is
repeated more often than allowed. Under a token budget a source's quota is then
met by whole passes over its documents and a part of one more pass; each pass
visits the source's blocks in another hashed order, and a block's documents in a
hashed order of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut, read

#: Part of the entropy of even weights to reach, and the most passes over a source.
ENTROPY_SHARE = 0.95
#: What the query aims at: more than the given tables' sources have of themselves, so that the power is found by bisection.
QUERY_ENTROPY = 0.999
#: Powers are sought up to here.
MAX_POWER = 8.0
MAX_REPEATS = 4.0
#: Tokens to draw, as a multiple of those there are.
BUDGET_FACTOR = 1.0
#: A source's documents fall into hashed blocks of about so many tokens, and into so many blocks at most.
TOKENS_PER_BLOCK, MAX_BLOCKS = 65_536, 65_536
#: Sources beyond this many are refused: their weights are solved on the driver.
MAX_SOURCES = 100_000


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def weights_at(shares: dict, power: float) -> dict:
    logs = {k: power * math.log(p) for k, p in shares.items()}
    top = max(logs.values())
    total = math.fsum(math.exp(v - top) for v in logs.values())
    return {k: math.exp(v - top) / total for k, v in logs.items()}


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def solve_power(tokens: dict, entropy_share: float | None = ENTROPY_SHARE, max_repeats: float | None = MAX_REPEATS, budget_factor: float = BUDGET_FACTOR, exact: bool = False) -> float:
    """The power that meets the wanted entropy, moved towards 1 as far as the repetition limit needs.

    Entropy falls as the power grows. Sources that have the wanted entropy or
    more stay as they are (power 1); with ``exact`` the power is sought up to
    MAX_POWER, and an entropy that no power reaches is refused. If the two aims
    disagree, the repetition limit wins. At power 1 every source is repeated
    ``budget_factor`` times; a limit below that is refused.
    """
    total = sum(tokens.values())
    if len(tokens) < 2 or not total:
        return 1.0
    shares = {k: v / total for k, v in tokens.items() if v > 0}
    if max_repeats is not None and max_repeats < budget_factor:
        raise ValueError("the budget repeats every source more often than allowed")

    def bisect(lo: float, hi: float, holds) -> float:
        """The power nearest to ``hi`` at which the aim, which holds at ``lo``, still holds."""
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return lo

    power = 1.0
    if entropy_share is not None:
        want = entropy_share * math.log(len(shares))
        enough = lambda a: entropy(weights_at(shares, a)) >= want
        if entropy(shares) < want:
            power = bisect(0.0, 1.0, enough)
        elif exact and entropy(shares) > want + 1e-12:
            if enough(MAX_POWER):
                raise ValueError(f"no power up to {MAX_POWER:g} brings the entropy down to {entropy_share:g} of that of even weights")
            power = bisect(1.0, MAX_POWER, enough)
    if max_repeats is not None:
        within = lambda a: max(w * budget_factor / shares[k] for k, w in weights_at(shares, a).items()) <= max_repeats
        if not within(power):
            power = bisect(1.0, power, within)
    return power


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy_share: float | None = ENTROPY_SHARE, max_repeats: float | None = MAX_REPEATS, budget_factor: float = BUDGET_FACTOR, seed: int = 42, exact: bool = False) -> DataFrame:
    """One row for each time a document is drawn: id, source, tokens, pass_no, block, weight, power, order_key.

    Null sources make a source of their own (null). Documents without words are
    never drawn. The last, partial pass takes blocks in their order, and within
    the block in which the quota ends documents in theirs, up to the one in
    which it is reached. Reading in the order of ``order_key`` interleaves the
    sources, so that every long stretch is near the target weights. Repeated rows are
    drawn as rows of their own; ties in hashed order go to the smaller id, then
    to the row. Empty tables give an empty result; texts of any length are counted
    whole. Other columns, whatever their names, are not read.
    """
    h = lambda *c: F.xxhash64(*c, F.lit(seed))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("tokens")).where("tokens > 0")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy("source").agg(F.sum("tokens").alias("n"))
    found = sizes.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError("more sources than weights can be solved for on the driver")
    tokens = {r["source"]: r["n"] for r in found}
    power = solve_power(tokens, entropy_share, max_repeats, budget_factor, exact)
    total = sum(tokens.values())
    weights = weights_at({k: v / total for k, v in tokens.items()}, power) if total else {}
    plan = [(k, n, min(MAX_BLOCKS, max(1, n // TOKENS_PER_BLOCK)), weights[k], int(round(weights[k] * total * budget_factor))) for k, n in sorted(tokens.items(), key=lambda x: (x[0] is not None, x[0]))]
    spark = docs.sparkSession
    targets = F.broadcast(spark.createDataFrame(plan, f"source {dict(rows.dtypes)['source']}, n long, blocks long, weight double, quota long"))  # at most MAX_SOURCES rows
    targets = targets.withColumn("whole", F.expr("quota div n")).withColumn("rest", F.expr("quota % n"))
    dealt = rows.join(targets, rows.source.eqNullSafe(targets.source)).drop(targets.source)
    dealt = dealt.withColumn("block", F.pmod(h(F.col("id").cast("string")), F.col("blocks")))
    # where each block of the partial pass begins: a source has few blocks, and only their sums meet
    block_order = h(F.col("block").cast("string"), F.col("whole").cast("string"))
    sums = dealt.groupBy("source", "block", "whole", "rest").agg(F.sum("tokens").alias("size"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy(block_order, "block").rowsBetween(Window.unboundedPreceding, -1))
    sums = cut(sums.select("source", "block", F.coalesce(before, F.lit(0)).alias("before"), "size"))
    dealt = dealt.join(sums.withColumnRenamed("source", "_s").withColumnRenamed("block", "_b"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    inner = Window.partitionBy("source", "block").orderBy(h(F.col("id").cast("string"), F.lit("in")), "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    cut_at = F.col("rest") - F.col("before")  # tokens of the block that the partial pass still takes
    ahead = F.coalesce(F.sum("tokens").over(inner), F.lit(0))
    dealt = dealt.withColumn("ahead", ahead).withColumn("drawn", (F.col("whole") + F.when(F.col("ahead") < cut_at, 1).otherwise(0)).cast("int"))
    drawn = dealt.where("drawn > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("drawn") - 1)).alias("pass_no"))
    spot = F.pmod(h(F.col("block").cast("string"), F.col("pass_no").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    key = (F.col("pass_no") + spot + F.col("ahead") / F.col("size") / F.col("blocks")) * F.col("n") / F.col("quota")
    return drawn.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "tokens", "pass_no", "block", "weight", F.lit(power).alias("power"), key.alias("order_key"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"), entropy_share=QUERY_ENTROPY)


QUERIES = {"op7_mixing": op7_mixing}
SQL: dict[str, str] = {}
