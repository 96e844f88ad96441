"""Explicit schemas of the engine's tables, and the checks made before a write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _D, _TS = T.StringType(), T.IntegerType(), T.DateType(), T.TimestampType()


def _table(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


CONCEPT = _table(("id", _S), ("type", _S), ("title", _S), ("description", _S), ("body", _S), ("language", _S), ("tags", T.ArrayType(_S)), ("source_uri", _S), ("content_sha", _S), ("first_epoch", _I), ("last_epoch", _I), ("updated_at", _TS), ("intent_terms", _S), ("domain", _S), ("norm_ref", _S))
EMBEDDING = _table(("id", _S), ("epoch", _I), ("embed_model", _S), ("dim", _I), ("vec", T.ArrayType(T.FloatType())))
EPOCH = _table(("n", _I), ("created_at", _TS), ("commit", _S))
FACT = _table(("id", _S), ("epoch", _I), ("type", _S), ("content_sha", _S), ("valid_from", _TS), ("valid_to", _TS), ("tx_from", _TS), ("tx_to", _TS))
EDGE = _table(("src", _S), ("dst", _S), ("kind", _S))
PARTICIPANT = _table(("ispb", _S), ("name", _S), ("legal_name", _S), ("cnpj", _S), ("bank_code", _S), ("authorized", T.BooleanType()), ("started", _D), ("canonical_synced", _TS), ("secondary_synced", _TS))
SERIES_POINT = _table(("series_code", _S), ("point_date", _D), ("value", _S), ("fetched_at", _TS))


class ConstraintError(ValueError):
    """A write that would break a key or another constraint."""


def empty(spark, schema: T.StructType) -> DataFrame:
    """No rows of a schema, known as such when a query is planned: a join with it moves nothing."""
    return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` if no two rows share the keys, else ConstraintError naming one."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ConstraintError(f"more than one row for {', '.join(f'{k}={twice[0][k]!r}' for k in keys)}")
    return df


def guard_dim(df: DataFrame, column: str = "vec", dim: int | None = None) -> DataFrame:
    """``df`` if all vectors have one width (``dim``, if given), else ConstraintError."""
    widths = [r[0] for r in df.select(F.size(column).alias("w")).distinct().limit(2).collect()]
    if len(widths) > 1 or dim is not None and widths not in ([], [dim]):
        raise ConstraintError(f"vectors of widths {widths}, wanted {dim or 'one'}")
    return df


def overlapping_versions(facts: DataFrame) -> DataFrame:
    """Facts whose transaction time overlaps the version before, per id; empty if the history is sound."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("id").orderBy("tx_from", "epoch")
    last = F.lag(F.coalesce("tx_to", F.lit("9999-12-31").cast("timestamp"))).over(w)
    return facts.withColumn("_end", last).where(F.col("_end") > F.col("tx_from")).drop("_end")


def check_edges(edges: DataFrame) -> DataFrame:
    """``edges`` if no citation is given twice."""
    require_unique(edges.where("kind = 'cites'"), "src", "dst", "kind")
    return edges
