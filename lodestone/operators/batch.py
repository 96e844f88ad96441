"""Ranked retrieval of many questions in one plan: hybrid, multi-query, similar rows, grounding, and measures over cases.

Every function takes its questions, seeds or cases as rows and gives hits keyed by
them, so that a table of cases is one job. Texts are read once, as postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import first_bytes, title_boost, type_weight
from .retrieval import ADJACENT, FLOOR, HYBRID_K, MULTI_K, OFFICIAL, SIMILAR_K, VOCABULARY, diversify, expand_question, hash_vectors, neighbours, within_budget
from .search import first_of, lexical_many, nearest_many

#: Hits that a subquery is asked for at least, hits of a grounding, its bytes, and bytes of a seed's body in its question.
SUBQUERY_HITS, GROUNDING_HITS, GROUNDING_BYTES, EXCERPT = 20, 6, 8000, 500
#: Ids that are sent to all tasks at most, to pick their texts where these are.
IDS_SENT = 1_000_000


class Embedder(Protocol):
    """What turns texts into vectors: a name and width for the tables, and a column of vectors."""

    name: str
    dim: int

    def vectors(self, text: Column) -> Column: ...


class HashEmbedder:
    """Hashed trigram counts at unit length."""

    def __init__(self, dim: int = 256):
        self.name, self.dim = "hashing", dim

    def vectors(self, text: Column) -> Column:
        return hash_vectors(text, self.dim)


# -- hybrid ------------------------------------------------------------------


def hybrid_many(df: DataFrame, posted: DataFrame, latest: DataFrame, questions: DataFrame, limit: int = 20) -> DataFrame:
    """Hits of questions (q, question, vec): both arms to the limit, the vector arm above its floor, fused, boosted, ranked.

    (q, id, type, title, official, rrf, title_boost, type_weight, official_boost, arm, score, rank).
    """
    questions = questions.select("q", "question", "vec").localCheckpoint()  # the rows that they come from are read once
    words = lexical_many(posted, questions, limit).select("q", "id", "rank", F.lit(0).alias("arm_no"))
    near = nearest_many(latest, questions, limit).where(F.col("score") >= FLOOR).select("q", "id", "rank", F.lit(1).alias("arm_no"))
    one = F.lit(1.0) / (HYBRID_K + F.col("rank") - 1)
    fused = words.unionByName(near).groupBy("q", "id").agg(F.sum(one).alias("rrf"), F.min(F.struct("arm_no", "rank")).alias("first_seen"), F.count("*").alias("arms"))
    info = df.select("id", "type", "title", F.coalesce(F.array_contains("tags", "trusted:official"), F.lit(False)).alias("official"))
    rows = info.join(fused, "id").join(questions.select("q", "question"), "q")
    title, kind, source = title_boost(F.col("question"), F.col("title")), type_weight(F.col("type")), F.when(F.col("official"), OFFICIAL).otherwise(1.0)
    label = F.when(F.col("arms") > 1, "both").when(F.col("first_seen.arm_no") == 0, "fts").otherwise("vector")
    rows = rows.select("q", "id", "type", "title", "official", "rrf", title.alias("title_boost"), kind.alias("type_weight"), source.alias("official_boost"), label.alias("arm"), "first_seen", (F.col("rrf") * kind * title * source).alias("score"))
    return first_of(rows, limit, F.desc("score"), F.col("first_seen"), F.col("id")).drop("first_seen")


def expanded(questions: DataFrame, vocabulary=VOCABULARY) -> DataFrame:
    """(q, sub_no, question): each question (q, question), its folded words, and the vocabulary's subqueries."""
    kind = questions.schema["q"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, sub) for k, text in enumerate(batch.column(1).to_pylist()) for n, sub in enumerate(expand_question(text or "", vocabulary))]
            at, no, sub = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(sub, pa.string())], ["q", "sub_no", "question"])

    return questions.select("q", "question").mapInArrow(run, f"q {kind.simpleString()}, sub_no int, question string")


def multi_many(df: DataFrame, posted: DataFrame, latest: DataFrame, questions: DataFrame, embedder: Embedder, limit: int = 20, vocabulary=VOCABULARY) -> DataFrame:
    """Hits of questions (q, question) by the hybrid search of each expansion, fused from rank 1.

    (q, id, type, title, score, provenance, rank); provenance has query, arm and rank of each
    subquery that found the row. Subqueries are asked for SUBQUERY_HITS at least.
    """
    subs = expanded(questions, vocabulary).select(F.struct("q", "sub_no").alias("q"), "question").localCheckpoint()
    texts = subs.groupBy("question").agg(F.min("q").alias("q")).select("q", "question")  # a text that many questions have is asked once
    texts = texts.withColumn("vec", embedder.vectors(F.col("question"))).localCheckpoint()
    hits = hybrid_many(df, posted, latest, texts, max(limit, SUBQUERY_HITS)).select(F.col("q").alias("asked"), "id", "type", "title", "arm", "rank")
    hits = hits.join(texts.select(F.col("q").alias("asked"), "question"), "asked").join(subs, "question").drop("asked")
    found = F.array_sort(F.collect_list(F.struct(F.col("q.sub_no").alias("sub_no"), "rank", "arm", F.col("question").alias("query"))))  # a row for each subquery
    fused = hits.groupBy(F.col("q.q").alias("q"), "id", "type", "title").agg(found.alias("found"))
    score = F.aggregate("found", F.lit(0.0), lambda s, x: s + F.lit(1.0) / (MULTI_K + x["rank"]))
    rows = fused.select("q", "id", "type", "title", score.alias("score"), F.transform("found", lambda x: F.struct(x.query.alias("query"), x.arm.alias("arm"), x["rank"].alias("rank"))).alias("provenance"), F.struct(F.col("found")[0]["sub_no"], F.col("found")[0]["rank"]).alias("seen"))
    return first_of(rows, limit, F.desc("score"), F.col("seen"), F.col("id")).drop("seen")


# -- similar rows ------------------------------------------------------------


def seed_questions(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """(q, question): a seed's own title, intent terms and the first bytes of its body, as a question."""
    intent = F.when(F.coalesce("intent_terms", F.lit("")) != "", F.col("intent_terms"))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), intent, first_bytes(F.coalesce("body", F.lit("")), EXCERPT))
    return df.join(seeds.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("q"), text.alias("question"))


def _without_seed(hits: DataFrame, limit: int) -> DataFrame:
    """Hits (q, id, rank, why) without the seed itself, ranked again."""
    return first_of(hits.where("id <> q").withColumnRenamed("rank", "before"), limit, F.col("before")).select("q", "id", "rank", "why")


def signals_of(df: DataFrame, posted: DataFrame, latest: DataFrame, links: DataFrame, seeds: DataFrame, embedder: Embedder, limit: int = 10) -> dict[str, DataFrame]:
    """semantic, more-like-this and graph: hits (q, id, rank, why) of each seed (id), the seed left out before ranks are given."""
    asked = latest.join(seeds.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("q"), "vec")
    near = nearest_many(latest, asked, limit + 1).withColumn("why", F.array(F.lit("semantic")))
    questions = seed_questions(df, seeds)
    like = hybrid_many(df, posted, latest, questions.withColumn("vec", embedder.vectors(F.col("question"))), limit + 1)
    why = F.when(F.col("arm") == "both", F.array(F.lit("semantic"), F.lit("lexical"))).when(F.col("arm") == "vector", F.array(F.lit("semantic"))).otherwise(F.array(F.lit("lexical")))
    beside = neighbours(links, df, seeds).groupBy(F.col("seed").alias("q"), "id").agg(F.min("direction").alias("direction"))
    graph = first_of(beside.where("id <> q"), limit, F.col("direction"), F.col("id")).select("q", "id", "rank", F.array(F.lit("graph")).alias("why"))
    return {"semantic": _without_seed(near, limit), "more-like-this": _without_seed(like.withColumn("why", why), limit), "graph": graph}


def similar_many(df: DataFrame, posted: DataFrame, latest: DataFrame, links: DataFrame, seeds: DataFrame, embedder: Embedder, limit: int = 10, modes: tuple[str, ...] = ("semantic", "more-like-this", "graph")) -> DataFrame:
    """(q, id, type, score, why, rank) of each seed (id): the signals of ``modes`` fused by reciprocal ranks from 1, in their order.

    why names the signals, and domain where the hit's type is adjacent to the seed's. Neighbours without a row of their own stay, with a blank type.
    """
    signals = signals_of(df, posted, latest, links, seeds, embedder, limit)
    all_ = None
    for n, mode in enumerate(modes):
        part = signals[mode].withColumn("list_no", F.lit(n))
        all_ = part if all_ is None else all_.unionByName(part)
    parts = F.array_sort(F.collect_list(F.struct("list_no", "rank", "why")))  # a row for each signal
    fused = all_.groupBy("q", "id").agg(parts.alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda s, x: s + F.lit(1.0) / (SIMILAR_K + x["rank"]))
    types = df.select("id", F.col("type"))
    rows = fused.select("q", "id", score.alias("score"), F.array_distinct(F.flatten("parts.why")).alias("why"), F.struct(F.col("parts")[0]["list_no"], F.col("parts")[0]["rank"]).alias("seen"))
    rows = rows.join(types, "id", "left").join(types.select(F.col("id").alias("q"), F.col("type").alias("own")), "q", "left")
    adjacent = F.lit(False)
    for kind, others in ADJACENT.items():
        adjacent = adjacent | ((F.col("own") == kind) & F.col("type").isin(*others))
    why = F.array_sort(F.when(F.coalesce(adjacent, F.lit(False)), F.array_append("why", F.lit("domain"))).otherwise(F.col("why")))
    return first_of(rows.select("q", "id", F.coalesce("type", F.lit("")).alias("type"), "score", why.alias("why"), "seen"), limit, F.desc("score"), F.col("seen"), F.col("id")).drop("seen")


# -- grounding ---------------------------------------------------------------


def grounding_many(df: DataFrame, hits: DataFrame, links: DataFrame | None = None, like: DataFrame | None = None, least: float = 0.0, diverse: bool = False, seeds: int = 1, budget: int = GROUNDING_BYTES) -> DataFrame:
    """Chunks (q, ord, id, title, type, body) of the hits (q, id, type, score, rank) of many questions.

    A question whose best hit is under ``least`` has none. Each type's first hit goes ahead
    if ``diverse``; the neighbours of the first ``seeds`` hits and the rows ``like`` the first one
    (q is its id) follow; an id counts once. Blank bodies and ids without a row are skipped, the first chunk
    always stays, and the first that goes over the budget of bytes ends the grounding.
    """
    if least > 0:
        hits = hits.join(hits.where((F.col("rank") == 1) & (F.col("score") >= least)).select("q"), "q", "left_semi")
    if diverse:
        hits = diversify(hits, "q")
    ids = hits.select("q", "id", F.struct(F.lit(0).alias("part"), F.col("rank").alias("seed"), F.lit("").alias("way"), F.lit("").alias("at")).alias("place"))
    if links is not None:
        first = hits.where(F.col("rank") <= seeds).select("q", F.col("id").alias("seed"), F.col("rank").alias("seed_rank"))
        beside = first.join(neighbours(links, df, first.select(F.col("seed").alias("id"))), "seed")
        ids = ids.unionByName(beside.select("q", "id", F.struct(F.lit(1).alias("part"), F.col("seed_rank").alias("seed"), F.col("direction").alias("way"), F.col("id").alias("at")).alias("place")))
    if like is not None:
        best = hits.where("rank = 1").select("q", F.col("id").alias("best"))
        near = best.join(like.select(F.col("q").alias("best"), F.col("id").alias("near"), F.col("rank").alias("near_rank")), "best")
        ids = ids.unionByName(near.select("q", F.col("near").alias("id"), F.struct(F.lit(2).alias("part"), F.col("near_rank").alias("seed"), F.lit("").alias("way"), F.lit("").alias("at")).alias("place")))
    ids = ids.groupBy("q", "id").agg(F.min("place").alias("place")).localCheckpoint()
    asked = ids.select("id").distinct()
    body = F.btrim("body", F.lit(" \t\n\x0b\f\r"))
    texts = df.select("id", "title", "type", body.alias("body")).where("body <> ''")
    texts = texts.join(F.broadcast(asked) if asked.count() <= IDS_SENT else asked, "id", "left_semi")  # only the bodies of hits move
    rows = ids.join(texts, "id")
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy("place")).cast("long")).drop("place")
    return within_budget(rows, F.octet_length("body"), budget, "q").select("q", "ord", "id", "title", "type", "body")


# -- measures over cases -----------------------------------------------------


def coverage_many(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(q, found, total): how many of the ids that each case (q, id) wants are among its hits (q, id)."""
    asked = wanted.select("q", "id").distinct()
    found = hits.select("q", "id").distinct().withColumn("hit", F.lit(1))
    return asked.join(found, ["q", "id"], "left").groupBy("q").agg(F.count("hit").alias("found"), F.count("*").alias("total"))


def best_rank_many(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(q, rank): the best rank of the ids that each case (q, id) accepts; 0 where none was found."""
    found = hits.join(wanted.select("q", "id").distinct(), ["q", "id"], "left_semi").groupBy("q").agg(F.min("rank").alias("rank"))
    return wanted.select("q").distinct().join(found, "q", "left").select("q", F.coalesce("rank", F.lit(0)).alias("rank"))
