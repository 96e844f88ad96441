"""Documents to a training mix: five stages, each written and read again by whoever runs them.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of ``documents``, and other columns that
docs has. Empty tables give empty results; texts of any length are read whole; ties
go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op1_decontaminate, op2_substrings, op7_mixing, op8_langid, op10_simhash
from lodestone.llm.session import cut, fresh_name, read

#: A text is rejected if no language has this share of its words' posterior mass.
MIN_LANGUAGE_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only texts in one of the languages of the labelled rows stay. Null texts and texts without a letter go; with no labelled rows nothing stays."""
    return op8_langid.in_known_language(docs, op8_langid.train(docs), MIN_LANGUAGE_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays, that of the smallest id.

    Rows that share an id are told apart by their texts: each has its own
    fingerprint, and of two in one group the text of smaller hash stays; of rows
    alike in id and text any one does. Null texts are empty and linked like any other; rows
    without an id stay.
    """
    found = cut(op10_simhash.near_duplicates(docs))
    kept = found.where("id is not null").groupBy("root").agg(F.min(F.struct("id", "h")).alias("k")).select("k.*")
    kept = kept.unionByName(found.where("id is null").select("id", "h").distinct())
    key, h, again = (fresh_name(x, docs) for x in ("key", "h", "again"))
    kept = kept.select(F.col("id").alias(key), F.col("h").alias(h))
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept[key]) & (op10_simhash.text_hash(docs["text"]) == kept[h]), "left_semi")
    twice = cut(found.where("id is not null").groupBy("id", "h").count().where("count > 1").select(F.col("id").alias(key), F.col("h").alias(h)))
    if twice.isEmpty():
        return out.select(docs.columns)
    marked = out.join(twice.withColumn(again, F.lit(True)), (out["doc_id"] == twice[key]) & (op10_simhash.text_hash(out["text"]) == twice[h]), "left")
    once = marked.where(F.col(again)).dropDuplicates([key, h])
    return marked.where(F.col(again).isNull()).unionByName(once).select(docs.columns)


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a long that tells texts apart, and its name: the id, or for ids that several texts share, all but one of these, and rows without an id, a hash.

    The hashes are beyond 2**62, so such rows are later than the others. Rows alike in id and text have one key.
    """
    key, least, most = (fresh_name(x, docs) for x in ("key", "least", "most"))
    h = op10_simhash.text_hash(F.col("text"))
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", h), 2).bitwiseOR(F.lit(1 << 62))
    shared = cut(docs.groupBy(F.col("doc_id").alias(key)).agg(F.min(h).alias(least), F.max(h).alias(most)).where(F.col(key).isNull() | (F.col(least) != F.col(most))).drop(most))
    if shared.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    joined = docs.join(shared, docs["doc_id"].eqNullSafe(shared[key]), "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col(least).isNull() | (F.col(least) == h)), F.col("doc_id").cast("long")).otherwise(hashed)
    return joined.select(*docs.columns, own.alias(key)), key


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; texts of which nothing is left, null ones too, go.

    Texts that share an id are read as documents of their own.
    """
    keyed, key = with_key(docs)
    spans = cut(op2_substrings.repeated_spans(keyed, key))
    cut_out = op2_substrings.without_spans(keyed, spans, key)
    return cut_out.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, those that share their id only if they hold one too; with no items all stay."""
    keyed, key = with_key(docs)
    leaks = op1_decontaminate.find_leaks(keyed, read(spark, sf_dir, "benchmark", "item_id", "text"), key)
    return keyed.join(cut(leaks.select(key).distinct()), key, "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time a document is drawn into the mix; documents without words are never drawn."""
    return op7_mixing.mix(docs)


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("substring dedup", repeated_passages), ("benchmark decontamination", benchmark_leaks), ("mixing", mixture)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
