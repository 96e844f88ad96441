"""Result rows as text, JSON, Markdown or YAML, as one string column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render(df: DataFrame, form: str) -> DataFrame:
    """(line): one for each row of (rank, id, title, type, score). Raises ValueError for an unknown form."""
    score = F.format_string("%.4f", "score")
    forms: dict[str, Column] = {
        "text": F.format_string("%3d  %s  %s  [%s]  %s", F.col("rank").cast("int"), score, F.col("id"), F.col("type"), F.col("title")),
        "json": F.to_json(F.struct("rank", "id", "title", "type", "score")),
        "md": F.concat(F.lit("| "), F.concat_ws(" | ", F.col("rank").cast("string"), F.replace("title", F.lit("|"), F.lit("\\|")), "id", "type", score), F.lit(" |")),
        "yaml": F.concat(F.lit("- rank: "), F.col("rank").cast("string"), F.lit("\n  id: "), "id", F.lit("\n  title: "), F.to_json(F.struct(F.col("title").alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("title").alias("t")))) - 6), F.lit("\n  type: "), "type", F.lit("\n  score: "), score),
    }
    if form not in forms:
        raise ValueError(f"no form {form!r}; there are {', '.join(forms)}")
    return df.select(forms[form].alias("line"))
