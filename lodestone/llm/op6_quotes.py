"""Quotation linking: quoted passages are traced to the message that first said them.

A line's quote level is the number of leading '>' (spaces between allowed). A
passage is a run of lines of one level without an empty line between, its lines
joined by a space, lower-cased, its white space single spaces; so a re-wrapped
quotation is the same passage. Passages, and their lines for quotations of a
part, are hashed with their conversation. The earliest message that has the
same text unquoted is the original of a quotation, and the earliest that has it
one level less deep the message it was quoted from. A message answers the one
that most of its passages were quoted from, level 1 before the inner levels, or
else the message before it. Pointer doubling over these parents gives each
message's thread root and depth; ordering by (conversation, root_turn, turn)
reads a conversation in reply order, without quotes.

All of it is DataFrame expressions; every join is on (conversation, piece) or
(conversation, turn), so no conversation is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut, read

MARKS = "^[ \\t]*(>[ \\t]*)+"
#: Shorter normalised lines (in characters) are not evidence of a quotation on their own; whole passages are, of any length.
MIN_CHARS = 8


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normal_line(line: Column) -> Column:
    """A line without quote marks, lower-cased, its white space single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), "\\s+", " "))


def without_quotes(text: Column) -> Column:
    """A text's unquoted lines, with runs of empty lines as one, trimmed of newlines."""
    kept = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(MARKS)), "\n")
    return F.regexp_replace(F.regexp_replace(kept, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def passages(text: Column) -> Column:
    """(level, lines): a text's passages; a text of n lines takes n steps."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(quote_level(x).alias("level"), normal_line(x).alias("line")))
    before = F.concat(F.array(F.lit(None).cast("struct<level:int,line:string>")), lines)

    def piece(x, last):
        goes_on = (x.level == last.level) & (x.line != "") & (last.line != "")
        return F.when(x.isNull(), "").when(goes_on, F.concat(F.lit("\t"), x.line)).otherwise(F.concat(F.lit("\n"), x.level.cast("string"), F.lit("\t"), x.line))

    runs = F.split(F.array_join(F.zip_with(lines, before, piece), ""), "\n")
    parts = F.transform(runs, lambda x: F.split(x, "\t"))
    return F.transform(F.filter(parts, lambda x: F.coalesce(F.get(x, F.lit(1)), F.lit("")) != ""), lambda x: F.struct(x[0].cast("int").alias("level"), F.slice(x, 2, F.size(x) - 1).alias("lines")))


def link_quotes(messages: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(conv_id, turn, level, passage_hash, origin, holder): quoted passages, the turn that first said them and the turn they were quoted from, or null.

    One row for each (message, level, passage). Both turns are earlier ones. The
    whole passage decides; where nobody had it, its lines do, the latest of
    their turns. Rows without conv_id or turn take no part.
    """
    found = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p"))
    whole = F.array_join(F.col("p.lines"), " ")
    digest = lambda x: F.md5(x.cast("binary"))
    parts = F.transform(F.filter(F.col("p.lines"), lambda x: F.length(x) >= min_chars), lambda x: F.struct(digest(x).alias("piece"), F.lit(False).alias("whole")))
    pieces = F.concat(F.array(F.struct(digest(whole).alias("piece"), F.lit(True).alias("whole"))), parts)
    hashed = found.select("conv_id", "turn", F.col("p.level").alias("level"), digest(whole).alias("passage_hash"), pieces.alias("pieces"))
    rows = hashed.select("conv_id", "turn", "level", "passage_hash", F.explode("pieces").alias("x")).select("conv_id", "turn", "level", "passage_hash", "x.piece", "x.whole")
    first = rows.groupBy("conv_id", "piece", "level").agg(F.min("turn").alias("first")).groupBy("conv_id", "piece").agg(F.map_from_entries(F.collect_list(F.struct("level", "first"))).alias("firsts"))
    quoted = rows.where("level > 0").distinct().join(first, ["conv_id", "piece"])
    earlier = lambda level: F.when(F.col("firsts")[level] < F.col("turn"), F.col("firsts")[level])
    seen = quoted.select("conv_id", "turn", "level", "passage_hash", "whole", earlier(F.lit(0)).alias("origin"), earlier(F.col("level") - 1).alias("holder"))
    best = lambda name: F.coalesce(F.max(F.when(F.col("whole"), F.col(name))), F.max(name)).alias(name)
    return seen.groupBy("conv_id", "turn", "level", "passage_hash").agg(best("origin"), best("holder"))


def reply_parents(messages: DataFrame, links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_quoted, n_linked) for each distinct (conv_id, turn).

    n_quoted counts all quoted passages, n_linked those with an original. Of
    several turns quoted from, the parent is the one with most level-1 passages, of equals
    the one with most of the inner levels, then the latest; without any it is
    turn - 1 if there is such a message.
    """
    votes = links.where("holder is not null").groupBy("conv_id", "turn", "holder").agg(F.count_if(F.col("level") == 1).alias("n"), F.count("*").alias("all"))
    chosen = votes.groupBy("conv_id", "turn").agg(F.max_by("holder", F.struct("n", "all", "holder")).alias("quoted_turn"))
    counts = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quoted"), F.count("origin").alias("n_linked"))
    keys = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = keys.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("last_turn"))
    out = keys.join(before, ["conv_id", "turn"], "left").join(chosen, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", F.coalesce("quoted_turn", "last_turn").alias("parent_turn"), F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))


def thread_roots(parents: DataFrame, rounds: int = 40) -> DataFrame:
    """(conv_id, turn, root_turn, depth) by pointer doubling: depth 2**k needs k rounds.

    Messages that point to a root are done; each round joins only the others,
    so a few deep threads do not carry all messages along.
    """
    rows = cut(parents.select("conv_id", "turn", F.coalesce("parent_turn", "turn").alias("up"), F.col("parent_turn").isNotNull().cast("long").alias("steps")))
    done, open_ = rows.where("steps = 0"), rows.where("steps > 0")
    for _ in range(rounds):
        top = done.unionByName(open_).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        moved = cut(open_.join(top, ["conv_id", "up"]).select("conv_id", "turn", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("steps2") == 0).alias("done")))
        done = done.unionByName(moved.where("done").drop("done"))
        open_ = moved.where("not done").drop("done")
        if open_.isEmpty():
            return done.select("conv_id", "turn", F.col("up").alias("root_turn"), F.col("steps").alias("depth"))
    raise RuntimeError("threads deeper than 2**rounds")


def conversations_in_reply_order(messages: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each message: conv_id, turn, role, clean_text, parent_turn, root_turn, depth, n_quoted, n_linked.

    Null text is empty. Messages without conv_id or turn keep their row, with
    null thread columns. Repeated messages share their thread columns and give
    repeated rows. Empty tables give an empty result. Other columns are not read.
    """
    slim = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    parents = cut(reply_parents(slim, link_quotes(slim, min_chars)))
    threads = parents.join(thread_roots(parents), ["conv_id", "turn"])
    clean = slim.select("conv_id", "turn", "role", without_quotes(F.col("text")).alias("clean_text"))
    return clean.join(threads, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "clean_text", "parent_turn", "root_turn", "depth", "n_quoted", "n_linked")


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_in_reply_order(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


QUERIES = {"op6_quotes": op6_quotes}
SQL = {
    "op6_quotes": f"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS msg FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT msg, conv_id, turn, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM m),
n AS (
  SELECT msg, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^[ \\t]*(>[ \\t]*)+'), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^[ \\t]*(>[ \\t]*)+', '')), '\\s+', ' ', 'g')) AS line FROM l),
e AS (
  SELECT *, CASE WHEN line <> '' AND lag(line) OVER w <> '' AND lag(level) OVER w = level THEN 0 ELSE 1 END AS starts FROM n
  WINDOW w AS (PARTITION BY msg ORDER BY i)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY msg ORDER BY i) AS run FROM e),
pa AS (
  SELECT conv_id, turn, level, string_agg(line, ' ' ORDER BY i) AS passage, list(line) AS lines FROM g WHERE line <> ''
  GROUP BY msg, conv_id, turn, level, run),
h AS (
  SELECT conv_id, turn, level, passage, passage AS piece, true AS whole FROM pa
  UNION SELECT conv_id, turn, level, passage, piece, false FROM (SELECT conv_id, turn, level, passage, unnest(lines) AS piece FROM pa) WHERE length(piece) >= {MIN_CHARS}),
f AS (SELECT conv_id, piece, level, min(turn) AS first FROM h GROUP BY ALL),
s AS (
  SELECT h.conv_id, h.turn, h.level, h.passage, h.whole, CASE WHEN o.first < h.turn THEN o.first END AS origin, CASE WHEN d.first < h.turn THEN d.first END AS holder
  FROM h LEFT JOIN f o ON o.conv_id = h.conv_id AND o.piece = h.piece AND o.level = 0
  LEFT JOIN f d ON d.conv_id = h.conv_id AND d.piece = h.piece AND d.level = h.level - 1 WHERE h.level > 0),
q AS (
  SELECT conv_id, turn, level, passage, coalesce(max(origin) FILTER (whole), max(origin)) AS origin, coalesce(max(holder) FILTER (whole), max(holder)) AS holder
  FROM s GROUP BY ALL),
v AS (SELECT conv_id, turn, holder, count(*) FILTER (level = 1) AS n, count(*) AS a FROM q WHERE holder IS NOT NULL GROUP BY ALL),
c AS (SELECT conv_id, turn, max({{'n': n, 'a': a, 'o': holder}}).o AS quoted_turn FROM v GROUP BY ALL),
k AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (
  SELECT k.conv_id, k.turn, coalesce(c.quoted_turn, b.turn) AS parent_turn, coalesce(t.n_quoted, 0) AS n_quoted, coalesce(t.n_linked, 0) AS n_linked
  FROM k LEFT JOIN k b ON b.conv_id = k.conv_id AND b.turn + 1 = k.turn
  LEFT JOIN c ON c.conv_id = k.conv_id AND c.turn = k.turn
  LEFT JOIN (SELECT conv_id, turn, count(*) AS n_quoted, count(origin) AS n_linked FROM q GROUP BY ALL) t ON t.conv_id = k.conv_id AND t.turn = k.turn),
walk AS (
  SELECT conv_id, turn, turn AS root_turn, 0::BIGINT AS depth FROM p WHERE parent_turn IS NULL
  UNION ALL
  SELECT p.conv_id, p.turn, walk.root_turn, walk.depth + 1 FROM p JOIN walk ON p.conv_id = walk.conv_id AND p.parent_turn = walk.turn)
SELECT m.conv_id, m.turn, m.role,
  regexp_replace(regexp_replace(array_to_string(list_filter(string_split(coalesce(m.text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^[ \\t]*(>[ \\t]*)+')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS clean_text,
  p.parent_turn, walk.root_turn, walk.depth, p.n_quoted, p.n_linked
FROM conversations m LEFT JOIN p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN walk ON walk.conv_id = m.conv_id AND walk.turn = m.turn""",
}
