"""Registered queries of search for many questions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import CONCEPT_SQL, EMBEDDING_SQL, concepts, table
from ..functions.text import ACCENTED, PLAIN, TITLE_STOP
from ..plans.registry import Registry
from .batch import HashEmbedder, best_rank_many, coverage_many, expanded, grounding_many, hybrid_many, multi_many, signals_of, similar_many
from .retrieval import ADJACENT, latest_vectors, select_vocabulary
from .search import asked_sql, hash_vectors_sql, lexical_hits, lexical_many_sql, postings, word_rows, words_sql

registry = Registry()
query = registry
#: Width of the given embeddings.
DIM = 64
#: Questions beside the documents' own titles: plain words, and branches with an excluded word.
ASKED = ((-1, "It was that"), (-2, "that or was -und"))
#: Subqueries by domain, as a vocabulary file has them.
DOMAINS = {"prose": [{"stems": ["that"], "subquery": "that from"}, {"stems": ["was"], "subquery": "was with"}, {"stems": ["que"], "subquery": "que las", "enabled": False}], "names": [{"stems": ["for", "with"], "subquery": "with this"}]}
_LATEST = f"{EMBEDDING_SQL}, latest AS (SELECT id, vec FROM emb WHERE epoch = 2)"
_STOP = ", ".join(f"'{w}'" for w in TITLE_STOP)


def titles(spark, d) -> DataFrame:
    """Titles of the documents whose id is divisible by 100, as questions; the stated query set."""
    rows = concepts(spark, d).where(F.substring("id", 11, 2) == "00")
    return rows.select(F.substring("id", 5, 8).cast("long").alias("q"), F.col("title").alias("question"))


def asked(spark, d) -> DataFrame:
    return titles(spark, d).unionByName(spark.createDataFrame(list(ASKED), "q long, question string"))


def seeds(spark, d) -> DataFrame:
    return concepts(spark, d).where(F.substring("id", 11, 2) == "00").select("id")


def part_links(spark, d) -> DataFrame:
    """Links between documents: from each part's number to its suppliers'."""
    doc = lambda c: F.format_string("doc/%08d.md", c)
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.select(doc("l_partkey").alias("src"), doc("l_suppkey").alias("dst"), F.lit("link").alias("kind"))


TITLES_SQL = "sq_title AS (SELECT substr(id, 5, 8)::BIGINT AS q, title AS question FROM concept WHERE substr(id, 11, 2) = '00')"
ASKED_SQL = TITLES_SQL + ", sq_all AS (SELECT * FROM sq_title UNION ALL SELECT q::BIGINT, question FROM (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in ASKED) + ") t(q, question))"
LINKS_SQL = "link AS (SELECT DISTINCT printf('doc/%08d.md', l_partkey) AS src, printf('doc/%08d.md', l_suppkey) AS dst FROM lineitem)"


def _folded(text: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(translate(lower({text}), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND w NOT IN ({_STOP}))"


def near_sql(limit: int, vectors: str = "sq_vec", name: str = "sq_near") -> str:
    return f"""{name} AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM (
  SELECT v.q, l.id, round(list_cosine_similarity(l.vec::DOUBLE[], v.vec::DOUBLE[]), 6) AS score FROM latest l CROSS JOIN {vectors} v) WHERE NOT isnan(score) QUALIFY rank <= {limit})"""


def hybrid_many_sql(limit: int) -> str:
    """Expressions up to sq_hybrid (q, id, type, title, arm, score, rank) of the questions sq_q."""
    return f"""{words_sql()}, {asked_sql()}, {lexical_many_sql(limit)}, {hash_vectors_sql('sq_q', DIM, 'sq_vec')}, {near_sql(limit)},
sq_arm AS (SELECT q, id, 0 AS arm, rank FROM sq_lex UNION ALL SELECT q, id, 1, rank FROM sq_near WHERE score >= 0.05),
sq_fuse AS (SELECT q, id, sum(1.0::DOUBLE / (60 + rank - 1)) AS rrf, min({{'a': arm, 'r': rank}}) AS first_seen, count(*) AS n, min(arm) AS arm FROM sq_arm GROUP BY q, id),
sq_fold AS (SELECT q, list_distinct({_folded('question')}) AS ws FROM sq_q),
sq_boost AS (SELECT f.q, c.id, c.type, c.title, first_seen, CASE WHEN n > 1 THEN 'both' WHEN f.arm = 0 THEN 'fts' ELSE 'vector' END AS arm,
  rrf * (CASE WHEN type IN ('ApiEndpoint', 'PacsMessage', 'CamtMessage') THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END)
    * (CASE WHEN len(ws) = 0 THEN 1.0::DOUBLE ELSE 1.0 + 0.5::DOUBLE * (len(list_intersect(ws, {_folded('title')})) / len(ws)) END)
    * (CASE WHEN list_contains(tags, 'trusted:official') THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END) AS score
  FROM sq_fuse f JOIN concept c USING (id) JOIN sq_fold USING (q)),
sq_hybrid AS (SELECT q, id, type, title, arm, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, first_seen, id) AS rank FROM sq_boost QUALIFY rank <= {limit})"""


def expanded_sql(questions: str, vocabulary, most: str = " QUALIFY sub_no < 5") -> str:
    """Expression sq_sub (q, sub_no, question); ``most`` is the cut of the queries whose vocabulary cannot reach it."""
    more = ", ".join(f"CASE WHEN len(list_filter(ws, lambda w: {' OR '.join(f"starts_with(w, '{s}')" for s in stems)})) > 0 THEN '{sub}' END" for stems, sub in vocabulary) or "NULL"
    return f"""sq_cand AS (SELECT q, list_concat([question], list_filter(list_concat([array_to_string(ws, ' ')], [{more}]), lambda x: x IS NOT NULL AND trim(x) <> '')) AS c FROM (SELECT q, question, {_folded('question')} AS ws FROM {questions})),
sq_each AS (SELECT q, unnest(c) AS question, unnest(range(len(c))) AS n FROM sq_cand),
sq_sub AS (SELECT q, question, row_number() OVER (PARTITION BY q ORDER BY n) - 1 AS sub_no FROM (SELECT * FROM sq_each QUALIFY row_number() OVER (PARTITION BY q, lower(trim(question)) ORDER BY n) = 1){most})"""


def multi_many_sql(questions: str, vocabulary, limit: int, most: str = "") -> str:
    """Expressions up to sq_multi (q, id, score, found, rank); up to eight subqueries of a question have numbers of their own."""
    return f"""{expanded_sql(questions, vocabulary, most)}, sq_q AS (SELECT q * 8 + sub_no AS q, question FROM sq_sub), {hybrid_many_sql(max(limit, 20))},
sq_tell AS (SELECT s.q, s.sub_no, h.id, h.rank FROM sq_hybrid h JOIN sq_sub s ON h.q = s.q * 8 + s.sub_no),
sq_sum AS (SELECT q, id, list_reduce(list(1.0::DOUBLE / (5 + rank) ORDER BY sub_no), lambda a, b: a + b, 0::DOUBLE) AS score, count(*) AS found, min({{'s': sub_no, 'r': rank}}) AS first_seen FROM sq_tell GROUP BY q, id),
sq_multi AS (SELECT q, id, score, found, row_number() OVER (PARTITION BY q ORDER BY score DESC, first_seen, id) AS rank FROM sq_sum QUALIFY rank <= {limit})"""


# -- grammar and index -------------------------------------------------------
_PHRASED = '"anea eriner" -was or "that with" or estorno'


@query("R01_query_grammar", f"WITH {CONCEPT_SQL}, w AS (SELECT id, ' ' || array_to_string(regexp_split_to_array(lower(title || ' ' || intent_terms || ' ' || body), '[^\\p{{L}}\\p{{Nd}}]+'), ' ') || ' ' AS t FROM concept) SELECT id FROM w WHERE contains(t, ' anea eriner ') AND NOT contains(t, ' was ') OR contains(t, ' that with ') OR contains(t, ' estorno ')")
def r01_grammar(spark, d):
    return lexical_hits(concepts(spark, d), _PHRASED, 1 << 30).select("id")


@query("R03_token_table", f"WITH {CONCEPT_SQL}, {words_sql()} SELECT stem, config, count(*) AS places, count(DISTINCT id) AS ids, sum(pos)::BIGINT AS sum_pos, round(sum(weight), 4) AS weight FROM sq_word GROUP BY stem, config")
def r03_table(spark, d):
    return postings(concepts(spark, d)).groupBy("stem", "config").agg(F.count("*").alias("places"), F.countDistinct("id").alias("ids"), F.sum("pos").alias("sum_pos"), F.round(F.sum("weight"), 4).alias("weight"))


# -- many questions ----------------------------------------------------------
_ENTRIES = select_vocabulary(DOMAINS)


@query("R08_expand_question", f"WITH t AS (SELECT item_id AS q, text AS question FROM benchmark), {expanded_sql('t', _ENTRIES)} SELECT q, sub_no, question FROM sq_sub")
def r08(spark, d):
    return expanded(table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question")), select_vocabulary(DOMAINS))


@query("R09_vocabulary_domain", f"WITH t AS (SELECT item_id AS q, text AS question FROM benchmark), {expanded_sql('t', select_vocabulary(DOMAINS, 'names'))} SELECT q, sub_no, question FROM sq_sub")
def r09(spark, d):
    return expanded(table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question")), select_vocabulary(DOMAINS, "names"))


@query("R10_multi_query", f"WITH {CONCEPT_SQL}, {_LATEST}, {ASKED_SQL}, {multi_many_sql('sq_all', _ENTRIES, 20)} SELECT q, id, round(score, 9) AS score, found, rank FROM sq_multi")
def r10(spark, d):
    c = concepts(spark, d)
    hits = multi_many(c, word_rows(c), latest_vectors(spark, d), asked(spark, d), HashEmbedder(DIM), vocabulary=_ENTRIES)
    return hits.select("q", "id", F.round("score", 9).alias("score"), F.size("provenance").cast("long").alias("found"), "rank")


@query("L08_subquery_limit", f"WITH {CONCEPT_SQL}, {_LATEST}, {ASKED_SQL}, {multi_many_sql('sq_all', _ENTRIES, 3)} SELECT q, id, found, rank FROM sq_multi")
def l08(spark, d):
    """Three hits of subqueries that were asked for twenty."""
    c = concepts(spark, d)
    return multi_many(c, word_rows(c), latest_vectors(spark, d), asked(spark, d), HashEmbedder(DIM), 3, _ENTRIES).select("q", "id", F.size("provenance").cast("long").alias("found"), "rank")


_LIKE = 10
_ADJACENT = " OR ".join(f"(o.type = '{k}' AND c.type IN ({', '.join(repr(x) for x in v)}))" for k, v in ADJACENT.items())
_HEAD = "CASE WHEN strlen(body) <= 500 THEN body ELSE (SELECT max(left(body, n)) FROM (SELECT unnest(range(120, 501)) AS n) WHERE strlen(left(body, n)) <= 500) END"
_SIMILAR_SQL = f"""{CONCEPT_SQL}, {_LATEST}, {LINKS_SQL},
seed AS (SELECT id FROM concept WHERE substr(id, 11, 2) = '00'),
sq_q AS (SELECT id AS q, title || CASE WHEN intent_terms <> '' THEN ' ' || intent_terms ELSE '' END || ' ' || {_HEAD} AS question FROM concept SEMI JOIN seed USING (id)),
{hybrid_many_sql(_LIKE + 1)},
own_vec AS (SELECT id AS q, vec FROM latest SEMI JOIN seed USING (id)), {near_sql(_LIKE + 1, 'own_vec', 'own_near')},
s0 AS (SELECT q, id, 0 AS list_no, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank, ['semantic'] AS why FROM own_near WHERE id <> q QUALIFY row_number() OVER (PARTITION BY q ORDER BY own_near.rank) <= {_LIKE}),
s1 AS (SELECT q, id, 1 AS list_no, row_number() OVER (PARTITION BY q ORDER BY h.rank) AS rank, CASE arm WHEN 'both' THEN ['semantic', 'lexical'] WHEN 'vector' THEN ['semantic'] ELSE ['lexical'] END AS why FROM sq_hybrid h WHERE id <> q QUALIFY row_number() OVER (PARTITION BY q ORDER BY h.rank) <= {_LIKE}),
beside AS (SELECT q, id, min(direction) AS direction FROM (SELECT src AS q, dst AS id, 'out' AS direction FROM link UNION SELECT dst, src, 'in' FROM link) WHERE q IN (SELECT id FROM seed) AND q <> id GROUP BY q, id),
s2 AS (SELECT q, id, 2 AS list_no, row_number() OVER (PARTITION BY q ORDER BY direction, id) AS rank, ['graph'] AS why FROM beside QUALIFY rank <= {_LIKE}),
every AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
fused AS (SELECT q, id, list_reduce(list(1.0::DOUBLE / (60 + rank) ORDER BY list_no), lambda a, b: a + b, 0::DOUBLE) AS score, min({{'l': list_no, 'r': rank}}) AS seen, list_distinct(flatten(list(why))) AS why FROM every GROUP BY q, id),
similar_ AS (
  SELECT f.q, f.id, coalesce(c.type, '') AS type, score, array_to_string(list_sort(CASE WHEN coalesce({_ADJACENT}, false) THEN list_append(why, 'domain') ELSE why END), ',') AS why, row_number() OVER (PARTITION BY f.q ORDER BY score DESC, seen, f.id) AS rank
  FROM fused f LEFT JOIN concept c ON c.id = f.id LEFT JOIN concept o ON o.id = f.q QUALIFY rank <= {_LIKE})"""


def _similar(spark, d) -> DataFrame:
    c = concepts(spark, d)
    return similar_many(c, word_rows(c), latest_vectors(spark, d), part_links(spark, d), seeds(spark, d), HashEmbedder(DIM), _LIKE)


@query("R11_similar_hybrid", f"WITH {_SIMILAR_SQL} SELECT q AS seed, id, type, round(score, 9) AS score, why, rank FROM similar_")
def r11(spark, d):
    return _similar(spark, d).select(F.col("q").alias("seed"), "id", "type", F.round("score", 9).alias("score"), F.array_join("why", ",").alias("why"), "rank")


@query("R11_more_like_this", f"WITH {_SIMILAR_SQL} SELECT q AS seed, id, array_to_string(list_sort(why), ',') AS why, rank FROM s1")
def r11_like(spark, d):
    c = concepts(spark, d)
    found = signals_of(c, word_rows(c), latest_vectors(spark, d), part_links(spark, d), seeds(spark, d), HashEmbedder(DIM), _LIKE)["more-like-this"]
    return found.select(F.col("q").alias("seed"), "id", F.array_join(F.array_sort("why"), ",").alias("why"), "rank")


_GROUND_SQL = f"""{CONCEPT_SQL}, {_LATEST}, {LINKS_SQL}, {ASKED_SQL}, sq_q AS (SELECT * FROM sq_all), {hybrid_many_sql(6)},
strong AS (SELECT * FROM sq_hybrid WHERE q IN (SELECT q FROM sq_hybrid WHERE rank = 1 AND score >= 0.02)),
again AS (SELECT *, CASE WHEN type = '' THEN false ELSE row_number() OVER (PARTITION BY q, type ORDER BY rank) > 1 END AS later FROM strong),
spread AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY later, rank) AS rank FROM again),
beside AS (SELECT DISTINCT s.q, s.rank, l.direction, l.id FROM spread s JOIN (SELECT src AS seed, dst AS id, 'out' AS direction FROM link UNION SELECT dst, src, 'in' FROM link) l ON l.seed = s.id WHERE s.rank <= 2),
ids AS (SELECT q, id, min({{'p': part, 'r': rank, 'd': direction, 'i': way}}) AS place FROM (SELECT q, id, 0 AS part, rank, '' AS direction, '' AS way FROM spread UNION ALL SELECT q, id, 1, rank, direction, id FROM beside) GROUP BY q, id),
chunk AS (SELECT q, id, type, strlen(b) AS size, row_number() OVER (PARTITION BY q ORDER BY place) AS ord FROM (SELECT i.q, i.place, c.id, c.type, regexp_replace(c.body, '^\\s+|\\s+$', '', 'g') AS b FROM ids i JOIN concept c USING (id)) WHERE b <> ''),
over_ AS (SELECT *, sum(size) OVER w > 8000 AND ord > 1 AS over FROM chunk WINDOW w AS (PARTITION BY q ORDER BY ord))"""


@query("R12_grounding", f"WITH {_GROUND_SQL} SELECT q, ord, id, type, size::BIGINT AS bytes FROM (SELECT *, max(over::INT) OVER (PARTITION BY q ORDER BY ord) AS cut FROM over_) WHERE cut = 0")
def r12(spark, d):
    c = concepts(spark, d)
    questions = asked(spark, d).withColumn("vec", HashEmbedder(DIM).vectors(F.col("question")))
    hits = hybrid_many(c, word_rows(c), latest_vectors(spark, d), questions, 6)
    chunks = grounding_many(c, hits, part_links(spark, d), least=0.02, diverse=True, seeds=2)
    return chunks.select("q", "ord", "id", "type", F.octet_length("body").cast("long").alias("bytes"))


# -- cases -------------------------------------------------------------------
_TWINS_SQL = "twin AS (SELECT substr(a.id, 5, 8)::BIGINT AS q, a.id AS seed, b.id FROM concept a JOIN concept b USING (content_sha) WHERE substr(a.id, 11, 2) = '00')"


def twins(spark, d) -> DataFrame:
    """(q, seed, id): the documents of the same content as each document of the query set."""
    c = concepts(spark, d).select("id", "content_sha")
    own = c.where(F.substring("id", 11, 2) == "00").select(F.substring("id", 5, 8).cast("long").alias("q"), F.col("id").alias("seed"), "content_sha")
    return own.join(c, "content_sha").select("q", "seed", "id")


@query("E04_multi_coverage", f"WITH {CONCEPT_SQL}, {_LATEST}, {TITLES_SQL}, {_TWINS_SQL}, {multi_many_sql('sq_title', (), 20, ' QUALIFY sub_no < 5')} SELECT q, count(m.id) AS found, count(*) AS total FROM twin t LEFT JOIN sq_multi m USING (q, id) GROUP BY q")
def e04(spark, d):
    c = concepts(spark, d)
    hits = multi_many(c, word_rows(c), latest_vectors(spark, d), titles(spark, d), HashEmbedder(DIM), vocabulary=())
    return coverage_many(hits, twins(spark, d))


@query("E05_similar_family", f"WITH {_SIMILAR_SQL}, want AS (SELECT src AS seed, dst AS id FROM link SEMI JOIN seed ON src = seed.id WHERE src <> dst) SELECT seed, coalesce(min(rank), 0) AS rank FROM want t LEFT JOIN similar_ s ON s.q = t.seed AND s.id = t.id GROUP BY seed")
def e05(spark, d):
    wanted = part_links(spark, d).join(seeds(spark, d).select(F.col("id").alias("src")), "src", "left_semi").where("src <> dst").select(F.col("src").alias("q"), F.col("dst").alias("id"))
    return best_rank_many(_similar(spark, d), wanted).select(F.col("q").alias("seed"), "rank")


QUERIES, SQL = registry.queries, registry.sql
