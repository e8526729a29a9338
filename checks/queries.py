"""Every registered query: the Spark job, and where SQL can say it, the same in DuckDB."""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures, sql
from sentilake.config import CleanConfig, FeatureConfig, TrainConfig
from sentilake.functions import aspects, rules, text
from sentilake.functions import fixed_words as words
from sentilake.functions.lexicon import Lexicon, read_lexicon
from sentilake.operators import cleaning, edges, features, labels, metrics, models, pages, results, scoring, search, splitting
from sentilake.operators.checks import chunk_counts, classes_of, require_columns, require_rows
from sentilake.plans import jobs
from sentilake.session import shared_dir
from sentilake.sources import readers, versions, writers
from sentilake.streaming import streams

LEXICON = Lexicon()
DOC_CLEAN = CleanConfig(id_column="doc_id")
DOC_FEATURES = FeatureConfig(id_column="doc_id")
REVIEW_CLEAN = CleanConfig(id_column="review_id")
CLASSES = ("negative", "positive")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


QUERIES: dict[str, Query] = {}


def query(oracle: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = Query(run, oracle)
        return run

    return add


# ---- inputs --------------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return readers.spread(table(spark, sf, "documents"))


def fixture(spark: SparkSession, sf: str, select: str) -> DataFrame:
    """A fixture SELECT with its tables bound to the files of this run."""
    for name in ("orders", "documents", "labels"):
        source = table(spark, sf, name)
        if name in select:
            (readers.spread(source) if name != "labels" else source).createOrReplaceTempView(name)
    return spark.sql(select)


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, fixtures.REVIEWS)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_reviews(fixture(spark, sf, fixtures.CORPUS), DOC_CLEAN)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def naive_bayes(spark: SparkSession, sf: str) -> models.LinearTextModel:
    rows = corpus(spark, sf)
    return models.fit_naive_bayes(rows, features.fit_tfidf(rows, DOC_FEATURES), CLASSES)


def r6(column: str | Column, name: str | None = None):
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, 6).alias(name or column)


# ---- cleaning ------------------------------------------------------------------------------


@query(f"SELECT doc_id, array_to_string({sql.tokens('text')}, ' ') AS text_clean FROM documents")
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", text.clean_text(F.col("text")).alias("text_clean"))


@query(f"SELECT page_id, array_to_string({sql.tokens('html')}, ' ') AS text_clean FROM pages")
def clean_pages(spark, sf):
    return readers.spread(table(spark, sf, "pages")).select(
        "page_id", text.clean_text(F.col("html")).alias("text_clean")
    )


@query(f"""SELECT conv_id, turn, role, {sql.normal('text')} AS normal FROM conversations""")
def normal_text(spark, sf):
    return readers.spread(table(spark, sf, "conversations")).select(
        "conv_id", "turn", "role", text.normalize(F.col("text")).alias("normal")
    )


@query(f"""SELECT doc_id, CAST(pos - 1 AS INT) AS pos, toks[pos] AS token FROM (
  SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM (SELECT doc_id, {sql.tokens('text')} AS toks FROM documents))""")
def clean_tokens(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(text.clean_tokens(F.col("text"))).alias("pos", "token"))


@query(f"SELECT doc_id, CAST(len({sql.tokens('text')}) AS INT) AS token_count FROM documents")
def token_count(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(text.clean_tokens(F.col("text"))).alias("token_count"))


@query(f"""WITH r AS ({fixtures.REVIEWS})
SELECT review_id, coalesce(text, '') AS text, array_to_string({sql.tokens('text')}, ' ') AS text_clean
FROM r WHERE len({sql.tokens('text')}) > 0""")
def clean_reviews(spark, sf):
    return cleaning.clean_reviews(reviews(spark, sf), REVIEW_CLEAN)


@query(f"""WITH t AS (SELECT unnest(string_split({sql.normal('text')}, ' ')) AS token FROM documents)
SELECT token, count(*) AS n FROM t WHERE token <> '' AND token NOT IN (SELECT unnest({sql.quoted(words.STOP_WORDS)}))
GROUP BY token""")
def stop_words_removed(spark, sf):
    tokens = documents(spark, sf).select(F.explode(text.text_tokens(text.normalize(F.col("text")))).alias("token"))
    stop = spark.createDataFrame([(w,) for w in words.STOP_WORDS], "token string")
    return cleaning.remove_stop_words(tokens, stop).groupBy("token").agg(F.count("*").alias("n"))


# A lemma table that grows with the corpus: every word on -ing maps to its stem.
_LEMMAS_SQL = f"""SELECT DISTINCT token, left(token, length(token) - 3) AS lemma
FROM (SELECT unnest({sql.raw_tokens('text')}) AS token FROM documents) WHERE length(token) > 4 AND right(token, 3) = 'ing'"""


@query(f"""WITH lemmas AS ({_LEMMAS_SQL}),
raw AS (SELECT doc_id, {sql.raw_tokens('text')} AS toks FROM documents),
t AS (SELECT doc_id, pos, toks[pos] AS token FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM raw)),
j AS (SELECT doc_id, pos, coalesce(lemma, token) AS token FROM t LEFT JOIN lemmas USING (token))
SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text_clean FROM j WHERE length(token) >= 2 GROUP BY doc_id""")
def lemma_lookup(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    token = F.col("token")
    table_ = (
        docs.select(F.explode(text.raw_tokens(F.col("text"))).alias("token"))
        .distinct()
        .filter((F.length("token") > 4) & token.endswith("ing"))
        .select("token", F.substring(token, F.lit(1), F.length("token") - 3).alias("lemma"))
    )
    return cleaning.clean_reviews(docs, DOC_CLEAN, lemma_table=table_).select("doc_id", "text_clean")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def dedup_text(spark, sf):
    kept = cleaning.first_per_text(documents(spark, sf).select("doc_id", "text"), "text", "doc_id")
    return kept.select("doc_id", F.md5("text").alias("digest"))


@query(f"""WITH r AS ({fixtures.REVIEWS})
SELECT review_id, CASE WHEN {sql.blank('text')} THEN 'Input sentence cannot be empty.'
WHEN len({sql.tokens('text')}) = 0 THEN 'Sentence became empty after preprocessing. Provide richer text.' END AS error FROM r""")
def row_errors(spark, sf):
    raw = text.as_text(F.col("text"))
    return reviews(spark, sf).select("review_id", scoring.row_error(raw, text.clean_tokens(raw)).alias("error"))


@query(f"""SELECT count(*) AS rows_written FROM documents WHERE len({sql.tokens('text')}) > 0""")
def rows_written(spark, sf):
    """The last running total over the chunks of the cleaned table."""
    cleaned = cleaning.clean_reviews(documents(spark, sf).select("doc_id", "text"), DOC_CLEAN)
    return chunk_counts(cleaned).agg(F.max("total_rows").alias("rows_written"))


# ---- sources and sinks -----------------------------------------------------------------------


@query("SELECT doc_id, upper(lang) AS lang, source, md5(concat(text, ' good camera.')) AS digest FROM documents")
def latest_version(spark, sf):
    rows = fixture(spark, sf, fixtures.VERSIONS)
    return writers.latest_rows(rows).select("doc_id", "lang", "source", F.md5("text").alias("digest"))


def _publish(spark, sf, path: str, job: str, replace_existing: bool) -> None:
    rows = fixture(spark, sf, fixtures.VERSIONS)
    for version in (1, 2):
        part = rows.filter(F.col("version") == version).drop("version")
        versions.publish_version(part, path, version, job, sf, replace_existing)


@query("SELECT doc_id, upper(lang) AS lang, CAST(2 AS INT) AS version, 'replace' AS source_job FROM documents")
def publish_replace(spark, sf):
    path = fresh_path(spark, "replace")
    _publish(spark, sf, path, "replace", replace_existing=True)
    return versions.read_versions(spark, path).select("doc_id", "lang", "version", "source_job")


@query("""SELECT CAST(v.version AS INT) AS version, count(*) AS n, CAST(2 AS INT) AS newest
FROM documents, (VALUES (1), (2)) AS v(version) GROUP BY v.version""")
def publish_revisions(spark, sf):
    path = fresh_path(spark, "revisions")
    _publish(spark, sf, path, "keep", replace_existing=False)
    stored = versions.read_versions(spark, path)
    newest = versions.newest(spark, path).version
    return stored.groupBy("version").agg(F.count("*").alias("n")).withColumn("newest", F.lit(newest))


@query(f"""WITH r AS ({fixtures.REVIEWS})
SELECT CAST(review_id AS BIGINT) AS review_id, CAST(review_id AS DOUBLE) / 8 AS weight, review_id % 3 = 0 AS kept,
CASE WHEN review_id % 5 > 0 THEN review_id END AS sparse, 'n' || review_id AS code, array_to_string({sql.tokens('text')}, ' ') AS text_clean
FROM r WHERE len({sql.tokens('text')}) > 0""")
def csv_to_cleaned(spark, sf):
    """Raw CSV to cleaned Parquet; numbers and truth values keep their types."""
    raw_path, out = fresh_path(spark, "raw") + ".csv", fresh_path(spark, "cleaned")
    n = F.col("review_id")
    more = {"sentiment": F.lit("positive"), "weight": n / 8, "kept": n % 3 == 0, "sparse": F.when(n % 5 > 0, n), "code": F.concat(F.lit("n"), n)}
    reviews(spark, sf).withColumns(more).write.option("header", True).option("escape", '"').csv(raw_path)
    jobs.clean_csv(spark, raw_path, out, REVIEW_CLEAN)
    return readers.read_cleaned(spark, out).select("review_id", "weight", "kept", "sparse", "code", "text_clean")


_NEW_TEXT = "(text || ' good camera.')"


@query(f"""SELECT doc_id, array_to_string({sql.tokens(_NEW_TEXT)}, ' ') AS text_clean FROM documents""")
def publish_cleaned(spark, sf):
    """Newest raw version in, cleaned version out."""
    raw, out = fresh_path(spark, "raw"), fresh_path(spark, "published")
    _publish(spark, sf, raw, "upload", replace_existing=False)
    jobs.publish_cleaned(spark, raw, out, 1, DOC_CLEAN)
    return versions.read_latest(spark, out).select("doc_id", "text_clean")


@query("""SELECT CAST(v.version AS INT) AS version, d.doc_id, CASE WHEN v.version = 2 THEN upper(lang) ELSE lang END AS lang, CAST(2 AS INT) AS newest,
n AS rows_recorded FROM documents AS d, (VALUES (1), (2)) AS v(version), (SELECT count(*) AS n FROM documents)""")
def publish_twice(spark, sf):
    """A version published twice, another whose write fails: readers see the committed rows once, and no others."""
    path = fresh_path(spark, "twice")
    rows = fixture(spark, sf, fixtures.VERSIONS)
    parts = {v: rows.filter(F.col("version") == v).drop("version") for v in (1, 2)}
    versions.publish_version(parts[1].limit(1), path, 1, "job", sf, replace_existing=False)
    versions.publish_version(parts[1], path, 1, "job", sf, replace_existing=False)
    broken = parts[2].withColumn("lang", F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("broken"))).otherwise(F.col("lang")))
    try:
        versions.publish_version(broken, path, 3, "job", sf, replace_existing=True)
    except Exception as error:  # noqa: BLE001
        if "broken" not in str(error):
            raise
    versions.publish_version(parts[2], path, 2, "job", sf, replace_existing=False)
    recorded = spark.createDataFrame([(c.version, c.rows) for c in versions.commits(spark, path).values()], "version int, rows_recorded long")
    stored = versions.read_versions(spark, path).select("version", "doc_id", "lang")
    return stored.join(recorded, "version").withColumn("newest", F.lit(versions.newest(spark, path).version))


# ---- lexicon ---------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT doc_id, unnest({sql.tokens('text')}) AS word FROM documents)
SELECT word, CASE WHEN {sql.has(words.POSITIVE_CUES, 'word')} THEN 'positive' ELSE 'negative' END AS polarity,
  CASE WHEN {sql.has(words.POSITIVE_CUES, 'word')} THEN {sql.weight_case('word', words.POSITIVE_WEIGHTS)}
  ELSE {sql.weight_case('word', words.NEGATIVE_WEIGHTS)} END AS weight, count(*) AS n
FROM t WHERE {sql.has((*words.POSITIVE_CUES, *words.NEGATIVE_CUES), 'word')} GROUP BY word""")
def cue_hits(spark, sf):
    tokens = documents(spark, sf).select(F.explode(text.clean_tokens(F.col("text"))).alias("word"))
    return tokens.join(F.broadcast(LEXICON.cue_table(spark)), "word").groupBy("word", "polarity", "weight").agg(
        F.count("*").alias("n")
    )


@query(f"""WITH t AS (SELECT doc_id, {sql.tokens('text')} AS toks FROM documents),
s AS (SELECT doc_id, {sql.positive_sum('toks')} AS p, {sql.negative_sum('toks')} AS n FROM t)
SELECT doc_id, round(p, 6) AS positive_cues, round(n, 6) AS negative_cues,
  CASE WHEN n > p THEN 'negative' WHEN p > n THEN 'positive' ELSE 'undecided' END AS polarity FROM s""")
def lexicon_polarity(spark, sf):
    docs = documents(spark, sf).select("doc_id", text.clean_tokens(F.col("text")).alias("toks"))
    rule = docs.select("doc_id", rules.clause_rule(F.col("toks"), LEXICON).alias("r"))
    pos, neg = F.col("r.positive_cues"), F.col("r.negative_cues")
    verdict = F.when(neg > pos, "negative").when(pos > neg, "positive").otherwise("undecided")
    return rule.select("doc_id", r6(pos, "positive_cues"), r6(neg, "negative_cues"), verdict.alias("polarity"))


@query(f"""WITH t AS (SELECT doc_id, {sql.tokens('text')} AS toks FROM documents)
SELECT CASE WHEN n > p THEN 'negative' WHEN p > n THEN 'positive' ELSE 'undecided' END AS polarity, count(*) AS n_docs
FROM (SELECT {sql.positive_sum('toks')} AS p, {sql.negative_sum('toks')} AS n FROM t) GROUP BY 1""")
def polarity_counts(spark, sf):
    return lexicon_polarity(spark, sf).groupBy("polarity").agg(F.count("*").alias("n_docs"))


_GROUP_ROWS = ", ".join(
    f"({i}, '{w}', {len(g)})" for i, g in enumerate(words.FORCED_NEGATIVE_GROUPS) for w in g
)


@query(f"""WITH r AS ({fixtures.REVIEWS}), t AS (SELECT DISTINCT review_id, unnest({sql.tokens('text')}) AS word FROM r),
g(group_id, word, group_size) AS (VALUES {_GROUP_ROWS})
SELECT review_id, CAST(group_id AS INT) AS group_id FROM t JOIN g USING (word)
GROUP BY review_id, group_id, group_size HAVING count(DISTINCT word) = group_size""")
def forced_groups(spark, sf):
    """Relational division: word groups all of whose words occur in a review."""
    tokens = reviews(spark, sf).select("review_id", F.explode(F.array_distinct(text.clean_tokens(F.col("text")))).alias("word"))
    hits = tokens.join(F.broadcast(LEXICON.group_table(spark)), "word")
    counted = hits.groupBy("review_id", "group_id", "group_size").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") == F.col("group_size")).select("review_id", "group_id")


# ---- clauses and aspects ---------------------------------------------------------------------


@query(f"""SELECT doc_id, CAST(generate_subscripts({sql.clauses('text')}, 1) AS INT) AS clause_no,
md5(unnest({sql.clauses('text')})) AS digest FROM documents""")
def clauses(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.posexplode(text.split_clauses(F.col("text"))).alias("i", "clause"))
    return rows.select("doc_id", (F.col("i") + 1).alias("clause_no"), F.md5("clause").alias("digest"))


@query(f"""WITH r AS ({fixtures.REVIEWS}), {sql.unit_ctes('r', 'review_id')}
SELECT review_id, unit, evidence, array_to_string(toks, ' ') AS cleaned, feature FROM units""")
def aspect_names(spark, sf):
    units = aspects.clause_units(F.col("text"), REVIEW_CLEAN, LEXICON)
    return reviews(spark, sf).select("review_id", F.explode(units).alias("u")).select(
        "review_id", "u.unit", "u.evidence", F.array_join("u.tokens", " ").alias("cleaned"), "u.feature"
    )


@query(f"""WITH {sql.unit_ctes('documents', 'doc_id')} SELECT doc_id, unit, feature, md5(evidence) AS digest FROM units""")
def document_aspects(spark, sf):
    units = aspects.clause_units(F.col("text"), DOC_CLEAN, LEXICON)
    return documents(spark, sf).select("doc_id", F.explode(units).alias("u")).select(
        "doc_id", "u.unit", "u.feature", F.md5("u.evidence").alias("digest")
    )


_P = "CAST(review_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE)"


@query(f"""WITH r AS ({fixtures.REVIEWS}), {sql.unit_ctes('r', 'review_id')},
m AS (SELECT *, {_P} AS p, 1 - {_P} AS n, CASE WHEN {_P} > CAST(0.5 AS DOUBLE) THEN 'positive' ELSE 'negative' END AS label FROM units),
z AS (SELECT review_id, unit, {sql.ruled('label', 'p', 'n')} FROM m)
SELECT review_id, unit, sentiment, round(positive, 6) AS positive, round(negative, 6) AS negative FROM z""")
def clause_rules(spark, sf):
    units = aspects.clause_units(F.col("text"), REVIEW_CLEAN, LEXICON)
    rows = reviews(spark, sf).select("review_id", F.inline(units))
    p = F.col("review_id") % 101 / F.lit(100.0)
    rows = rows.withColumns({"p": p, "n": 1 - p, "label": F.when(p > 0.5, "positive").otherwise("negative")})
    done = rules.apply_clause_rule(F.col("rule"), F.col("label"), F.col("p"), F.col("n"), LEXICON)
    return rows.select("review_id", "unit", done.alias("d")).select(
        "review_id", "unit", "d.sentiment", r6("d.positive", "positive"), r6("d.negative", "negative")
    )


@query(f"""WITH r AS ({fixtures.REVIEWS}), {sql.unit_ctes('r', 'review_id')},
m AS (SELECT *, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS n, 'unsure' AS label FROM units),
z AS (SELECT review_id, unit, {sql.ruled('label', 'p', 'n')} FROM m)
SELECT review_id, unit, sentiment, round(positive, 6) AS positive, round(negative, 6) AS negative FROM z""")
def clause_rules_without_scores(spark, sf):
    units = aspects.clause_units(F.col("text"), REVIEW_CLEAN, LEXICON)
    none = F.lit(None).cast("double")
    rows = reviews(spark, sf).select("review_id", F.inline(units))
    done = rules.apply_clause_rule(F.col("rule"), F.lit("unsure"), none, none, LEXICON)
    return rows.select("review_id", "unit", done.alias("d")).select(
        "review_id", "unit", "d.sentiment", r6("d.positive", "positive"), r6("d.negative", "negative")
    )


@query(f"""WITH f AS ({fixtures.PREDICTIONS}),
m AS (SELECT *, 1 - p_positive AS q, ln((p_positive + 0.005) / (1.005 - p_positive)) AS margin,
  CASE WHEN p_positive > 0.5 THEN 'positive' ELSE 'negative' END AS said FROM f)
SELECT doc_id, {sql.overall('said', 'greatest(p_positive, q)', 'p_positive', 'q')} AS overall,
  CASE WHEN abs(2 / (1 + exp(-margin)) - 1) < CAST(1 AS DOUBLE) - CAST(0.6 AS DOUBLE) THEN 'neutral' ELSE said END AS margin_overall,
  round(1 / (1 + exp(-margin)), 6) AS margin_positive,
  CASE said WHEN 'positive' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label_positive FROM m""")
def overall_label(spark, sf):
    f = fixture(spark, sf, fixtures.PREDICTIONS)
    p, q = F.col("p_positive"), 1 - F.col("p_positive")
    said = F.when(p > 0.5, "positive").otherwise("negative")
    margin = F.log((p + 0.005) / (1.005 - p))
    up = rules.sigmoid(margin)
    none = F.lit(None).cast("double")
    return f.select(
        "doc_id",
        rules.overall_label(said, F.greatest(p, q), p, q, LEXICON).alias("overall"),
        rules.overall_label(said, none, up, 1 - up, LEXICON).alias("margin_overall"),
        r6(up, "margin_positive"),
        rules.label_scores(said)[0].alias("label_positive"),
    )


# ---- dependency edges --------------------------------------------------------------------------

_PAIRS_SQL = f"""WITH e AS ({fixtures.EDGES}),
nouns AS (SELECT * FROM e WHERE pos IN ('NOUN', 'PROPN') AND NOT {sql.has(words.BANNED_ASPECT_TOKENS, 'lower(text)')} AND length(text) >= 3),
ops AS (
  SELECT n.review_id, n.i, 0 AS branch, c.i AS word_i, lower(c.text) AS word FROM nouns n JOIN e c
    ON c.review_id = n.review_id AND c.head_i = n.i AND c.i <> n.i WHERE c.dep IN ('amod', 'acomp') AND c.pos = 'ADJ'
  UNION ALL
  SELECT n.review_id, n.i, 1, c.i, lower(c.text) FROM nouns n JOIN e c
    ON c.review_id = n.review_id AND c.head_i = n.head_i WHERE n.dep IN ('nsubj', 'nsubjpass') AND c.dep IN ('acomp', 'attr') AND c.pos = 'ADJ'
  UNION ALL
  SELECT n.review_id, n.i, 2, h.i, lower(h.lemma) FROM nouns n JOIN e h
    ON h.review_id = n.review_id AND h.i = n.head_i WHERE n.dep IN ('nsubj', 'nsubjpass') AND h.pos = 'VERB'
    AND {sql.has((*words.POSITIVE_CUES, *words.NEGATIVE_CUES), 'lower(h.lemma)')}),
joined AS (SELECT review_id, i, string_agg(word, ' ' ORDER BY branch, word_i) AS opinion FROM ops GROUP BY ALL),
named AS (SELECT n.review_id, n.i AS pos, lower(n.lemma) AS aspect, coalesce(opinion, '') AS opinion
  FROM nouns n LEFT JOIN joined j ON n.review_id = j.review_id AND n.i = j.i
  WHERE opinion IS NOT NULL OR {sql.has(words.PREFERRED_FEATURES, 'lower(n.lemma)')}),
pairs AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY review_id, aspect ORDER BY pos) = 1)"""


@query(f"{_PAIRS_SQL} SELECT review_id, pos, aspect, opinion FROM pairs")
def dependency_pairs(spark, sf):
    return edges.aspect_opinion_pairs(fixture(spark, sf, fixtures.EDGES), LEXICON)


_CONTEXT = "CASE WHEN opinion <> '' THEN opinion ELSE aspect END"


@query(f"""{_PAIRS_SQL}, c AS (SELECT *, {_CONTEXT} AS evidence, {sql.tokens(_CONTEXT)} AS toks FROM pairs)
SELECT review_id, aspect, evidence, CASE WHEN len(toks) > 0 THEN array_to_string(toks, ' ') ELSE aspect END AS context FROM c""")
def dependency_context(spark, sf):
    pairs = edges.aspect_opinion_pairs(fixture(spark, sf, fixtures.EDGES), LEXICON)
    units = scoring.pair_units(pairs, REVIEW_CLEAN, LEXICON, "review_id")
    return units.select("review_id", F.inline("pair_units")).select(
        "review_id", F.col("feature").alias("aspect"), "evidence", F.array_join("tokens", " ").alias("context")
    )


# ---- features ------------------------------------------------------------------------------


@query(f"WITH {sql.corpus_ctes()} SELECT term, idx, df, tf, round(idf, 6) AS idf FROM vocab")
def vocabulary(spark, sf):
    model = features.fit_tfidf(corpus(spark, sf), DOC_FEATURES)
    return model.vocabulary.select("term", "idx", "df", "tf", r6("idf"))


@query(f"WITH {sql.corpus_ctes()} SELECT doc_id, term, idx, cnt AS count, round(tfidf, 6) AS tfidf FROM x")
def tfidf(spark, sf):
    rows = corpus(spark, sf)
    long = features.tfidf_long(rows, features.fit_tfidf(rows, DOC_FEATURES))
    return long.select("doc_id", "term", "idx", "count", r6("tfidf"))


@query(f"""WITH {sql.corpus_ctes()} SELECT c.doc_id, count(idx) AS n_terms, coalesce(round(sum(tfidf), 6), 0) AS l1,
CAST(min(idx) AS INT) AS first_idx FROM cleaned AS c LEFT JOIN x USING (doc_id) GROUP BY c.doc_id""")
def tfidf_vectors(spark, sf):
    """The vector form, unpacked again per document; documents without a known term have the zero vector."""
    rows = corpus(spark, sf)
    vectors = features.vectorize(rows, features.fit_tfidf(rows, DOC_FEATURES))
    sparse = vectors.select("doc_id", F.unwrap_udt("features").alias("v"))
    return sparse.select(
        "doc_id",
        F.size("v.indices").cast("bigint").alias("n_terms"),
        r6(F.aggregate("v.values", F.lit(0.0), lambda s, v: s + v), "l1"),
        F.array_min("v.indices").alias("first_idx"),
    )


@query("""SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS label_index
FROM (SELECT DISTINCT CAST(quality * 2 + toxic AS VARCHAR) AS label FROM labels)""")
def label_index(spark, sf):
    rows = table(spark, sf, "labels").select((F.col("quality") * 2 + F.col("toxic")).cast("string").alias("label"))
    return labels.label_index_table(rows, "label")


@query("""WITH e AS (SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS i FROM events)
SELECT event_id, CAST(i AS INT) AS label_index, event_type AS decoded FROM e""")
def label_encode_decode(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type")
    names = classes_of(rows, "event_type")
    encoded = labels.encode_labels(rows, "event_type", names)
    return labels.decode_labels(encoded, "label_index", names, "decoded").select("event_id", "label_index", "decoded")


@query("""SELECT event_type AS label, count(*) AS n,
round(CAST((SELECT count(*) FROM events) AS DOUBLE) / ((SELECT count(DISTINCT event_type) FROM events) * count(*)), 6) AS weight
FROM events GROUP BY event_type""")
def class_weights(spark, sf):
    return labels.class_weights(table(spark, sf, "events"), "event_type").select("label", "n", r6("weight"))


@query("""SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY md5(concat(event_id, ':42')))
<= floor(count(*) OVER (PARTITION BY event_type) * CAST(0.2 AS DOUBLE) + 0.5) THEN 'test' ELSE 'train' END AS split FROM events""")
def stratified_split(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type")
    return splitting.assign_split(rows, "event_id", "event_type")


@query("""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(concat(doc_id, ':7')))
<= floor(count(*) OVER () * CAST(0.3 AS DOUBLE) + 0.5) THEN 'test' ELSE 'train' END AS split FROM labels""")
def plain_split(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    return splitting.assign_split(rows, "doc_id", "quality", 0.3, 7, stratify=False).select("doc_id", "split")


@query("""SELECT event_id, event_type, CAST(ntile(3) OVER (PARTITION BY event_type ORDER BY md5(concat(event_id, ':42'))) - 1 AS INT) AS fold
FROM events""")
def stratified_folds(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type")
    return splitting.assign_folds(rows, "event_id", "event_type", 3, 42)


# ---- models --------------------------------------------------------------------------------


@query(f"WITH {sql.corpus_ctes()} SELECT term, round(w0, 6) AS w_negative, round(w1, 6) AS w_positive FROM nbw")
def nb_weights(spark, sf):
    model = naive_bayes(spark, sf)
    return model.weights.select("term", r6(F.get("w", F.lit(0)), "w_negative"), r6(F.get("w", F.lit(1)), "w_positive"))


_DOC_UNITS = f"docs AS (SELECT doc_id, 0 AS unit, {sql.tokens('text')} AS toks FROM documents)"


def _document_scores(spark, sf, model):
    docs = documents(spark, sf).select("doc_id", F.lit(0).alias("unit"), text.clean_tokens(F.col("text")).alias("tokens"))
    placed = docs.repartition("doc_id")
    scores = models.score_units(placed, model, "doc_id")
    joined = docs.select("doc_id").join(scores, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("scores", model.intercept_scores()).alias("scores"))


@query(f"""WITH {sql.corpus_ctes()}, {_DOC_UNITS}, {sql.score_ctes('doc_id', 'docs', 's')}
SELECT doc_id, round(z0, 6) AS score_negative, round(z1, 6) AS score_positive, round(p1, 6) AS p_positive,
round(greatest(p0, p1), 6) AS confidence, label FROM s""")
def nb_scores(spark, sf):
    model = naive_bayes(spark, sf)
    rows = _document_scores(spark, sf, model).withColumn("seen", model.observe(F.col("scores")))
    return rows.select(
        "doc_id",
        r6(F.get("scores", F.lit(0)), "score_negative"),
        r6(F.get("scores", F.lit(1)), "score_positive"),
        r6("seen.positive", "p_positive"),
        r6("seen.confidence", "confidence"),
        "seen.label",
    )


@query(f"""WITH {sql.corpus_ctes()}, {_DOC_UNITS}, {sql.score_ctes('doc_id', 'docs', 's')}
SELECT doc_id, round(z1 - z0, 6) AS margin, round(1 / (1 + exp(z0 - z1)), 6) AS positive, label FROM s""")
def margin_scores(spark, sf):
    """The same model as one margin per document: no probabilities, scores by sigmoid."""
    nb = naive_bayes(spark, sf)
    w = F.array(F.lit(0.0), F.get("w", F.lit(1)) - F.get("w", F.lit(0)))
    model = models.LinearTextModel(
        nb.weights.select("term", "idx", "idf", w.alias("w")),
        CLASSES,
        (0.0, nb.intercepts[1] - nb.intercepts[0]),
        models.MARGIN,
        nb.vocabulary_size,
    )
    rows = _document_scores(spark, sf, model).withColumn("seen", model.observe(F.col("scores")))
    return rows.select("doc_id", r6("seen.margin", "margin"), r6("seen.positive", "positive"), "seen.label")


@query(f"""WITH {sql.corpus_ctes()}, docs AS (SELECT doc_id, {sql.tokens('text')} AS toks FROM documents),
t AS (SELECT doc_id, pos, toks[pos] AS word FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM docs)),
s AS (SELECT doc_id, pos, word, coalesce(w0, 0) + b0 AS z0, coalesce(w1, 0) + b1 AS z1 FROM t LEFT JOIN nbw ON word = term, priors)
SELECT doc_id, CAST(pos - 1 AS INT) AS position, word, CASE WHEN z1 > z0 THEN 'positive' ELSE 'negative' END AS predicted_label,
round(1 / (1 + exp(z0 - z1)), 6) AS positive, round(1 / (1 + exp(z1 - z0)), 6) AS negative FROM s""")
def word_sentiment(spark, sf):
    tokens = documents(spark, sf).select("doc_id", F.posexplode(text.clean_tokens(F.col("text"))).alias("pos", "token"))
    rows = models.word_sentiments(tokens, naive_bayes(spark, sf), "doc_id")
    return rows.select("doc_id", "position", "word", "predicted_label", r6("positive"), r6("negative"))


_CLASS_SQL = f"""f AS ({fixtures.PREDICTIONS}),
m AS (SELECT label, CASE WHEN p_positive >= CAST(0.5 AS DOUBLE) THEN 'positive' ELSE 'negative' END AS said FROM f),
c AS (SELECT c.class, count(*) FILTER (label = class) AS support, count(*) FILTER (said = class) AS called,
  count(*) FILTER (label = class AND said = class) AS tp
  FROM m, (SELECT label AS class FROM m UNION SELECT said FROM m) c GROUP BY c.class),
s AS (SELECT *, CASE WHEN called = 0 THEN 0 ELSE tp / CAST(called AS DOUBLE) END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE tp / CAST(support AS DOUBLE) END AS recall FROM c),
k AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s)"""


def _predictions(spark, sf, cut: float = 0.5):
    f = fixture(spark, sf, fixtures.PREDICTIONS)
    return f.select("label", F.when(F.col("p_positive") >= cut, "positive").otherwise("negative").alias("said"))


@query(f"""WITH {_CLASS_SQL} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM k""")
def class_metrics(spark, sf):
    rows = metrics.class_metrics(_predictions(spark, sf), "label", "said")
    return rows.select("class", "support", r6("precision"), r6("recall"), r6("f1"))


@query(f"""WITH {_CLASS_SQL} SELECT round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS test_accuracy,
round(sum(precision * support) / sum(support), 6) AS test_precision_weighted,
round(sum(recall * support) / sum(support), 6) AS test_recall_weighted,
round(sum(f1 * support) / sum(support), 6) AS test_f1_weighted FROM k""")
def weighted_metrics(spark, sf):
    row = metrics.weighted_metrics(_predictions(spark, sf), "label", "said")
    return row.select(*[r6(c) for c in row.columns])


_CUTS = (0.5, 0.3, 0.3, 0.9)


@query(f"""WITH f AS ({fixtures.PREDICTIONS}),
o(ordinal, cut) AS (VALUES {', '.join(f'({i}, CAST({c} AS DOUBLE))' for i, c in enumerate(_CUTS))}),
a AS (SELECT ordinal, avg(CASE WHEN (p_positive >= cut) = (label = 'positive') THEN 1.0 ELSE 0.0 END) AS acc FROM f, o GROUP BY ordinal)
SELECT CAST(ordinal AS INT) AS ordinal, round(acc, 6) AS test_accuracy FROM a ORDER BY acc DESC, ordinal LIMIT 1""")
def best_model(spark, sf):
    """Four thresholds as four models, two of them equal: the earlier one wins the tie."""
    parts = [
        metrics.weighted_metrics(_predictions(spark, sf, c), "label", "said").withColumn("ordinal", F.lit(i))
        for i, c in enumerate(_CUTS)
    ]
    scores = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return metrics.best_model(scores, "accuracy").select("ordinal", r6("test_accuracy"))


def _small_search(spark, sf):
    rows = corpus(spark, sf)
    found = jobs.build_features(rows, DOC_FEATURES)
    return found, jobs.train_and_select(found, TrainConfig())


@query()
def grid_search(spark, sf):
    """The full grid of all four models on the labelled documents."""
    _, trained = _small_search(spark, sf)
    return trained.scores.withColumns({"best": F.col("name") == trained.best, "best_params": F.to_json("best_params")})


_TRAIN_ROWS = f"""SELECT doc_id, text, sentiment FROM (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY md5(concat(doc_id, ':42')))
> floor(count(*) OVER (PARTITION BY sentiment) * CAST(0.2 AS DOUBLE) + 0.5) AS train FROM corpus WHERE len({sql.tokens('text')}) > 0) WHERE train"""

# Multinomial naive Bayes once more: per fold and alpha fitted on the other folds, scored on the fold.
_BAYES_SEARCH = f"""{sql.corpus_ctes(_TRAIN_ROWS)},
folds AS (SELECT doc_id, sentiment, ntile(3) OVER (PARTITION BY sentiment ORDER BY md5(concat(doc_id, ':42'))) - 1 AS fold FROM cleaned),
alphas AS (SELECT CAST(unnest([0.1, 0.5, 1.0]) AS DOUBLE) AS alpha),
parts AS (SELECT 0 AS part UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3),
fold_terms AS (SELECT x.term, x.sentiment, fold, sum(tfidf) AS s FROM x JOIN folds USING (doc_id) GROUP BY ALL),
part_sums AS (SELECT part, term, coalesce(sum(s) FILTER (f.sentiment = 'negative' AND fold <> part), 0) AS n0,
  coalesce(sum(s) FILTER (f.sentiment = 'positive' AND fold <> part), 0) AS n1
  FROM parts, vocab LEFT JOIN fold_terms AS f USING (term) GROUP BY ALL),
part_totals AS (SELECT part, sum(n0) AS t0, sum(n1) AS t1, count(*) AS size FROM part_sums GROUP BY part),
part_priors AS (SELECT part, ln(count(*) FILTER (sentiment = 'negative' AND fold <> part) / CAST(count(*) FILTER (fold <> part) AS DOUBLE)) AS b0,
  ln(count(*) FILTER (sentiment = 'positive' AND fold <> part) / CAST(count(*) FILTER (fold <> part) AS DOUBLE)) AS b1 FROM folds, parts GROUP BY part),
part_weights AS (SELECT part, alpha, term, ln((n0 + alpha) / (t0 + alpha * size)) AS w0, ln((n1 + alpha) / (t1 + alpha * size)) AS w1
  FROM part_sums JOIN part_totals USING (part), alphas),
held AS (SELECT doc_id, sentiment, toks FROM (SELECT doc_id, sentiment, {sql.tokens('text')} AS toks FROM corpus)
  WHERE len(toks) > 0 AND doc_id NOT IN (SELECT doc_id FROM chosen)),
held_terms AS (SELECT doc_id, term, count(*) AS cnt FROM (SELECT doc_id, unnest({sql.terms_of('toks')}) AS term FROM held) GROUP BY ALL),
seen AS (SELECT doc_id, fold AS part, term, tfidf FROM x JOIN folds USING (doc_id)
  UNION ALL SELECT doc_id, 3, term, cnt * idf / sqrt(sum(cnt * idf * cnt * idf) OVER (PARTITION BY doc_id)) FROM held_terms JOIN vocab USING (term)),
every AS (SELECT doc_id, sentiment, fold AS part FROM folds UNION ALL SELECT doc_id, sentiment, 3 FROM held),
sums_of AS (SELECT doc_id, part, alpha, sum(tfidf * w0) AS s0, sum(tfidf * w1) AS s1 FROM seen JOIN part_weights USING (part, term) GROUP BY ALL),
said AS (SELECT e.part, a.alpha, e.sentiment, CASE WHEN coalesce(s1, 0) + b1 > coalesce(s0, 0) + b0 THEN 'positive' ELSE 'negative' END AS predicted
  FROM every AS e CROSS JOIN alphas AS a JOIN part_priors USING (part) LEFT JOIN sums_of AS s ON s.doc_id = e.doc_id AND s.part = e.part AND s.alpha = a.alpha),
per_class AS (SELECT part, alpha, class, count(*) FILTER (sentiment = class) AS support, count(*) FILTER (predicted = class) AS called,
  count(*) FILTER (sentiment = class AND predicted = class) AS tp FROM said, (VALUES ('negative'), ('positive')) AS c(class) GROUP BY ALL),
rates AS (SELECT *, coalesce(tp / nullif(CAST(called AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(support AS DOUBLE), 0), 0) AS recall FROM per_class),
scored_parts AS (SELECT part, alpha, sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy,
  sum(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END * support) / sum(support) AS f1 FROM rates GROUP BY ALL),
means AS (SELECT alpha, avg(f1) AS mean FROM scored_parts WHERE part < 3 GROUP BY alpha),
picked AS (SELECT alpha FROM means ORDER BY round(mean, 12) DESC, alpha LIMIT 1)"""


@query(f"""WITH {_BAYES_SEARCH} SELECT alpha, round(mean, 6) AS cv_f1, alpha IN (FROM picked) AS chosen,
CASE WHEN alpha IN (FROM picked) THEN round(accuracy, 6) END AS test_accuracy, CASE WHEN alpha IN (FROM picked) THEN round(f1, 6) END AS test_f1_weighted
FROM means JOIN (SELECT * FROM scored_parts WHERE part = 3) USING (alpha)""")
def bayes_search(spark, sf):
    """Naive Bayes searched over its smoothing values: mean metric of each, the chosen one and its test metrics."""
    built = jobs.build_features(corpus(spark, sf), DOC_FEATURES)
    cfg = TrainConfig(models=("MultinomialNB",))
    train, test = (search.training_vectors(part, built.tfidf, built.labels, cfg) for part in (built.train, built.test))
    (tuned,) = search.tune(search.search_space(cfg), train, test, len(built.labels), cfg)
    rows = []
    for alpha, mean in zip(search.NB_ALPHAS, tuned.cv_scores, strict=True):
        chosen = tuned.best_params == {"alpha": str(alpha)}
        tested = [tuned.metrics[c] if chosen else None for c in ("test_accuracy", "test_f1_weighted")]
        rows.append((alpha, mean, chosen, *tested))
    found = spark.createDataFrame(rows, "alpha double, cv_f1 double, chosen boolean, test_accuracy double, test_f1_weighted double")
    return found.select("alpha", r6("cv_f1"), "chosen", r6("test_accuracy"), r6("test_f1_weighted"))


@query("""SELECT name, true AS converged, true AS at_minimum, points FROM (VALUES ('LogisticRegression', 6), ('LinearSVC', 3),
('MultinomialNB', 3), ('SGDClassifier', 12)) AS m(name, points)""")
def search_certificates(spark, sf):
    """All four models searched over their whole grids: did the solver stop by itself, and is the refit the minimum of its objective?"""
    built = jobs.build_features(corpus(spark, sf), DOC_FEATURES)
    cfg = TrainConfig()
    train, test = (search.training_vectors(part, built.tfidf, built.labels, cfg) for part in (built.train, built.test))
    tuned = search.tune(search.search_space(cfg), train, test, len(built.labels), cfg)
    bounds = {"LogisticRegression": 2 * search.EXACT, "LinearSVC": 2 * search.EXACT, "MultinomialNB": 1e-9, "SGDClassifier": 2 * search.STOCHASTIC}
    rows = []
    for t in tuned:
        proof = search.certificate(t, train)
        rows.append((t.name, proof["converged"], proof["violation"] <= bounds[t.name], len(t.cv_scores)))
    return spark.createDataFrame(rows, "name string, converged boolean, at_minimum boolean, points int")


@query(f"""WITH {sql.corpus_ctes(_TRAIN_ROWS)},
c AS (SELECT doc_id, sentiment, toks FROM (SELECT doc_id, sentiment, {sql.tokens('text')} AS toks FROM corpus) WHERE len(toks) > 0),
t AS (SELECT doc_id, term, count(*) AS cnt FROM (SELECT doc_id, unnest({sql.terms_of('toks')}) AS term FROM c) GROUP BY ALL),
w AS (SELECT doc_id, idx, cnt * idf / sqrt(sum(cnt * idf * cnt * idf) OVER (PARTITION BY doc_id)) AS tfidf FROM t JOIN vocab USING (term))
SELECT c.doc_id, sentiment, CASE WHEN c.doc_id IN (SELECT doc_id FROM chosen) THEN 'train' ELSE 'test' END AS split,
  (SELECT count(*) FROM vocab) AS size, count(idx) AS n_terms, coalesce(round(sum(tfidf), 6), 0) AS l1,
  coalesce(round(sum(tfidf * (idx % 17)), 6), 0) AS checksum FROM c LEFT JOIN w USING (doc_id) GROUP BY ALL""")
def feature_table(spark, sf):
    """Features written by split and read back split by split."""
    built = jobs.build_features(corpus(spark, sf), DOC_FEATURES)
    path = writers.write_features(
        features.vectorize(built.rows, built.tfidf).select("doc_id", "sentiment", "split", "features"),
        fresh_path(spark, "features"),
    )
    parts = [writers.read_features(spark, path, split) for split in ("train", "test")]
    v = F.unwrap_udt("features")
    values = F.zip_with(v["indices"], v["values"], lambda i, x: x * (i % 17))
    return parts[0].unionByName(parts[1]).select(
        "doc_id", "sentiment", "split", v["size"].cast("bigint").alias("size"), F.size(v["indices"]).cast("bigint").alias("n_terms"),
        r6(F.aggregate(v["values"], F.lit(0.0), lambda s, x: s + x), "l1"), r6(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), "checksum"),
    )


@query(f"""WITH {sql.corpus_ctes(_TRAIN_ROWS)}, held AS (SELECT doc_id, sentiment, 0 AS unit, {sql.tokens('text')} AS toks FROM corpus
  WHERE len({sql.tokens('text')}) > 0 AND doc_id NOT IN (SELECT doc_id FROM chosen)),
{sql.score_ctes('doc_id', 'held', 's')}
SELECT doc_id, sentiment, label, round(p1, 6) AS positive FROM s""")
def held_out_scores(spark, sf):
    """Split, vocabulary and model from the training part only; predictions for the test part."""
    built = jobs.build_features(corpus(spark, sf), DOC_FEATURES)
    model = models.fit_naive_bayes(built.train, built.tfidf, built.labels)
    held = built.test.select("doc_id", "sentiment", "text")
    scored = scoring.score_reviews(held, model, LEXICON, DOC_CLEAN, words=False, carry=["sentiment"])
    return scored.select("doc_id", "carried.sentiment", F.col("predicted_label").alias("label"), r6("positive_score", "positive"))


@query(f"""WITH {sql.corpus_ctes()}, {_DOC_UNITS}, {sql.score_ctes('doc_id', 'docs', 's')}
SELECT doc_id, label, round(p1, 6) AS positive FROM s""")
def saved_model_scores(spark, sf):
    """A model saved, read back and applied."""
    path = fresh_path(spark, "model")
    naive_bayes(spark, sf).save(path)
    model = models.LinearTextModel.load(spark, path)
    rows = _document_scores(spark, sf, model).withColumn("seen", model.observe(F.col("scores")))
    return rows.select("doc_id", "seen.label", r6("seen.positive", "positive"))


# ---- scored reviews --------------------------------------------------------------------------


def _scored(spark, sf, words_too=False, pairs=None):
    return scoring.score_reviews(reviews(spark, sf), naive_bayes(spark, sf), LEXICON, REVIEW_CLEAN, pairs, words_too)


@query(f"""WITH {sql.review_ctes()}
SELECT review_id, CASE WHEN error IS NULL THEN array_to_string(toks, ' ') ELSE '' END AS cleaned_text,
CASE WHEN error IS NULL THEN CAST(len(toks) AS INT) ELSE 0 END AS token_count,
CASE WHEN error IS NULL THEN label ELSE '' END AS predicted_label,
CASE WHEN error IS NULL THEN CASE label WHEN 'positive' THEN 1 ELSE 0 END END AS predicted_raw,
CASE WHEN error IS NULL THEN round(p1, 6) END AS positive_score, CASE WHEN error IS NULL THEN round(p0, 6) END AS negative_score,
CASE WHEN error IS NULL THEN round(confidence, 6) END AS confidence,
CASE WHEN error IS NULL THEN overall ELSE '' END AS overall_sentiment, error FROM whole""")
def scored_reviews(spark, sf):
    return _scored(spark, sf).select(
        "review_id", "cleaned_text", "token_count", "predicted_label", "predicted_raw",
        r6("positive_score"), r6("negative_score"), r6("confidence"), "overall_sentiment", "error",
    )


# Every word on -ing has its stem for lemma, all others themselves; the model keeps the lemmas it was fitted with.
_ING_RULE = "CASE WHEN right(t, 3) = 'ing' AND length(t) > 5 THEN left(t, length(t) - 3) ELSE t END"


def _with_ing(statement: str) -> str:
    return statement.replace(sql.lemma("t"), _ING_RULE)


def _ing_table(rows):
    """(token, lemma) of all words on -ing, as a table that grows with the texts."""
    tokens = rows.select(F.explode(text.raw_tokens(F.col("text"))).alias("token")).distinct()
    long = tokens.filter(F.col("token").endswith("ing") & (F.length("token") > 5))
    return long.select("token", F.expr("left(token, length(token) - 3)").alias("lemma"))


@query(f"""WITH {sql.corpus_ctes()}{_with_ing(sql.review_ctes()[len(sql.corpus_ctes()):])}
SELECT w.review_id, CASE WHEN error IS NULL THEN array_to_string(w.toks, ' ') ELSE '' END AS cleaned_text, round(p1, 6) AS positive_score, pos,
feature, sentiment, round(positive, 6) AS positive FROM whole w JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY review_id ORDER BY unit) - 1 AS INT) AS pos FROM points)
USING (review_id) WHERE w.error IS NULL""")
def scored_with_lemmas(spark, sf):
    """Reviews scored with a lemma table: whole text, clauses and rules all use it."""
    rows = reviews(spark, sf)
    scored = scoring.score_reviews(rows, naive_bayes(spark, sf), LEXICON, REVIEW_CLEAN, words=False, lemma_table=_ing_table(rows))
    points = scored.select("review_id", "cleaned_text", r6("positive_score"), F.posexplode("main_feature_points").alias("pos", "p"))
    return points.select(
        "review_id", "cleaned_text", "positive_score", "pos", "p.feature", "p.sentiment", r6("p.scores.positive", "positive")
    )


@query(f"""WITH {sql.review_ctes()}
SELECT p.review_id, CAST(row_number() OVER (PARTITION BY p.review_id ORDER BY p.unit) - 1 AS INT) AS pos, feature, sentiment, evidence,
round(positive, 6) AS positive, round(negative, 6) AS negative FROM points p JOIN whole w USING (review_id) WHERE w.error IS NULL""")
def scored_points(spark, sf):
    rows = _scored(spark, sf).select("review_id", F.posexplode("main_feature_points").alias("pos", "p"))
    return rows.select(
        "review_id", "pos", "p.feature", "p.sentiment", "p.evidence",
        r6("p.scores.positive", "positive"), r6("p.scores.negative", "negative"),
    )


@query(f"""WITH {sql.review_ctes()}
SELECT review_id, feature, sentiment, round(positive, 6) AS positive FROM points p JOIN whole w USING (review_id) WHERE w.error IS NULL
QUALIFY row_number() OVER (PARTITION BY review_id, feature ORDER BY p.unit DESC) = 1""")
def aspect_map(spark, sf):
    """Per review the last sentiment of each feature."""
    rows = _scored(spark, sf)
    labels_ = rows.select("review_id", F.explode("aspect_sentiments").alias("feature", "sentiment"), "aspect_sentiment_scores")
    return labels_.select(
        "review_id", "feature", "sentiment",
        r6(F.try_element_at("aspect_sentiment_scores", F.col("feature"))["positive"], "positive"),
    )


@query(f"""WITH {sql.review_ctes()}, t AS (SELECT review_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM whole WHERE error IS NULL),
s AS (SELECT review_id, pos, toks[pos] AS word, coalesce(w0, 0) + b0 AS z0, coalesce(w1, 0) + b1 AS z1
  FROM t LEFT JOIN nbw ON toks[pos] = term, priors)
SELECT review_id, CAST(pos - 1 AS INT) AS position, word, round(1 / (1 + exp(z0 - z1)), 6) AS positive FROM s""")
def scored_words(spark, sf):
    rows = _scored(spark, sf, words_too=True).select("review_id", F.inline("word_sentiments"))
    return rows.select("review_id", "position", "word", r6("positive"))


@query(f"""WITH {sql.review_ctes()},
p AS (SELECT review_id, string_agg(concat_ws('|', feature, sentiment, evidence, printf('%.4f', positive)), ' / ' ORDER BY unit) AS main_points, count(*) AS n FROM points GROUP BY ALL),
m AS (SELECT review_id, string_agg(concat_ws('|', feature, sentiment, printf('%.4f', negative)), ' / ' ORDER BY feature) AS aspects
  FROM (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY review_id, feature ORDER BY unit DESC) = 1) GROUP BY ALL)
SELECT review_id, text AS input_text, CASE WHEN error IS NULL THEN array_to_string(toks, ' ') ELSE '' END AS cleaned_text,
CASE WHEN error IS NULL THEN array_to_string(toks, '+') ELSE '' END AS tokens, CASE WHEN error IS NULL THEN CAST(len(toks) AS INT) ELSE 0 END AS token_count,
CASE WHEN error IS NULL THEN '1x' || (SELECT size FROM totals) ELSE '' END AS embedding_shape, CASE WHEN error IS NULL THEN label ELSE '' END AS predicted_label,
CASE WHEN error IS NULL THEN overall ELSE '' END AS overall_sentiment, CASE WHEN error IS NULL THEN CASE label WHEN 'positive' THEN 1 ELSE 0 END END AS predicted_raw,
CASE WHEN error IS NULL THEN round(p1, 6) END AS positive_score, CASE WHEN error IS NULL THEN round(p0, 6) END AS negative_score,
CASE WHEN error IS NULL THEN round(p1, 6) END AS breakdown_positive, CASE WHEN error IS NULL THEN round(p0, 6) END AS breakdown_negative,
CASE WHEN error IS NULL THEN round(confidence, 6) END AS confidence, CAST(NULL AS DOUBLE) AS decision_margin,
CASE WHEN error IS NULL THEN round(p1, 6) END AS p_positive, CASE WHEN error IS NULL THEN round(p0, 6) END AS p_negative,
CASE WHEN error IS NULL THEN coalesce(main_points, '') END AS main_points, CASE WHEN error IS NULL THEN coalesce(aspects, '') END AS aspects
FROM whole LEFT JOIN p USING (review_id) LEFT JOIN m USING (review_id)""")
def response_rows(spark, sf):
    """All columns of the response, nested ones flattened."""
    rows = results.response_rows(_scored(spark, sf, words_too=True), "review_id")

    def shown(score: Column) -> Column:
        return F.format_string("%.4f", score)

    points = F.transform("main_feature_points", lambda p: F.concat_ws("|", p["feature"], p["sentiment"], p["evidence"], shown(p["scores"]["positive"])))
    names = F.array_sort(F.map_keys("aspect_sentiments"))
    aspects_ = F.transform(
        names,
        lambda n: F.concat_ws(
            "|", n, F.try_element_at("aspect_sentiments", n), shown(F.try_element_at("aspect_sentiment_scores", n)["negative"])
        ),
    )
    return rows.select(
        "review_id", "input_text", "cleaned_text", F.array_join("tokens", "+").alias("tokens"), "token_count",
        F.array_join(F.transform("embedding_shape", lambda n: n.cast("string")), "x").alias("embedding_shape"),
        "predicted_label", "overall_sentiment", "predicted_raw", r6("positive_score"), r6("negative_score"),
        r6("sentiment_breakdown.positive", "breakdown_positive"), r6("sentiment_breakdown.negative", "breakdown_negative"),
        r6("confidence"), "decision_margin", r6(F.try_element_at("class_probabilities", F.lit("positive")), "p_positive"),
        r6(F.try_element_at("class_probabilities", F.lit("negative")), "p_negative"),
        F.array_join(points, " / ").alias("main_points"), F.array_join(aspects_, " / ").alias("aspects"),
    )


_ANNOTATED = """SELECT w.review_id, r.text, CASE WHEN error IS NULL THEN overall ELSE '' END AS overall_sentiment,
CASE WHEN error IS NULL THEN round(p1, 6) END AS positive_score, CASE WHEN error IS NULL THEN round(p0, 6) END AS negative_score,
CASE WHEN error IS NULL THEN round(confidence, 6) END AS confidence,
CASE WHEN error IS NULL THEN coalesce(fs, '') ELSE '' END AS features_and_sentiments
FROM whole w JOIN reviews r USING (review_id)
LEFT JOIN (SELECT review_id, string_agg(feature || ': ' || sentiment, ', ' ORDER BY unit) AS fs FROM points GROUP BY review_id) USING (review_id)"""


@query(f"WITH {sql.review_ctes()} {_ANNOTATED}")
def annotated(spark, sf):
    rows = jobs.annotate(reviews(spark, sf), naive_bayes(spark, sf), LEXICON, REVIEW_CLEAN)
    return rows.select(
        "review_id", "text", "overall_sentiment", r6("positive_score"), r6("negative_score"), r6("confidence"),
        "features_and_sentiments",
    )


@query(f"""WITH {sql.review_ctes()}, a AS ({_ANNOTATED})
SELECT CAST(review_id AS VARCHAR) AS review_id, coalesce(text, '') AS text, overall_sentiment, positive_score, negative_score, confidence, features_and_sentiments FROM a""")
def annotated_csv(spark, sf):
    """An uploaded CSV scored, written as annotated CSV and read back."""
    upload, out = fresh_path(spark, "upload") + ".csv", fresh_path(spark, "annotated")
    writers.write_annotated_csv(reviews(spark, sf), upload)
    jobs.annotate_csv(spark, upload, "text", out, naive_bayes(spark, sf), LEXICON)
    rows = spark.read.option("header", True).option("escape", '"').csv(out)
    number = {c: F.col(c).cast("double") for c in ("positive_score", "negative_score", "confidence")}
    # A CSV cell cannot tell null from '': an empty text cell reads back as null.
    empty = {c: F.coalesce(F.col(c), F.lit("")) for c in ("text", "overall_sentiment", "features_and_sentiments")}
    return rows.withColumns({**number, **empty}).select(
        "review_id", "text", "overall_sentiment", r6("positive_score"), r6("negative_score"), r6("confidence"), "features_and_sentiments"
    )


@query(f"""WITH {sql.review_ctes()}, ok AS (SELECT *, count(*) OVER () AS total FROM whole WHERE error IS NULL ORDER BY review_id LIMIT 10 OFFSET 10)
SELECT review_id, text AS review, overall AS overall_sentiment, round(p1, 6) AS positive_score, round(confidence, 6) AS confidence,
CAST(total AS BIGINT) AS total, CAST(ceil(total / 10.0) AS BIGINT) AS pages, true AS has_previous, 20 < total AS has_next,
CAST((SELECT count(*) FROM points p WHERE p.review_id = ok.review_id) AS INT) AS n_features FROM ok""")
def page_2(spark, sf):
    page = jobs.score_page(reviews(spark, sf), naive_bayes(spark, sf), 2, 10, LEXICON, REVIEW_CLEAN)
    total = F.lit(page.total).cast("bigint")
    before, after = pages.page_links(total, 2, 10)
    return page.rows.select(
        "review_id", "review", "overall_sentiment", r6("positive_score"), r6("confidence"),
        total.alias("total"), pages.page_count(total, 10).alias("pages"),
        before.alias("has_previous"), after.alias("has_next"), F.size("features").alias("n_features"),
    )


@query("""SELECT event_id, total FROM (SELECT event_id, CAST(count(*) OVER () AS BIGINT) AS total FROM events) ORDER BY event_id LIMIT 25 OFFSET 8025""")
def deep_page(spark, sf):
    page = pages.page_of(table(spark, sf, "events").select("event_id"), "event_id", 322, 25)
    return page.rows.withColumn("total", F.lit(page.total).cast("bigint"))


_TEXT_IDS = """SELECT event_id, md5(concat(event_id, ':page')) AS id FROM events"""


@query(f"""SELECT id, event_id, total FROM (SELECT *, CAST(count(*) OVER () AS BIGINT) AS total FROM ({_TEXT_IDS})) ORDER BY id LIMIT 40 OFFSET 7960""")
def page_text_ids(spark, sf):
    """A deep page in order of a text id, from the table as it is."""
    events = table(spark, sf, "events")
    rows = events.select("event_id", F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":page"))).alias("id"))
    page = pages.page_of(rows, "id", 200, 40)
    return page.rows.select("id", "event_id", F.lit(page.total).cast("bigint").alias("total"))


@query("""SELECT id, total FROM (SELECT event_id * event_id * 1000003 - 7000000000 AS id, CAST(count(*) OVER () AS BIGINT) AS total FROM events)
ORDER BY id LIMIT 30 OFFSET 6000""")
def page_sparse_ids(spark, sf):
    """A deep page of integer ids with wide gaps; the ids of large tables pass 64 bits, those of the page do not."""
    n = F.col("event_id").cast("decimal(19,0)")
    rows = table(spark, sf, "events").select((n * n * 1000003 - 7000000000).cast("decimal(37,0)").alias("id"))
    page = pages.page_of(rows, "id", 201, 30)
    return page.rows.select(F.col("id").cast("bigint").alias("id"), F.lit(page.total).cast("bigint").alias("total"))


@query(f"""SELECT id, event_id, total FROM (SELECT *, CAST(count(*) OVER () AS BIGINT) AS total FROM ({_TEXT_IDS})) ORDER BY id LIMIT 40 OFFSET 7960""")
def page_stored(spark, sf):
    """The same page read from a stored table by its page index."""
    events = table(spark, sf, "events")
    rows = events.select("event_id", F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":page"))).alias("id"))
    page = pages.store_pages(rows, "id", fresh_path(spark, "pages"), 3000).page(200, 40)
    return page.rows.select("id", "event_id", F.lit(page.total).cast("bigint").alias("total"))


@query(f"""WITH {sql.review_ctes()}, ok AS (SELECT *, count(*) OVER () AS total FROM whole WHERE error IS NULL ORDER BY review_id LIMIT 20 OFFSET 20)
SELECT text AS review, overall AS overall_sentiment, round(p1, 6) AS positive_score, round(confidence, 6) AS confidence, CAST(total AS BIGINT) AS total,
CAST((SELECT count(*) FROM points p WHERE p.review_id = ok.review_id) AS INT) AS n_features FROM ok""")
def page_from_upload(spark, sf):
    """An uploaded CSV, scored once and paged twice: the second page, read from the stored scores."""
    upload, space = fresh_path(spark, "upload") + ".csv", fresh_path(spark, "workspace")
    writers.write_annotated_csv(reviews(spark, sf).orderBy("review_id").coalesce(1), upload)
    model = naive_bayes(spark, sf)
    jobs.score_upload_page(spark, upload, "text", model, 1, space, 1, 20, LEXICON)
    page = jobs.score_upload_page(spark, upload, "text", model, 1, space, 2, 20, LEXICON)
    return page.rows.select(
        "review", "overall_sentiment", r6("positive_score"), r6("confidence"), F.lit(page.total).cast("bigint").alias("total"),
        F.size("features").alias("n_features"),
    )


@query(f"""WITH {sql.review_ctes()}, ok AS (SELECT *, count(*) OVER () AS total FROM whole WHERE error IS NULL ORDER BY review_id LIMIT 5 OFFSET 10)
SELECT CAST(max(total) AS BIGINT) AS total, 3 AS page, 5 AS per_page, string_agg(overall, '|' ORDER BY review_id) AS labels FROM ok""")
def page_json(spark, sf):
    """The page as one JSON document, parsed again."""
    page = jobs.score_page(reviews(spark, sf), naive_bayes(spark, sf), 3, 5, LEXICON, REVIEW_CLEAN)
    schema = "total bigint, page int, per_page int, results array<struct<review:string,overall_sentiment:string>>"
    doc = pages.page_document(page, "review_id").select(F.from_json("document", schema).alias("d"))
    return doc.select("d.total", "d.page", "d.per_page", F.array_join("d.results.overall_sentiment", "|").alias("labels"))


@query(f"""WITH {sql.review_ctes()} SELECT review_id,
CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview, overall AS label,
CASE WHEN overall = 'positive' THEN 'positive' ELSE 'negative' END AS tone, round(p1 * 100, 1) AS positive_pct,
round(p0 * 100, 1) AS negative_pct, round(confidence * 100, 1) AS confidence_pct,
round(greatest(0, least(100, p1 * 100)), 6) AS positive_width, round(greatest(0, least(100, p0 * 100)), 6) AS negative_width
FROM whole WHERE error IS NULL""")
def display_rows(spark, sf):
    shown = results.display_rows(results.result_rows(_scored(spark, sf), "review_id"), "review_id")
    return shown.withColumns({c: F.round(c, 6) for c in ("positive_width", "negative_width")})


@query(f"""WITH {sql.review_ctes()} SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY p.unit) - 1 AS INT) AS pos, feature,
sentiment, CASE WHEN sentiment = 'negative' THEN 'negative' ELSE 'positive' END AS tone,
round(positive * 100, 1) AS positive_pct, round(negative * 100, 1) AS negative_pct, evidence
FROM points p JOIN whole w USING (review_id) WHERE w.error IS NULL""")
def aspect_cards(spark, sf):
    return results.aspect_cards(results.result_rows(_scored(spark, sf), "review_id"), "review_id")


@query(f"""WITH {sql.corpus_ctes()}, texts AS ({fixtures.REVIEWS}),
{_PAIRS_SQL[len('WITH '):]},
ctx AS (SELECT *, {_CONTEXT} AS evidence, {sql.tokens(_CONTEXT)} AS cleaned_toks FROM pairs),
pair_units AS (SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY pos) AS INT) AS unit, evidence,
  CASE WHEN len(cleaned_toks) > 0 THEN cleaned_toks ELSE [aspect] END AS toks, aspect AS feature FROM ctx),
{sql.unit_ctes('texts', 'review_id')},
every AS (
  SELECT review_id, unit, evidence, toks, feature, {sql.forced('toks')} AS forced, {sql.positive_sum('toks')} AS ps, {sql.negative_sum('toks')} AS ns FROM pair_units
  UNION ALL
  SELECT review_id, unit, evidence, toks, feature, forced, ps, ns FROM units WHERE review_id NOT IN (SELECT review_id FROM pair_units)),
{sql.score_ctes('review_id', 'every', 's')},
ok AS (SELECT review_id FROM texts WHERE len({sql.tokens('text')}) > 0),
z AS (SELECT review_id, unit, feature, evidence, {sql.ruled('label', 'p1', 'p0')} FROM s WHERE review_id IN (SELECT review_id FROM ok))
SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY unit) - 1 AS INT) AS pos, feature, evidence, sentiment,
round(positive, 6) AS positive FROM z""")
def scored_with_edges(spark, sf):
    """Aspect pairs from dependency edges; reviews without a pair fall back to their clauses."""
    pairs = edges.aspect_opinion_pairs(fixture(spark, sf, fixtures.EDGES), LEXICON)
    rows = _scored(spark, sf, pairs=pairs).select("review_id", F.posexplode("main_feature_points").alias("pos", "p"))
    return rows.select("review_id", "pos", "p.feature", "p.evidence", "p.sentiment", r6("p.scores.positive", "positive"))


# ---- streams -------------------------------------------------------------------------------


def _document_stream(spark, sf):
    schema = table(spark, sf, "documents").schema
    return streams.read_files(spark, f"{sf}/documents.parquet", schema)


@query(f"""SELECT doc_id, array_to_string({sql.tokens('text')}, ' ') AS text_clean FROM documents WHERE len({sql.tokens('text')}) > 0""")
def stream_clean(spark, sf):
    out = fresh_path(spark, "stream-clean")
    rows = _document_stream(spark, sf).select("doc_id", "text")
    streams.clean_stream(rows, out, f"{out}-checkpoint", DOC_CLEAN).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "text_clean")


@query(f"""WITH {sql.corpus_ctes()}, {_DOC_UNITS}, {sql.score_ctes('doc_id', 'docs', 's')}
SELECT doc_id, CASE WHEN len(toks) > 0 THEN label ELSE '' END AS predicted_label, CASE WHEN len(toks) > 0 THEN round(p1, 6) END AS positive_score FROM s""")
def stream_score(spark, sf):
    out = fresh_path(spark, "stream-score")
    rows = _document_stream(spark, sf).select("doc_id", "text")
    streams.score_stream(rows, naive_bayes(spark, sf), out, f"{out}-checkpoint", LEXICON, DOC_CLEAN).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "predicted_label", r6("positive_score"))


@query(f"""WITH {sql.corpus_ctes()}, {_with_ing(_DOC_UNITS)}, {_with_ing(sql.score_ctes('doc_id', 'docs', 's'))}
SELECT doc_id, CASE WHEN len(toks) > 0 THEN label ELSE '' END AS predicted_label, CAST(len(toks) AS INT) AS token_count,
CASE WHEN len(toks) > 0 THEN round(p1, 6) END AS positive_score FROM s""")
def stream_with_lemmas(spark, sf):
    """A stream scored with a lemma table."""
    out = fresh_path(spark, "stream-lemmas")
    rows = _document_stream(spark, sf).select("doc_id", "text")
    lemmas = _ing_table(documents(spark, sf))
    streams.score_stream(
        rows, naive_bayes(spark, sf), out, f"{out}-checkpoint", LEXICON, DOC_CLEAN, lemma_table=lemmas
    ).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "predicted_label", "token_count", r6("positive_score"))


@query("SELECT DISTINCT md5(text) AS digest FROM documents")
def stream_dedup(spark, sf):
    out = fresh_path(spark, "stream-dedup")
    rows = _document_stream(spark, sf).select("text", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("ts"))
    kept = streams.dedup_stream(rows, "text", "ts", "3650 days")
    streams.write_batches(kept, lambda b, _: b, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out).select(F.md5("text").alias("digest"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def stream_counts(spark, sf):
    out = fresh_path(spark, "stream-counts")
    streams.running_counts(_document_stream(spark, sf), "source", out, f"{out}-checkpoint").awaitTermination()
    return streams.read_counts(spark, out, "source")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def stream_counts_batches(spark, sf):
    """The same counts over many micro-batches with snapshots between, and a last batch that is run twice."""
    files, out = fresh_path(spark, "files"), fresh_path(spark, "stream-counts")
    docs = table(spark, sf, "documents")
    docs.select("doc_id", "source").repartition(7).write.parquet(files)

    arriving = streams.read_files(spark, files, docs.select("doc_id", "source").schema, max_files_per_trigger=1)
    streams.running_counts(arriving, "source", out, f"{out}-checkpoint", 3).awaitTermination()
    changes = [c for c in versions.commits(spark, out).values() if c.source_job == "changes"]
    newest = max(changes, key=lambda c: c.version)
    versions.append_record(spark, out, newest.version, newest.folder, "changes")
    return streams.read_counts(spark, out, "source")


@query(f"""WITH {sql.corpus_ctes()}, {_DOC_UNITS}, {sql.score_ctes('doc_id', 'docs', 's')}
SELECT doc_id, 2 AS model_version, CASE WHEN len(toks) > 0 THEN label ELSE '' END AS predicted_label,
CASE WHEN len(toks) > 0 THEN round(p1, 6) END AS positive_score FROM s""")
def stream_newest_model(spark, sf):
    """Two registered models; the stream scores with the newer one."""
    space = fresh_path(spark, "workspace")
    newest = naive_bayes(spark, sf)
    older = replace(newest, intercepts=(0.0, -50.0))
    for version, model in ((1, older), (2, newest)):
        path = jobs.model_version_path(space, version)
        model.save(path)
        jobs.register_model(spark, space, version, path)
    out = fresh_path(spark, "stream-newest")
    rows = _document_stream(spark, sf).select("doc_id", "text")
    streams.score_stream_newest(rows, space, out, f"{out}-checkpoint", LEXICON, DOC_CLEAN).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "model_version", "predicted_label", r6("positive_score"))


# ---- guards, files and cuts --------------------------------------------------------------------


_COLUMNS_SAID = "The table has no column nope; it has doc_id, text, lang, source, n_chars."


@query(f"""SELECT guard, message, n FROM (VALUES ('columns', '{_COLUMNS_SAID}'), ('rows', 'The table holds no row.'), ('metric', 'test_f1_weighted'),
('unknown metric', 'refused')) AS g(guard, message), (SELECT count(*) AS n FROM documents)""")
def guard_messages(spark, sf):
    """What the guards say to the documents: missing columns, no rows, names of metrics."""
    docs = table(spark, sf, "documents")
    said = {"metric": metrics.score_column("f1_weighted")}
    guards = {
        "columns": lambda: require_columns(docs, ["text", "nope"]),
        "rows": lambda: require_rows(docs.filter(F.col("doc_id") < -1)),
        "unknown metric": lambda: metrics.score_column("auc"),
    }
    for name, guard in guards.items():
        try:
            guard()
            said[name] = "passed"
        except ValueError as error:
            said[name] = "refused" if name == "unknown metric" else str(error)
    passed = require_rows(require_columns(docs, ["doc_id", "text"]))
    n = passed.count()
    return spark.createDataFrame([(k, v, n) for k, v in said.items()], "guard string, message string, n long")


_OWN_POSITIVE, _OWN_WEIGHTS = ("best", "time", "worthless"), {"best": 2.5, "worthless": 0.25}


@query(f"""WITH t AS (SELECT doc_id, {sql.tokens('text')} AS toks FROM documents)
SELECT doc_id, round({sql.cue_sum('toks', _OWN_POSITIVE, _OWN_WEIGHTS)}, 6) AS positive, round({sql.negative_sum('toks')}, 6) AS negative,
round({sql.positive_sum('toks')}, 6) AS kept FROM t""")
def lexicon_from_file(spark, sf):
    """A lexicon file whose entries replace those of the defaults, one by one; a file that is no mapping changes nothing."""
    path, broken = fresh_path(spark, "lexicon"), fresh_path(spark, "lexicon")
    entries = json.dumps({"positive_cues": list(_OWN_POSITIVE), "positive_weights": _OWN_WEIGHTS, "unknown": 1})
    for folder, content in ((path, entries), (broken, "[1, 2]")):
        spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(folder)
    own = read_lexicon(spark, path, LEXICON)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        kept = read_lexicon(spark, broken, LEXICON)
    tokens = documents(spark, sf).select("doc_id", text.clean_tokens(F.col("text")).alias("t"))
    return tokens.select(
        "doc_id", r6(own.cue_sum(F.col("t"), "positive"), "positive"), r6(own.cue_sum(F.col("t"), "negative"), "negative"),
        r6(kept.cue_sum(F.col("t"), "positive"), "kept"),
    )


@query(f"""WITH f AS ({fixtures.PREDICTIONS}), o(ordinal, cut) AS (VALUES {', '.join(f'({i}, CAST({c} AS DOUBLE))' for i, c in enumerate(_CUTS))}),
a AS (SELECT ordinal, cut, avg(CASE WHEN (p_positive >= cut) = (label = 'positive') THEN 1.0 ELSE 0.0 END) AS acc FROM f, o GROUP BY ALL),
best AS (SELECT * FROM a ORDER BY round(acc, 12) DESC, ordinal LIMIT 1)
SELECT 'cut' || a.ordinal AS model, round(a.acc, 6) AS test_accuracy, CAST(a.cut AS VARCHAR) AS param, 'accuracy' AS primary_metric,
'cut' || best.ordinal AS best_name, round(best.acc, 6) AS best_score, 'somewhere' AS artifact_path, 'cut' || best.ordinal AS estimator FROM a, best""")
def report_rows(spark, sf):
    """The model report written as JSON and read back: one entry a model, and the best one."""
    parts = []
    for i, c in enumerate(_CUTS):
        row = metrics.weighted_metrics(_predictions(spark, sf, c), "label", "said")
        params = F.create_map(F.lit("cut"), F.lit(str(float(c))))
        parts.append(row.select(F.lit(f"cut{i}").alias("name"), F.lit(i).alias("ordinal"), F.lit(0.5).alias("cv_best_score"), "*", params.alias("best_params")))
    scores = reduce(DataFrame.unionByName, parts)
    best = metrics.best_model(scores, "accuracy").first()["name"]
    path = writers.write_report(search.model_report(scores, best, "accuracy", "somewhere"), fresh_path(spark, "report"))
    read = spark.read.schema(
        "primary_metric string, best_model struct<name:string,score:double,artifact_path:string,estimator:string,best_params:map<string,string>>, "
        "models map<string,struct<cv_best_score:double,test_accuracy:double,best_params:map<string,string>>>"
    ).json(path)
    return read.select("*", F.explode("models").alias("model", "entry")).select(
        "model", r6("entry.test_accuracy", "test_accuracy"), F.try_element_at("entry.best_params", F.lit("cut")).alias("param"), "primary_metric",
        F.col("best_model.name").alias("best_name"), r6("best_model.score", "best_score"), "best_model.artifact_path", "best_model.estimator",
    )


@query(f"""WITH {sql.corpus_ctes().replace('LIMIT 50000', 'LIMIT 700')} SELECT term, idx, df, tf, round(idf, 6) AS idf FROM vocab""")
def vocabulary_cut(spark, sf):
    """The most frequent terms where the cut bites, ties by term."""
    small = replace(DOC_FEATURES, max_features=700)
    return features.fit_tfidf(corpus(spark, sf), small).vocabulary.select("term", "idx", "df", "tf", r6("idf"))


@query(f"""WITH {sql.corpus_ctes()}, {_DOC_UNITS}, {sql.score_ctes('doc_id', 'docs', 's')},
z AS (SELECT doc_id, z0, z1, (z0 + z1) / 2 + CAST(0.05 AS DOUBLE) AS z2 FROM s)
SELECT doc_id, round(greatest(z0, z1, z2), 6) AS margin, round(1 / (1 + exp(-greatest(z0, z1, z2))), 6) AS positive,
CASE WHEN z0 >= z1 AND z0 >= z2 THEN 'negative' WHEN z1 >= z2 THEN 'positive' ELSE 'mixed' END AS label FROM z""")
def margin_of_three(spark, sf):
    """Three machines: the margin is that of the winning class."""
    nb = naive_bayes(spark, sf)
    w, (b0, b1) = F.col("w"), nb.intercepts
    third = (F.get(w, F.lit(0)) + F.get(w, F.lit(1))) / 2
    table_ = nb.weights.select("term", "idx", "idf", F.concat(w, F.array(third)).alias("w"))
    model = models.LinearTextModel(table_, (*CLASSES, "mixed"), (b0, b1, (b0 + b1) / 2 + 0.05), models.MARGIN, nb.vocabulary_size)
    rows = _document_scores(spark, sf, model).withColumn("seen", model.observe(F.col("scores")))
    return rows.select("doc_id", r6("seen.margin", "margin"), r6("seen.positive", "positive"), "seen.label")


@query(f"""WITH {_BAYES_SEARCH} SELECT 'MultinomialNB' AS best, CAST(alpha AS VARCHAR) AS alpha, round(mean, 6) AS cv_best_score, round(accuracy, 6) AS test_accuracy,
round(f1, 6) AS test_f1_weighted, CAST(2 AS INT) AS model_version, (SELECT count(*) FROM vocab) AS terms
FROM means JOIN (SELECT * FROM scored_parts WHERE part = 3) USING (alpha) WHERE alpha IN (FROM picked)""")
def retrain_report(spark, sf):
    """Raw versions to a registered model, twice: the report of the second run and the model that scorers pick up."""
    raw, space = fresh_path(spark, "raw"), fresh_path(spark, "workspace")
    labelled = fixture(spark, sf, fixtures.CORPUS)
    for version in (1, 2):
        versions.publish_version(labelled, raw, version, "upload", sf, replace_existing=False)
        paths = jobs.retrain(spark, raw, space, version, DOC_CLEAN, DOC_FEATURES, TrainConfig(models=("MultinomialNB",)))
    version, model = jobs.newest_model(spark, space)
    score = "cv_best_score:double,test_accuracy:double,test_f1_weighted:double,best_params:map<string,string>"
    report = spark.read.schema(f"best_model struct<name:string>, models map<string,struct<{score}>>").json(paths["report"])
    entry = F.try_element_at("models", F.lit("MultinomialNB"))
    return report.select(
        F.col("best_model.name").alias("best"), F.try_element_at(entry["best_params"], F.lit("alpha")).alias("alpha"),
        r6(entry["cv_best_score"], "cv_best_score"), r6(entry["test_accuracy"], "test_accuracy"), r6(entry["test_f1_weighted"], "test_f1_weighted"),
        F.lit(version).alias("model_version"), F.lit(model.weights.count()).cast("bigint").alias("terms"),
    )
