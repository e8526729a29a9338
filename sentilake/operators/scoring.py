"""Score whole review tables: overall label, aspect points, word sentiments.

Every text to be scored (the review, its clauses or opinions) is a *unit* of its review.
Reviews are placed by id once; term counts, unit sums, the regrouping per review and the
join back to the review all reuse that placement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentilake.config import CleanConfig
from sentilake.functions import aspects, rules, text
from sentilake.functions.lexicon import Lexicon
from sentilake.operators.checks import require_columns
from sentilake.operators.lemmas import with_lemmas
from sentilake.operators.models import LinearTextModel, score_units, unit_scores, word_lists, word_sentiments

# --- fixed values: messages of rows that cannot be scored ---
ERROR_BLANK = "Input sentence cannot be empty."
ERROR_EMPTY_CLEAN = "Sentence became empty after preprocessing. Provide richer text."

UNIT_TYPE = (
    "array<struct<unit:int,feature:string,evidence:string,tokens:array<string>,"
    "rule:struct<forced:double,positive_cues:double,negative_cues:double>>>"
)


def row_error(raw: Column, tokens: Column) -> Column:
    """Why a row cannot be scored, or null."""
    return F.when(text.is_blank(raw), F.lit(ERROR_BLANK)).when(F.size(tokens) == 0, F.lit(ERROR_EMPTY_CLEAN))


def pair_units(pairs: DataFrame, cfg: CleanConfig, lexicon: Lexicon, key: str) -> DataFrame:
    """(key, pair_units): aspect-opinion pairs of a review as scoring units, in text order."""
    context = F.when(F.col("opinion") != "", F.col("opinion")).otherwise(F.col("aspect"))
    own = [cfg.lemma_map] if cfg.lemma_map else []
    rows = pairs.select(key, "pos", "aspect", context.alias("context"), *own).withColumn(
        "cleaned", text.clean_tokens(F.col("context"), cfg)
    )
    rows = rows.withColumn("tokens", F.when(F.size("cleaned") > 0, F.col("cleaned")).otherwise(F.array("aspect")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "aspect", "context", "tokens")))
    return rows.groupBy(key).agg(ordered.alias("p")).select(
        key,
        F.transform(
            "p",
            lambda p, i: F.struct(
                (i + 1).cast("int").alias("unit"),
                p["aspect"].alias("feature"),
                p["context"].alias("evidence"),
                p["tokens"].alias("tokens"),
                rules.clause_rule(p["tokens"], lexicon).alias("rule"),
            ),
        )
        .cast(UNIT_TYPE)
        .alias("pair_units"),
    )


def review_units(
    df: DataFrame,
    cfg: CleanConfig,
    lexicon: Lexicon,
    pairs: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, input_text, tokens, units, carried) placed by id: one row per review, map-side work only.

    Reviews with aspect-opinion pairs use them as units; all others use their clauses.
    ``carried`` is a struct of further columns of the review, present if any are named.
    """
    key = cfg.id_column
    require_columns(df, [key, cfg.text_column, *carry])
    # A null id cannot be regrouped; it stops the job rather than losing the row.
    known_id = F.coalesce(F.col(key), F.raise_error(F.lit(f"null {key}")).cast(df.schema[key].dataType))
    rows = df.select(
        known_id.alias(key),
        text.as_text(F.col(cfg.text_column)).alias("input_text"),
        *([F.struct(*carry).alias("carried")] if carry else []),
        *([cfg.lemma_map] if cfg.lemma_map else []),
    )
    rows = rows.filter(F.col(key).isNotNull())
    rows = rows.withColumn("tokens", text.clean_tokens(F.col("input_text"), cfg))
    units = aspects.clause_units(F.col("input_text"), cfg, lexicon).cast(UNIT_TYPE)
    if cfg.remove_non_alpha:
        units = F.when(_no_clause_can_have_a_cue(lexicon), F.array().cast(UNIT_TYPE)).otherwise(units)
    if pairs is not None:
        if cfg.lemma_map:
            # An opinion's words may not stand in the text as they are: it is looked up in the review's map.
            pairs = pairs.join(rows.select(key, cfg.lemma_map), key)
        rows = rows.join(pair_units(pairs, cfg, lexicon, key), key, "left")
        units = F.when(F.col("pair_units").isNotNull(), F.col("pair_units")).otherwise(units)
    if cfg.text_column in carry:
        # The text travels once: it is taken from the carried columns after the exchange.
        placed = rows.select(key, "tokens", units.alias("units"), "carried").repartition(key)
        text_of = text.as_text(F.col("carried").getField(cfg.text_column))
        return placed.select(key, text_of.alias("input_text"), "tokens", "units", "carried")
    kept = ["carried"] if carry else []
    return rows.select(key, "input_text", "tokens", units.alias("units"), *kept).repartition(key)


def _no_clause_can_have_a_cue(lexicon: Lexicon) -> Column:
    """True when the clauses need no cleaning of their own, because none can hold a cue.

    Clause borders never fall inside a run of letters, so every token of a clause is a token of
    the review, unless a tag or an address is cut by a border. Text that may hold either one is
    never skipped. Holds only where everything but letters is removed.
    """
    raw = F.col("input_text")
    cuttable = raw.contains("<") | raw.contains("://") | raw.contains("www.")
    return ~cuttable & ~lexicon.has_signal(F.col("tokens"))


def score_reviews(
    df: DataFrame,
    model: LinearTextModel,
    lexicon: Lexicon = Lexicon(),
    cfg: CleanConfig = CleanConfig(),
    pairs: DataFrame | None = None,
    words: bool = True,
    carry: Sequence[str] = (),
    lemma_table: DataFrame | None = None,
) -> DataFrame:
    """The full observation record of every review; rows that cannot be scored carry ``error``.

    Ids must be unique; an id that repeats stops the job, as its reviews could not be told apart. ``words=False`` leaves out
    the per-word list. ``carry`` names input columns that travel along in the struct ``carried``. ``lemma_table`` (token,
    lemma) takes the place of the default lemmas in review, clauses and words; use the one that the model was trained with.
    """
    key = cfg.id_column
    if lemma_table is not None:
        df, cfg = with_lemmas(df, lemma_table, cfg)
    base = review_units(df, cfg, lexicon, pairs, carry)
    # Unit 0 is the review itself.
    every_unit = F.concat(
        F.array(F.struct(F.lit(0).alias("unit"), F.col("tokens"))),
        F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), u["tokens"].alias("tokens"))),
    )
    repeated = F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string"))).cast("boolean")
    whole = base
    if not words:
        # Counted where the rows are placed by id: what a Python function returns counts as placed nowhere, and would be shuffled again.
        counted = base.withColumn("_once", F.count(F.lit(1)).over(Window.partitionBy(key)) == 1)
        whole = counted.filter(F.when(F.col("_once"), F.lit(True)).otherwise(repeated)).drop("_once")
    if model.small():
        # Every unit is scored within its row: no row per unit, nothing to regroup or join.
        listed = whole.withColumn("_every", every_unit)
        found = unit_scores(F.col("_every.tokens"), model)
        joined = listed.withColumn("scores", F.map_from_arrays("_every.unit", found)).drop("_every")
    else:
        unit_rows = base.select(key, F.inline(_reading_whole_row(base, every_unit)))
        scored = (
            score_units(unit_rows, model, key)
            .groupBy(key)
            .agg(F.map_from_entries(F.collect_list(F.struct("unit", "scores"))).alias("scores"))
        )
        joined = whole.join(scored, key, "left")
    if words:
        # The rows meet the word lists in order of their ids anyway: the ids are counted alone.
        ids = base.select(key, _reading_whole_row(base, F.lit(1)).alias("_id"))
        joined = joined.join(ids.groupBy(key).agg((F.count("_id") == 1).alias("_once")), key, "left")
        joined = joined.filter(F.when(F.col("_once"), F.lit(True)).otherwise(repeated)).drop("_once")
        joined = joined.join(_word_lists(base, model, key), key, "left")
    return _observations(joined, model, lexicon, key, words)


def _reading_whole_row(base: DataFrame, array: Column) -> Column:
    """The array, tied to the other columns of the placed rows by a test that always holds.

    Every branch over the placed rows then asks for the same columns, so the planner sees one
    and the same exchange, and the reviews are cleaned and shuffled once instead of per branch.
    """
    always = (F.length("input_text") >= 0) & (F.size("units") >= 0) & (F.size("tokens") >= 0)
    if "carried" in base.columns:
        always = always & (F.hash("carried") >= F.lit(-(2**31)))
    return F.when(always, array)


def _word_lists(base: DataFrame, model: LinearTextModel, key: str) -> DataFrame:
    if model.small():
        return base.select(key, word_lists(_reading_whole_row(base, F.col("tokens")), model).alias("word_sentiments"))
    tokens = base.select(key, F.posexplode(_reading_whole_row(base, F.col("tokens"))).alias("pos", "token"))
    entry = F.struct("position", "word", "predicted_label", "positive", "negative")
    return (
        word_sentiments(tokens, model, key)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(entry)).alias("word_sentiments"))
    )


def _observations(joined: DataFrame, model: LinearTextModel, lexicon: Lexicon, key: str, words: bool) -> DataFrame:
    def scores_of(unit: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("scores"), unit), model.intercept_scores())

    def with_seen(u: Column) -> Column:
        return F.struct(u.alias("u"), scores_of(u["unit"]).alias("s"))

    def with_result(x: Column) -> Column:
        seen = x["seen"]
        result = rules.apply_clause_rule(x["u"]["rule"], seen["label"], seen["positive"], seen["negative"], lexicon)
        return F.struct(x["u"].alias("u"), result.alias("r"))

    def as_point(x: Column) -> Column:
        pair = F.struct(x["r"]["positive"].alias("positive"), x["r"]["negative"].alias("negative"))
        return F.struct(
            x["u"]["feature"].alias("feature"),
            x["r"]["sentiment"].alias("sentiment"),
            x["u"]["evidence"].alias("evidence"),
            F.when(x["r"]["positive"].isNotNull(), pair).alias("scores"),
        )

    kept = ["carried"] if "carried" in joined.columns else []
    with_scores = F.transform(F.transform("units", with_seen), lambda x: F.struct(x["u"].alias("u"), model.observe(x["s"]).alias("seen")))
    points = F.transform(F.transform(with_scores, with_result), as_point)
    rows = joined.select(
        key,
        "input_text",
        "tokens",
        row_error(F.col("input_text"), F.col("tokens")).alias("error"),
        scores_of(F.lit(0)).alias("_scores"),
        points.alias("_points"),
        *kept,
        *(["word_sentiments"] if words else []),
    )
    rows = rows.withColumn("_seen", model.observe(F.col("_scores")))
    ok = F.col("error").isNull()
    seen = F.col("_seen")
    label_map = F.map_from_arrays(F.array(*[F.lit(x) for x in model.labels]), seen["probabilities"])
    breakdown = F.struct(seen["positive"].alias("positive"), seen["negative"].alias("negative"))
    overall = rules.overall_label(seen["label"], seen["confidence"], seen["positive"], seen["negative"], lexicon)
    last_points = last_per_feature(F.col("_points"))
    # Per-feature scores come from the last point that has scores.
    last_scored = last_per_feature(F.filter("_points", lambda p: p["scores"].isNotNull()))
    empty_words = F.array().cast(
        "array<struct<position:int,word:string,predicted_label:string,positive:double,negative:double>>"
    )
    return rows.select(
        key,
        "input_text",
        F.when(ok, F.array_join("tokens", " ")).otherwise("").alias("cleaned_text"),
        F.when(ok, F.col("tokens")).otherwise(F.array().cast("array<string>")).alias("tokens"),
        F.when(ok, F.size("tokens")).otherwise(0).alias("token_count"),
        F.when(ok, F.array(F.lit(1), F.lit(model.vocabulary_size)))
        .otherwise(F.array().cast("array<int>"))
        .alias("embedding_shape"),
        F.when(ok, seen["label"]).otherwise("").alias("predicted_label"),
        F.when(ok, seen["raw"]).alias("predicted_raw"),
        F.when(ok, seen["confidence"]).alias("confidence"),
        F.when(ok & seen["probabilities"].isNotNull(), label_map).alias("class_probabilities"),
        F.when(ok, seen["margin"]).alias("decision_margin"),
        F.when(ok & seen["positive"].isNotNull(), breakdown).alias("sentiment_breakdown"),
        F.when(ok, seen["positive"]).alias("positive_score"),
        F.when(ok, seen["negative"]).alias("negative_score"),
        F.when(ok, overall).otherwise("").alias("overall_sentiment"),
        F.when(ok, F.map_from_entries(F.transform(last_points, lambda p: F.struct(p["feature"], p["sentiment"])))).alias(
            "aspect_sentiments"
        ),
        F.when(ok, F.map_from_entries(F.transform(last_scored, lambda p: F.struct(p["feature"], p["scores"])))).alias(
            "aspect_sentiment_scores"
        ),
        F.when(ok, F.col("_points")).alias("main_feature_points"),
        *([F.when(ok, F.coalesce("word_sentiments", empty_words)).alias("word_sentiments")] if words else []),
        "error",
        *kept,
    )


def last_per_feature(points: Column) -> Column:
    """Of points naming the same feature only the last one, in their order; the map form of the list.

    One sort by (feature, place): a point is the last of its feature where the next one has another. No point is compared with all
    others, so a review of many clauses costs no square.
    """
    placed = F.transform(points, lambda p, i: F.struct(p["feature"].alias("feature"), i.alias("at"), p.alias("p")))
    ordered = F.array_sort(placed)
    # zip_with evaluates each side once; an index into the sorted array inside a lambda would sort it for each element.
    with_next = F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), lambda x, y: F.struct(x.alias("x"), y["feature"].alias("next")))
    last = F.filter(with_next, lambda z: z["x"].isNotNull() & (z["next"].isNull() | (z["next"] != z["x"]["feature"])))
    in_order = F.array_sort(F.transform(last, lambda z: F.struct(z["x"]["at"].alias("at"), z["x"]["p"].alias("p"))))
    return F.transform(in_order, lambda z: z["p"])
