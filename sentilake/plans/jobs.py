"""The user-facing jobs: clean, build features, train, retrain, score, page, annotate."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentilake.config import CleanConfig, FeatureConfig, TrainConfig
from sentilake.functions import text
from sentilake.functions.lexicon import Lexicon
from sentilake.operators import search
from sentilake.operators.checks import classes_of, require_columns, require_rows
from sentilake.operators.cleaning import clean_reviews
from sentilake.operators.features import TfidfModel, fit_tfidf, tfidf_long
from sentilake.operators.models import LinearTextModel
from sentilake.operators.pages import Page, PagedTable, page_of, store_pages
from sentilake.operators.results import ANNOTATION_COLUMNS, annotation_columns, result_rows
from sentilake.operators.scoring import row_error, score_reviews
from sentilake.operators.splitting import assign_split
from sentilake.session import cut_lineage, kept_once
from sentilake.sources import readers, versions, writers


@dataclass(frozen=True)
class Features:
    """Labelled rows with their split, and the TF-IDF fitted on the training part."""

    rows: DataFrame
    tfidf: TfidfModel
    labels: tuple[str, ...]

    @property
    def train(self) -> DataFrame:
        return self.rows.filter(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter(F.col("split") == "test")

    def long(self) -> DataFrame:
        """(id, label, split, term, idx, count, tfidf) of both parts."""
        return tfidf_long(self.rows, self.tfidf, self.tfidf.cfg.label_column, "split")


@dataclass(frozen=True)
class Trained:
    """The outcome of a model search."""

    model: LinearTextModel
    best: str
    scores: DataFrame
    report: DataFrame


def clean_csv(
    spark: SparkSession,
    raw_path: str,
    out_path: str,
    cfg: CleanConfig = CleanConfig(),
    multi_line: bool | None = None,
    types: Mapping[str, str] | None = None,
) -> str:
    """Raw CSV to cleaned Parquet. Line mode and types are those of ``read_raw_csv``."""
    raw = readers.read_raw_csv(spark, raw_path, cfg, multi_line=multi_line, types=types)
    if cfg.deduplicate_on_text and cfg.id_column not in raw.columns:
        raw = readers.number_rows(raw, cfg.id_column)
    return writers.write_cleaned(clean_reviews(raw, cfg), out_path)


def publish_cleaned(
    spark: SparkSession, raw_path: str, cleaned_path: str, version: int, cfg: CleanConfig = CleanConfig()
) -> str:
    """Newest raw version in, cleaned and published version out."""
    raw = require_columns(require_rows(versions.read_latest(spark, raw_path)), [cfg.text_column])
    cleaned = require_rows(clean_reviews(raw, cfg), "No review is left after cleaning.")
    versions.publish_version(cleaned, cleaned_path, version, "clean_reviews", raw_path)
    return cleaned_path


def build_features(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> Features:
    """Split first, then fit the vocabulary on the training part only.

    The rows are written once to the shared folder: split, folds, vocabulary and vectors read them about ten times, and would clean
    every text anew each time. They stay there, as what is returned reads them.
    """
    require_columns(df, [cfg.id_column, cfg.text_column, cfg.label_column])
    labelled = df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (cfg.text_column, cfg.label_column)}
    )
    labelled = kept_once(labelled, "labelled-rows")
    rows = assign_split(labelled, cfg.id_column, cfg.label_column, cfg.test_size, cfg.seed, cfg.stratify)
    labels = tuple(classes_of(rows, cfg.label_column))
    return Features(rows, fit_tfidf(rows.filter(F.col("split") == "train"), cfg), labels)


def train_and_select(features: Features, cfg: TrainConfig = TrainConfig(), artifact_path: str = "") -> Trained:
    """Search every model, evaluate on the test part, keep the best by the primary metric."""
    search.score_column(cfg.primary_metric)
    spark = features.rows.sparkSession
    train = search.training_vectors(features.train, features.tfidf, features.labels, cfg)
    test = search.training_vectors(features.test, features.tfidf, features.labels, cfg)
    tuned = search.tune(search.search_space(cfg), train, test, len(features.labels), cfg)
    best = search.pick_best(tuned, cfg.primary_metric)
    scores = search.score_table(tuned, spark)
    report = search.model_report(scores, best.name, cfg.primary_metric, artifact_path)
    return Trained(search.as_text_model(best.model, features.tfidf, features.labels), best.name, scores, report)


def retrain(
    spark: SparkSession,
    raw_path: str,
    workspace: str,
    version: int,
    clean_cfg: CleanConfig = CleanConfig(),
    feature_cfg: FeatureConfig = FeatureConfig(),
    train_cfg: TrainConfig = TrainConfig(),
) -> dict[str, str]:
    """Raw versions to a new model version: clean, publish, features, search, save, report."""
    cleaned_path = publish_cleaned(spark, raw_path, f"{workspace}/cleaned", version, clean_cfg)
    cleaned = require_columns(versions.read_latest(spark, cleaned_path), [feature_cfg.text_column, feature_cfg.label_column])
    features = build_features(cleaned, feature_cfg)
    model_path = model_version_path(workspace, version)
    trained = train_and_select(features, train_cfg, model_path)
    trained.model.save(model_path)
    report_path = writers.write_report(trained.report, f"{workspace}/report/version={version}")
    # Registering comes last: a reader sees a version only when all its parts are written.
    register_model(spark, workspace, version, model_path)
    return {"cleaned": cleaned_path, "model": model_path, "report": report_path}


def model_version_path(workspace: str, version: int) -> str:
    return f"{workspace}/models/data/version={version}"


def register_model(spark: SparkSession, workspace: str, version: int, path: str) -> None:
    """Make a fully written model visible to scorers."""
    entry = spark.createDataFrame([(version, path)], "version int, path string").coalesce(1)
    entry.write.mode("append").parquet(f"{workspace}/models/registry")


def newest_model(spark: SparkSession, workspace: str) -> tuple[int, LinearTextModel]:
    """The newest registered model; a scorer calls this to pick up a retrained one."""
    registry = spark.read.parquet(f"{workspace}/models/registry")
    row = writers.latest_rows(registry).first()
    return row["version"], LinearTextModel.load(spark, row["path"])


def score_page(
    df: DataFrame,
    model: LinearTextModel,
    page: int = 1,
    per_page: int = 10,
    lexicon: Lexicon = Lexicon(),
    cfg: CleanConfig = CleanConfig(),
) -> Page:
    """One page of scored reviews. Rows that cannot be scored are left out of rows and total.

    Which rows can be scored is known from the text alone, so the page is cut first and only
    its reviews are scored.
    """
    raw = text.as_text(F.col(cfg.text_column))
    scorable = df.filter(row_error(raw, text.clean_tokens(raw, cfg)).isNull())
    cut = page_of(scorable.select(cfg.id_column, cfg.text_column), cfg.id_column, page, per_page)
    scored = score_reviews(cut_lineage(cut.rows), model, lexicon, cfg, words=False)
    return replace(cut, rows=result_rows(scored, cfg.id_column))


def score_upload(
    spark: SparkSession,
    path: str,
    text_column: str,
    model: LinearTextModel,
    model_version: int | str,
    workspace: str,
    lexicon: Lexicon = Lexicon(),
    cfg: CleanConfig = CleanConfig(),
    multi_line: bool | None = None,
) -> PagedTable:
    """A caller's CSV scored once and stored for paging, in the order of the file; rows that cannot be scored are left out.

    The stored table is found again by the digest of the rows, the model's version and the digest of lexicon and
    settings, so further pages and repeated uploads score nothing. A fill that fails leaves nothing behind that a reader would find.
    """
    named = replace(cfg, text_column=text_column, id_column="_row_id")
    upload = readers.read_upload(spark, path, text_column, multi_line)
    numbered = readers.number_rows(upload, "_row_id")
    cells = F.xxhash64(*[F.col(f"`{c}`") for c in numbered.columns])
    seen = numbered.agg(F.count("*"), F.sum(cells.cast("decimal(38,0)")), F.bit_xor(cells)).first()
    asked = json.dumps([*map(str, seen), text_column, str(model_version), asdict(lexicon), asdict(named)], sort_keys=True, default=str)
    key = hashlib.sha256(asked.encode()).hexdigest()
    home = f"{workspace}/pages/{key}"
    stored = versions.commits(spark, home)
    if stored:
        return PagedTable(spark, stored[max(stored)].folder)
    folder = f"{home}/attempt={uuid.uuid4().hex}"
    scored = score_reviews(numbered.select("_row_id", text_column), model, lexicon, named, words=False)
    table = store_pages(result_rows(scored, "_row_id"), "_row_id", folder)
    versions.commit_folder(spark, home, 1, folder, table.page(1, 1).total, key, "score_upload", path)
    return table


def score_upload_page(
    spark: SparkSession,
    path: str,
    text_column: str,
    model: LinearTextModel,
    model_version: int | str,
    workspace: str,
    page: int = 1,
    per_page: int = 10,
    lexicon: Lexicon = Lexicon(),
    cfg: CleanConfig = CleanConfig(),
) -> Page:
    """One page of a scored upload; the first page of an upload scores it, all others read."""
    return score_upload(spark, path, text_column, model, model_version, workspace, lexicon, cfg).page(page, per_page)


def annotate(
    df: DataFrame,
    model: LinearTextModel,
    lexicon: Lexicon = Lexicon(),
    cfg: CleanConfig = CleanConfig(),
    pairs: DataFrame | None = None,
    lemma_table: DataFrame | None = None,
) -> DataFrame:
    """All rows and columns of the caller's table plus five result columns.

    Input columns that carry the name of a result column are refused.
    """
    clash = sorted(set(df.columns) & set(ANNOTATION_COLUMNS))
    if clash:
        raise ValueError(f"Input columns collide with result columns: {clash}")
    scored = score_reviews(df, model, lexicon, cfg, pairs, words=False, carry=df.columns, lemma_table=lemma_table)
    return scored.select("carried.*", *annotation_columns())


def annotate_csv(
    spark: SparkSession,
    path: str,
    text_column: str,
    out_path: str,
    model: LinearTextModel,
    lexicon: Lexicon = Lexicon(),
    cfg: CleanConfig = CleanConfig(),
    keep_order: bool = True,
    multi_line: bool | None = None,
    lemma_table: DataFrame | None = None,
) -> str:
    """A caller's CSV in, the annotated CSV out, by default in the order of the input.

    The order is kept across part files by a range sort on the row id, never by one task.
    """
    named = replace(cfg, text_column=text_column, id_column="_row_id")
    numbered = readers.number_rows(readers.read_upload(spark, path, text_column, multi_line), "_row_id")
    rows = annotate(numbered, model, lexicon, named, lemma_table=lemma_table)
    ordered = rows.orderBy("_row_id") if keep_order else rows
    return writers.write_annotated_csv(ordered.drop("_row_id"), out_path)
