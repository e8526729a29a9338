"""Guards, CSV and versioned sources, pages, streams against their batch twins, registered queries."""

from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from checks import compare, queries
from sentilake.config import CleanConfig
from sentilake.operators import checks as guards
from sentilake.operators import cleaning, models, pages, results, scoring
from sentilake.plans import jobs
from sentilake.sources import readers, versions, writers
from sentilake.streaming import streams

SF = "/root/testdata/sf0.001"


def write_csv(folder, name, body):
    (folder / name).write_text(body)
    return str(folder / name)


def test_required_columns(spark):
    df = spark.createDataFrame([("a", 1)], "text string, other int")
    with pytest.raises(ValueError, match="no column a, sentiment; it has text, other"):
        guards.require_columns(df, ["text", "sentiment", "a"])
    with pytest.raises(ValueError, match="holds no row"):
        guards.require_rows(df.limit(0))


def test_raw_csv(spark, tmp_path):
    path = write_csv(tmp_path, "raw.csv", 'text,sentiment,extra\n"Great, ""big""\nscreen",positive,1\n,negative,2\n123,,3\n')
    rows = readers.read_raw_csv(spark, path).collect()
    assert [tuple(r) for r in rows] == [('Great, "big"\nscreen', "positive", 1), (None, "negative", 2), ("123", None, 3)]
    with pytest.raises(ValueError, match="has no column"):
        readers.read_raw_csv(spark, write_csv(tmp_path, "odd.csv", "a,b\n1,2\n"))
    with pytest.raises(ValueError, match="no row"):
        readers.read_raw_csv(spark, write_csv(tmp_path, "none.csv", "text,sentiment\n"))
    out = jobs.clean_csv(spark, path, str(tmp_path / "clean"))
    got = readers.read_cleaned(spark, out).collect()
    assert [(r.extra, r.text_clean) for r in got] == [(1, "great big screen")]
    with pytest.raises(ValueError, match="No rows were written"):
        jobs.clean_csv(spark, write_csv(tmp_path, "blank.csv", "text,sentiment\n 12 ,x\n"), str(tmp_path / "blank"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.read_cleaned(spark, str(tmp_path / "missing"))


def test_plain_lines_are_split_and_quoted_line_breaks_found(spark, tmp_path):
    plain = write_csv(tmp_path, "plain.csv", "text,sentiment\n" + "".join(f'"good, ""{n}""",x\n' for n in range(20_000)))
    broken = write_csv(tmp_path, "broken.csv", 'text,sentiment\nplain,x\n"two\n\nlines",y\n')
    assert not readers.has_line_breaks(spark, plain) and readers.has_line_breaks(spark, broken)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
        rows = readers.read_raw_csv(spark, plain)
        assert rows.rdd.getNumPartitions() > 4 and rows.count() == 20_000
        numbered = readers.number_rows(rows, "id")
        assert [r.text for r in numbered.orderBy("id").limit(3).collect()] == ['good, "0"', 'good, "1"', 'good, "2"']
        assert [r.text for r in numbered.orderBy(F.col("id").desc()).limit(1).collect()] == ['good, "19999"']
        assert readers.read_raw_csv(spark, plain, multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r.text for r in readers.read_raw_csv(spark, broken).collect()] == ["plain", "two\n\nlines"]


def test_upload_guards(spark, tmp_path):
    good = write_csv(tmp_path, "up.csv", "id,review\n1,good camera\n2,\n")
    assert readers.read_upload(spark, good, "review").count() == 2
    for path, column, message in [
        (good, "  ", "Name the column"),
        (str(tmp_path / "up.txt"), "review", "end in .csv"),
        (write_csv(tmp_path, "zero.csv", ""), "review", "no header"),
        (good, "text", "no column text; it has id, review"),
        (str(tmp_path / "nothing.csv"), "review", "cannot be read as CSV"),
    ]:
        with pytest.raises(ValueError, match=message):
            readers.read_upload(spark, path, column)


def test_dedup_keeps_the_first_of_a_hot_text(spark):
    rows = spark.range(9000).select(F.col("id").alias("review_id"), F.when(F.col("id") % 3 > 0, "same good text").otherwise(F.concat(F.lit("good "), F.col("id") % 700)).alias("text"))
    cfg = CleanConfig(deduplicate_on_text=True)
    got = {r.review_id for r in cleaning.clean_reviews(rows, cfg).collect()}
    first = {}
    for r in rows.collect():
        first[r.text] = min(r.review_id, first.get(r.text, r.review_id))
    assert got == set(first.values())


def test_blank_rows_can_be_kept(spark):
    rows = spark.createDataFrame([(1, None), (2, "bad bugs")], "review_id long, text string")
    kept = cleaning.clean_reviews(rows, CleanConfig(drop_empty_rows=False)).orderBy("review_id").collect()
    assert [(r.text, r.text_clean) for r in kept] == [("", ""), ("bad bugs", "bad bug")]
    plan = cleaning.clean_reviews(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") < 10 and "Exchange" not in plan


def test_versions(spark, tmp_path):
    path = str(tmp_path / "set")
    for v in (1, 2):
        versions.publish_version(spark.range(v), path, v, "job", "raw", replace_existing=False)
    assert versions.newest(spark, path).version == writers.newest_version(versions.read_versions(spark, path)) == 2
    assert readers.require_rows(versions.read_latest(spark, path)).count() == 2
    assert versions.read_latest(spark, path).columns == ["id"]
    versions.publish_version(spark.range(7), path, 3, "job", "raw", replace_existing=True)
    assert versions.read_versions(spark, path).select("version").distinct().count() == 1


@pytest.mark.parametrize("ids", [range(0, 100), range(0, 10_000_000, 99_991), [5, 70_000, 70_001, 1 << 40]])
def test_pages_cover_the_table(spark, ids):
    ids = list(ids)
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "review_id long")
    size = 7
    seen = []
    for n in range(1, min(4, -(-len(ids) // size)) + 1):
        page = pages.page_of(df, "review_id", n, size)
        assert page.total == len(ids)
        seen += [r.review_id for r in page.rows.collect()]
    assert seen == ids[: len(seen)]
    last = -(-len(ids) // size)
    assert [r.review_id for r in pages.page_of(df, "review_id", last, size).rows.collect()] == ids[(last - 1) * size :]
    assert pages.page_of(df, "review_id", last + 1, size).rows.count() == 0
    with pytest.raises(ValueError):
        pages.page_of(df, "review_id", 0, size)


def test_pages_of_ids_of_other_types_and_of_sparse_ids(spark, monkeypatch):
    """Small ranges, so that they are cut again and again."""
    import datetime
    import decimal

    monkeypatch.setattr(pages, "RANGE_ROWS", 8)
    monkeypatch.setattr(pages, "SAMPLE", 16)
    monkeypatch.setattr(pages, "CUTS", 4)
    monkeypatch.setattr(pages, "RUNS", 4)
    day = datetime.date(2020, 1, 1)
    kinds = {
        "string": [f"é{n * 7919 % 1000:04d}" if n % 3 else f"z{n}" for n in range(150)],
        "date": [day + datetime.timedelta(days=n * n) for n in range(120)],
        "decimal(20,2)": [decimal.Decimal(n * 37 - 900) / 4 for n in range(130)],
        "double": [n / 7 - 3 for n in range(110)],
        "long": [n * n * n * 10**12 - 10**18 for n in range(140)],
    }
    for kind, ids in kinds.items():
        ids = [*ids, None]
        df = spark.createDataFrame([(i, n) for n, i in enumerate(reversed(ids))], f"review_id {kind}, n int").repartition(3)
        want = [r.review_id for r in df.orderBy("review_id").collect()]
        for page, size in ((1, 7), (2, 7), (12, 9), (3, 40), (1, 500), (99, 5), (len(ids), 1)):
            got = pages.page_of(df, "review_id", page, size)
            assert got.total == len(ids)
            assert [r.review_id for r in got.rows.collect()] == want[(page - 1) * size : page * size], (kind, page, size)


def test_stored_pages(spark, tmp_path):
    ids = [f"r{n * 7919 % 1000:04d}" for n in range(1000)] + [None, "r0007"]
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "review_id string, n int").repartition(5)
    stored = pages.store_pages(df, "review_id", str(tmp_path / "pages"), rows_per_range=90)
    assert stored.index().count() > 5
    want = [r.review_id for r in df.orderBy("review_id").collect()]
    for page, size in ((1, 10), (50, 10), (3, 250), (1, 5000), (101, 10), (102, 10), (1002, 1)):
        got = stored.page(page, size)
        assert got.total == 1002 and got.rows.columns == ["review_id", "n"]
        assert [r.review_id for r in got.rows.collect()] == want[(page - 1) * size : page * size]
    plan = stored.page(50, 10).rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GreaterThanOrEqual(_place" in plan
    again = pages.PagedTable(spark, str(tmp_path / "pages"))
    assert {r.n for r in again.page(1, 5000).rows.collect()} == set(range(1002))
    empty = pages.store_pages(df.limit(0), "review_id", str(tmp_path / "none")).page()
    assert empty.total == 0 and empty.rows.count() == 0
    with pytest.raises(ValueError):
        stored.page(0)
    with pytest.raises(ValueError, match="taken"):
        pages.store_pages(df.withColumn("_place", F.lit(1)), "review_id", str(tmp_path / "x"))


def test_page_filter_reaches_the_scan(spark):
    page = pages.page_of(spark.read.parquet(f"{SF}/events.parquet"), "event_id", 2, 10)
    plan = page.rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), GreaterThanOrEqual(event_id,0), LessThan(event_id,65536)]" in plan


def test_empty_page_document(spark):
    empty = spark.createDataFrame([], "review_id long, review string")
    doc = pages.page_document(pages.page_of(empty, "review_id", 1, 10), "review_id").first().document
    assert doc == '{"total":0,"page":1,"per_page":10,"results":[]}'


def test_display_defaults(spark):
    rows = spark.createDataFrame(
        [(1, "x" * 81, "", 1.2, -0.1, 0.555), (2, "y" * 80, "Positive", None, 0.25, 0.5)],
        "id long, review string, overall_sentiment string, positive_score double, negative_score double, confidence double",
    )
    a, b = results.display_rows(rows, "id").collect()
    assert a.preview == "x" * 80 + "..." and (a.label, a.tone) == ("unknown", "negative")
    assert (a.positive_width, a.negative_width, a.confidence_pct) == (100.0, 0.0, 55.5)
    assert b.preview == "y" * 80 and b.tone == "positive" and b.positive_pct is None and b.positive_width == 0.0


@pytest.fixture(scope="module")
def bayes(spark):
    return queries.naive_bayes(spark, SF)


def test_annotated_csv_keeps_order(spark, tmp_path, bayes):
    body = "review,n\n" + "".join(f'"good camera {i}, ok",{i}\n' if i % 4 else f",{i}\n" for i in range(200))
    out = jobs.annotate_csv(spark, write_csv(tmp_path, "in.csv", body), "review", str(tmp_path / "out"), bayes)
    rows = spark.read.option("header", True).option("escape", '"').csv(out)
    assert rows.columns == ["review", "n", *results.ANNOTATION_COLUMNS]
    in_files = rows.select("n", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("m")).collect()
    assert [int(r.n) for r in sorted(in_files, key=lambda r: (r.f, r.m))] == list(range(200))


def test_streams_equal_batch(spark, tmp_path, bayes):
    folder = tmp_path / "in"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("review_id"), "text")
    docs.repartition(4).write.parquet(str(folder))
    source = streams.read_files(spark, str(folder), docs.schema, max_files_per_trigger=2)
    cfg = CleanConfig()

    query = streams.clean_stream(source, str(tmp_path / "clean"), str(tmp_path / "c1"), cfg)
    query.awaitTermination()
    assert sum(p.observedMetrics["written"].rows for p in query.recentProgress if p.observedMetrics) == 200
    got = spark.read.parquet(str(tmp_path / "clean")).select("review_id", "text_clean")
    want = cleaning.clean_reviews(docs, cfg).select("review_id", "text_clean")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

    for v, intercepts in ((1, (0.0, 0.0)), (2, bayes.intercepts)):
        path = jobs.model_version_path(str(tmp_path), v)
        replace(bayes, intercepts=intercepts).save(path)
        jobs.register_model(spark, str(tmp_path), v, path)
    streams.score_stream_newest(source, str(tmp_path), str(tmp_path / "scored"), str(tmp_path / "c2")).awaitTermination()
    scored = spark.read.parquet(str(tmp_path / "scored"))
    assert {r.model_version for r in scored.select("model_version").distinct().collect()} == {2}
    assert scored.select(streams.BATCH_COLUMN).distinct().count() == 2
    batch = scoring.score_reviews(docs, bayes, words=False)
    keep = ["review_id", "predicted_label", F.round("positive_score", 9).alias("p"), "overall_sentiment"]
    assert scored.select(keep).exceptAll(batch.select(keep)).isEmpty() and scored.count() == batch.count()
    with pytest.raises(ValueError, match="dedup_stream"):
        streams.clean_stream(source, "x", "y", CleanConfig(deduplicate_on_text=True))


def test_retrain_and_score_with_the_new_model(spark, tmp_path):
    from sentilake.config import FeatureConfig, TrainConfig

    rows = spark.createDataFrame(
        [(i, "lovely camera" if i % 2 else "awful sound", "positive" if i % 2 else "negative", 1) for i in range(40)],
        "review_id long, text string, sentiment string, stars int",
    )
    raw = str(tmp_path / "raw")
    versions.publish_version(rows, raw, 1, "upload", "x", replace_existing=False)
    for version in (1, 2):
        paths = jobs.retrain(
            spark, raw, str(tmp_path / "w"), version, feature_cfg=FeatureConfig(), train_cfg=TrainConfig(models=("MultinomialNB",))
        )
    version, model = jobs.newest_model(spark, str(tmp_path / "w"))
    assert version == 2 and paths["model"].endswith("version=2")
    got = scoring.score_reviews(rows.limit(2), model).collect()
    assert {r.predicted_label for r in got} == {"positive", "negative"}
    report = spark.read.json(paths["report"]).first()
    assert report.best_model.name == "MultinomialNB"


def test_entry_and_registry(spark):
    assert entry_point.entry(spark).count() == 200
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", ["clean_text", "dedup_text", "aspect_names", "tfidf", "stratified_split", "annotated", "stream_dedup"])
def test_registered_query_equals_oracle(spark, name):
    con = compare.duckdb_views(SF)
    q = queries.QUERIES[name]
    assert compare.spark_rows(q.run(spark, SF)) == compare.oracle_rows(con, q.oracle)


@pytest.mark.parametrize(
    "name", ["stream_clean", "stream_counts", "stream_dedup", "stream_score", "stream_with_lemmas", "stream_newest_model"]
)
def test_streams_read_tables_that_are_folders_of_files(spark, tmp_path, name):
    for table in ("documents", "labels", "orders"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    q = queries.QUERIES[name]
    assert compare.spark_rows(q.run(spark, str(tmp_path))) == compare.spark_rows(q.run(spark, SF))


def test_pages_of_ids_beyond_64_bits(spark, tmp_path):
    ids = [k * 10**33 - 5 * 10**36 for k in range(40)] + [10**37 - 1, 1 - 10**37, 0, 2**63, 2**63 + 1]
    df = spark.createDataFrame([(Decimal(i),) for i in ids] + [(None,)], "review_id decimal(37,0)")
    got = [r.review_id for n in range(1, 17) for r in pages.page_of(df, "review_id", n, 3).rows.collect()]
    assert got == [None, *sorted(map(Decimal, ids))]
    assert pages.page_of(df, "review_id", 1, 1).rows.first().review_id is None
    events = spark.range(0, 6_000_001, 100).select(F.col("id").alias("event_id"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    page = queries.QUERIES["page_sparse_ids"].run(spark, str(tmp_path)).collect()
    want = [(100 * k) ** 2 * 1000003 - 7000000000 for k in range(6000, 6030)]
    assert [(r.id, r.total) for r in page] == [(i, 60001) for i in want]


def test_pages_of_large_and_of_text_ids(spark):
    ids = [2**60 + 65536 * k - 1 for k in range(8)] + [2**63 - 1, -(2**63), -1]
    df = spark.createDataFrame([(i,) for i in ids], "review_id long")
    got = [r.review_id for n in range(1, 7) for r in pages.page_of(df, "review_id", n, 2).rows.collect()]
    assert got == sorted(ids)
    text = spark.createDataFrame([(f"r{i:02d}",) for i in range(9)], "review_id string")
    page = pages.page_of(text, "review_id", 2, 4)
    assert page.total == 9 and [r.review_id for r in page.rows.collect()] == ["r04", "r05", "r06", "r07"]


def test_publishing_a_version_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "versions")
    for version, n in ((1, 3), (2, 5), (2, 4)):
        versions.publish_version(spark.range(n), path, version, "job", "raw", replace_existing=False)
    counts = {r["version"]: r["count"] for r in versions.read_versions(spark, path).groupBy("version").count().collect()}
    assert counts == {1: 3, 2: 4}


def test_annotated_cells_keep_their_white_space(spark, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_annotated_csv(spark.createDataFrame([("  padded  ",)], "text string"), path)
    assert spark.read.option("header", True).csv(path).first().text == "  padded  "


def test_shared_folder_is_asked_for_off_one_machine():
    from sentilake.session import is_local

    assert is_local("local") and is_local("local[8]") and is_local("local[*]")
    assert not is_local("local-cluster[3,2,3000]") and not is_local("yarn") and not is_local("spark://host:7077")


def test_a_label_without_rows_is_refused(spark):
    from types import SimpleNamespace

    from sentilake.operators import models

    df = spark.createDataFrame([("good one", "positive")], "text_clean string, sentiment string")
    model = SimpleNamespace(cfg=SimpleNamespace(label_column="sentiment"))
    with pytest.raises(ValueError, match="No training row"):
        models.fit_naive_bayes(df, model, ("negative", "positive"))


def test_csv_stream_reads_quoted_line_breaks_like_a_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    path = write_csv(folder, "a.csv", 'text,sentiment\n"Great, ""big""\nscreen",positive\nplain,negative\n')
    batch = readers.read_raw_csv(spark, path)
    arriving = streams.read_files(spark, str(folder), batch.schema, "csv")
    out = str(tmp_path / "out")
    streams.clean_stream(arriving, out, str(tmp_path / "check")).awaitTermination()
    want = {(r.text, r.text_clean) for r in cleaning.clean_reviews(batch).collect()}
    assert {(r.text, r.text_clean) for r in spark.read.parquet(out).collect()} == want and len(want) == 2


def test_a_failed_publish_leaves_what_stood(spark, tmp_path):
    path = str(tmp_path / "set")
    versions.publish_version(spark.range(3), path, 1, "job", "raw")
    broken = spark.range(5).withColumn("id", F.when(F.col("id") > 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        versions.publish_version(broken, path, 2, "job", "raw", replace_existing=True)
    assert versions.newest(spark, path).version == 1 and versions.read_latest(spark, path).count() == 3
    done = versions.publish_version(spark.range(4), path, 2, "job", "raw", replace_existing=True)
    assert (done.number, done.rows) == (2, 4) and list(versions.commits(spark, path)) == [2]
    # the replaced folder is gone, the failed one is named by no record
    assert not list((tmp_path / "set" / "version=1").glob("attempt=*/*.parquet"))
    assert versions.read_versions(spark, path).count() == 4
    with pytest.raises(ValueError, match="committed"):
        versions.read_versions(spark, path, [1])
    with pytest.raises(ValueError, match="committed"):
        versions.newest(spark, str(tmp_path / "nothing"))


def test_records_of_other_writers_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "set")
    first = versions.publish_version(spark.range(3), path, 1, "job", "raw")
    (tmp_path / "set" / "_commits" / "000000000002.json").write_text('{"number": 2, "ver')
    second = versions.publish_version(spark.range(2), path, 2, "job", "raw", replace_existing=False)
    assert second.number == 3 and set(versions.commits(spark, path)) == {1, 2}
    again = versions.publish_version(spark.range(3).repartition(3), path, 5, "job", "raw", replace_existing=False)
    assert again.digest == first.digest != second.digest


def test_the_newest_version_is_read_without_a_job(spark, tmp_path):
    path = str(tmp_path / "set")
    for v in (1, 2, 10):
        versions.publish_version(spark.range(v), path, v, "job", "raw", replace_existing=False)
    spark.sparkContext.setJobGroup("newest-version", "newest version")
    assert versions.newest(spark, path).version == 10
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("newest-version")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
