"""CSV types, last sentiment of long reviews, vectors of any vocabulary, counts read while batches arrive."""

import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sentilake.config import CleanConfig, FeatureConfig
from sentilake.operators import features, scoring
from sentilake.plans import jobs
from sentilake.sources import readers, versions
from sentilake.streaming import streams


def test_cell_types(spark):
    cells = {
        "whole": ["1", " -20 ", None, "", "NaN"], "number": ["1", "2.5", "1e-3", ".5", None], "truth": ["True", "false", None, "TRUE", ""],
        "mixed": ["1", "x", None, "2", "3"], "none": [None, "", "NA", None, "null"], "long": ["1" * 18, "-" + "9" * 18, "0", "0", "0"],
        "longer": ["1" * 19, "2", "3", "4", "5"], "both": ["True", "1", "0", "False", ""], "dot": [".", "1", "2", "3", "4"],
    }
    df = spark.createDataFrame(list(zip(*cells.values(), strict=True)), ", ".join(f"`{c}` string" for c in cells)).repartition(3)
    found = readers.cell_types(df, df.columns)
    assert found == {
        "whole": "bigint", "number": "double", "truth": "boolean", "mixed": "string", "none": "string", "long": "bigint",
        "longer": "double", "both": "string", "dot": "string",
    }
    typed = readers.with_types(df, found)
    assert {r.whole for r in typed.collect()} == {1, -20, None} and {r.truth for r in typed.collect()} == {True, False, None}
    assert {r.mixed for r in typed.collect()} == {"1", "x", None, "2", "3"}
    assert readers.cell_types(df.limit(0), ["whole"]) == {"whole": "string"}


def test_types_and_lines_pass_through_the_job(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('text,sentiment,stars,note\n"7",positive,3,a\n"great\nscreen",1,,b\n')
    out = jobs.clean_csv(spark, str(path), str(tmp_path / "out"), CleanConfig(remove_non_alpha=False, min_token_length=1))
    rows = spark.read.parquet(out)
    assert dict(rows.dtypes) == {"text": "string", "sentiment": "string", "stars": "bigint", "note": "string", "text_clean": "string"}
    assert {(r.text, r.sentiment, r.stars) for r in rows.collect()} == {("7", "positive", 3), ("great\nscreen", "1", None)}
    plain = readers.read_raw_csv(spark, str(path), types={})
    assert dict(plain.dtypes)["stars"] == "string"
    lines = tmp_path / "b.csv"
    lines.write_text("text,sentiment,stars\ngood,positive,1.5\nbad,negative,2\n")
    split = readers.read_raw_csv(spark, str(lines), multi_line=False, types={"stars": "double"})
    assert sorted(r.stars for r in split.collect()) == [1.5, 2.0]


def test_last_sentiment_of_a_review_of_many_clauses(spark):
    rng = random.Random(1)
    points = [(f"f{rng.randrange(5000)}", rng.choice(["positive", "negative"])) for _ in range(20_000)]
    rows = spark.createDataFrame([(1, points), (2, []), (3, None)], "id int, p array<struct<feature:string,sentiment:string>>")
    start = time.time()
    got = {r.id: r.l for r in rows.select("id", scoring.last_per_feature(F.col("p")).alias("l")).collect()}
    assert time.time() - start < 20
    last = {f: (n, s) for n, (f, s) in enumerate(points)}
    assert [(p.feature, p.sentiment) for p in got[1]] == [(f, s) for f, (_, s) in sorted(last.items(), key=lambda x: x[1][0])]
    assert got[2] == [] and got[3] is None


def test_vectors_by_join_equal_those_by_stages(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["good camera good", "bad camera", "zzz", "", "good screen bad screen"] * 4)]
    df = spark.createDataFrame(rows, "review_id long, text_clean string")
    cfg = FeatureConfig(min_df=2, max_df=1.0)
    model = features.fit_tfidf(df, cfg)
    want = {r.review_id: r.features for r in features.vectorize(df, model).collect()}
    monkeypatch.setattr(features, "BROADCAST_TERMS", 2)
    got = {r.review_id: r.features for r in features.vectorize(df, model).collect()}
    assert got.keys() == want.keys() and len(got) == 20
    for i, v in want.items():
        assert got[i].size == v.size and got[i].toArray() == pytest.approx(v.toArray())
    with pytest.raises(ValueError, match="vectorize"):
        features.vector_pipeline(replace(model, stages={}))


def test_counts_are_read_while_batches_arrive(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "counts")
    schema = "g string"
    for n in range(7):
        spark.createDataFrame([("a",)] * 2 + [(f"b{n}",)] + [(None,)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    arriving = streams.read_files(spark, str(folder), spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
    seen = []
    commit = streams._commit_counts

    def noted(df, path, number, kind):
        commit(df, path, number, kind)
        seen.append(streams.read_counts(spark, out, "g"))
        if len(seen) == 3:
            # a batch that is run again after its commit
            commit(df, path, number, kind)

    streams._commit_counts = noted
    try:
        streams.running_counts(arriving, "g", out, str(tmp_path / "c"), snapshot_every=3).awaitTermination()
    finally:
        streams._commit_counts = commit
    counts = {r.g: r.n for r in streams.read_counts(spark, out, "g").collect()}
    assert counts == {"a": 14, None: 7, **{f"b{n}": 1 for n in range(7)}}
    # seven batches and two snapshots; a reader pinned at the last snapshot still sees its batch
    assert len(seen) == 9
    pinned = {r.g: r.n for r in seen[-2].collect()}
    assert pinned["a"] == 12 and pinned[None] == 6
    kinds = [c.source_job for _, c in sorted(versions.commits(spark, out).items())]
    assert kinds.count("snapshot") == 2
    with pytest.raises(ValueError, match="No counts"):
        streams.read_counts(spark, str(tmp_path / "none"), "g")
