"""Columns of the user that carry the names which the operators use inside come out as they went in."""

import pytest
from pyspark.sql import functions as F

from sentilake.llm import decontaminate, extraction, mixing, near_dedup, quality, sharding, url_filter, warc

NAMES = [
    "_size", "_turn", "_times", "_body", "_weight", "_rank", "_slot_cell", "_slot_base", "_slot_n", "_p", "_raw", "_grams", "_vector",
    "_label", "_host", "_path", "_rule", "_chance", "_row", "_url", "fp", "node", "component_id", "size", "taken", "body", "a b", "x.y",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, f"some words of document {n % 7} in a row {'more ' * (n % 4)}", "en", f"s{n % 2}", f"http://x.example.com/en/{n}") for n in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string")
    return df.withColumns({name: F.concat(F.lit(f"{name}-"), F.col("doc_id")) for name in NAMES})


def untouched(out, docs):
    assert out.columns[: len(docs.columns)] == docs.columns or set(docs.columns) <= set(out.columns)
    rows = out.select([F.col(f"`{c}`") for c in docs.columns]).collect()
    assert rows
    for row in rows:
        for name in NAMES:
            assert row[name] == f"{name}-{row['doc_id']}"
    return rows


def test_operators_that_return_the_users_rows(spark, docs):
    untouched(near_dedup.drop_near_duplicates(docs), docs)
    items = spark.createDataFrame([(1, "quite another text of six words")], "item_id long, text string")
    assert len(untouched(decontaminate.drop_contaminated(docs, items), docs)) == 40
    untouched(mixing.apply_mix(docs, mixing.mix_sources(docs)), docs)
    assert len(untouched(url_filter.judge_urls(docs), docs)) == 40
    assert len(untouched(sharding.number_slots(sharding.assign_shards(docs, "doc_id", 3), "shard", ["doc_id"]), docs)) == 40
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(40)], "doc_id long, quality int, toxic int")
    fitted, _ = quality.fit_quality(docs, labels)
    kept = fitted.keep(docs)
    assert kept.columns == docs.columns
    pages = docs.withColumn("html", F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")))
    out = extraction.extract_main_text(pages, id_column="doc_id", text="main text")
    untouched(out, docs)


def test_ids_with_line_breaks_and_marks_are_read_back(spark):
    rows = [("a\r\nb", "one"), ("null", "two"), (None, "three"), ("<é> %41+ &", "one"), ("c", "one")]
    pages = spark.createDataFrame([(i, "http://x/", h) for i, h in rows], "page_id string, url string, html string")
    index = warc.write_warc(pages, warc.new_archive(spark))
    got = {(r.record_id, r.kind, r.refers_to) for r in warc.read_records(index, payload=False).collect()}
    largest = max(i for i, h in rows if h == "one")
    assert {i for i, _, _ in got} == {i for i, _ in rows}
    assert {r for _, kind, r in got if kind == "revisit"} == {largest}
