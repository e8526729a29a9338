import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentilake.llm import token_files, topk

PATH = public_tokenizers.path("byte_bpe_50k.json")


def top_by_hand(rows, asked, k):
    whole = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(1024 * x) for x in v]
        whole[i] = min(w, whole.get(i, w))
    out = []
    for q in (i for i in whole if asked(i)):
        score = lambda i: sum(a * b for a, b in zip(whole[q], whole[i], strict=False))  # noqa: E731, B023
        best = sorted(((-score(i), i) for i in whole if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in draw.normal(size=8)]) for i in range(900)]
    rows += [(2000 + i, [0.5] * 8) for i in range(300)]  # one common vector: ties go to the smaller id
    rows += [(10, [9.0] * 8), (None, [1.0] * 8), (3000, None), (3010, [1.0, None]), (3020, [float("nan")] * 8)]
    rows += [(3030, [float("inf")]), (3040, []), (3050, [2.0, 2.0]), (3060, [1e9] * 8), (3070, [-1e9] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    got = sorted(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 10 == 0).collect())
    narrow = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == top_by_hand(narrow, lambda i: i % 10 == 0, 10)


def test_top_k_prunes_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.exact_top_k(df, F.lit(True)).collect())) == [(0, 1, 1, 1024 * 2048), (1, 1, 0, 1024 * 2048)]
    assert topk.exact_top_k(df.limit(0), F.lit(True)).count() == 0
    import pyarrow as pa

    blocks = [([b * 4 + n for n in range(4)], [10 * b] * 4, [10 * b], [10 * b]) for b in range(20)]
    table = pa.table({"ids": [b[0] for b in blocks], "data": [b[1] for b in blocks], "high": [b[2] for b in blocks],
                      "low": [b[3] for b in blocks], "dims": [1] * 20})
    found, scored = topk.search_cell(pa.table({"query_id": [1000], "v": [[3]]}), table, 8)
    assert found.column("vec_id").to_pylist() == [76, 77, 78, 79, 72, 73, 74, 75] and scored == 2


TEXTS = [
    "Hello world, it's fine.\nNew line", "", None, "a  b   c ", " lead", "tab\tand\u00a0space", "naïve ÉÀ ñ words. 3,4 ok!!",
    "x" * 5000, "日本語 テキスト", "a\n b \nc", "<|endoftext|> in text", "A_b c_ _d", "it's\nJohn's. (yes)",
]


def ids_by_hand(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_token_files_round_trip(spark, tmp_path):
    rows = [(n * 7 % 97, t) for n, t in enumerate(TEXTS * 3)] + [(None, "no id"), (3, "same id"), (3, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(5)
    path = str(tmp_path / "t")
    index = token_files.write_token_files(df, path, PATH)
    got = token_files.read_token_files(index, path).select("doc_id", "start", "ids", F.crc32("ids").alias("crc")).collect()
    tokenizer = token_files.Encoder(PATH, 2).tokenizer
    at = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (doc_id, text) in zip(sorted(got, key=lambda r: r["start"]), order, strict=True):
        want = np.asarray(ids_by_hand(tokenizer, text), "<u4").tobytes()
        assert (r["doc_id"], r["start"], bytes(r["ids"]), r["crc"]) == (doc_id, at, want, zlib.crc32(want))
        at += len(want) // 4
    one = token_files.read_token_files(index.filter("doc_id = 7"), path).first()
    assert bytes(one["ids"]) == np.asarray(ids_by_hand(tokenizer, TEXTS[1]), "<u4").tobytes()


def test_files_of_another_dictionary_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(n, f"some text {n} " * 9) for n in range(300)], "doc_id long, text string")
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    index = token_files.write_token_files(df, first, PATH)
    token_files.write_token_files(df.withColumn("text", F.upper("text")), second, PATH)
    with pytest.raises(Exception, match="another dictionary"):
        token_files.read_token_files(index, second).count()


def test_token_files_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    index = token_files.write_token_files(df, str(tmp_path / "none"), PATH)
    assert token_files.read_token_files(index, str(tmp_path / "none")).count() == 0


ENCODER = token_files.Encoder(PATH, None)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aB é\n.,'!1_ñ\t$-\u00a0日") | st.characters(codec="utf-8"), max_size=40))
def test_cached_encoding_equals_the_library(text):
    want = ENCODER.tokenizer.encode(text, add_special_tokens=False).ids
    assert ENCODER.encode(text) == np.asarray(want, ENCODER.kind).tobytes()
