import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentilake.llm import mixing, sharding


def jump_one(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one_and_moves_only_into_the_new_shard():
    keys = np.array([0, 1, -5, 2**62, *np.random.default_rng(1).integers(-(2**62), 2**62, 3000)], np.int64)
    for shards in (1, 2, 24):
        assert sharding.jump(keys, shards).tolist() == [jump_one(int(k), shards) for k in keys]
    now, grown = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert set(grown[now != grown]) == {24}
    assert abs((now != grown).mean() - 1 / 25) < 0.02
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_slots_have_no_gap_with_nulls_repeats_and_clashing_names(spark):
    rows = [(i % 500 if i % 11 else None, "x" * (i % 7), -1) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.number_slots(sharding.assign_shards(df, "doc_id", 24, "shard", grown="grown"), "shard", ["doc_id", "text"])
    got = out.collect()
    assert len(got) == 2000
    for r in got:
        assert r["shard"] == jump_one(r["doc_id"] or 0, 24)
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    empty = sharding.number_slots(sharding.assign_shards(df.limit(0), "doc_id", 24), "shard", ["doc_id"])
    assert empty.count() == 0


def test_string_keys_and_written_shards(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    got = sharding.assign_shards(df, "k", 5).collect()
    assert len({r["shard"] for r in got if r["k"] == "a"}) == 1
    path = sharding.write_shards(df, str(tmp_path / "shards"), "k", 5)
    assert spark.read.parquet(path).count() == 4


def targets_by_hand(sizes, weights, share, repeats):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[n] for n in open_)
        above = [n for n in open_ if left * weight[n] / total > repeats * sizes[n]]
        if not above:
            target.update({n: left * weight[n] / total for n in open_})
            break
        for n in above:
            target[n] = repeats * sizes[n]
            left -= target[n]
            open_.discard(n)
    return target


def mix_by_hand(rows, weights=(5, 2, 1), share=1.5, repeats=2):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    target = targets_by_hand(sizes, weights, share, repeats)
    turn = lambda i: hashlib.md5(f"mix{'' if i is None else i}".encode()).hexdigest()
    key = lambda d: (turn(d[0]), -1 if d[0] is None else d[0], d[2])
    passes = []
    for source in sizes:
        so_far = 0
        for d in sorted((d for d in docs if d[1] == source), key=key):
            so_far += d[2]
            if target[source]:
                passes += [((so_far + p * sizes[source]) / target[source], *key(d)[:2], p, d[2], d) for p in range(repeats)]
    taken, budget, end = {}, sum(target.values()), 0
    for *_, size, d in sorted(passes, key=lambda x: x[:5]):
        end += size
        if end > budget:
            break
        taken[d] = taken.get(d, 0) + size
    return {(d, target[d[1]], taken.get(d, 0)) for d in docs}


def test_mix_equals_the_queue_by_hand(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.choice([0, 1, 3, 40, 200]), draw.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(700)]
    rows += [(None, "one two", "a"), (5000, None, "b"), (5001, "", "zero"), (5002, "a\tb\nc\u00a0d", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    want = mix_by_hand(rows)
    for _ in range(2):
        got = mixing.mix_sources(df).rows.collect()
        assert len(got) == len(rows)
        found = {((r["doc_id"], r["source"], r["size"]), round(r["target"], 6), r["taken"]) for r in got}
        assert found == {(d, round(t, 6), n) for d, t, n in want}
    by_source = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        by_source.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(target - taken) <= 400 for target, taken in by_source.values())


def test_mixed_rows_repeat_and_keep_their_columns(spark):
    rows = [(i, "w " * (i % 5), "ab"[i % 2], i) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mix = mixing.mix_sources(df)
    out = mixing.apply_mix(df, mix)
    assert out.columns == df.columns
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mix.rows.collect() if r["taken"]}
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == want
    empty = mixing.mix_sources(df.limit(0))
    assert empty.rows.count() == 0 and mixing.apply_mix(df.limit(0), empty).count() == 0
