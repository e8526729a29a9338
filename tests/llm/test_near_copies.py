import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sentilake.llm import common, components, near_dedup


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, size):
    w = words(text)
    return [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


TEXTS = ["", None, " \n\t", "one", "one two", "One TWO", "one two three", "ÀB àb", "a\u00a0b c d e f"]


def corpus(n, seed):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeéñß") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    texts = list(TEXTS)
    for _ in range(n):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([4, 8, 60, 300]))]
        texts.append(" ".join(base))
        for _ in range(draw.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2, 6])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(" ".join(copy))
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_components_equal_union_find(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(2000, 2001 + i) for i in range(200)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df, "a", "b").collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == groups({x for e in real for x in e}, real)
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def test_simhash_groups_equal_brute_force(spark):
    rows = corpus(60, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df).withColumn("hex", near_dedup.hex_print(F.col("fp"))).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    assert {i: r["hex"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r["component_id"] for i, r in got.items()} == groups(prints, links)


def test_links_of_dense_postings(spark):
    """Hundreds of fingerprints around few points: long postings take the way by points, short ones the tally."""
    draw = random.Random(7)
    prints = set()
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(150):
            p = centre
            for _ in range(draw.choice([1, 2, 3, 4])):
                p ^= 1 << draw.randrange(64)
            prints.add(p)
    prints |= {draw.getrandbits(64) for _ in range(300)}
    rows = [(n, p - 2**64 if p >= 2**63 else p) for n, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "node long, fp long")
    links = [(a, b) for (a, p), (b, q) in combinations(rows, 2) if ((p ^ q) & (2**64 - 1)).bit_count() <= 2]
    want = groups([n for n, _ in rows], links)
    for bucket in (4, 32, 10_000):
        found = near_dedup.linked_pairs(df, bucket).collect()
        assert groups([n for n, _ in rows], [tuple(r) for r in found]) == want


def test_long_and_repeated_shingles():
    hashes = np.arange(2_000_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ends = np.array([0, 3, 3, 1_500_000, 2_000_000])
    got = near_dedup.majority_bits(hashes, ends)
    starts = [0, *ends[:-1]]
    for start, end, p in zip(starts, ends, got, strict=True):
        for bit in (0, 17, 63):
            ones = int(((hashes[start:end] >> np.uint64(bit)) & np.uint64(1)).sum())
            assert (int(p) >> bit & 1) == (2 * ones > end - start)


def test_one_document_of_each_group_stays(spark):
    rows = corpus(60, 2) + [(7001, "gone to x"), (7002, "gone to x"), (7002, "gone to x"), (7003, "another text here"), (7003, "a third")]
    clash = {"fp": F.lit(1), "_rank0": F.lit("mine"), "component_id": F.lit(2), "node": F.lit(3)}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(4)
    nodes = sorted({(fingerprint(t), i) for i, t in rows})
    links = [(a, b) for a, b in combinations(nodes, 2) if (a[0] ^ b[0]).bit_count() <= 2 or a[1] == b[1]]
    by_node = groups(nodes, links)
    least = defaultdict(lambda: 10**9)
    for print_, i in nodes:
        least[by_node[print_, i]] = min(i, least[by_node[print_, i]])
    want = {least[c] for c in by_node.values()}
    nameless = df.limit(2).withColumn("doc_id", F.lit(None).cast("long"))
    kept = near_dedup.drop_near_duplicates(df.unionByName(nameless))
    assert kept.columns == df.columns
    got = kept.collect()
    assert Counter(r.doc_id for r in got) == Counter([*want, None, None])
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    assert all(r.text in texts[r.doc_id] and r["_rank0"] == "mine" and r.fp == 1 for r in got if r.doc_id is not None)
    again = near_dedup.drop_near_duplicates(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in got if r.doc_id is not None)
    assert near_dedup.drop_near_duplicates(df.limit(0)).count() == 0
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_large_group_of_copies_leaves_one(spark):
    """Exact copies meet in one grouping, edits of one text in long postings of distinct fingerprints."""
    text = " ".join(f"w{n}" for n in range(400))
    rows = [(n, text) for n in range(50, 850)] + [(n, f"{text} {n % 3}") for n in range(850, 1250)] + [(7, "something else")]
    prints = {fingerprint(t) for t in (text, f"{text} 0", f"{text} 1", f"{text} 2")}
    assert all((a ^ fingerprint(text)).bit_count() <= 2 for a in prints)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(df).collect()) == [7, 50]


def test_a_failed_step_leaves_no_tables(spark):
    made = []
    with pytest.raises(ZeroDivisionError), common.passing_tables(spark) as keep:
        made += keep(spark.range(3).toDF("n"), "failing").inputFiles()
        raise ZeroDivisionError
    assert made and not any(Path(f.removeprefix("file:")).exists() for f in made)
