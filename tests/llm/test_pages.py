import base64
import glob
import gzip
import hashlib

from pyspark.sql import functions as F

from sentilake.llm import byte_ranges, url_filter, warc

PAGES = [
    (1, "http://a.com/x", "<p>one</p>"),
    (2, "http://a.com/y", "<p>one</p>"),
    (3, "http://a.com/z", "two ünï"),
    (4, None, None),
    (5, "http://a.com/evil\r\nWARC-Type: x", ""),
    (6, "", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
    (7, "http://a.com/long", "ab" * 300_000),
    (9, "http://a.com/x", "<p>one</p>"),
    (9, "http://a.com/x", "<p>one</p>"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write_warc(df.repartition(3), str(tmp_path / "w"), file_bytes=2000)
    got = sorted(warc.read_records(index).collect(), key=lambda r: (int(r["record_id"]), r["kind"]))
    assert len(got) == len(PAGES)
    newest = {}
    for i, _, html in PAGES:
        newest[html or ""] = max(i, newest.get(html or "", -1))
    for r, (i, url, html) in zip(got, PAGES, strict=True):
        first = newest[html or ""]
        assert int(r["record_id"]) == i
        assert r["digest"] == digest(html) and r["payload_bytes"] == len((html or "").encode())
        assert r["url"] == (url and url.replace("\r", "%0D").replace("\n", "%0A"))
        if first == i:
            assert r["kind"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == (html or "").encode()
        else:
            assert r["kind"] == "revisit" and r["refers_to"] == str(first) and r["payload"] is None
    few = warc.read_records(index.filter("record_id = '3'"), gap=0).collect()
    assert [bytes(r["payload"]).decode() for r in few] == ["two ünï"]
    # Each file is a plain sequence of gzip members that any reader can follow.
    whole = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "w/records/*.warc.gz")))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: re") == len(PAGES)


def test_warc_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_warc(df, str(tmp_path / "none"))
    assert index.count() == 0 and warc.read_records(index).count() == 0


def test_neighbours_are_read_together():
    entries = [("f", 0, 10), ("f", 10, 10), ("f", 25, 5), ("f", 200, 1), ("g", 0, 500), ("g", 500, 1)]
    groups = list(byte_ranges.coalesced(iter(entries), gap=5, most=100))
    assert groups == [entries[:3], entries[3:4], entries[4:5], entries[5:]]


def test_base32(spark):
    texts = ["", "a", "zürich", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(warc.base32_sha1(F.col("t"))).collect()]
    assert got == [digest(t) for t in texts]


URLS = [
    ("http://www.Example.COM/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/"),
    ("https://blog.example.com/en/2", "blog.example.com", "/en/2", "example.com/en/"),
    ("https://blog.example.com/de/2", "blog.example.com", "/de/2", "com/"),
    ("https://notexample.com/en/", "notexample.com", "/en/", "com/"),
    ("https://x.net/es/", "x.net", "/es/", "net/es/"),
    ("https://net/fr/9", "net", "/fr/9", "net/fr/"),
    ("https://x.net/en/", "x.net", "/en/", None),
    ("https://x.com", "x.com", "", None),
    ("https://x.com?q=/en/", "x.com", "", None),
    ("no scheme", "", "", None),
    ("a://b://c/d", "b:", "//c/d", None),
    ("", "", "", None),
    (None, "", "", None),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(URLS)], "page_id int, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    verdicts = {h + p: v for h, p, v in url_filter.RULES}
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), URLS[i]
        assert got[i]["verdict"] == verdicts[rule] if rule else got[i]["verdict"] in ("allow", "block")


def test_model_learns_urls_that_it_has_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    known = pages.select(
        "url", url_filter.rule_index(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), url_filter.RULES).alias("r")
    ).filter("r IS NOT NULL")
    block = F.get(F.array(*[F.lit(float(v == "block")) for _, _, v in url_filter.RULES]), F.col("r"))
    split = F.pmod(F.xxhash64("url"), F.lit(3)) == 0
    model = url_filter.fit_url_model(url_filter.labelled_urls(known.filter(~split), "url", block))
    held = model.probability(known.filter(split).withColumn("block", block), "url", "p")
    right = held.select(F.avg(((F.col("p") >= 0.5) == (F.col("block") == 1)).cast("double"))).first()[0]
    assert right > 0.95


def test_one_class_or_no_label(spark):
    one = spark.createDataFrame([("http://a.com/", 1.0)], "url string, block double")
    assert url_filter.fit_url_model(one).constant == 1.0
    assert url_filter.fit_url_model(one.limit(0)).constant == 0.0
    empty = spark.createDataFrame([], "url string")
    assert url_filter.judge_urls(empty).count() == 0
