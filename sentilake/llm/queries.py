"""Registered queries of the operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentilake.llm import (
    decontaminate,
    divergence,
    extraction,
    mixing,
    near_dedup,
    passages,
    phrases,
    quality,
    sharding,
    token_files,
    topk,
    url_filter,
    warc,
)


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


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# SHA-1 in hex becomes base32: 40 bits are ten hex digits or eight base32 digits.
_BASE32 = """array_to_string(list_transform(range(0, 4), lambda c: array_to_string(list_transform(range(0, 8), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(hex_digest, c * 10 + 1, 10))::BIGINT >> (35 - 5 * k)) & 31) + 1 AS BIGINT), 1)), '')), '')"""


@query(f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex_digest) AS newest FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> newest THEN newest END AS refers_to FROM m""")
def op4_warc(spark, sf):
    """Write all pages as WARC files, then read every record back by its index entry."""
    index = warc.write_warc(table(spark, sf, "pages"), warc.new_archive(spark))
    return warc.read_records(index, payload=False).select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


_JUMP = """WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ids AS (SELECT DISTINCT coalesce(doc_id, 0) AS doc_id FROM docs),
jump AS (
  SELECT doc_id, n, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j,
    CASE WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE CAST(doc_id AS HUGEINT) END AS k
  FROM ids, (VALUES (24), (25)) AS s(n)
  UNION ALL
  SELECT doc_id, n, j, CAST(floor(CAST(j + 1 AS DOUBLE) * (CAST(2147483648 AS DOUBLE)
    / CAST(((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1 AS DOUBLE))) AS BIGINT),
    (k * 2862933555777941757 + 1) % 18446744073709551616
  FROM jump WHERE j < n),
placed AS (SELECT doc_id, n, max(b) AS shard FROM jump GROUP BY doc_id, n),
crcs AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
hexed AS (SELECT doc_id, text, hex(encode(text)) AS h FROM docs),
summed AS (SELECT doc_id, text, xor(list_reduce(list_transform(range(0, length(h) // 2),
    lambda i: ('0x' || substr(h, i * 2 + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM hexed, crcs)"""


def _op5(spark, sf):
    docs = table(spark, sf, "documents")
    placed = sharding.assign_shards(docs, "doc_id", 24, "shard", grown="grown_shard").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "grown_shard",
    )
    return sharding.number_slots(placed, "shard", ["doc_id", "size", "text_crc32"]).withColumn(
        "slot", F.col("slot").cast("long")
    )


@query(f"""{_JUMP}
SELECT s.doc_id, strlen(text) + 8 AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(a.shard AS INT) AS shard,
  row_number() OVER (PARTITION BY a.shard ORDER BY substr(md5(concat_ws('|', s.doc_id, strlen(text) + 8, CAST(text_crc32 AS BIGINT))), 1, 3), s.doc_id NULLS FIRST) - 1 AS slot, CAST(g.shard AS INT) AS grown_shard
FROM summed s JOIN placed a ON a.doc_id = coalesce(s.doc_id, 0) AND a.n = 24 JOIN placed g ON g.doc_id = coalesce(s.doc_id, 0) AND g.n = 25""")
def op5_jump_hash(spark, sf):
    """All documents into 24 shards, with the shard that a 25th would leave each in."""
    return _op5(spark, sf)


_MIX = """WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight,
  row_number() OVER (ORDER BY source IS NULL, source) - 1 AS position, source_size * 2 AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
c AS (SELECT min_by(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, CASE WHEN c.level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), c.level * weight) END AS target
  FROM l, c),
e AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS reached
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CAST(reached + round * source_size AS DOUBLE) / target AS time FROM e, (VALUES (0), (1)) AS x(round) WHERE target > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY time, turn, doc_id NULLS FIRST, round, size ROWS UNBOUNDED PRECEDING) AS upto FROM p),
k AS (SELECT doc_id, source, size, turn, CAST(sum(size) FILTER (WHERE upto <= (SELECT sum(target) FROM t)) AS BIGINT) AS taken FROM g GROUP BY ALL)
SELECT e.doc_id, e.size, e.source_size, e.target, coalesce(k.taken, 0) AS taken FROM e LEFT JOIN k
ON e.doc_id IS NOT DISTINCT FROM k.doc_id AND e.source IS NOT DISTINCT FROM k.source AND e.size = k.size"""


@query(_MIX)
def op7_fair_mix(spark, sf):
    """All documents mixed to the weights 5, 2, 1 of their sources."""
    mix = mixing.mix_sources(table(spark, sf, "documents"))
    return mix.rows.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op8_url_filter(spark, sf):
    """Every page's URL judged by the rules, or by the model fitted on URLs that the rules judge."""
    judged = url_filter.judge_urls(table(spark, sf, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in url_filter.RULES)


@query(f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
m AS (SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS turn
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, host, path, rule, verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND turn = 1""")
def url_rules(spark, sf):
    """Host, path, rule and its verdict of every page; URLs that no rule fits have none."""
    judged = url_filter.judge_urls(table(spark, sf, "pages").select("page_id", "url"), model=url_filter.UrlModel(url_filter.BUCKETS, None, 0.0))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


@query()
def op9_simhash(spark, sf):
    """Fingerprint and component of every document."""
    found = near_dedup.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", near_dedup.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op10_decontaminate(spark, sf):
    """Benchmark items held by any document, with the best window."""
    found = decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "start", "similarity")


@query()
def op1_importance(spark, sf):
    """The documents that importance resampling towards good text takes."""
    return quality.resample(table(spark, sf, "documents"), table(spark, sf, "labels"))


_WHOLE = "list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))"


@query(f"""WITH v AS (SELECT vec_id, {_WHOLE} AS w FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(v.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10""")
def op2_block_topk(spark, sf):
    """The ten best rows for every vector whose id is divisible by 100."""
    return topk.exact_top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query()
def op3_token_files(spark, sf):
    """All documents as token-id files, read back by their index."""
    import public_tokenizers

    path = token_files.new_files(spark)
    index = token_files.write_token_files(
        table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json")
    )
    return token_files.read_token_files(index, path).select(
        "doc_id", "start", token_files.n_ids(F.col("ids")).alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query()
def op6_passages(spark, sf):
    """Passages of fifty words or more that several documents hold."""
    return passages.repeated_passages(table(spark, sf, "documents"))


_SHARE = "1 + (1000000000::HUGEINT * ({} + 1)) // ({} + v)"


@query(rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
w AS (SELECT lang, source, rid, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
groups AS (SELECT lang, source FROM d GROUP BY ALL),
langs AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(total), 0) AS ln FROM (SELECT DISTINCT lang FROM groups) AS g LEFT JOIN kept AS k USING (lang) GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS gn FROM groups AS g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, {_SHARE.format("coalesce(n, 0)", "gn")} AS p, {_SHARE.format("total", "ln")} AS q
  FROM s JOIN langs USING (lang) JOIN kept AS k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups AS a JOIN groups AS b
  ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""")
def op11_divergence(spark, sf):
    """How far the sources of each language differ, and by which terms."""
    return divergence.audit_sources(table(spark, sf, "documents"))


@query()
def op12_main_text(spark, sf):
    """The main text of every page."""
    texts = extraction.extract_main_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(r"""WITH pieces AS (SELECT lang, unnest(string_split_regex(body, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
sizes AS (SELECT lang, sum(len(ws)) AS n FROM lists GROUP BY lang),
spans AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM lists, (VALUES (1), (2), (3), (4)) AS o(k)),
f AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, k, ws, unnest(range(1, k)) AS c FROM cand),
met AS (SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM cuts
  JOIN f AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1 : c], ' ')
  JOIN f AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[c + 1 : cuts.k], ' ')),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS turn FROM met),
subs AS (SELECT lang, a, ws, k, s, unnest(range(1, k - s + 2)) AS i FROM cand, (VALUES (2), (3)) AS o(s) WHERE s < k),
longer AS (SELECT lang, array_to_string(ws[i : i + s - 1], ' ') AS phrase, max(a) AS longer FROM subs GROUP BY ALL),
ranked AS (SELECT low.lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM low LEFT JOIN longer USING (lang, phrase) WHERE turn = 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a))
SELECT lang, CAST(rank AS INT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000""")
def op13_phrases(spark, sf):
    """The best collocations of every language."""
    return phrases.mine_phrases(table(spark, sf, "documents"))
