"""The registered queries ``opN_<name>`` and their DuckDB SQL.

Each query applies its operator to its whole table and derives the digest
columns of its contract from what the operator returns.  A query without an
entry in ``ORACLE`` cannot be put in SQL; its tests hold it against a
brute-force version.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hilbert, merkle, mixing, pii, quality, secret_scan, simhash, topk, toxicity, trie, url_filter, warc
from ..session import scratch_path
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


@_query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def _fold(col: str) -> F.Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5


@_query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), allowed=_fold("id") != 0)
    found = toxicity.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), (_fold("id") == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query("op3_exact_top_k", sql="""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, embedding
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


@_query("op4_mix_sources", sql="""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT)
      / 4503599627370496.0::DOUBLE AS u, count(*) OVER (PARTITION BY doc_id, text, source) AS n,
    row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size / w AS ratio FROM w),
b AS (SELECT *, coalesce(sum(source_size) OVER o, 0) AS size_before, coalesce(sum(w) OVER o, 0) AS w_before,
    row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos FROM r
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - 2.0::DOUBLE * size_before)
    / ((SELECT sum(w) FROM w) - w_before) AS level FROM b),
f AS (SELECT min_by(level, pos) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, CASE WHEN ratio < f.level THEN 2.0::DOUBLE * source_size ELSE f.level * w END AS target FROM b, f),
p AS (SELECT doc_id, size, source_size, target, u, n, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, n * (rate - floor(rate)) AS more FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST((floor(rate) + CASE WHEN k < floor(more) + CASE WHEN u < more - floor(more) THEN 1 ELSE 0 END THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM m""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan_table(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# CRC-32 by its table, ranks as cells, the curve by a recursion over bits and axes, cuts by running bytes.
@_query("op8_hilbert_shards", sql="""
WITH RECURSIVE crc_steps AS (SELECT i AS n, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM crc_steps WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, lang, source, n_chars, hex(encode(coalesce(text, ''))) AS x, row_number() OVER () AS id FROM documents),
c AS (SELECT d.* EXCLUDE (x), xor(list_reduce(list_concat([4294967295], list_transform(range(size - 1), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, crc.t[1 + (xor(a, b) & 255)])), 4294967295) AS text_crc32 FROM d, crc),
q AS (SELECT *, (rank() OVER (ORDER BY lang NULLS LAST) - 1) * 32 // count(*) OVER () AS x, (rank() OVER (ORDER BY source NULLS LAST) - 1) * 32 // count(*) OVER () AS y,
    (rank() OVER (ORDER BY n_chars NULLS LAST) - 1) * 32 // count(*) OVER () AS z FROM c),
-- the curve: from the top bit down, each axis in turn reflects the first or changes places with it
h AS (SELECT DISTINCT x, y, z, x AS a, y AS b, z AS c, 16 AS bit, 0 AS axis FROM q
  UNION ALL SELECT x, y, z,
    CASE WHEN (CASE axis WHEN 0 THEN a WHEN 1 THEN b ELSE c END) & bit <> 0 THEN xor(a, bit - 1)
         WHEN axis = 0 THEN a ELSE xor(a, xor(a, CASE axis WHEN 1 THEN b ELSE c END) & (bit - 1)) END,
    CASE WHEN axis = 1 AND b & bit = 0 THEN xor(b, xor(a, b) & (bit - 1)) ELSE b END,
    CASE WHEN axis = 2 AND c & bit = 0 THEN xor(c, xor(a, c) & (bit - 1)) ELSE c END,
    CASE WHEN axis = 2 THEN bit // 2 ELSE bit END, (axis + 1) % 3 FROM h WHERE bit > 1),
g AS (SELECT x, y, z, a, xor(a, b) AS b, xor(xor(a, b), c) AS c FROM h WHERE bit = 1),
f AS (SELECT *, xor(xor(CASE WHEN c & 16 <> 0 THEN 15 ELSE 0 END, CASE WHEN c & 8 <> 0 THEN 7 ELSE 0 END),
    xor(CASE WHEN c & 4 <> 0 THEN 3 ELSE 0 END, CASE WHEN c & 2 <> 0 THEN 1 ELSE 0 END)) AS t FROM g),
k AS (SELECT x, y, z, CAST(list_sum(list_transform(range(5), lambda i: ((xor(a, t) >> i) & 1) * (1 << (3 * i + 2)) + ((xor(b, t) >> i) & 1) * (1 << (3 * i + 1))
    + ((xor(c, t) >> i) & 1) * (1 << (3 * i)))) AS BIGINT) AS hilbert FROM f),
o AS (SELECT q.*, hilbert, sum(size) OVER w AS upto, sum(size) OVER () AS total, row_number() OVER w - 1 AS pos FROM q JOIN k USING (x, y, z)
  WINDOW w AS (ORDER BY hilbert, doc_id NULLS LAST, text_crc32, size, id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, CAST(least((2 * (upto - size) + size) * 8 // (2 * total), 7) AS INTEGER) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(pos - min(pos) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, hilbert FROM r""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hilbert.shard_table(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "hilbert")


@_query("op5_url_words")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def _spans(col: str) -> F.Column:
    return F.concat_ws(",", F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in kinds]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_spans("base").cast("binary"), 256).alias("base_sha256"), _spans("spans").alias("spans"))


@_query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.find_personal_data(read(spark, sf_dir, "documents")), pii.KINDS)


@_query("op7_warc_bundles", sql="""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first = page_id OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first < page_id OR page_id IS NULL THEN first END AS refers_to FROM s""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"llm/warc-{uuid.uuid4().hex}")
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    return warc.index_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op9_benchmark_leaks")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@_query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secret_scan.find_secrets(read(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def _third(col: str) -> F.Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % 3


@_query("op11_quality")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), allowed=_third("id") != 1)
    found = quality.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), (_third("id") == 1).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


# CRC-32 by its table; both trees by a recursion over levels, the proofs by one up the levels.
@_query("op12_merkle_manifest", sql="""
WITH RECURSIVE crc_steps AS (SELECT i AS n, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM crc_steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS s,
    concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS head, text,
    CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT))),
      lambda a, b: xor(a >> 8, crc.t[1 + (xor(a, b) & 255)])), 4294967295) % 5 = 0
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents, crc),
l AS (SELECT rid, doc_id, s, sha256(concat(head, coalesce(octet_length(encode(text)) || ':' || text, '-'))) AS h,
    sha256(concat(head, coalesce(octet_length(encode(other)) || ':' || other, '-'))) AS h2 FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h, rid) - 1 AS pos, count(*) OVER (PARTITION BY s) AS n FROM l),
tree AS (SELECT s, 0 AS level, pos, h, n FROM p
  UNION ALL SELECT s, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM tree WHERE n > 1 GROUP BY s, level, pos // 16, n),
sub AS (SELECT s, h, row_number() OVER (ORDER BY encode(s)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
tops AS (SELECT 0 AS level, pos, h, n FROM sub
  UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY level, pos // 16, n),
near AS (SELECT s, level, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY s, level, pos // 16 ORDER BY pos)),
near2 AS (SELECT level, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM tops WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 16 ORDER BY pos)),
up AS (SELECT rid, s, 0 AS level, pos, n, '' AS proof, h2 AS f FROM p
  UNION ALL SELECT rid, s, level + 1, pos // 16, (n + 15) // 16, proof || a || b, sha256(a || f || b) FROM up JOIN near USING (s, level, pos) WHERE n > 1),
up2 AS (SELECT rid, 0 AS level, sub.pos, sub.n, proof, f FROM up JOIN sub USING (s) WHERE up.n = 1
  UNION ALL SELECT rid, level + 1, pos // 16, (n + 15) // 16, proof || a || b, sha256(a || f || b) FROM up2 JOIN near2 USING (level, pos) WHERE n > 1)
SELECT p.doc_id, p.h AS leaf, sub.h AS subroot, r.h AS root, sha256(up2.proof) AS proof_sha256, up2.f AS folded_root, up2.f = r.h AS verified
FROM p JOIN up2 USING (rid) JOIN sub ON sub.s = p.s, (SELECT h FROM tops WHERE n = 1) r WHERE up2.n = 1""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tampered(f: dict[str, F.Column]) -> dict[str, F.Column]:
        hit = F.crc32(f["doc_id"].cast("string").cast("binary")) % 5 == 0
        return f | {"text": F.when(hit, F.translate(f["text"], string.ascii_uppercase, string.ascii_lowercase)).otherwise(f["text"])}

    found = merkle.proofs(read(spark, sf_dir, "documents"), altered=tampered)
    found = found.withColumn("folded_root", merkle.fold(F.col("altered_leaf"), F.col("proof")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.hashed(merkle.proof_text(F.col("proof"))).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# A node is the digest of its turns' digests; its subtree's nodes are found through their smallest members' prefixes.
@_query("op13_conversation_trie", sql="""
WITH RECURSIVE crc_steps AS (SELECT i AS n, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM crc_steps WHERE k = 8),
t AS (SELECT conv_id AS c, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
    sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, bytes, d, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS p FROM t),
n AS (SELECT c, n, xor(list_reduce(list_concat([4294967295], list_transform(range(length(CAST(c AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i + 1, 1)) AS BIGINT))),
    lambda a, b: xor(a >> 8, crc.t[1 + (xor(a, b) & 255)])), 4294967295) % 9 AS h FROM (SELECT c, count(*) AS n FROM o GROUP BY c), crc),
b AS (SELECT n.c, n.n, n.h, least(n.h, coalesce(m.n, 0)) AS k FROM n LEFT JOIN n m ON m.c = n.c - n.c % 5),
r AS (SELECT b.c, o.p AS i, d, bytes FROM b JOIN o ON o.c = b.c - b.c % 5 WHERE o.p <= b.h
  UNION ALL SELECT b.c, o.p - b.h + b.k, d, bytes FROM b JOIN o ON o.c = b.c WHERE o.p > b.h),
x AS (SELECT c, i, bytes, sha256(string_agg(d, '') OVER (PARTITION BY c ORDER BY i)) AS key FROM r),
e AS (SELECT c, i, bytes, key, lag(key, 1, '') OVER (PARTITION BY c ORDER BY i) AS up, lead(key) OVER (PARTITION BY c ORDER BY i) IS NULL AS last FROM x
  UNION ALL SELECT c, 0, 0, '', NULL, c NOT IN (SELECT c FROM x) FROM n),
g AS (SELECT key, i AS depth, min(c) AS conv_id, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own,
    sha256(coalesce(string_agg(CASE WHEN last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM e GROUP BY key, i),
k AS (SELECT up AS key, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT e.key, sum(own) AS saved, count(*) FILTER (WHERE k.key IS NULL) AS leaves FROM g JOIN e ON e.c = g.conv_id AND e.i <= g.depth LEFT JOIN k ON k.key = g.key GROUP BY e.key)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n_children, 0) AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, g.ends_sha256 FROM g JOIN s ON s.key = g.key LEFT JOIN k ON k.key = g.key LEFT JOIN g p ON p.key = g.up""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, convs = trie.rebuilt(trie.turns_of(read(spark, sf_dir, "conversations")))
    return trie.trie(rows, convs)
