"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster
from .classifiers import classifier, scored
from .decontaminate import benchmark_matches
from .ftrl import held_out
from .jaccard_join import similar_documents
from .line_dedup import without_repeated_lines
from .mining import hard_negatives
from .mixing import mix_sources
from .nearest import nearest
from .secrets import find_secrets, listed
from .sharding import shard_rows
from .substring_dedup import repeated_passages
from .tables import stored
from .warc import read_chunks, to_chunks, with_revisits

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 34], ' ') AS seq
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM d WHERE len(ws) >= 35)
), hit AS (
  SELECT doc_id, p FROM win WHERE seq IN (SELECT seq FROM win GROUP BY seq HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, p + k AS p FROM hit, range(0, 35) t(k)
), words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d
), kept AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.p) AS kept, count(*) AS n
  FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(to_chunks(with_revisits(table(spark, sf_dir, "pages"))))
    out = read_chunks(archives)
    return out.select(F.expr("try_cast(record_id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "chunks_ok")


OP2_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to, true AS chunks_ok
FROM r
"""


def _classified(spark: SparkSession, sf_dir: str, label: str, folds: int, fold: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = classifier(docs, table(spark, sf_dir, "labels"), label, usable=~held_out(F.col("doc_id"), folds, fold))
    out = scored(docs, scorer, label)
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "toxic", 5, 0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark
), ds AS (
  SELECT doc_id, len(ws) AS n, p, array_to_string(ws[p + 1:p + 5], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 4)) AS p FROM dw WHERE len(ws) >= 5)
), its AS (
  SELECT item_id, n, s, count(*) AS c FROM (SELECT item_id, len(ws) AS n, array_to_string(ws[p + 1:p + 5], ' ') AS s FROM (SELECT item_id, ws, unnest(range(0, len(ws) - 4)) AS p FROM iw WHERE len(ws) >= 5)) GROUP BY ALL
), hit AS (
  SELECT DISTINCT ds.doc_id, ds.n - 4 AS dm, ds.p, its.item_id, its.n - 4 AS m FROM ds JOIN its ON its.s = ds.s
), win AS (
  SELECT DISTINCT doc_id, item_id, m, least(m, dm) AS wm, unnest(range(greatest(0, p - m + 1), greatest(0, least(p, dm - m)) + 1)) AS p0 FROM hit
), cnt AS (
  SELECT w.doc_id, w.item_id, w.m, w.wm, w.p0, ds.s, count(*) AS c FROM win w JOIN ds ON ds.doc_id = w.doc_id AND ds.p >= w.p0 AND ds.p < w.p0 + w.wm GROUP BY ALL
), ov AS (
  SELECT c.doc_id, c.item_id, c.m, c.wm, c.p0, sum(least(c.c, its.c))::BIGINT AS o FROM cnt c JOIN its ON its.item_id = c.item_id AND its.s = c.s GROUP BY ALL
), sim AS (SELECT *, o / (wm + m - o)::DOUBLE AS similarity FROM ov)
SELECT doc_id, item_id, max(similarity) AS similarity, min_by(p0, (-similarity, p0))::INTEGER AS start_word, (any_value(wm) + 4)::INTEGER AS n_words
FROM sim WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (
  SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("_tokens").alias("n_words"), F.col("_source_tokens").alias("source_words"), F.col("_weight").alias("weight"), F.col("_draws").alias("draws"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "quality", 3, 1)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT doc_id, 0 AS kind, start, finish, part FROM (
    SELECT doc_id, part, (sum(length(gap)) OVER w + coalesce(sum(length(al)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start, (sum(length(gap)) OVER w + sum(length(al)) OVER w)::INT AS finish
    FROM (SELECT doc_id, unnest(string_split_regex(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')) AS gap, unnest(regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0)) AS al, unnest(regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) AS part, generate_subscripts(string_split_regex(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'), 1) AS i FROM d)
    WHERE al IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE length(part) >= 12
  UNION ALL SELECT doc_id, 1 AS kind, start, finish, part FROM (
    SELECT doc_id, part, (sum(length(gap)) OVER w + coalesce(sum(length(al)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start, (sum(length(gap)) OVER w + sum(length(al)) OVER w)::INT AS finish
    FROM (SELECT doc_id, unnest(string_split_regex(text, 'AKIA[A-Z0-9]+')) AS gap, unnest(regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0)) AS al, unnest(regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0)) AS part, generate_subscripts(string_split_regex(text, 'AKIA[A-Z0-9]+'), 1) AS i FROM d)
    WHERE al IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE length(part) >= 18 UNION ALL SELECT doc_id, 2 AS kind, start, finish, part FROM (
    SELECT doc_id, part, (sum(length(gap)) OVER w + coalesce(sum(length(al)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start, (sum(length(gap)) OVER w + sum(length(al)) OVER w)::INT AS finish
    FROM (SELECT doc_id, unnest(string_split_regex(text, '[0-9a-f]+')) AS gap, unnest(regexp_extract_all(text, '[0-9a-f]+', 0)) AS al, unnest(regexp_extract_all(text, '[0-9a-f]+', 0)) AS part, generate_subscripts(string_split_regex(text, '[0-9a-f]+'), 1) AS i FROM d)
    WHERE al IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE length(part) >= 16),
tok AS (SELECT doc_id, start, CASE WHEN regexp_matches(substr(text, finish + 1, 1), '[A-Za-z0-9+/_-]') THEN start + length(part) ELSE finish END AS finish, part FROM (
    SELECT doc_id, part, text, (sum(length(gap)) OVER w + coalesce(sum(length(al)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start, (sum(length(gap)) OVER w + sum(length(al)) OVER w)::INT AS finish
    FROM (SELECT doc_id, text, unnest(string_split_regex(text, '([A-Za-z0-9+/]+)=*')) AS gap, unnest(regexp_extract_all(text, '([A-Za-z0-9+/]+)=*', 0)) AS al, unnest(regexp_extract_all(text, '([A-Za-z0-9+/]+)=*', 1)) AS part, generate_subscripts(string_split_regex(text, '([A-Za-z0-9+/]+)=*'), 1) AS i FROM d)
    WHERE al IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE length(part) >= 24
  UNION SELECT doc_id, start, CASE WHEN regexp_matches(substr(text, finish + 1, 1), '[A-Za-z0-9+/_-]') THEN start + length(part) ELSE finish END AS finish, part FROM (
    SELECT doc_id, part, text, (sum(length(gap)) OVER w + coalesce(sum(length(al)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start, (sum(length(gap)) OVER w + sum(length(al)) OVER w)::INT AS finish
    FROM (SELECT doc_id, text, unnest(string_split_regex(text, '([A-Za-z0-9_-]+)=*')) AS gap, unnest(regexp_extract_all(text, '([A-Za-z0-9_-]+)=*', 0)) AS al, unnest(regexp_extract_all(text, '([A-Za-z0-9_-]+)=*', 1)) AS part, generate_subscripts(string_split_regex(text, '([A-Za-z0-9_-]+)=*'), 1) AS i FROM d)
    WHERE al IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE length(part) >= 24),
t0 AS (SELECT doc_id, start, finish, part AS s FROM tok t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.start < t.finish AND t.start < b.finish)),
t1 AS (SELECT *, CASE WHEN (regexp_full_match(s, '[0-9a-f]+') OR regexp_full_match(s, '[0-9A-F]+')) AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Fa-f]') THEN '0123456789abcdef'
  WHEN regexp_full_match(s, '[A-Z2-7]+') AND regexp_matches(s, '[2-7]') AND regexp_matches(s, '[A-Z]') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'
  WHEN regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[0-9]') AND regexp_full_match(s, '[A-Za-z0-9+/]+|[A-Za-z0-9_-]+') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' END AS alphabet FROM t0),
t2 AS (SELECT doc_id, start, finish, alphabet, CASE WHEN length(alphabet) = 16 THEN lower(s) ELSE translate(s, '-_', '+/') END AS s, length(s)::DOUBLE AS n, length(alphabet)::DOUBLE AS k FROM t1 WHERE alphabet IS NOT NULL AND length(s) >= 24),
ch AS (SELECT doc_id, start, finish, n, k, i, instr(alphabet, s[i:i])::DOUBLE AS v FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM t2)),
sq AS (SELECT doc_id, start, finish, sum(c * c)::DOUBLE AS squares FROM (SELECT doc_id, start, finish, v, count(*) AS c FROM ch GROUP BY ALL) GROUP BY ALL),
st AS (SELECT doc_id, start, finish, n, k, avg(v) OVER w AS mean_v, v, i, (v > k / 2)::INT AS bit FROM ch WINDOW w AS (PARTITION BY doc_id, start, finish)),
s2 AS (SELECT *, lead(v) OVER w - mean_v AS nx, lag(bit) OVER w AS pb FROM st WINDOW w AS (PARTITION BY doc_id, start, finish ORDER BY i)),
s3 AS (SELECT doc_id, start, finish, n, k, sum((v - mean_v) * (v - mean_v)) AS energy, sum((v - mean_v) * nx) AS cross_, 1 + sum((pb IS NOT NULL AND pb <> bit)::INT) AS runs, sum(bit)::DOUBLE AS n1 FROM s2 GROUP BY ALL),
s4 AS (SELECT *, squares * k / n - n AS chi, k - 1 AS df, 2 * n1 * (n - n1) / n + 1 AS r FROM s3 JOIN sq USING (doc_id, start, finish)),
s5 AS (SELECT doc_id, start, finish, n, (pow(greatest(chi, 0) / df, 1.0::DOUBLE / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df)) AS zc, abs(runs - r) / sqrt(greatest((r - 1) * (r - 2) / (n - 1), 1e-9::DOUBLE)) AS zr, abs(cross_ / greatest(energy, 1e-9::DOUBLE) + 1 / n) * sqrt(n) AS zs FROM s4),
z AS (SELECT doc_id, start, finish, n, zc, unnest([abs(zc), zr, zs]) AS z, unnest([0, 1, 2]) AS which FROM s5),
tl AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * z / sqrt(2.0::DOUBLE)) AS t FROM z),
tp AS (SELECT *, greatest(t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-z * z / 2), 1e-300::DOUBLE) AS q FROM tl),
hf AS (SELECT doc_id, start, finish, n, -sum(ln(CASE WHEN which > 0 THEN q WHEN zc > 0 THEN q / 2 ELSE 1 - q / 2 END)) AS half FROM tp GROUP BY ALL),
pv AS (SELECT doc_id, start, finish, n, greatest(exp(-half) * (1 + half + half * half / 2), 1e-300::DOUBLE) AS p FROM hf),
bn AS (SELECT *, floor(-log10(greatest(p * avg(n) OVER () / n, 1e-300::DOUBLE)) * 10) AS b, count(*) OVER () AS m FROM pv),
ct AS (SELECT b, any_value(m) AS m, sum(count(*)) OVER (ORDER BY b DESC) AS rank FROM bn GROUP BY b),
lim AS (SELECT coalesce(min(b) FILTER (pow(10.0::DOUBLE, -b / 10) <= 0.1 * rank / m), 1e308::DOUBLE) AS lim FROM ct),
told AS (SELECT bn.doc_id, bn.start, bn.finish, max(bn.finish) OVER (PARTITION BY bn.doc_id ORDER BY bn.start, bn.finish DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bn, lim WHERE bn.b < lim.lim),
rnd AS (SELECT doc_id, 3 AS kind, start, finish FROM told WHERE reach IS NULL OR finish > reach),
al AS (SELECT doc_id, kind, start, finish FROM base UNION ALL SELECT * FROM rnd),
ls AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start || ':' || finish, ',' ORDER BY start, kind) FILTER (kind < 3) AS bs, string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || finish, ',' ORDER BY start, kind) AS spans FROM al GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN ls USING (doc_id)
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), shards=24)


OP9_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id, -1) AS k FROM documents
), crc AS (
  SELECT doc_id, k, strlen(text) + 8 AS size,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::UBIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM d, tab
), j AS (
  SELECT DISTINCT k, -1::BIGINT AS b, 0::BIGINT AS j, CASE WHEN k < 0 THEN k::HUGEINT + 18446744073709551616::HUGEINT ELSE k::HUGEINT END AS h, 0 AS n FROM d
  UNION ALL
  SELECT k, j, floor((j + 1) * (2147483648.0::DOUBLE / ((((h * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT) // 8589934592 + 1)::DOUBLE)))::BIGINT,
         (h * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT, n + 1
  FROM j WHERE j < 25
), s AS (
  SELECT k, max(b) FILTER (b < 24)::INT AS shard, max(b)::INT AS grown_shard FROM j GROUP BY k
)
SELECT c.doc_id, c.size, c.text_crc32, 'key' AS law, s.shard,
       row_number() OVER (PARTITION BY s.shard ORDER BY ((c.k % 65521 + 65521) % 65521 * 31321 % 65521 + c.text_crc32) % 256, c.k, c.text_crc32, c.size, c.doc_id IS NULL) - 1 AS slot, s.grown_shard
FROM crc c JOIN s ON s.k = c.k
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w
), t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS tok FROM s),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM s
  UNION
  SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = s.doc_id
"""


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=20, least_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, p, ls[p] AS line, translate(trim(ls[p], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM d)),
g AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (g.top <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (g.top IS NULL OR g.top = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN g ON g.k = l.k GROUP BY l.doc_id
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=40, rounds=5, seed=2, dim=64)
    return out.drop("embedding")


def _op12_sql(rounds: int = 5) -> str:
    nearest = """SELECT v.r, v.vec_id, v.w, arg_min(c.c, (d.d, c.c)) AS c, min(d.d) AS d FROM v, {c} c,
  LATERAL (SELECT list_sum(list_transform(list_zip(v.w, c.w), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d) d GROUP BY v.r, v.vec_id, v.w"""
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(c=f'c{i}')})")
        steps.append(f"""m{i} AS (SELECT c, list(x ORDER BY i) AS w FROM (SELECT c, i, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM (SELECT c, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c)""")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT p.c, coalesce(m.w, p.w) AS w FROM c{i} p LEFT JOIN m{i} m ON m.c = p.c)")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)::BIGINT) AS w FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), w) - 1 AS c, w FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), w LIMIT 40
), {', '.join(steps)}, f AS MATERIALIZED ({nearest.format(c=f'c{rounds}')})
SELECT f.vec_id, f.c::INTEGER AS cluster, f.d AS distance, (sum(f.d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(f.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.c = f.c
"""


OP12_SQL = _op12_sql()


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=5, low=80, high=100)


OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)::BIGINT) AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, coalesce(list_sum(list_transform(list_zip(a.w, c.w), lambda x: x[1] * x[2])), 0)::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.w) = len(a.w) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT a, c AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5
)
SELECT p.a AS anchor_id, positive_id, (row_number() OVER (PARTITION BY p.a, positive_id ORDER BY s.score DESC, s.c))::INTEGER AS rank, s.c AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.score >= 80 * positive_score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (op1_substring_dedup, op2_warc, op3_toxicity, op4_decontamination, op5_nearest, op6_mixing, op7_quality, op8_secrets, op9_sharding, op10_jaccard_join, op11_line_dedup, op12_centroids, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op4_decontamination": OP4_SQL, "op5_nearest": OP5_SQL, "op8_secrets": OP8_SQL, "op9_sharding": OP9_SQL, "op10_jaccard_join": OP10_SQL, "op11_line_dedup": OP11_SQL, "op12_centroids": OP12_SQL, "op13_hard_negatives": OP13_SQL}
