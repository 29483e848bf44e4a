"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .ball_tree import cluster_vectors
from .common import table
from .decontaminate import contamination
from .license_scan import TEMPLATES, scan_licenses
from .mixing import mix_plan
from .near_dup import near_duplicates
from .ngram_join import ngram_join
from .prefix_trie import prefix_trie
from .quality import score_documents
from .secret_scan import scan_secrets
from .sharding import shard_documents
from .url_filter import filter_urls
from .warc import archive_pages


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "license_id", "n_shingles", "n_found", "containment")


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings")).select(F.col("query_id").cast("long").alias("query_id"), "rank", "vec_id", "score")


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key", "spans", "items")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=5, percent=80)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_secret_scan": op2_secret_scan,
    "op3_sharding": op3_sharding,
    "op4_url_filter": op4_url_filter,
    "op5_license_scan": op5_license_scan,
    "op6_nn_descent": op6_nn_descent,
    "op7_minhash_near_dup": op7_minhash_near_dup,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_ball_tree": op11_ball_tree,
    "op12_ngram_join": op12_ngram_join,
    "op13_prefix_trie": op13_prefix_trie,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_URLS = """
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT q.*, CASE
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_TEMPLATE_VALUES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in TEMPLATES)
_LICENSES = f"""
WITH t AS (SELECT license_id, {_WORDS} AS w FROM (VALUES {_TEMPLATE_VALUES}) AS v(license_id, text)),
ts AS (SELECT DISTINCT license_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT license_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
n AS (SELECT license_id, count(*) AS n_shingles FROM ts GROUP BY 1),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
m AS (SELECT doc_id, license_id, count(*) AS n_found FROM ds JOIN ts USING (s) GROUP BY 1, 2)
SELECT doc_id, license_id, n_shingles, n_found, n_found / n_shingles AS containment FROM m JOIN n USING (license_id) WHERE n_found >= ceil(n_shingles * 0.8)
"""

#: The exact answer: NN-descent reaches it where all vectors fit one block, as at the scale of the correctness check.
_NEIGHBOURS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b, CAST(0 AS DOUBLE)) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""


def _components(k: int) -> str:
    """Each document's number of k-word shingles and the smallest document that it reaches by links of 0.8 and more."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w WHERE len(w) >= {k})
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND {k - 1})),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
pairs AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(v, r) AS (SELECT a, a FROM pairs UNION SELECT pairs.b, reach.r FROM reach JOIN pairs ON pairs.a = reach.v),
c AS (SELECT v, min(r) AS r FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.r, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = w.doc_id
"""


_NEAR = f"SELECT *, component_id = doc_id AS kept FROM ({_components(4)}) AS found"

_LEAKS = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw USING (win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {g * 5 + 1}, 5))::INT >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))
_WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, octet_length(body) AS payload_bytes, {_LETTERS} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q
"""



def _lloyd(rounds: int) -> str:
    """Plain rounds: all distances, the least (distance, number), floors of exact means."""
    assign = """a{r} AS (SELECT vec_id, e, min({{'d': d, 'k': k}}) AS best FROM (
      SELECT vec_id, e, k, CAST(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY vec_id, e)"""
    move = """c{n} AS (SELECT c{r}.k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT k, list(x ORDER BY i) AS m FROM (
      SELECT best.k AS k, i, CAST(floor(sum(e[i]) / count(*)) AS BIGINT) AS x FROM a{r}, range(1, 65) AS t(i) GROUP BY 1, 2) GROUP BY k) AS n ON n.k = c{r}.k)"""
    steps = [part.format(r=r, n=r + 1) for r in range(rounds) for part in (assign, move)]
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS INTEGER) AS k, e AS c FROM v QUALIFY k < 16),
{", ".join(steps)},
{assign.format(r=rounds)},
s AS (SELECT best.k AS k, CAST(sum(best.d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY 1)
SELECT vec_id, a.best.k AS cluster, a.best.d AS distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM s) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN s ON s.k = a.best.k JOIN c{rounds} AS c ON c.k = a.best.k
"""


#: CRC-32 bit by bit: a byte is followed by eight shifts. A node is a distinct list of opening turns.
_TRIE = r"""
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(x ORDER BY p) AS own, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: list_prepend(CAST(ascii(ch) AS BIGINT), CAST([-1, -1, -1, -1, -1, -1, -1, -1] AS BIGINT[]))))),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS s FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, s[1:d] AS path, d, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS e,
             (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(path[d].t), '[^\x20\x09-\x0D]+')), 0) AS own FROM m GROUP BY path),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT path[1:a] AS path, own, n_children = 0 AS leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM f)),
s AS (SELECT path, count(*) FILTER (leaf) AS n_leaves, sum(own) AS saved FROM u GROUP BY path)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.e) AS ends_sha256
FROM f JOIN s USING (path) LEFT JOIN n AS up ON f.depth > 0 AND up.path = f.path[1:f.depth - 1]
"""

ORACLES: dict[str, str] = {
    "op4_url_filter": _URLS,
    "op5_license_scan": _LICENSES,
    "op6_nn_descent": _NEIGHBOURS,
    "op7_minhash_near_dup": _NEAR,
    "op8_decontamination": _LEAKS,
    "op10_warc": _WARC,
    "op11_ball_tree": _lloyd(3),
    "op12_ngram_join": _components(5),
    "op13_prefix_trie": _TRIE,
}
