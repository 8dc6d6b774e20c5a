"""The operators over the driver's tables: one query each, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.llm import archives, bpe, contamination, digest, hosts, interactions, linededup, manifest, nearest, secrets, sharding, simhash, toxicity
from daytrace.llm.common import new_folder, table

RANKS = "byte_bpe_50k.tiktoken"
Query = Callable[[SparkSession, str], DataFrame]

# The rules that the contract of operator 2 states.
RULES = (
    hosts.Rule("block", "net", "/"),
    hosts.Rule("allow", "example.net", "/en/"),
    hosts.Rule("block", "example.com", "/de/"),
    hosts.Rule("allow", "org", "/fr/"),
)


def held_out(key: Column) -> Column:
    """Whether labels of this document are kept from the fit; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(toxicity.sampled(docs, labels.where(~held_out(F.col("doc_id"))), "doc_id", "text", "toxic"))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url; outcomes are the quality labels, paired with pages by equal ids."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = hosts.judge_urls(table(spark, folder, "pages"), labels, RULES)
    return judged.withColumn("bound", F.round("bound", 6))


def op3_bpe_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    there = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return there.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as whole records in 40 shards; the text is digested after the shuffle."""
    out = sharding.shuffle_records(table(spark, folder, "documents"), shards=40)
    return out.select(
        "doc_id",
        sharding.text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        *sharding.ADDED,
    )


def op5_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, folder, "documents"))


def op6_quartile_digest(spark: SparkSession, folder: str) -> DataFrame:
    pairs = digest.edited_pairs(table(spark, folder, "documents"))
    return pairs.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def op7_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as ARC archives of both versions (by page_id), converted, written as WARC files and read back."""
    packed = archives.pages_to_arc(table(spark, folder, "pages"), "page_id", "url", "html", "CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END")
    path = new_folder(spark, "warc")
    archives.write_warc(archives.with_types(archives.convert(packed)), path)
    read = archives.resolved(archives.read_warc(spark, path))
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op9_contamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    named = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secrets.find_secrets(docs, secrets.fit(secrets.labelled_samples(docs)))
    counted = [secrets.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select(
        "doc_id", *counted, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans")
    )


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a leaf, a tree per lang; claims differ where 7 divides the crc of the id."""
    docs = table(spark, folder, "documents")
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    fields = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    leaf = manifest.record_digest(fields(F.col("n_chars")))
    records = docs.select("doc_id", "lang", leaf.alias("leaf"), manifest.record_digest(fields(claimed)).alias("claimed"))
    built = manifest.manifest(records, "lang", "doc_id", "leaf", carried=["claimed"])
    return manifest.prove(built, "claimed").withColumnRenamed("key", "doc_id")


def op12_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """Filters A to D are conditions on a text, E is a copy of a smaller doc_id's text."""
    text, words = F.col("text"), interactions.words_of(F.col("text"))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    conditions = {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return interactions.audit(table(spark, folder, "documents"), table(spark, folder, "labels"), conditions, copied="E")


def op13_voronoi_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of all other vectors for each whose id 100 divides."""
    return nearest.top_k(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_host_reputation, op3_bpe_tree, op4_shards, op5_line_windows, op6_quartile_digest, op7_arc_to_warc, op8_simhash, op9_contamination, op10_secrets, op11_merkle_manifest, op12_filter_interactions, op13_voronoi_topk)}

SQL: dict[str, str] = {}

SQL["op2_host_reputation"] = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
votes AS (SELECT doc_id, count(*) AS n, sum(quality) AS k FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h0 AS (
  SELECT host, CAST(sum(coalesce(n, 0)) AS DOUBLE) AS n, CAST(sum(coalesce(k, 0)) AS DOUBLE) AS k
  FROM parts LEFT JOIN votes ON page_id = doc_id GROUP BY host),
h1 AS (
  SELECT *, CASE WHEN regexp_matches(host, '^[0-9.:]*$') OR NOT contains(host, '.') THEN ''
    WHEN regexp_extract(host, '[^.]*[.][^.]*$') IN ('co.uk','org.uk','ac.uk','gov.uk','com.au','net.au','org.au','co.nz','co.jp','com.br','co.in','co.za')
      THEN regexp_extract(host, '[^.]*[.][^.]*$')
    ELSE regexp_extract(host, '[^.]*$') END AS suffix FROM h0),
h AS (
  SELECT *, CASE WHEN suffix = '' OR suffix = host THEN host
    WHEN contains(suffix, '.') THEN regexp_extract(host, '([^.]*[.])?[^.]*[.][^.]*$')
    ELSE regexp_extract(host, '[^.]*[.][^.]*$') END AS domain FROM h1),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix, domain),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
g AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS overall FROM s),
ms AS (SELECT s.*, overall AS m FROM s, g),
ss AS (
  SELECT sum(n * (k / n - m) * (k / n - m)) AS s, sum(m * (1 - m)) AS noise, sum(n * m * (1 - m)) / sum(n) AS unit,
    sum(n) AS t, sum(n * n) AS q, count(*) AS g FROM ms WHERE n > 0),
rs AS (
  SELECT least(greatest(coalesce(CASE WHEN g > 1 AND unit * (t - q / t - (g - 1)) > 0
    THEN (s - noise * (g - 1) / g) / (unit * (t - q / t - (g - 1))) END, 1 / 1001.0::DOUBLE), 1 / 1001.0::DOUBLE), 0.5::DOUBLE) AS rho FROM ss),
us AS (SELECT suffix, (k + (1 - rho) / rho * m) / (n + (1 - rho) / rho) AS m FROM ms, rs),
md AS (SELECT d.*, us.m FROM d JOIN us USING (suffix)),
sd AS (
  SELECT sum(n * (k / n - m) * (k / n - m)) AS s, sum(m * (1 - m)) AS noise, sum(n * m * (1 - m)) / sum(n) AS unit,
    sum(n) AS t, sum(n * n) AS q, count(*) AS g FROM md WHERE n > 0),
rd AS (
  SELECT least(greatest(coalesce(CASE WHEN g > 1 AND unit * (t - q / t - (g - 1)) > 0
    THEN (s - noise * (g - 1) / g) / (unit * (t - q / t - (g - 1))) END, 1 / 1001.0::DOUBLE), 1 / 1001.0::DOUBLE), 0.5::DOUBLE) AS rho FROM sd),
ud AS (SELECT domain, (k + (1 - rho) / rho * m) / (n + (1 - rho) / rho) AS m FROM md, rd),
mh AS (SELECT h.*, ud.m FROM h JOIN ud USING (domain)),
sh AS (
  SELECT sum(n * (k / n - m) * (k / n - m)) AS s, sum(m * (1 - m)) AS noise, sum(n * m * (1 - m)) / sum(n) AS unit,
    sum(n) AS t, sum(n * n) AS q, count(*) AS g FROM mh WHERE n > 0),
rh AS (
  SELECT least(greatest(coalesce(CASE WHEN g > 1 AND unit * (t - q / t - (g - 1)) > 0
    THEN (s - noise * (g - 1) / g) / (unit * (t - q / t - (g - 1))) END, 1 / 1001.0::DOUBLE), 1 / 1001.0::DOUBLE), 0.5::DOUBLE) AS rho FROM sh),
uh AS (SELECT host, n, k, (k + (1 - rho) / rho * m) / (n + (1 - rho) / rho) AS m, n + (1 - rho) / rho AS size FROM mh, rh),
r AS (SELECT host, n, k, m - 1.645 * sqrt(m * (1 - m) / (size + 1)) AS bound FROM uh),
j AS (
  SELECT page_id, host, path, n, k, bound, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts JOIN r USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict,
  CAST(n AS BIGINT) AS n_outcomes, CAST(k AS BIGINT) AS n_good, round(bound, 6) AS bound
FROM j
"""

SQL["op5_line_windows"] = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM l)
  WHERE trim(ls[pos + 1] || ls[pos + 2] || ls[pos + 3]) <> ''),
later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM w) WHERE nth > 1),
covered AS (SELECT doc_id, list(DISTINCT pos + step) AS gone FROM later, (SELECT unnest([0, 1, 2]) AS step) GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, l.text, l.ls, gone,
    [ls[i + 1] for i in range(0, len(ls)) if not list_contains(gone, i)] AS left_over
  FROM l LEFT JOIN covered USING (doc_id))
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(left_over, chr(10)) END AS text,
  CAST(coalesce(len(ls), 0) AS INTEGER) AS n_lines,
  CAST(CASE WHEN gone IS NULL THEN 0 ELSE len(ls) - len(left_over) END AS INTEGER) AS n_removed
FROM kept
"""

SQL["op9_contamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS size, list_slice(ws, s + 1, s + least(len(ws), 13)) AS win
  FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 13, 0) + 1)) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM w),
dw AS (
  SELECT doc_id, size, p, list_slice(ws, p + 1, p + size) AS win
  FROM (SELECT doc_id, ws, size, unnest(range(0, len(ws) - size + 1)) AS p FROM d, sizes WHERE len(ws) >= size)),
hit AS (SELECT doc_id, item_id, p, dw.size FROM dw JOIN w ON dw.size = w.size AND dw.win = w.win),
places AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL["op7_arc_to_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to, true AS sound
FROM f
"""

SQL["op11_merkle_manifest"] = r"""
WITH RECURSIVE
d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source, lang, CAST(n_chars AS VARCHAR) AS n, CAST(n_chars + 1 AS VARCHAR) AS n1, text FROM documents),
-- The crc32 of each id, bit by bit: 8 halvings a byte, with the reversed polynomial where a one falls out.
c AS (
  SELECT DISTINCT id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, i: xor(b >> 1, (b & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS crc
  FROM d WHERE id IS NOT NULL),
e AS (
  SELECT doc_id, lang, coalesce(c.crc % 7 = 0, false) AS tampered,
    coalesce(octet_length(encode(d.id)) || ':' || d.id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(n)) || ':' || n, '-') AS n0, coalesce(octet_length(encode(n1)) || ':' || n1, '-') AS n1,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM d LEFT JOIN c USING (id)),
l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256(head || n0 || tail) AS leaf, sha256(head || CASE WHEN tampered THEN n1 ELSE n0 END || tail) AS claimed FROM e)),
t(lang, level, i, n, h) AS (
  SELECT lang, 0, i, n, leaf FROM l
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, level, i // 2, n),
tops AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
r(level, i, n, h) AS (
  SELECT 0, i, n, subroot FROM tops
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM r WHERE n > 1 GROUP BY level, i // 2, n),
root AS (SELECT h AS root FROM r WHERE n = 1),
f(lang, doc_id, leaf, level, i, x, path) AS (
  SELECT lang, doc_id, leaf, 0, i, claimed, '' FROM l
  UNION ALL
  SELECT f.lang, doc_id, leaf, f.level + 1, f.i // 2, CASE WHEN s.h IS NULL THEN sha256(x) WHEN s.i < f.i THEN sha256(s.h || x) ELSE sha256(x || s.h) END, path || coalesce(s.h, '')
  FROM f JOIN t ON t.lang IS NOT DISTINCT FROM f.lang AND t.level = f.level AND t.i = f.i AND t.n > 1
    LEFT JOIN t s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.i = xor(f.i, 1)),
ends AS (SELECT f.*, subroot, tops.i AS top_i FROM f JOIN tops ON tops.lang IS NOT DISTINCT FROM f.lang JOIN t ON t.lang IS NOT DISTINCT FROM f.lang AND t.level = f.level AND t.n = 1),
g(doc_id, leaf, subroot, level, i, x, path) AS (
  SELECT doc_id, leaf, subroot, 0, top_i, x, path FROM ends
  UNION ALL
  SELECT doc_id, leaf, subroot, g.level + 1, g.i // 2, CASE WHEN s.h IS NULL THEN sha256(x) WHEN s.i < g.i THEN sha256(s.h || x) ELSE sha256(x || s.h) END, path || coalesce(s.h, '')
  FROM g JOIN r ON r.level = g.level AND r.i = g.i AND r.n > 1 LEFT JOIN r s ON s.level = g.level AND s.i = xor(g.i, 1))
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, x AS folded_root, x = root AS verified
FROM g JOIN r ON r.level = g.level AND r.n = 1, root
"""

SQL["op12_filter_interactions"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN firsts USING (t) LEFT JOIN said ON d.doc_id = said.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS n_good, sum(bad) AS n_bad FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substring(filter_order, step, 1) AS own, substring(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
p AS (
  SELECT part, filter_order, step, own, n, n_good, n_bad, fails, contains(fails, own) AS hit,
    len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS gone
  FROM g, steps),
c AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN n_bad ELSE 0 END) AS toxic_lost
  FROM p GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM c
"""

SQL["op13_voronoi_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * v.v[i])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
