"""Queries over `documents`, `benchmark`, `pages` and `conversations`: tokens, spans, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace.bindings.registry import joined, query, rounded
from daytrace.bindings.views import table
from daytrace.functions import text as ft
from daytrace.operators import search as osr
from daytrace.session import spread

TOKEN = r"[a-z0-9][a-z0-9/''\-]*"


def chunk_view(spark, folder) -> DataFrame:
    """Documents as report narrative: each belongs to a supplier, a bore and a date."""
    c = F.col
    return spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source")).select(
        c("doc_id").cast("string").alias("chunk_id"),
        "text",
        (c("doc_id") % 100 + 1).cast("string").alias("well"),
        c("source").alias("wellbore"),
        F.concat("lang", F.lit("_"), "source").alias("source_document"),
        F.date_add(F.lit("1995-01-01").cast("date"), (c("doc_id") * 37 % 2500).cast("int")).alias("report_date"),
        c("lang").alias("activity_code"),
    )


CHUNKS_SQL = """chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text, CAST(doc_id % 100 + 1 AS VARCHAR) AS well, source AS wellbore,
    lang || '_' || source AS source_document,
    CAST(DATE '1995-01-01' + CAST(doc_id * 37 % 2500 AS INTEGER) AS DATE) AS report_date
  FROM documents)"""


def index_sql(chunks: str) -> str:
    """Lengths, totals, term frequencies and weights of a chunk table."""
    return f"""words AS MATERIALIZED (SELECT chunk_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM {chunks}),
  totals AS (SELECT count(*) AS n, avg(len(t)) AS a FROM words),
  tf AS (SELECT chunk_id, length, term, count(*) AS tf
         FROM (SELECT chunk_id, len(t) AS length, unnest(t) AS term FROM words) GROUP BY ALL),
  idf AS (SELECT term, ln(1e0 + ((SELECT n FROM totals) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf
          FROM tf GROUP BY term)"""


PART = """idf * tf * 2.5e0 / (tf + 1.5e0 * (1e0 - 0.75e0 + 0.75e0 * (greatest(length, 1) / (SELECT a FROM totals))))"""


@query(
    "token_counts",
    f"""SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents)""",
)
def token_counts(spark, folder) -> DataFrame:
    """Tokens per document."""
    t = F.col("t")
    rows = table(spark, folder, "documents").select("doc_id", ft.tokens(F.col("text")).alias("t"))
    return rows.select(
        "doc_id",
        F.size(t).cast("bigint").alias("tokens"),
        F.size(F.array_distinct(t)).cast("bigint").alias("distinct_tokens"),
    )


@query(
    "search_documents",
    f"""WITH {CHUNKS_SQL}, {index_sql("chunks")},
    asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM benchmark),
    scored AS (
      SELECT item_id, chunk_id, list_reduce(list({PART} ORDER BY term), lambda x, y: x + y) AS score, count(*) AS terms
      FROM asked JOIN tf USING (term) JOIN idf USING (term) GROUP BY item_id, chunk_id)
    SELECT item_id, chunk_id, round(score, 6) AS score, terms, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score > 0)
    WHERE rank <= 5""",
)
def search_documents(spark, folder) -> DataFrame:
    """Best five documents for every benchmark text."""
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = osr.search(chunk_view(spark, folder), asked)
    return hits.select(
        F.col("query_id").alias("item_id"),
        "chunk_id",
        rounded("score", digits=6),
        F.size("matched_terms").cast("bigint").alias("terms"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "search_filtered",
    f"""WITH {CHUNKS_SQL}, {index_sql("chunks")},
    q AS (SELECT item_id, CAST(item_id % 100 + 1 AS VARCHAR) AS well, text FROM benchmark),
    asked AS (SELECT DISTINCT item_id, well, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM q),
    scored AS (
      SELECT item_id, chunk_id, list_reduce(list({PART} ORDER BY term), lambda x, y: x + y) AS score
      FROM asked JOIN tf USING (term) JOIN idf USING (term) JOIN chunks c USING (chunk_id)
      WHERE c.well = asked.well AND c.report_date BETWEEN DATE '1995-06-01' AND DATE '2000-06-01'
      GROUP BY item_id, chunk_id)
    SELECT item_id, chunk_id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
    WHERE rank <= 5""",
)
def search_filtered(spark, folder) -> DataFrame:
    """The same limited to one well and a date range; weights stay those of the corpus."""
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        (F.col("item_id") % 100 + 1).cast("string").alias("well"),
        F.lit("1995-06-01").cast("date").alias("on_or_after"),
        F.lit("2000-06-01").cast("date").alias("on_or_before"),
    )
    hits = osr.search(chunk_view(spark, folder), asked)
    return hits.select(
        F.col("query_id").alias("item_id"), "chunk_id", rounded("score", digits=6), F.col("rank").cast("bigint").alias("rank")
    )


OPENING = r"""CASE WHEN position('. ' IN h) - 1 > 12 THEN left(s, position('. ' IN h))
      WHEN position('.' || chr(10) IN h) - 1 > 12 THEN left(s, position('.' || chr(10) IN h))
      WHEN position('; ' IN h) - 1 > 12 THEN left(s, position('; ' IN h))
      ELSE regexp_replace(h, '\s+$', '') END"""


@query(
    "opening_spans",
    rf"""SELECT doc_id, {OPENING} AS span FROM (SELECT doc_id, s, left(s, 160) AS h FROM (
      SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents))""",
)
def opening_spans(spark, folder) -> DataFrame:
    """Opening span of every document."""
    return table(spark, folder, "documents").select("doc_id", ft.opening_span(F.col("text")).alias("span"))


@query(
    "sentences_with_terms",
    r"""SELECT doc_id, coalesce(list_filter(list_transform(string_split(replace(text, chr(10), '. '), '. '),
        lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '' AND contains(text, p)
          AND (contains(lower(p), 'pressure') OR contains(lower(p), 'anat') OR contains(lower(p), 'ouch')))[1],
      CASE WHEN contains(lower(text), 'pressure') OR contains(lower(text), 'anat') OR contains(lower(text), 'ouch')
        THEN text END) AS span FROM documents""",
)
def sentences_with_terms(spark, folder) -> DataFrame:
    """First sentence of a document that holds one of the terms."""
    terms = F.array(F.lit("pressure"), F.lit("anat"), F.lit("ouch"))
    return table(spark, folder, "documents").select("doc_id", ft.sentence_with(F.col("text"), terms).alias("span"))


@query(
    "stated_reasons",
    "SELECT doc_id, "
    + " OR ".join(
        f"contains(lower(text), '{p}')"
        for p in (
            "to prepare", "in preparation", "in order to", "due to", "because of", "for the purpose",
            "as per", "according to programme", "planned", "requested by",
        )
    )
    + " AS states_a_reason FROM documents",
)
def stated_reasons(spark, folder) -> DataFrame:
    """Does a document use a phrase that states a reason."""
    return table(spark, folder, "documents").select("doc_id", ft.states_a_reason(F.col("text")).alias("states_a_reason"))


# A look-behind is a test of the character before each place; a match that began earlier covers later places.
@query(
    "stray_numbers",
    r"""WITH plain AS (
      SELECT doc_id, regexp_replace(regexp_replace(text, '\b\d{1,3}/\d{1,3}-(?:[A-Z]-)?\d{1,3}(?:\s+[A-Z]{1,2}\d?\b)?', '<well>', 'g'),
        '\b(?:19|20)\d{2}-\d{2}-\d{2}\b', '<date>', 'g') AS p FROM documents WHERE regexp_matches(text, '\d')),
    places AS (SELECT doc_id, p, unnest(range(1, length(p) + 1)) AS i FROM plain),
    starts AS (
      SELECT doc_id, p, i, regexp_extract(substr(p, i), '^(\d[\d,]*(?:\.\d+)?)(?:[^\w]|$)', 1) AS n FROM places
      WHERE regexp_matches(substr(p, i, 1), '^\d') AND (i = 1 OR regexp_matches(substr(p, i - 1, 1), '^[^\w.]'))),
    spans AS (
      SELECT *, max(i + length(n)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
      FROM starts WHERE n <> '')
    SELECT doc_id, n AS number, count(*) AS times FROM spans
    WHERE coalesce(reached <= i, true) AND NOT regexp_matches(n, '^(?:19|20)\d{2}$')
      AND NOT regexp_matches(substr(p, i + length(n)), '^(?:%|\s{0,2}percent|\s{0,1}per cent)')
    GROUP BY doc_id, n""",
)
def stray_numbers(spark, folder) -> DataFrame:
    """P25: every number in prose without a source, one row per number and document with its count."""
    rows = table(spark, folder, "documents").select("doc_id", F.explode(ft.stray_numbers(F.col("text"))).alias("number"))
    return rows.groupBy("doc_id", "number").agg(F.count(F.lit(1)).alias("times"))


@query(
    "wording_above_level",
    r"""SELECT conv_id, turn, len(regexp_extract_all(text, '(?i)\bcaused\s+by\b'))
      + len(regexp_extract_all(text, '(?i)\bunderlying\s+(?:reason|cause)\b'))
      + len(regexp_extract_all(text, '(?i)\boriginated\s+(?:from|in)\b'))
      + len(regexp_extract_all(text, '(?i)\bbecause\s+the\s+operator\b'))
      + len(regexp_extract_all(text, '(?i)\bdue\s+to\s+a\s+(?:decision|plan)\b'))
      + len(regexp_extract_all(text, '(?i)\boperator''s\s+decision\b'))
      + len(regexp_extract_all(text, '(?i)\broot[\s-]?causes?'))
      - len(regexp_extract_all(text, '(?i)\broot[\s-]?causes?\s+(?:unresolved|not\s+(?:established|documented))')) AS phrases
    FROM conversations""",
)
def wording_above_level(spark, folder) -> DataFrame:
    """Root-cause wording per message, judged at no level."""
    found = ft.wording_above_level(F.col("text"), F.lit(None).cast("string"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.size(found).cast("bigint").alias("phrases"))
