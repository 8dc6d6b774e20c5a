"""BM25 search of many queries over a chunk table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.functions import text as ft
from daytrace.operators.joins import hinted, in_range, within
from daytrace.session import checkpointed, shared_folder

DATE_CELL_DAYS = 64
#: Files of postings are told apart by this many groups of terms.
BUCKETS = 32
#: First contenders of a query: its rarest terms up to this many postings, and of those the best; both times the hits.
SEED_ROWS, CONTENDERS = 64, 4
#: Terms are read only for the chunks left if together they stay under this share of the floor: a larger share reads
#: fewer postings of common terms for all chunks, a smaller one leaves fewer chunks.
IDLE_SHARE = 0.5
#: Floors are lowered by more than any rounding of sums.
SLACK = 1 - 1e-9


@dataclass(frozen=True)
class Index:
    """A stored index: postings by term bucket, one row per term, and two figures of the corpus."""

    postings: DataFrame  # bucket, term, chunk_id, kept columns, length, tf
    terms: DataFrame  # bucket, term, df, most: the greatest share of a posting, before its weight
    chunks: int
    average_length: float


def query_terms(queries: DataFrame) -> DataFrame:
    """One row per query and distinct term."""
    return queries.withColumn("term", F.explode(F.array_distinct(ft.tokens(F.col("query"))))).drop("query")


def term_counts(chunks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per chunk its length in tokens and `terms`, its distinct terms with their counts.

    Counted inside the row: the tokens are sorted and the places found where a run begins, so no
    token leaves its row.
    """
    rows = chunks.select("chunk_id", *keep, F.array_sort(ft.tokens(F.col("text"))).alias("_t"))
    at = F.transform("_t", lambda term, i: F.when((i == 0) | (F.get("_t", i - 1) != term), i))
    rows = rows.withColumn("length", F.size("_t")).withColumn("_at", F.array_compact(at))

    def entry(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_at", i + 1), F.col("length"))
        return F.struct(F.get("_t", start).alias("term"), (end - start).alias("tf"))

    return rows.withColumn("terms", F.transform("_at", entry)).drop("_t", "_at")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_index(chunks: DataFrame, keep: Sequence[str] = (), vocabulary: DataFrame | None = None, folder: str | None = None) -> Index:
    """Write the index of a chunk table, of all its terms or of a vocabulary, and give it back.

    The chunks are read once, into rows of counts; everything else is made of those. Postings are
    dealt to files by term bucket, where a search finds them; a bucket that a common term fills is
    split into several files. `keep` names columns that queries may filter on.
    """
    spark = chunks.sparkSession
    folder = folder or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    counts = stored(term_counts(chunks, keep), "counts")
    figures = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("a")).first()
    average = figures["a"] or 0.0
    rows = counts.select("chunk_id", *keep, "length", F.explode("terms").alias("_e")).select("_e.term", "chunk_id", *keep, "length", "_e.tf")
    if vocabulary is not None:
        rows = rows.join(vocabulary, "term", "left_semi")
    dealt = rows.withColumn("bucket", bucket_of(F.col("term"))).hint("rebalance", "bucket")
    postings = stored(dealt.sortWithinPartitions("bucket", "term"), "postings", ["bucket"])
    of_term = postings.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.max(_share(average)).alias("most"))
    return Index(postings, stored(of_term, "terms"), figures["n"], average)


def _share(average: float) -> Column:
    """What a posting adds to a score for each unit of its term's weight."""
    k1, b, tf = F.lit(fixed.BM25_K1), F.lit(fixed.BM25_B), F.col("tf")
    relative = F.greatest(F.col("length"), F.lit(1)) / F.lit(average if average > 0 else 1.0)
    return tf * (k1 + 1.0) / (tf + k1 * (F.lit(1.0) - b + b * relative))


def _part(average: float) -> Column:
    return F.col("idf") * _share(average)


def _asked(queries: DataFrame) -> tuple[list[str], bool]:
    """Filter columns the queries use, and whether they limit dates."""
    filters = [c for c in ("well", "wellbore") if c in queries.columns]
    return filters, "on_or_after" in queries.columns or "on_or_before" in queries.columns


def search(chunks: DataFrame, queries: DataFrame, limit: int = fixed.HITS_PER_PASS) -> DataFrame:
    """Top `limit` chunks per query: (query_id, chunk_id, score, matched_terms, rank).

    `queries` holds query_id and query, and may hold filters: well, wellbore, on_or_after and
    on_or_before (null means no filter). Filters act before ranking; document frequencies and the
    average length stay those of the whole corpus. An index of the queries' terms is made for it.
    """
    filters, dated = _asked(queries)
    terms = query_terms(queries).select("term").distinct()
    index = build_index(chunks, [*filters, *(["report_date"] if dated else [])], hinted(terms, within(terms)))
    return search_index(index, queries, limit)


def search_index(index: Index, queries: DataFrame, limit: int = fixed.HITS_PER_PASS) -> DataFrame:
    """The same over an index built before; it must keep the columns that the queries filter on."""
    filters, dated = _asked(queries)
    asked = query_terms(queries)
    n = F.col("df")
    weight = F.ln(F.lit(1.0) + (F.lit(float(index.chunks)) - n + 0.5) / (n + 0.5))
    weighted = asked.join(index.terms.withColumn("idf", weight), "term")
    if filters or dated:
        found = index.postings.drop("bucket")
        weighted = weighted.drop("bucket", "df", "most")
        return _best(_scored(_filtered(found, hinted(weighted, within(asked)), filters, dated), index), limit)
    return _best(_scored(_contenders(index, weighted, limit), index), limit)


def _read(index: Index, wanted: DataFrame) -> DataFrame:
    """Postings of the wanted terms; the bucket lets a scan skip files."""
    return index.postings.join(wanted, ["bucket", "term"])


def _contenders(index: Index, weighted: DataFrame, limit: int) -> DataFrame:
    """Postings (query_id, chunk_id, length, term, tf, idf) of every chunk that can be among the best of a query.

    The rarest terms of a query give first contenders, whose whole scores give a floor: the score that the
    last of the best has at least. Terms that together stay well under the floor cannot bring a chunk
    in by themselves, so only the others are read for all chunks; a chunk goes on if what it has of those
    and the most that the rest could add reach the floor. Nothing that ties with the floor is lost.
    """
    query = Window.partitionBy("query_id")
    terms = checkpointed(weighted.withColumn("impact", F.col("idf") * F.col("most")))
    small = within(terms)
    before = F.sum("df").over(query.orderBy(F.desc("impact"), "term").rowsBetween(Window.unboundedPreceding, -1))
    seeds = terms.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < SEED_ROWS * limit)
    part = _part(index.average_length)

    def sums(wanted: DataFrame) -> DataFrame:
        return _read(index, hinted(wanted, small)).groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))

    def whole(pairs: DataFrame) -> DataFrame:
        """Postings of given (query_id, chunk_id) for all terms of the query."""
        wanted = pairs.select("query_id", "chunk_id").join(hinted(terms, small), "query_id")
        return index.postings.join(wanted, ["bucket", "term", "chunk_id"]).select("query_id", "chunk_id", "length", "term", "tf", "idf")

    first = query.orderBy(F.desc("score"), "chunk_id")
    contenders = sums(seeds.drop("_before")).withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= CONTENDERS * limit)
    scored = whole(contenders).groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    floor = (
        scored.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") == limit).select("query_id", (F.col("score") * SLACK).alias("floor"))
    )
    upward = query.orderBy("impact", F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = terms.join(floor, "query_id", "left").withColumn("idle", F.coalesce(F.sum("impact").over(upward) < F.col("floor") * IDLE_SHARE, F.lit(False)))
    rest = F.sum(F.when(F.col("idle"), F.col("impact")).otherwise(0.0)).over(query)
    judged = checkpointed(judged.withColumn("rest", rest))
    drawn = sums(judged.where("not idle").select("query_id", "bucket", "term", "idf"))
    bounds = judged.groupBy("query_id").agg(F.max("floor").alias("floor"), F.max("rest").alias("rest"))
    able = drawn.join(hinted(bounds, small), "query_id").where(F.col("floor").isNull() | (F.col("score") + F.col("rest") >= F.col("floor")))
    return whole(able)


def _scored(pairs: DataFrame, index: Index) -> DataFrame:
    # Terms are added in sorted order, so the last bit of a score does not depend on the plan.
    parts = F.sort_array(F.collect_list(F.struct("term", "part")))
    return (
        pairs.withColumn("part", _part(index.average_length))
        .groupBy("chunk_id", "query_id")
        .agg(parts.alias("p"))
        .select(
            "query_id",
            "chunk_id",
            F.aggregate("p", F.lit(0.0), lambda total, x: total + x["part"]).alias("score"),
            F.transform("p", lambda x: x["term"]).alias("matched_terms"),
        )
        .where(F.col("score") > 0.0)
    )


def _best(scored: DataFrame, limit: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    # The rank filter is applied inside each task first, so a query matching every chunk still
    # sends only its best few rows to the final ranking.
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def _filtered(found: DataFrame, weighted: DataFrame, filters: Sequence[str], dated: bool) -> DataFrame:
    if not filters and not dated:
        return found.join(weighted, "term")
    first, last = F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")
    for name, default in (("on_or_after", first), ("on_or_before", last)):
        bound = F.coalesce(F.col(name), default) if name in weighted.columns else default
        weighted = weighted.withColumn(name, bound)
    wanted = weighted.withColumnsRenamed({f: f"_{f}" for f in filters})
    open_well = "well" not in filters
    tests = [(F.col(f"_{f}").isNull() | (F.col(f"_{f}") == F.col(f))) for f in filters]
    condition = F.lit(True)
    for test in tests:
        condition = condition & test
    if dated and not open_well:
        # Queries about one well and a date range: equi join on well, term and date cell.
        exact = wanted.where(
            F.col("_well").isNotNull() & (F.col("on_or_after") > first) & (F.col("on_or_before") < last)
        )
        general = wanted.where(
            F.col("_well").isNull() | (F.col("on_or_after") <= first) | (F.col("on_or_before") >= last)
        )
        near = in_range(
            found,
            exact.withColumn("well", F.col("_well")),
            ["term", "well"],
            F.unix_date("report_date"),
            F.unix_date("on_or_after"),
            F.unix_date("on_or_before"),
            DATE_CELL_DAYS,
        ).where(condition)
        rest = found.join(general, "term").where(
            condition & F.col("report_date").between(F.col("on_or_after"), F.col("on_or_before"))
        )
        columns = ["query_id", "chunk_id", "length", "term", "tf", "idf"]
        return near.select(*columns).unionByName(rest.select(*columns))
    joined = found.join(wanted, "term").where(condition)
    if dated:
        joined = joined.where(F.col("report_date").between(F.col("on_or_after"), F.col("on_or_before")))
    return joined
