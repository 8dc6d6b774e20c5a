"""Operator 5: overlapping three-line windows, repeated ones removed wherever they come later.

Each text is cut at line feeds, with `ends=SENTENCES` also where a sentence ends; every three
consecutive lines are hashed to 128 bits inside the row.
A window that occurs more than once anywhere keeps its first occurrence (smallest doc_id, then
position); the lines of all later ones go, and what the overlapping windows cover is merged.

The aggregation is combined before its shuffle, and the join back is salted, so a passage that a
third of all documents share is spread over tasks. A text is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.llm.common import salted_join

SPAN = 3
#: What lies between two lines: a line feed, or the spaces after a sentence end as well.
LINES, SENTENCES = r"\n", r"\n|(?<=[.!?\u2026])[ \t]+|(?<=[\u3002\uff01\uff1f])[ \t]*"


def windows(lines: Column) -> Column:
    """(position, two hashes) of each three lines in a row, unless all three are blank."""
    three = lambda i: [F.get(lines, i + k) for k in range(SPAN)]
    found = F.transform(
        F.sequence(F.lit(0), F.size(lines) - SPAN),
        lambda i: F.when(
            F.trim(F.concat(*three(i))) != "",
            F.struct(i.alias("pos"), F.xxhash64(*three(i)).alias("w1"), F.xxhash64(F.lit("again"), *three(i)).alias("w2")),
        ),
    )
    return F.when(F.size(lines) >= SPAN, F.filter(found, lambda w: w.isNotNull()))


def kept_lines(lines: Column, starts: Column) -> Column:
    """Lines outside of all windows that begin at `starts` (sorted): the gaps between them."""
    n = F.size(starts)

    def gap(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(starts, i - 1) + SPAN)
        end = F.when(i == n, F.size(lines)).otherwise(F.get(starts, i))
        return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), n), gap))


def kept_places(n: Column, starts: Column) -> Column:
    """Positions out of `n` that no window beginning at `starts` (sorted) covers."""
    last = F.size(starts)

    def gap(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(starts, i - 1) + SPAN)
        end = F.when(i == last, n).otherwise(F.get(starts, i))
        return F.when(begin < end, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), last), gap))


def rejoined(lines: Column, between: Column, places: Column) -> Column:
    """The lines at `places` with what lay before each; a line feed if one lay anywhere in what went."""

    def glue(j: Column) -> Column:
        a, b = F.get(places, j - 1), F.get(places, j)
        fed = (b > a + 1) & F.exists(F.slice(between, a + 1, b - a), lambda s: s == "\n")
        return F.when(j == 0, F.lit("")).when(fed, F.lit("\n")).otherwise(F.get(between, b - 1))

    parts = F.transform(F.sequence(F.lit(0), F.size(places) - 1), lambda j: F.concat(glue(j), F.get(lines, F.get(places, j))))
    return F.when(F.size(places) == 0, F.lit("")).otherwise(F.array_join(parts, ""))


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carried: Sequence[str] = (), ends: str = LINES
) -> DataFrame:
    """Per row: key, text without later occurrences, the `carried` columns, n_lines and n_removed.

    A null text stays null with no lines; texts under three lines are left alone; a document of which
    all lines go becomes an empty text. Rows that share a key count as one document: neither is later
    than the other. Null keys come after all others. In a run of equal lines the first stays. `ends`
    is what a line ends at; the lines that stay keep their own separators.
    """
    rest = F.struct(*[F.col(c) for c in carried]) if carried else F.lit(None)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), rest.alias("_rest")).withColumn("_row", F.xxhash64("_text"))
    # The lines are a column of their own: inside the lambdas the split would run once per line.
    lined = rows.select("_key", "_row", F.split("_text", ends).alias("_lines"))
    seen = lined.select("_key", "_row", F.explode(windows(F.col("_lines"))).alias("_w")).select("_key", "_row", "_w.*")
    first = seen.groupBy("w1", "w2").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    repeated = salted_join(seen, first, ["w1", "w2"], ["_key", "_row"])
    within = Window.partitionBy("_key", "_row").orderBy("w1", "w2", "pos")
    again = (F.lag("w1").over(within) == F.col("w1")) & (F.lag("w2").over(within) == F.col("w2")) & (F.lag("pos").over(within) < F.col("pos"))
    later = (
        repeated.withColumn("_again", F.coalesce(again, F.lit(False)))
        .where(F.col("_again") | ~F.col("_key").eqNullSafe(F.col("_first")))
        .groupBy("_key", "_row")
        .agg(F.sort_array(F.collect_set("pos")).alias("_starts"))
        .withColumnsRenamed({"_key": "_k", "_row": "_r"})
    )
    met = rows.join(later, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")), "left")
    met = met.select("_key", "_text", "_rest", "_starts", F.split("_text", ends).alias("_lines"))
    if ends != LINES:
        return _with_separators(met, key, text, carried, ends)
    kept = met.select(
        "_key",
        "_text",
        "_rest",
        F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("_lines")).alias("_n"),
        F.when(F.col("_starts").isNotNull(), kept_lines(F.col("_lines"), F.col("_starts"))).alias("_kept"),
    )
    n = F.col("_n")
    return kept.select(
        F.col("_key").alias(key),
        F.when(F.col("_kept").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n")).alias(text),
        *[F.col(f"_rest.{c}").alias(c) for c in carried],
        n.alias("n_lines"),
        F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(n - F.size("_kept")).alias("n_removed"),
    )


def _with_separators(met: DataFrame, key: str, text: str, carried: Sequence[str], ends: str) -> DataFrame:
    """The result of `dedup_lines` where lines are not all joined by line feeds."""
    changed = F.col("_starts").isNotNull()
    placed = met.select(
        "_key",
        "_text",
        "_rest",
        "_lines",
        F.when(changed, F.regexp_extract_all("_text", F.lit(ends), F.lit(0))).alias("_between"),
        F.when(changed, kept_places(F.size("_lines"), F.col("_starts"))).alias("_places"),
    )
    n = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("_lines"))
    whole = F.col("_places").isNull()
    return placed.select(
        F.col("_key").alias(key),
        F.when(whole, F.col("_text")).otherwise(rejoined(F.col("_lines"), F.col("_between"), F.col("_places"))).alias(text),
        *[F.col(f"_rest.{c}").alias(c) for c in carried],
        n.alias("n_lines"),
        F.when(whole, F.lit(0)).otherwise(n - F.size("_places")).alias("n_removed"),
    )
