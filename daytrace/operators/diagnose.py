"""Diagnostic bundles: what changed between the rows before an episode and the episode."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.functions import days as fd
from daytrace.operators.joins import hinted, in_range, within

EPISODE = ["well", "onset", "offset"]
ROW_CELL = 64
#: Wells and ranges of dates that one task compares at once, and cells that a median sorts at once.
WELLS_AT_ONCE, RANGES_AT_ONCE, MEDIAN_CELLS = 512, 8192, 1 << 18


def _median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def numbered(days: DataFrame) -> DataFrame:
    w = Window.partitionBy("well").orderBy("production_date")
    return days.withColumn("row", F.row_number().over(w))


def bundle_rows(episodes: DataFrame, days: DataFrame, baseline_rows: int = fixed.BASELINE_ROWS) -> DataFrame:
    """Day rows of each episode and of the rows before it, marked by `during`.

    Episodes are turned into row-number ranges of their well, so 'the last 60 rows before' is a
    range join and nothing is ranked per episode. Wells without an episode are left out before
    their days are numbered.
    """
    spans = episodes.select(*EPISODE)
    wells = spans.select("well").distinct()
    rows = numbered(days.join(hinted(wells, within(wells)), "well", "left_semi"))
    placed = (
        rows.select("well", "production_date", "row")
        .join(
            spans.select("well", "onset", "offset", F.explode(F.array("onset", "offset")).alias("production_date")).distinct(),
            ["well", "production_date"],
        )
        .groupBy(*EPISODE)
        .agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"))
    )
    held = in_range(
        rows, placed, ["well"], F.col("row"), F.col("first_row") - baseline_rows, F.col("last_row"), ROW_CELL
    )
    return held.withColumn("during", F.col("row") >= F.col("first_row"))


def bundles(
    episodes: DataFrame, days: DataFrame, baseline_rows: int = fixed.BASELINE_ROWS
) -> DataFrame:
    """One row per episode: window bounds, rates, water cut, class counts, and `channels`, an
    array with one struct per mandatory channel."""
    during = F.col("during")
    when = F.col("production_date")

    def side(test: Column, c: Column) -> Column:
        return F.when(test, c)

    stats = []
    for name in fixed.MANDATORY_CHANNELS:
        v = fd.reading(name)
        seen = F.when(during & v.isNotNull(), when)
        stats += [
            F.count(side(~during, v)).alias(f"{name}__nb"),
            _median(side(~during, v)).alias(f"{name}__mb"),
            F.stddev_pop(side(~during, v)).alias(f"{name}__sb"),
            F.count(side(during, v)).alias(f"{name}__ne"),
            _median(side(during, v)).alias(f"{name}__me"),
            F.min_by(v, seen).alias(f"{name}__first"),
            F.max_by(v, seen).alias(f"{name}__last"),
        ]
    rates = []
    for prefix, test in (("baseline", ~during), ("episode", during)):
        rates += [
            F.count_if(test).alias(f"{prefix}_days"),
            _median(side(test, F.col("q_24h"))).alias(f"{prefix}_median_rate"),
            _median(side(test, fd.water_cut())).alias(f"{prefix}_water_cut"),
            _median(side(test, fd.gas_oil_ratio())).alias(f"{prefix}_gas_oil_ratio"),
        ]
    grouped = (
        bundle_rows(episodes, days, baseline_rows)
        .groupBy(*EPISODE)
        .agg(
            F.min(side(~during, when)).alias("baseline_start"),
            F.max(side(~during, when)).alias("baseline_end"),
            *rates,
            *stats,
            *[
                F.count_if(during & (F.col("day_class") == c)).alias(f"{c}_days")
                for c in ("quarantined", "missing", "downtime")
            ],
        )
    )
    channels = F.array(*[_channel(name) for name in fixed.MANDATORY_CHANNELS])
    return grouped.select(
        *EPISODE,
        F.coalesce("baseline_start", "onset").alias("baseline_start"),
        F.coalesce("baseline_end", "onset").alias("baseline_end"),
        *[f"{p}_{c}" for p in ("baseline", "episode") for c in ("days", "median_rate", "water_cut", "gas_oil_ratio")],
        "quarantined_days",
        "missing_days",
        "downtime_days",
        channels.alias("channels"),
    )


def _channel(name: str) -> Column:
    """Comparison of one channel; shifts are null unless both sides have enough readings."""

    def c(part: str) -> Column:
        return F.col(f"{name}__{part}")

    enough = (c("nb") >= fixed.MIN_CHANNEL_READINGS) & (c("ne") >= fixed.MIN_CHANNEL_READINGS)
    shift = F.when(enough, c("me") - c("mb"))
    return F.struct(
        F.lit(name).alias("channel"),
        F.lit(fixed.CHANNEL_UNITS[name]).alias("unit"),
        F.col("episode_days").alias("days"),
        c("nb").alias("baseline_readings"),
        c("mb").alias("baseline_median"),
        c("ne").alias("readings"),
        c("me").alias("median"),
        c("first").alias("first"),
        c("last").alias("last"),
        shift.alias("shift"),
        F.when(c("mb") != 0.0, shift / F.abs(c("mb"))).alias("relative_shift"),
        F.when((c("nb") > 1) & (c("sb") > 0.0), shift / c("sb")).alias("standardised_shift"),
        (c("ne") >= fixed.MIN_CHANNEL_READINGS).alias("available"),
    )


def channel_rows(bundle: DataFrame) -> DataFrame:
    """Long form: one row per episode and channel."""
    return bundle.select(*EPISODE, F.posexplode("channels").alias("position", "c")).select(
        *EPISODE, "position", "c.*"
    )


def _medians(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Median of values[start:end] for each pair, NaN where it holds no reading."""
    out = np.full(len(starts), np.nan)
    widths = ends - starts
    order = np.argsort(widths, kind="stable")
    step = max(1, MEDIAN_CELLS // max(1, int(widths.max(initial=1))))
    for part in (order[i : i + step] for i in range(0, len(order), step)):
        at = starts[part, None] + np.arange(max(1, int(widths[part].max())))
        held = np.where(at < ends[part, None], values[np.minimum(at, len(values) - 1)], np.nan)
        held.sort(axis=1)
        n = np.count_nonzero(~np.isnan(held), axis=1)
        row = np.arange(len(part))
        low, high = held[row, np.maximum(n - 1, 0) // 2], held[row, np.minimum(n // 2, held.shape[1] - 1)]
        out[part] = np.where(low == high, low, 0.5 * low + 0.5 * high)
    return out


def _changes(dates: np.ndarray, rates: np.ndarray, inside: np.ndarray, first: np.ndarray, last: np.ndarray, baseline_rows: int) -> np.ndarray:
    """Rate change of one well over each range of dates, NaN where it cannot be compared.

    `inside` marks the rows that belong to the group. Ranges that hold the same rows are worked once.
    """
    at = np.flatnonzero(inside)
    low, high = np.searchsorted(dates[at], first, "left"), np.searchsorted(dates[at], last, "right")
    pairs, place = np.unique(low * (len(at) + 1) + high, return_inverse=True)
    low, high = np.divmod(pairs, len(at) + 1)
    change = np.full(len(pairs), np.nan)
    begin = at[np.minimum(low, len(at) - 1)]
    held = np.flatnonzero((high > low) & (begin >= fixed.MIN_CHANNEL_READINGS))
    if len(held):
        begins, which = np.unique(begin[held], return_inverse=True)
        before = _medians(rates, np.maximum(begins - baseline_rows, 0), begins)[which]
        during = _medians(rates[at], low[held], high[held])
        with np.errstate(invalid="ignore", divide="ignore"):
            change[held] = np.where(before > 0, (during - before) / before, np.nan)
    return change[place]


def _compare(baseline_rows: int):
    """The changes of a bucket of wells over a part of the ranges of their group, one row per range."""

    def compared(key: tuple, wells: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
        if wells.empty or ranges.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("_group", "onset", "offset", "changes", "down", "own")})
        first, last = ranges["first"].to_numpy(), ranges["last"].to_numpy()
        rows = zip(wells["dates"], wells["rates"], wells["inside"], strict=True)
        table = np.stack([_changes(np.asarray(d), np.asarray(r, dtype=float), np.asarray(i, dtype=bool), first, last, baseline_rows) for d, r, i in rows])
        place = {well: n for n, well in enumerate(wells["well"])}
        own = [
            [{"well": w, "change": None if np.isnan(table[place[w], n]) else table[place[w], n]} for w in asked if w in place]
            for n, asked in enumerate(ranges["asked"])
        ]
        ordered = np.sort(table, axis=0)
        counts = np.count_nonzero(~np.isnan(ordered), axis=0)
        return pd.DataFrame(
            {
                "_group": key[0],
                "onset": ranges["onset"],
                "offset": ranges["offset"],
                "changes": [ordered[:n, i] for i, n in enumerate(counts)],
                "down": np.count_nonzero(ordered <= fixed.OFFSET_DOWN, axis=0),
                "own": own,
            }
        )

    return compared


def offset_changes(asked: DataFrame, days: DataFrame, sizes: DataFrame, baseline_rows: int = fixed.BASELINE_ROWS) -> DataFrame:
    """Rate changes of every well of a group over each range of dates (_group, onset, offset, changes, down, own).

    `asked` names ranges by well (_group, onset, offset, well), `days` has a column _group, `sizes` the wells
    of each group. A range that several episodes share is worked once. A well's rows, at most one a date, are
    one list; buckets of wells meet the ranges of their group, so no row is paired with a range and only
    the changes are shuffled. `changes` are sorted; `own` holds the change of each well that asked.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.unix_date("production_date").alias("n"), "q_24h", "_group")))
    held = days.groupBy("well").agg(rows.alias("_rows"))
    lists = held.withColumn("_group", F.explode(F.array_distinct(F.transform("_rows", lambda r: r["_group"]))))
    ranges = asked.groupBy("_group", "onset", "offset").agg(F.collect_set("well").alias("asked"))
    placed = ranges.select(
        "*", F.unix_date("onset").alias("first"), F.unix_date("offset").alias("last"),
        F.floor((F.row_number().over(Window.partitionBy("_group").orderBy("onset", "offset")) - 1) / RANGES_AT_ONCE).alias("_part"),
    )
    parts = placed.groupBy("_group").agg((F.max("_part") + 1).alias("_parts"))
    buckets = F.ceil(F.col("wells") / WELLS_AT_ONCE)
    wells = (
        lists.join(sizes, "_group")
        .join(parts, "_group")
        .select(
            "_group",
            F.pmod(F.xxhash64("well"), buckets).alias("_bucket"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part"),
            "well",
            F.transform("_rows", lambda r: r["n"]).alias("dates"),
            F.transform("_rows", lambda r: r["q_24h"]).alias("rates"),
            F.transform("_rows", lambda r: r["_group"].eqNullSafe(F.col("_group"))).alias("inside"),
        )
    )
    dealt = placed.join(sizes, "_group").withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), buckets - 1))).drop("wells")
    key = ["_group", "_bucket", "_part"]
    group = days.schema["_group"].dataType.simpleString()
    shape = f"_group {group}, onset date, offset date, changes array<double>, down bigint, own array<struct<well:string,change:double>>"
    found = wells.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(_compare(baseline_rows), shape)
    return found.groupBy("_group", "onset", "offset").agg(
        F.sort_array(F.flatten(F.collect_list("changes"))).alias("changes"),
        F.sum("down").alias("down"),
        F.flatten(F.collect_list("own")).alias("own"),
    )


def offsets(episodes: DataFrame, days: DataFrame, group: str, baseline_rows: int = fixed.BASELINE_ROWS) -> DataFrame:
    """Rate change of the other wells over each episode's dates, against their own rows before.

    `group` names a column of `days` (a field, an area) whose wells are compared. The changes of a
    range are sorted once; the median of all wells but the episode's own is then read off their
    middle, moved by one place where the own well lies before it.
    """
    # Columns that the comparison does not need would follow every day into its well's list.
    placed = days.select("well", "production_date", "q_24h", F.col(group).alias("_group"))
    members = placed.select("_group", "well").distinct()
    sizes = members.groupBy("_group").agg(F.count(F.lit(1)).alias("wells"))
    asked = episodes.select(*EPISODE).join(members, "well")
    summary = offset_changes(asked, placed, sizes, baseline_rows)

    def judged(own: Column) -> Column:
        there = own["change"].isNotNull()
        left = F.size("changes") - there.cast("int")
        nth = F.array_position("changes", own["change"]) - 1

        def change_at(place: Column) -> Column:
            """The change at a place among the other wells."""
            return F.get("changes", (place + F.coalesce((place >= nth).cast("int"), F.lit(0))).cast("int"))

        median = F.when(left > 0, (change_at(F.floor((left - 1) / 2)) + change_at(F.floor(left / 2))) / 2)
        down = F.col("down") - F.coalesce((own["change"] <= fixed.OFFSET_DOWN).cast("int"), F.lit(0))
        return F.struct(
            own["well"].alias("well"), left.cast("bigint").alias("wells_compared"), down.alias("wells_also_down"), median.alias("median_rate_change")
        )

    out = summary.select("_group", "onset", "offset", F.inline(F.transform("own", judged))).join(sizes, "_group")
    n = F.col("wells") - 1
    return out.select(*EPISODE, n.alias("other_wells"), "wells_compared", "wells_also_down", "median_rate_change").withColumn(
        "field_wide", (F.col("other_wells") > 0) & (F.col("wells_also_down") >= F.greatest(F.lit(1), F.floor(F.col("other_wells") / 2)))
    )


def strongest_deviation(bundle: DataFrame) -> DataFrame:
    """Baseline call per episode: the channel moved furthest in its adverse direction, or none."""
    drivers = fixed.BASELINE_DRIVERS

    def lookup(values: dict, key: Column) -> Column:
        return F.create_map(*[F.lit(x) for p in values.items() for x in p])[key]

    def scored(c: Column) -> Column:
        key = c["channel"]
        return F.struct(
            (c["standardised_shift"] * lookup({k: v[1] for k, v in drivers.items()}, key)).alias("signed"),
            (-lookup({k: v[0] for k, v in drivers.items()}, key)).alias("order"),
            key.alias("channel"),
        )

    comparable = F.filter("channels", lambda c: c["standardised_shift"].isNotNull())
    strong = F.filter(F.transform(comparable, scored), lambda s: F.round(s["signed"], fixed.SHIFT_DIGITS) >= fixed.STRONG_SHIFT)
    best = F.array_max(
        F.transform(
            strong,
            lambda s: F.struct(
                F.round(s["signed"], fixed.SHIFT_DIGITS).alias("rounded"), s["order"].alias("order"), s["channel"].alias("channel"), s["signed"].alias("signed")
            ),
        )
    )
    skipped = F.transform(
        F.filter("channels", lambda c: c["standardised_shift"].isNull()), lambda c: c["channel"]
    )
    return (
        bundle.withColumn("_b", best)
        .withColumn("channel", F.col("_b.channel"))
        .select(
            *EPISODE,
            lookup({k: v[2] for k, v in drivers.items()}, F.col("channel")).alias("proximate_driver"),
            "channel",
            F.col("_b.signed").alias("standardised_shift"),
            F.when(F.col("channel").isNotNull(), "proximate_driver").alias("causal_level"),
            F.lit("unresolved").alias("root_cause"),
            lookup({k: v[3] for k, v in drivers.items()}, F.col("channel")).alias("family"),
            skipped.alias("skipped_channels"),
            F.col("channel").isNull().alias("abstained"),
        )
    )
