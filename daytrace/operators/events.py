"""Lost-time events from activity blocks, baseline causes, two-path integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.functions.days import fired

HOUR_MICROS = 3_600_000_000.0
MINUTE_HOURS = 1.0 / 60.0


def is_non_productive(code: Column, state: Column) -> Column:
    head = F.lower(F.trim(F.substring_index(code, "--", 1)))
    return (head == "interruption") | (F.lower(F.trim(state)) == "fail")


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(HOUR_MICROS)


def category(code: Column) -> Column:
    return F.trim(F.substring_index(code, "--", 1))


def subcategory(code: Column) -> Column:
    at = F.instr(code, "--")
    return F.when(at > 0, F.trim(F.substring(code, at + 2, F.length(code)))).otherwise(F.lit(""))


def event_id(source: Column, start_raw: Column, code: Column, index: Column) -> Column:
    text = F.concat_ws("|", source, start_raw, code, index.cast("string"))
    return F.concat(F.lit("npt_"), F.left(F.sha2(text, 256), F.lit(16)))


def review_reasons(duration: Column, comment: Column) -> Column:
    return fired((duration < 0, "negative_duration"), (comment == "", "no_comment"))


def untimed(blocks: DataFrame) -> DataFrame:
    """The non-productive blocks without usable times: what makes a strict `extract` fail, as rows."""
    lost = blocks.where(is_non_productive(F.col("activity_code"), F.col("state")))
    return lost.where(F.col("start_time").isNull() | F.col("end_time").isNull())


def extract(blocks: DataFrame, *, strict: bool = True) -> DataFrame:
    """Events of the non-productive blocks. With `strict`, one without usable times fails the job."""
    code, state = F.col("activity_code"), F.col("state")
    untimed = F.col("start_time").isNull() | F.col("end_time").isNull()
    lost = blocks.where(is_non_productive(code, state))
    if strict:
        message = F.concat(
            F.col("source_document"), F.lit(": a non-productive block has no usable timestamps")
        )
        lost = lost.withColumn(
            "source_document",
            F.when(untimed, F.raise_error(message).cast("string")).otherwise(F.col("source_document")),
        )
    else:
        lost = lost.where(~untimed)
    none = F.lit(None).cast("string")
    reasons = review_reasons(F.col("duration_hours"), F.col("comment"))
    return (
        lost.withColumn("duration_hours", hours_between(F.col("start_time"), F.col("end_time")))
        .withColumn("review_reasons", reasons)
        .select(
            event_id(F.col("source_document"), F.col("start_raw"), code, F.col("block_index")).alias("event_id"),
            "well",
            "wellbore",
            "source_document",
            "report_date",
            "start_time",
            "end_time",
            "start_raw",
            "duration_hours",
            "activity_code",
            category(code).alias("category"),
            subcategory(code).alias("subcategory"),
            "state",
            "state_detail",
            "comment",
            none.alias("cause"),
            none.alias("evidence_span"),
            none.alias("equipment"),
            F.lit(None).cast("double").alias("attribution_confidence"),
            (F.size("review_reasons") > 0).alias("needs_review"),
            "review_reasons",
            F.lit(fixed.PARSER_VERSION).alias("parser_version"),
            F.lit(fixed.EXTRACTOR_VERSION).alias("extractor_version"),
        )
    )


def chunks(events: DataFrame) -> DataFrame:
    """Searchable narrative: events with a comment."""
    return events.where(F.trim("comment") != "").select(
        F.col("event_id").alias("chunk_id"),
        F.col("comment").alias("text"),
        "well",
        "wellbore",
        "source_document",
        "report_date",
        "activity_code",
    )


def _echo(value: Column, table: dict[str, str]) -> Column:
    causes = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    return F.coalesce(F.try_element_at(causes, F.lower(F.trim(value))), F.lit("not_stated"))


def echo_subcategory(value: Column) -> Column:
    return _echo(value, fixed.SUBCATEGORY_TO_CAUSE)


def echo_state_detail(value: Column) -> Column:
    return _echo(value, fixed.STATE_DETAIL_TO_CAUSE)


def integrity_findings(blocks: DataFrame, events: DataFrame) -> DataFrame:
    """Source blocks against stored events on (document, start, code): every disagreement.

    Columns kind, source_document, event_id, activity_code, start_time.
    """
    key = ["source_document", "start_time", "activity_code"]
    none = F.lit(None).cast("string")
    b = blocks.select(
        *key,
        "end_time",
        is_non_productive(F.col("activity_code"), F.col("state")).alias("qualifies"),
        (F.col("start_time").isNull() | F.col("end_time").isNull()).alias("untimed"),
    )
    # Blocks are counted per key first, so a repeated block is one row with a number.
    per_key = (
        b.where("not untimed")
        .groupBy(*key)
        .agg(
            F.count_if("qualifies").alias("lost"),
            F.count_if(~F.col("qualifies")).alias("other"),
            F.min_by("end_time", F.when(F.col("qualifies"), F.unix_micros("end_time"))).alias("block_end"),
        )
    )
    stored = events.groupBy(*key).agg(
        F.count(F.lit(1)).alias("copies"),
        F.max("event_id").alias("event_id"),
        F.max_by("duration_hours", "event_id").alias("duration_hours"),
    )
    both = per_key.join(stored, key, "full").select(
        *key,
        F.coalesce("lost", F.lit(0)).alias("lost"),
        F.coalesce("other", F.lit(0)).alias("other"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        "event_id",
        "duration_hours",
        "block_end",
    )
    held = F.col("copies") > 0
    off = F.abs(F.col("duration_hours") - hours_between(F.col("start_time"), F.col("block_end")))
    missing = F.col("lost") - F.when(held, F.least(F.col("lost"), F.lit(1))).otherwise(F.lit(0))
    kinds = F.concat(
        F.array_repeat(F.lit("missing_event"), missing.cast("int")),
        fired(
            (held & (F.col("lost") == 0), "unexpected_event"),
            (held & (F.col("lost") > 0) & (off > MINUTE_HOURS), "duration_mismatch"),
        ),
        F.when(held, F.array_repeat(F.lit("unexpected_event"), F.col("other").cast("int"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    keyed = both.select(F.explode(kinds).alias("kind"), "source_document", "event_id", "activity_code", "start_time")
    untimed = b.where("untimed and qualifies").select(
        F.lit("untimed_block").alias("kind"), "source_document", none.alias("event_id"), "activity_code", "start_time"
    )
    collapsed = (
        stored.groupBy("source_document")
        .agg(F.sum("copies").alias("held"), F.count(F.lit(1)).alias("distinct"))
        .where("held <> distinct")
        .select(
            F.lit("unexpected_event").alias("kind"),
            "source_document",
            none.alias("event_id"),
            none.alias("activity_code"),
            F.lit(None).cast("timestamp").alias("start_time"),
        )
    )
    repeated = (
        events.groupBy("event_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("source_document").alias("source_document"))
        .where("n > 1")
        .select(
            F.lit("duplicate_event_id").alias("kind"),
            "source_document",
            "event_id",
            none.alias("activity_code"),
            F.lit(None).cast("timestamp").alias("start_time"),
        )
    )
    return keyed.unionByName(untimed).unionByName(collapsed).unionByName(repeated)


def integrity_summary(blocks: DataFrame, events: DataFrame) -> DataFrame:
    """One row: documents, qualifying blocks, events checked, and whether both paths agree."""
    findings = integrity_findings(blocks, events)
    counted = findings.agg(
        F.count_if(F.col("kind").isin("missing_event", "unexpected_event", "duplicate_event_id")).alias("detection"),
        F.count_if(F.col("kind") == "duration_mismatch").alias("durations"),
        F.count_if(F.col("kind").isin("missing_event", "untimed_block")).alias("unchecked"),
    )
    source = blocks.agg(
        F.count_distinct("source_document").alias("documents"),
        F.count_if(is_non_productive(F.col("activity_code"), F.col("state"))).alias("qualifying_blocks"),
    )
    one = F.struct("detection", "durations", "unchecked")
    both = source.withColumn("_found", counted.select(one).scalar()).select("*", "_found.*")
    checked = F.col("qualifying_blocks") - F.col("unchecked")
    return both.select(
        "documents",
        "qualifying_blocks",
        checked.alias("events_checked"),
        ((F.col("qualifying_blocks") == checked) & (F.col("detection") == 0)).alias("detection_exact"),
        (F.col("durations") == 0).alias("duration_exact"),
    )
