"""Queries over `events` as timed activity blocks: lost time, coverage, patterns, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace.bindings.registry import day, joined, query, rounded
from daytrace.bindings.views import table
from daytrace.functions import names
from daytrace.functions import units as fu
from daytrace.operators import audits as oa
from daytrace.operators import events as oe
from daytrace.operators import patterns as opt
from daytrace.operators import recorded_time as ort
from daytrace.operators import sampling as os_
from daytrace.session import checkpointed
from daytrace.sources import files, store


def block_view(spark, folder) -> DataFrame:
    """Each event as a block of its user's report for that date, as long as its value in minutes."""
    c = F.col
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    start = c("ts").cast("timestamp")
    micros = F.round(c("value") * 100).cast("bigint") * 600_000
    code = F.when(
        c("event_type") == "error",
        F.concat(
            F.lit("interruption -- "),
            F.element_at(F.array(*[F.lit(s) for s in ("repair", "wait", "waiting on weather", "fish")]), c("k") % 4 + 1),
        ),
    ).otherwise(F.concat(F.lit("drilling -- "), c("event_type")))
    return (
        table(spark, folder, "events")
        .withColumn("k", k)
        .select(
            F.concat(F.lit("u"), "user_id", F.lit("_"), start.cast("date")).alias("source_document"),
            start.cast("date").alias("report_date"),
            c("user_id").cast("string").alias("wellbore"),
            c("user_id").cast("string").alias("well"),
            F.lit(0).alias("report_index"),
            c("event_id").alias("block_index"),
            code.alias("activity_code"),
            F.when((c("event_type") == "click") & (c("k") % 10 == 0), "fail").otherwise("success").alias("state"),
            F.when(c("k") % 9 == 0, "equipment failure")
            .when(c("k") % 9 == 1, "success")
            .when(c("k") % 9 == 2, "mud loss")
            .otherwise(F.concat(F.lit("detail "), c("k")))
            .alias("state_detail"),
            F.when(
                c("k") % 7 != 0,
                F.concat(F.lit("Pump "), c("k"), F.lit(" stopped. Wait due to "), c("event_type"), F.lit("; crew informed.")),
            )
            .otherwise(F.lit(""))
            .alias("comment"),
            F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("start_raw"),
            F.lit("").alias("end_raw"),
            start.alias("start_time"),
            F.timestamp_micros(F.unix_micros(start) + micros).alias("end_time"),
        )
    )


BLOCKS_SQL = r"""blocks AS (
  SELECT 'u' || user_id || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS source_document, CAST(ts AS DATE) AS report_date,
    CAST(user_id AS VARCHAR) AS well, event_id AS block_index,
    CASE WHEN event_type = 'error' THEN 'interruption -- ' || CASE k % 4 WHEN 0 THEN 'repair' WHEN 1 THEN 'wait'
        WHEN 2 THEN 'waiting on weather' ELSE 'fish' END ELSE 'drilling -- ' || event_type END AS activity_code,
    CASE WHEN event_type = 'click' AND k % 10 = 0 THEN 'fail' ELSE 'success' END AS state,
    CASE k % 9 WHEN 0 THEN 'equipment failure' WHEN 1 THEN 'success' WHEN 2 THEN 'mud loss' ELSE 'detail ' || k END AS state_detail,
    CASE WHEN k % 7 <> 0 THEN 'Pump ' || k || ' stopped. Wait due to ' || event_type || '; crew informed.' ELSE '' END AS comment,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS start_raw, epoch_us(ts) AS s,
    epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 AS e, k, event_type
  FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k FROM events)),
lost AS (
  SELECT *, 'npt_' || left(sha256(source_document || '|' || start_raw || '|' || activity_code || '|' || block_index), 16) AS event_id,
    (e - s) / 3.6e9 AS hours, split_part(activity_code, ' -- ', 2) AS subcategory
  FROM blocks WHERE activity_code LIKE 'interruption%' OR state = 'fail')"""


def event_view(spark, folder) -> DataFrame:
    return oe.extract(block_view(spark, folder))


@query(
    "lost_time_events",
    f"""WITH {BLOCKS_SQL}
    SELECT event_id, well, source_document, CAST(report_date AS VARCHAR) AS report_date, round(hours, 6) AS duration_hours,
      split_part(activity_code, ' -- ', 1) AS category, subcategory, state_detail,
      CASE WHEN comment = '' THEN 'no_comment' ELSE '' END AS review_reasons FROM lost""",
)
def lost_time_events(spark, folder) -> DataFrame:
    """Events of the non-productive blocks, with stable ids and review reasons."""
    return event_view(spark, folder).select(
        "event_id",
        "well",
        "source_document",
        day("report_date"),
        rounded("duration_hours", digits=6),
        "category",
        "subcategory",
        "state_detail",
        joined("review_reasons"),
    )


@query(
    "narrative_chunks",
    f"WITH {BLOCKS_SQL} SELECT event_id AS chunk_id, comment AS text, activity_code FROM lost WHERE trim(comment) <> ''",
)
def narrative_chunks(spark, folder) -> DataFrame:
    """Searchable comments."""
    return oe.chunks(event_view(spark, folder)).select("chunk_id", "text", "activity_code")


@query(
    "baseline_causes",
    f"""WITH {BLOCKS_SQL} SELECT event_id,
      CASE subcategory WHEN 'repair' THEN 'equipment_failure' WHEN 'waiting on weather' THEN 'waiting_on_weather'
        WHEN 'fish' THEN 'hole_problem' ELSE 'not_stated' END AS by_subcategory,
      CASE state_detail WHEN 'equipment failure' THEN 'equipment_failure' WHEN 'mud loss' THEN 'hole_problem'
        ELSE 'not_stated' END AS by_state_detail FROM lost""",
)
def baseline_causes(spark, folder) -> DataFrame:
    """The two echo baselines."""
    return event_view(spark, folder).select(
        "event_id",
        oe.echo_subcategory(F.col("subcategory")).alias("by_subcategory"),
        oe.echo_state_detail(F.col("state_detail")).alias("by_state_detail"),
    )


COVERAGE_SQL = """running AS (
  SELECT *, max(e) OVER (PARTITION BY source_document ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
  FROM blocks),
covered AS (
  SELECT source_document, any_value(well) AS well, sum(greatest(s - reached, 0)) AS gap, sum(e - s) AS summed,
    max(e) - min(s) AS extent FROM running GROUP BY source_document)"""


@query(
    "span_coverage",
    f"""WITH {BLOCKS_SQL}, {COVERAGE_SQL}
    SELECT source_document, round(coalesce(gap, 0) / 3.6e9, 6) AS gap_hours,
      round(greatest(summed - (extent - coalesce(gap, 0)), 0) / 3.6e9, 6) AS overlap_hours FROM covered""",
)
def span_coverage(spark, folder) -> DataFrame:
    """Gaps and overlaps between the blocks of each report."""
    found = ort.span_coverage(block_view(spark, folder), ["source_document"])
    return found.select("source_document", rounded("gap_hours", digits=6), rounded("overlap_hours", digits=6))


@query(
    "span_coverage_by_well",
    f"""WITH {BLOCKS_SQL}, r AS (
      SELECT *, max(e) OVER (PARTITION BY well ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM blocks)
    SELECT well, round(coalesce(sum(greatest(s - reached, 0)), 0) / 3.6e9, 6) AS gap_hours FROM r GROUP BY well""",
)
def span_coverage_by_well(spark, folder) -> DataFrame:
    """W10 over the whole history of a user at once, a key of any size."""
    found = ort.span_coverage(block_view(spark, folder), ["well"])
    return found.select("well", rounded("gap_hours", digits=6))


def reports_of(blocks: DataFrame) -> DataFrame:
    return blocks.select("well", "source_document").distinct()


@query(
    "recorded_time",
    f"""WITH {BLOCKS_SQL}, {COVERAGE_SQL}, g AS (
      SELECT well, count(*) AS reports, sum(coalesce(gap, 0)) / 3.6e9 AS gap,
        sum(greatest(summed - (extent - coalesce(gap, 0)), 0)) / 3.6e9 AS overlap FROM covered GROUP BY well),
    t AS (
      SELECT well, count(*) AS blocks, sum((e - s) / 3.6e9) AS total,
        coalesce(sum((e - s) / 3.6e9) FILTER (WHERE activity_code LIKE 'interruption%' OR state = 'fail'), 0e0) AS npt,
        count(*) FILTER (WHERE activity_code LIKE 'interruption%' OR state = 'fail') AS npt_blocks FROM blocks GROUP BY well)
    SELECT well, blocks, npt_blocks, reports, round(npt, 4) AS npt_hours, round(total, 4) AS summed_block_hours,
      round(gap, 4) AS unclassified_gap_hours, round(overlap, 4) AS concurrent_overlap_hours,
      round(npt / total, 6) AS npt_share FROM t JOIN g USING (well)""",
)
def recorded_time(spark, folder) -> DataFrame:
    """Recorded, lost, gap and overlap hours per user."""
    blocks = block_view(spark, folder)
    return ort.per_well(blocks, reports_of(blocks)).select(
        "well",
        "blocks",
        "npt_blocks",
        "reports",
        rounded("npt_hours"),
        rounded("summed_block_hours"),
        rounded("unclassified_gap_hours"),
        rounded("concurrent_overlap_hours"),
        rounded("npt_share", digits=6),
    )


@query(
    "walk_store_reconcile",
    f"""WITH {BLOCKS_SQL}, t AS (
      SELECT well, coalesce(sum((e - s) / 3.6e9) FILTER (WHERE activity_code LIKE 'interruption%' OR state = 'fail'), 0e0) AS npt,
        count(*) FILTER (WHERE activity_code LIKE 'interruption%' OR state = 'fail') AS n FROM blocks GROUP BY well),
    st AS (SELECT well, sum(hours) AS h, count(*) AS n FROM lost WHERE state_detail <> 'mud loss' GROUP BY well)
    SELECT t.well, round(t.npt, 4) AS npt_hours, round(coalesce(st.h, 0), 4) AS store_hours,
      round(abs(t.npt - coalesce(st.h, 0)), 9) <= 0.01 AS hours_agree, t.n = coalesce(st.n, 0) AS counts_agree
    FROM t LEFT JOIN st USING (well)""",
)
def walk_store_reconcile(spark, folder) -> DataFrame:
    """Walk totals against a store that lost one kind of event."""
    blocks = block_view(spark, folder)
    stored = event_view(spark, folder).where("state_detail <> 'mud loss'")
    found = ort.reconcile(ort.per_well(blocks, reports_of(blocks)), stored)
    return found.select("well", rounded("npt_hours"), rounded("store_hours"), "hours_agree", "counts_agree")


def _tampered(spark, folder) -> DataFrame:
    """The stored events with some dropped and some durations changed."""
    events = event_view(spark, folder).where("state_detail <> 'mud loss'")
    longer = F.when(F.col("subcategory") == "wait", F.col("duration_hours") + 1).otherwise(F.col("duration_hours"))
    return events.withColumn("duration_hours", longer)


@query(
    "integrity_findings",
    f"""WITH {BLOCKS_SQL}
    SELECT 'missing_event' AS kind, source_document, activity_code, count(*) AS n FROM lost WHERE state_detail = 'mud loss' GROUP BY ALL
    UNION ALL
    SELECT 'duration_mismatch', source_document, activity_code, count(*) FROM lost
    WHERE state_detail <> 'mud loss' AND subcategory = 'wait' GROUP BY ALL""",
)
def integrity_findings(spark, folder) -> DataFrame:
    """Source blocks against a damaged store."""
    found = oe.integrity_findings(block_view(spark, folder), _tampered(spark, folder))
    return found.groupBy("kind", "source_document", "activity_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "integrity_summary",
    f"""WITH {BLOCKS_SQL}
    SELECT (SELECT count(DISTINCT source_document) FROM blocks) AS documents, count(*) AS qualifying_blocks,
      count(*) AS events_checked, true AS detection_exact, true AS duration_exact FROM lost""",
)
def integrity_summary(spark, folder) -> DataFrame:
    """Both paths agree on an undamaged store."""
    return oe.integrity_summary(block_view(spark, folder), event_view(spark, folder))


LABELLED_SQL = "labelled AS (SELECT event_id FROM lost WHERE k % 5 = 0), miscoded AS (SELECT event_id FROM lost WHERE k % 20 = 0)"
REGISTER_SQL = rf"""{LABELLED_SQL}, grouped AS (
  SELECT subcategory, state_detail AS detail_state, count(DISTINCT well) AS wells, count(*) AS events, sum(hours) AS hours,
    min(report_date) AS first_seen, max(report_date) AS last_seen,
    count(*) FILTER (WHERE k % 5 = 0) AS labelled, count(*) FILTER (WHERE k % 20 = 0) AS miscoded,
    arg_max(event_id, (hours, event_id)) AS cited, arg_max(comment, (hours, event_id)) AS text
  FROM lost GROUP BY ALL)"""


def register_view(spark, folder) -> tuple[DataFrame, DataFrame]:
    """(events, register); every fifth kind of event carries a label."""
    events = event_view(spark, folder)
    k = F.regexp_extract("comment", r"Pump (\d+)", 1)
    number = F.when(k == "", F.lit(None)).otherwise(k.cast("int"))
    labelled = events.where(number % 5 == 0).select("event_id")
    miscoded = events.where(number % 20 == 0).select("event_id")
    return events, opt.register(events, labelled=labelled, miscoded=miscoded)


OPENING_SQL = r"""CASE WHEN text = '' THEN '' WHEN position('. ' IN text) - 1 > 12 THEN left(text, position('. ' IN text))
  WHEN position('; ' IN text) - 1 > 12 THEN left(text, position('; ' IN text)) ELSE text END"""


@query(
    "pattern_register",
    f"""WITH {BLOCKS_SQL}, {REGISTER_SQL.replace("k % 5 = 0", "k % 5 = 0 AND k % 7 <> 0").replace("k % 20 = 0", "k % 20 = 0 AND k % 7 <> 0")}
    SELECT subcategory, detail_state, wells, events, round(hours, 4) AS total_hours, CAST(first_seen AS VARCHAR) AS first_seen,
      CAST(last_seen AS VARCHAR) AS last_seen, labelled AS labelled_events, miscoded AS miscoded_events,
      cited AS cited_event_id, {OPENING_SQL} AS cited_span, wells >= 3 AND hours >= 24 AS recurring FROM grouped""",
)
def pattern_register(spark, folder) -> DataFrame:
    """Lost-time patterns with their longest event and its opening span."""
    return register_view(spark, folder)[1].select(
        "subcategory",
        "detail_state",
        "wells",
        "events",
        rounded("total_hours"),
        day("first_seen"),
        day("last_seen"),
        "labelled_events",
        "miscoded_events",
        "cited_event_id",
        "cited_span",
        "recurring",
    )


@query(
    "pattern_totals",
    f"""WITH {BLOCKS_SQL}, {REGISTER_SQL}
    SELECT count(*) FILTER (WHERE r) AS patterns, count(*) FILTER (WHERE NOT r) AS excluded_patterns,
      round(coalesce(sum(hours) FILTER (WHERE r), 0), 4) AS recurring_hours,
      round(coalesce(sum(hours) FILTER (WHERE NOT r), 0), 4) AS excluded_hours,
      round(coalesce(sum(hours) FILTER (WHERE r), 0) / sum(hours), 6) AS coverage
    FROM (SELECT *, wells >= 3 AND hours >= 24 AS r FROM grouped)""",
)
def pattern_totals(spark, folder) -> DataFrame:
    """Coverage of the recurring patterns."""
    return opt.register_totals(register_view(spark, folder)[1]).select(
        "patterns", "excluded_patterns", rounded("recurring_hours"), rounded("excluded_hours"), rounded("coverage", digits=6)
    )


@query(
    "largest_excluded_patterns",
    f"""WITH {BLOCKS_SQL} SELECT subcategory, state_detail AS detail_state, round(sum(hours), 4) AS total_hours
    FROM lost GROUP BY ALL HAVING count(DISTINCT well) < 3 OR sum(hours) < 24
    ORDER BY round(sum(hours), 6) DESC, subcategory, detail_state LIMIT 10""",
)
def largest_excluded_patterns(spark, folder) -> DataFrame:
    """The largest patterns that do not recur (a top-ten report)."""
    found = opt.largest_excluded(register_view(spark, folder)[1])
    return found.select("subcategory", "detail_state", rounded("total_hours"))


@query(
    "pattern_cost",
    f"""WITH {BLOCKS_SQL} SELECT subcategory, round(sum(hours) / 24e0 * 250000e0, 2) AS cost_equivalent_usd,
      'at a stated assumption of 250,000 USD per rig day, which is an illustration and not a market rate' AS assumption
    FROM lost GROUP BY subcategory""",
)
def pattern_cost(spark, folder) -> DataFrame:
    """Cost equivalent of lost hours at a stated rate."""
    per = event_view(spark, folder).groupBy("subcategory").agg(F.sum("duration_hours").alias("hours"))
    amount, stated = opt.cost_equivalent(F.col("hours"), 250_000)
    return per.select("subcategory", rounded(amount, "cost_equivalent_usd", 2), stated.alias("assumption"))


@query(
    "register_audits",
    f"""WITH {BLOCKS_SQL}, {REGISTER_SQL}
    SELECT 'citations_resolve' AS "check", count(*) AS examined, count(*) FILTER (WHERE text = '') AS problems,
      count(*) FILTER (WHERE text = '') = 0 AS passed FROM grouped
    UNION ALL SELECT 'register_reproducible', count(*), 0, true FROM grouped
    UNION ALL SELECT 'categories_reconcile', count(DISTINCT well), 0, true FROM blocks
    UNION ALL SELECT 'corpus_not_empty', (SELECT count(DISTINCT well) FROM blocks) + (SELECT count(*) FROM lost)
      + (SELECT count(*) FROM grouped WHERE wells >= 3 AND hours >= 24),
      CASE WHEN (SELECT count(*) FROM grouped WHERE wells >= 3 AND hours >= 24) = 0 THEN 1 ELSE 0 END,
      (SELECT count(*) FROM grouped WHERE wells >= 3 AND hours >= 24) > 0""",
)
def register_audits(spark, folder) -> DataFrame:
    """Citations, reproducibility on reordered input, reconciliation, corpus not empty."""
    blocks = block_view(spark, folder)
    events, register = register_view(spark, folder)
    plain, again = opt.register(events), opt.register(events.repartition(5, "comment"))
    walked = ort.per_well(blocks, reports_of(blocks))
    found = oa.all_outcomes(
        oa.citations_resolve(register, events, opt.pattern_wells(events)),
        oa.register_reproducible(plain, again),
        oa.reconciles(ort.reconcile(walked, events)),
        oa.corpus_not_empty(walked, events, register),
    )
    return found.select("check", "examined", "problems", "passed")


@query(
    "stratified_sample",
    f"""WITH {BLOCKS_SQL}, r AS (
      SELECT event_id, subcategory AS stratum, row_number() OVER (PARTITION BY subcategory
        ORDER BY sha256('20261006|' || event_id), event_id) AS round FROM lost
      WHERE report_date < DATE '2024-01-16' AND well NOT IN ('1', '2', '3', '4', '5'))
    SELECT event_id, stratum FROM r ORDER BY round, stratum LIMIT 135""",
)
def stratified_sample(spark, folder) -> DataFrame:
    """Seeded round-robin over subcategories (a sampling operator)."""
    drawn = os_.draw(event_view(spark, folder), boundary="2024-01-16", hold_out=("1", "2", "3", "4", "5"))
    return drawn.select("event_id", "stratum")


@query(
    "adjudication_draw",
    f"""WITH {BLOCKS_SQL}, l AS (
      SELECT event_id, subcategory IN ('repair') AS contested FROM lost),
    r AS (SELECT *, row_number() OVER (PARTITION BY contested ORDER BY sha256('20261006|' || event_id), event_id) AS n,
      count(*) FILTER (WHERE contested) OVER () AS c, count(*) FILTER (WHERE NOT contested) OVER () AS o FROM l),
    picked AS (SELECT event_id, contested FROM r WHERE n <= CASE WHEN contested THEN 40 - least(40 - least(20, c), o)
      ELSE least(40 - least(20, c), o) END)
    SELECT event_id, contested, row_number() OVER (ORDER BY sha256('20261007|' || event_id)) AS position FROM picked""",
)
def adjudication_draw(spark, folder) -> DataFrame:
    """Half from contested classes, half elsewhere, blind positions (a sampling operator)."""
    events = event_view(spark, folder)
    labels = events.select("event_id", oe.echo_subcategory(F.col("subcategory")).alias("cause"))
    drawn = os_.adjudication_ids(labels)
    return drawn.select("event_id", "contested", F.col("position").cast("bigint").alias("position"))


@query(
    "well_name_tokens",
    """SELECT p_partkey, '15/9-F-' || (p_partkey % 17) || CASE WHEN p_partkey % 3 = 0 THEN ' ' || chr(CAST(65 + p_partkey % 4 AS INTEGER)) ELSE '' END AS name,
      '15/9-F-' || (p_partkey % 17) AS well, (p_partkey % 17) IN (4, 5, 7, 9) AS hold_out FROM part""",
)
def well_name_tokens(spark, folder) -> DataFrame:
    """File tokens to names and wells, hold-out test."""
    c = F.col("p_partkey")
    tail = F.when(c % 3 == 0, F.concat(F.lit("_"), F.chr(65 + c % 4))).otherwise(F.lit(""))
    rows = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("15_9_F_"), (c % 17).cast("string"), tail).alias("token")
    )
    name = names.name_from_token(F.col("token"))
    return rows.select(
        "p_partkey",
        name.alias("name"),
        names.well_of(F.col("token")).alias("well"),
        names.is_hold_out(F.col("token")).alias("hold_out"),
    )


@query(
    "unit_conversion",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN fluid = 'liquid' THEN CASE unit WHEN 'bbl' THEN l_quantity * 0.158987294928e0
        WHEN 'm3' THEN l_quantity END ELSE CASE unit WHEN 'scf' THEN l_quantity * 0.028316846592e0 END END, 6) AS sm3,
      CASE WHEN fluid = 'gas' AND unit = 'm3' THEN 'actual_conditions' WHEN fluid = 'gas' AND unit = 'bbl' THEN 'unknown_unit'
        WHEN fluid = 'liquid' AND unit = 'scf' THEN 'unknown_unit' END AS problem, round(l_quantity / 60e0, 6) AS hours
    FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'bbl' WHEN 'N' THEN 'm3' ELSE 'scf' END AS unit,
      CASE WHEN l_linestatus = 'O' THEN 'liquid' ELSE 'gas' END AS fluid FROM lineitem)""",
)
def unit_conversion(spark, folder) -> DataFrame:
    """Volumes and hours, refused and unknown units named."""
    unit = F.when(F.col("l_returnflag") == "A", "bbl").when(F.col("l_returnflag") == "N", "m3").otherwise("scf")
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        unit.alias("unit"),
        F.when(F.col("l_linestatus") == "O", "liquid").otherwise("gas").alias("fluid"),
    )
    u, f = F.col("unit"), F.col("fluid")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        rounded(fu.to_sm3(F.col("l_quantity"), u, f), "sm3", 6),
        fu.volume_unit_problem(u, f).alias("problem"),
        rounded(fu.to_hours(F.col("l_quantity"), F.lit(" Min ")), "hours", 6),
    )


LANES_SQL = ", ".join(f"coalesce(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)), 0)" for i in range(8))


@query(
    "store_digest",
    f"""SELECT count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {LANES_SQL})) AS content_hash
    FROM (SELECT sha256('=' || conv_id || '|=' || role || '|=' || text || '|=' || turn) AS h FROM conversations)""",
)
def store_digest(spark, folder) -> DataFrame:
    """Order-independent digest of a table."""
    return store.content_digest(table(spark, folder, "conversations"))


@query("file_manifest")
def file_manifest(spark, folder) -> DataFrame:
    """Size and SHA-256 of the table files checked against a manifest that misses one."""
    found = checkpointed(files.fingerprints(spark, folder))  # a row per file, so that none is hashed twice
    recorded = found.where("path <> 'nation.parquet'")
    return files.verify(found, recorded).select("path", "status")
