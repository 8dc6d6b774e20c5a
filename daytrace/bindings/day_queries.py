"""Queries over the supplier-day view of `lineitem`: classes, windows, models, episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.bindings.registry import day, joined, query, rounded
from daytrace.bindings.views import (
    ACTIVITY_SQL,
    ANY_DIFFERS,
    DAYS_SQL,
    DIFFERS,
    RAW_DAYS_SQL,
    entity_days,
    order_activity,
    raw_days,
)
from daytrace.functions import days as fd
from daytrace.operators import backtest as ob
from daytrace.operators import days as od
from daytrace.operators import episodes as op
from daytrace.operators import expectation as oe
from daytrace.operators import windows as ow
from daytrace.plans import study
from daytrace.session import stored


def study_days(spark, folder) -> DataFrame:
    """The day view as a stored table, for queries that read it several times."""
    return stored(entity_days(spark, folder), "days")


FIELD_LIST = ", ".join(f"CASE WHEN {d} THEN '{f}' END" for f, d in DIFFERS.items())


@query(
    "duplicate_conflicts",
    f"""WITH {RAW_DAYS_SQL}
    SELECT well, CAST(production_date AS VARCHAR) AS production_date, count(*) AS rows,
           concat_ws(',', {FIELD_LIST}) AS disagreeing_fields
    FROM raw_days GROUP BY well, production_date HAVING {ANY_DIFFERS}""",
)
def duplicate_conflicts(spark, folder) -> DataFrame:
    """A1: supplier-days whose line items disagree, with the fields that differ."""
    found = od.duplicate_conflicts(raw_days(spark, folder))
    return found.select("well", day("production_date"), "rows", joined("disagreeing_fields"))


@query(
    "duplicates_kept",
    f"""WITH {RAW_DAYS_SQL}
    SELECT well, CAST(production_date AS VARCHAR) AS production_date, min(source) AS source,
           round(arg_min(oil_volume_sm3, source), 4) AS oil_volume_sm3
    FROM (SELECT r.*, count(*) OVER (PARTITION BY well, production_date) AS n FROM raw_days r) GROUP BY well, production_date HAVING NOT ({ANY_DIFFERS})""",
)
def duplicates_kept(spark, folder) -> DataFrame:
    """A1: one row per supplier-day whose line items agree, the first source kept."""
    kept = od.collapse_duplicates(raw_days(spark, folder))
    return kept.select("well", day("production_date"), "source", rounded("oil_volume_sm3"))


@query(
    "conflict_rows",
    f"""WITH {RAW_DAYS_SQL}, bad AS (
      SELECT well, production_date FROM raw_days GROUP BY well, production_date HAVING {ANY_DIFFERS})
    SELECT well, CAST(production_date AS VARCHAR) AS production_date, source
    FROM raw_days JOIN bad USING (well, production_date)""",
)
def conflict_rows(spark, folder) -> DataFrame:
    """A1: every line item behind a conflict."""
    rows = od.conflict_rows(raw_days(spark, folder))
    return rows.select("well", day("production_date"), "source")


@query(
    "day_class_counts",
    f"""WITH {DAYS_SQL}, classes(day_class) AS (VALUES ('missing'), ('quarantined'),
      ('non_producing'), ('downtime'), ('partial'), ('valid_producing'))
    SELECT w.well, c.day_class, count(d.well) AS days
    FROM (SELECT DISTINCT well FROM days) w CROSS JOIN classes c
    LEFT JOIN days d ON d.well = w.well AND d.day_class = c.day_class GROUP BY ALL""",
)
def day_class_counts(spark, folder) -> DataFrame:
    """Days per class and supplier, zero counts included."""
    return od.class_counts(entity_days(spark, folder), ["well"])


@query(
    "quarantined_days",
    f"""WITH {DAYS_SQL}
    SELECT well, CAST(production_date AS VARCHAR) AS production_date,
      concat_ws(',', CASE WHEN f_hours THEN 'hours_out_of_range' END,
        CASE WHEN f_negative THEN 'negative_volume' END, CASE WHEN f_zero THEN 'volume_without_hours' END,
        CASE WHEN f_dry THEN 'no_fluids_on_producing_day' END,
        CASE WHEN coalesce(oil_volume_sm3 > 1025, false) THEN 'volume_above_capacity' END) AS reasons
    FROM days WHERE day_class <> 'missing'
      AND (f_hours OR f_negative OR f_zero OR f_dry OR coalesce(oil_volume_sm3 > 1025, false))""",
)
def quarantined_days(spark, folder) -> DataFrame:
    """P5: failed checks per day, with a capacity limit on the main volume."""
    plain = entity_days(spark, folder).drop("day_class", "q_24h", "quarantine_reasons", "checks_not_evaluated")
    judged = od.classify(plain, capacity={"oil_volume_sm3": 1025.0})
    bad = judged.where(F.col("day_class") == "quarantined")
    return bad.select("well", day("production_date"), joined("quarantine_reasons", "reasons"))


@query(
    "day_volumes",
    f"""WITH {DAYS_SQL}
    SELECT well, CAST(production_date AS VARCHAR) AS production_date, round(q_24h, 4) AS q_24h,
      round(CASE WHEN s THEN 1015e0 * least(on_stream_hours, 24) / 24 END, 4) AS expected,
      round(CASE WHEN s THEN 1015e0 * (24 - least(on_stream_hours, 24)) / 24 END, 4) AS deferred,
      round(CASE WHEN s THEN 1015e0 * least(on_stream_hours, 24) / 24 - oil_volume_sm3 END, 4) AS shortfall,
      round(nullif(downhole_pressure_bar, 0), 4) AS pressure,
      round(CASE WHEN water_volume_sm3 + oil_volume_sm3 > 0
            THEN water_volume_sm3 / (water_volume_sm3 + oil_volume_sm3) END, 6) AS water_cut
    FROM (SELECT *, day_class IN ('downtime', 'partial', 'valid_producing') AS s FROM days)""",
)
def day_volumes(spark, folder) -> DataFrame:
    """Rate, expected, deferred and shortfall volumes, reading and water cut per day."""
    q = F.lit(1015.0)
    return entity_days(spark, folder).select(
        "well",
        day("production_date"),
        rounded("q_24h"),
        rounded(fd.expected_volume(q), "expected"),
        rounded(fd.deferred_volume(q), "deferred"),
        rounded(fd.rate_shortfall(q), "shortfall"),
        rounded(fd.reading("downhole_pressure_bar"), "pressure"),
        rounded(fd.water_cut(), "water_cut", 6),
    )


_COVER = ("downhole_pressure_bar", "wellhead_pressure_bar", "choke_dp_bar", "choke_size", "on_stream_hours")


@query(
    "channel_coverage",
    f"WITH {DAYS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS channel, count(*) AS days, count({c}) AS present,
        count({f"nullif({c}, 0)" if c == "downhole_pressure_bar" else c}) AS usable,
        count(*) FILTER (WHERE {c} = 0) AS zeros FROM days"""
        for c in _COVER
    ),
)
def channel_coverage(spark, folder) -> DataFrame:
    """A3: readings per channel, zero-as-missing told apart."""
    return od.coverage(entity_days(spark, folder), _COVER).select("channel", "days", "present", "usable", "zeros")


SPLIT_SQL = """split AS (
  SELECT s AS record_start, e AS record_end, s + b AS boundary, s + b - 90 AS development_end
  FROM (SELECT *, CAST(round_even((e - s) * 0.75e0, 0) AS INTEGER) AS b
        FROM (SELECT min(production_date) AS s, max(production_date) AS e FROM days
              WHERE day_class = 'valid_producing')))"""


@query(
    "temporal_split",
    f"""WITH {DAYS_SQL}, {SPLIT_SQL}
    SELECT CAST(record_start AS VARCHAR) AS record_start, CAST(record_end AS VARCHAR) AS record_end,
      CAST(boundary AS VARCHAR) AS boundary, CAST(development_end AS VARCHAR) AS development_end FROM split""",
)
def temporal_split(spark, folder) -> DataFrame:
    """A4: record span, hold-out boundary and end of development."""
    split = od.derive_split(entity_days(spark, folder))
    return split.select(*[day(c) for c in ("record_start", "record_end", "boundary", "development_end")])


@query(
    "development_by_well",
    f"""WITH {DAYS_SQL}, {SPLIT_SQL}
    SELECT *, development_days < 150 AS cold_start FROM (
      SELECT well, count(*) FILTER (WHERE day_class = 'valid_producing'
        AND production_date < (SELECT development_end FROM split)) AS development_days
      FROM days GROUP BY well)""",
)
def development_by_well(spark, folder) -> DataFrame:
    """A5: valid development days per supplier, and whether they are too few."""
    days = entity_days(spark, folder)
    return od.development_counts(days, od.derive_split(days))


def _requests(days: DataFrame) -> DataFrame:
    """Requests per well: its first year, all its time, a reversed range, and one without days; and an unknown well."""
    first = days.groupBy("well").agg(F.min("production_date").alias("first"), F.max("production_date").alias("last"))
    asked = first.select(
        "well",
        F.explode(
            F.array(
                F.struct(F.col("first").alias("start"), F.date_add("first", 364).alias("end")),
                F.struct(F.col("first").alias("start"), F.col("last").alias("end")),
                F.struct(F.col("first").alias("start"), F.date_sub("first", 1).alias("end")),
                F.struct(F.date_sub("first", 30).alias("start"), F.date_sub("first", 1).alias("end")),
            )
        ).alias("r"),
    ).select("well", "r.start", "r.end").distinct()
    nobody = days.agg(F.lit("nobody").alias("well"), F.min("production_date").alias("start"), F.max("production_date").alias("end"))
    return asked.unionByName(nobody)


_REQUESTS = """bounds AS (SELECT well, min(production_date) AS f, max(production_date) AS l FROM days GROUP BY well),
requests AS (
  SELECT well, f AS s, CAST(f + 364 AS DATE) AS e FROM bounds UNION SELECT well, f, l FROM bounds
  UNION SELECT well, f, CAST(f - 1 AS DATE) FROM bounds UNION SELECT well, CAST(f - 30 AS DATE), CAST(f - 1 AS DATE) FROM bounds
  UNION SELECT 'nobody', min(f), max(l) FROM bounds),
held AS (
  SELECT r.well, r.s, r.e, d.production_date, d.day_class, d.f_hours FROM requests r
  LEFT JOIN days d ON d.well = r.well AND d.production_date BETWEEN r.s AND r.e)"""

_ERROR = """CASE WHEN e < s THEN 'invalid_range' WHEN well NOT IN (SELECT well FROM bounds) THEN 'unknown_well'
      WHEN count(production_date) = 0 THEN 'no_data' END"""


@query(
    "well_history",
    f"""WITH {DAYS_SQL}, {_REQUESTS}
    SELECT well, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS "end", {_ERROR} AS error, count(production_date) AS rows_present,
      CAST(e - s AS BIGINT) + 1 - count(production_date) AS absent_days,
      count(*) FILTER (WHERE day_class = 'valid_producing') AS valid_producing_days,
      count(*) FILTER (WHERE day_class = 'downtime') AS downtime_days,
      count(*) FILTER (WHERE day_class = 'partial') AS partial_days,
      count(*) FILTER (WHERE day_class = 'missing') AS missing_days
    FROM held GROUP BY well, s, e""",
)
def well_history(spark, folder) -> DataFrame:
    """Class counts and absent days of each request, or why it has none."""
    days = entity_days(spark, folder)
    return od.history(days, _requests(days)).select(
        "well", day("start"), day("end"), "error", "rows_present", F.col("absent_days").cast("bigint").alias("absent_days"),
        "valid_producing_days", "downtime_days", "partial_days", "missing_days",
    )


@query(
    "well_data_quality",
    f"""WITH {DAYS_SQL}, {_REQUESTS}
    SELECT well, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS "end", {_ERROR} AS error,
      round(count(*) FILTER (WHERE day_class = 'valid_producing') / nullif(CAST(e - s AS DOUBLE) + 1, 0), 6) AS usable_fraction,
      round(count(*) FILTER (WHERE day_class IN ('quarantined', 'missing')) / nullif(CAST(count(production_date) AS DOUBLE), 0), 6) AS gap_fraction,
      count(*) FILTER (WHERE day_class = 'quarantined' AND f_hours) AS hours_out_of_range,
      CAST(min(production_date) FILTER (WHERE day_class = 'valid_producing') AS VARCHAR) AS first_valid_day,
      CAST(max(production_date) FILTER (WHERE day_class = 'valid_producing') AS VARCHAR) AS last_valid_day,
      CASE WHEN count(*) FILTER (WHERE day_class <> 'missing') > 0 THEN 'volume_above_capacity' ELSE '' END AS not_evaluated
    FROM held GROUP BY well, s, e""",
)
def well_data_quality(spark, folder) -> DataFrame:
    """Usable and gap fractions, reasons and unevaluated checks of each request."""
    days = entity_days(spark, folder)
    found = od.data_quality(days, _requests(days))
    reason = F.coalesce(F.try_element_at("quarantine_reasons", F.lit("hours_out_of_range")), F.lit(0))
    return found.select(
        "well",
        day("start"),
        day("end"),
        "error",
        rounded("usable_fraction", digits=6),
        rounded("gap_fraction", digits=6),
        reason.cast("bigint").alias("hours_out_of_range"),
        day("first_valid_day"),
        day("last_valid_day"),
        joined("checks_not_evaluated", "not_evaluated"),
    )


def windows_sql(activity: bool) -> str:
    """Segments, control splits and stable windows as a recursive CTE list ending in `windows`.

    `control_pieces` holds every piece of a segment's readings that the cuts make, cut at its first largest step
    while a reading is outside the tolerance of the piece's own median.
    """
    flag = (
        "(EXISTS (SELECT 1 FROM activity a WHERE a.well = d.well AND a.activity_date = d.production_date))"
        if activity
        else "false"
    )
    return (
        DAYS_SQL
        + (", " + ACTIVITY_SQL if activity else "")
        + f""", flagged AS (SELECT d.*, {flag} AS on_activity FROM days d),
    broken AS (
      SELECT *, day_class = 'quarantined' OR on_activity OR coalesce(pc <> 'quarantined'
          AND ps IS DISTINCT FROM well_status, false) AS breaks
      FROM (SELECT *, lag(day_class) OVER w AS pc, lag(well_status) OVER w AS ps FROM flagged
            WINDOW w AS (PARTITION BY well ORDER BY production_date))),
    segmented AS (
      SELECT *, sum(CAST(breaks AS INTEGER)) OVER (PARTITION BY well ORDER BY production_date) AS segment FROM broken),
    control_pieces(well, segment, vs, ds, starts) AS (
      SELECT well, segment, list(choke_size ORDER BY production_date), list(production_date ORDER BY production_date), CAST(NULL AS DATE)
      FROM segmented WHERE NOT breaks AND day_class = 'valid_producing' AND choke_size IS NOT NULL GROUP BY well, segment
      UNION ALL
      SELECT well, segment, vs[half.f:half.t], ds[half.f:half.t], half.starts FROM (
        SELECT well, segment, vs, ds,
          unnest([{{'f': 1, 't': a, 'starts': CAST(NULL AS DATE)}}, {{'f': a + 1, 't': len(vs), 'starts': ds[a + 1]}}]) AS half
        FROM (
          SELECT *, list_position(steps, list_max(steps)) AS a FROM (
            SELECT *, list_transform(range(1, len(vs)), lambda i: abs(vs[i + 1] - vs[i])) AS steps, list_median(vs) AS m FROM control_pieces WHERE len(vs) >= 2)
          WHERE m <> 0 AND greatest(list_max(vs) - m, m - list_min(vs)) / abs(m) > {fixed.CONTROL_TOLERANCE}e0))),
    parted AS (
      SELECT s.*, count(p.starts) OVER (PARTITION BY s.well, s.segment ORDER BY s.production_date) AS part
      FROM segmented s LEFT JOIN control_pieces p ON p.well = s.well AND p.starts = s.production_date WHERE NOT breaks),
    windows AS (
      SELECT well, min(production_date) AS ws, max(production_date) AS we,
        count(*) FILTER (WHERE day_class = 'valid_producing') AS n,
        median(choke_size) FILTER (WHERE day_class = 'valid_producing') AS median_choke,
        count(choke_size) FILTER (WHERE day_class = 'valid_producing') >= 2 AS tested
      FROM parted GROUP BY well, segment, part HAVING n >= 20)"""
    )


_WINDOW_COLUMNS = """SELECT well, CAST(ws AS VARCHAR) AS window_start, CAST(we AS VARCHAR) AS window_end,
  n AS valid_producing_days, round(median_choke, 4) AS median_choke FROM windows"""


def _window_columns(windows: DataFrame) -> DataFrame:
    return windows.select(
        "well", day("window_start"), day("window_end"), "valid_producing_days", rounded("median_choke")
    )


@query("stable_windows", f"WITH RECURSIVE {windows_sql(False)} {_WINDOW_COLUMNS}")
def stable_windows(spark, folder) -> DataFrame:
    """Stable reference windows."""
    return _window_columns(ow.stable_windows(study_days(spark, folder)))


@query("stable_windows_activity", f"WITH RECURSIVE {windows_sql(True)} {_WINDOW_COLUMNS}")
def stable_windows_activity(spark, folder) -> DataFrame:
    """Windows also broken on days with recorded activity."""
    days = study_days(spark, folder)
    return _window_columns(ow.stable_windows(days, order_activity(spark, folder)))


@query(
    "stable_windows_control",
    f"""WITH RECURSIVE {windows_sql(False)}
    SELECT w.well, CAST(ws AS VARCHAR) AS window_start, tested AS choke_test_applied,
      EXISTS (SELECT 1 FROM control_pieces p WHERE p.well = w.well AND p.starts BETWEEN w.ws AND w.we) AS starts_at_cut,
      round(median_choke, 4) AS median_choke FROM windows w""",
)
def stable_windows_control(spark, folder) -> DataFrame:
    """Windows that a move of the control starts, and whether the control was tested."""
    days = study_days(spark, folder)
    windows = ow.stable_windows(days)
    cuts = ow.control_cuts(ow.segments(days)).select("well", F.col("production_date").alias("window_start"), F.lit(True).alias("_cut"))
    found = windows.join(cuts, ["well", "window_start"], "left")
    return found.select("well", day("window_start"), "choke_test_applied", F.coalesce("_cut", F.lit(False)).alias("starts_at_cut"), rounded("median_choke"))


@query(
    "reference_windows",
    f"""WITH RECURSIVE {windows_sql(False)}, asked AS (
      SELECT DISTINCT well, CAST(date_trunc('month', production_date) AS DATE) AS b FROM days)
    SELECT a.well, CAST(b AS VARCHAR) AS before, CAST(arg_max(ws, we) AS VARCHAR) AS window_start,
      CAST(max(we) AS VARCHAR) AS window_end
    FROM asked a JOIN windows w ON w.well = a.well AND w.we < a.b GROUP BY a.well, b""",
)
def reference_windows(spark, folder) -> DataFrame:
    """The reference window in force at the start of each month."""
    days = study_days(spark, folder)
    asked = days.select("well", F.trunc("production_date", "month").alias("before")).distinct()
    found = ow.reference_window(ow.stable_windows(days), asked)
    return found.where("window_end is not null").select("well", day("before"), day("window_start"), day("window_end"))


FITS_SQL = """inside AS (
  SELECT w.well, w.ws, w.we, d.production_date, d.q_24h AS q, d.choke_size AS c,
    row_number() OVER (PARTITION BY w.well, w.ws ORDER BY d.production_date) - 1 AS i,
    row_number() OVER (PARTITION BY w.well, w.ws ORDER BY d.production_date DESC) AS newest,
    count(*) OVER (PARTITION BY w.well, w.ws) AS n
  FROM windows w JOIN days d ON d.well = w.well AND d.production_date BETWEEN w.ws AND w.we
  WHERE d.day_class = 'valid_producing'),
trends AS (
  SELECT *, regr_slope(ln(q), CAST(i AS DOUBLE)) OVER p AS slope,
    regr_intercept(ln(q), CAST(i AS DOUBLE)) OVER p AS icpt
  FROM inside WINDOW p AS (PARTITION BY well, ws)),
shaped AS (
  SELECT *, greatest(-slope, 0e0) AS dec, exp(icpt + slope * (n - 1)) AS q_end,
    1e0 + 5e-1 * greatest(-slope, 0e0) * (i - (n - 1)) AS base FROM trends),
summed AS (
  SELECT well, ws, we, any_value(dec) AS dec, any_value(q_end) AS q_end, min(base) AS min_base,
    arg_max(q, production_date) AS last_rate, median(q) AS reference_rate,
    median(q) FILTER (WHERE newest <= 28) AS t_mid,
    quantile_disc(q, 0.1) FILTER (WHERE newest <= 28) AS t_low,
    quantile_disc(q, 0.9) FILTER (WHERE newest <= 28) AS t_high,
    quantile_disc(q - exp(icpt + slope * i), 0.1) AS e_low,
    quantile_disc(q - exp(icpt + slope * i), 0.9) AS e_high,
    quantile_disc(q - q_end / pow(base, 2e0), 0.1) FILTER (WHERE base > 0) AS h_low,
    quantile_disc(q - q_end / pow(base, 2e0), 0.9) FILTER (WHERE base > 0) AS h_high,
    count(c) FILTER (WHERE c > 0) AS n_c, median(q / c) FILTER (WHERE c > 0) AS ratio,
    median(q) FILTER (WHERE c > 0) AS c_mid, quantile_disc(q, 0.1) FILTER (WHERE c > 0) AS c_low,
    quantile_disc(q, 0.9) FILTER (WHERE c > 0) AS c_high
  FROM shaped GROUP BY well, ws, we),
fits AS (
  SELECT well, ws, we, reference_rate, 'naive-median28' AS model, t_mid AS q0, 0e0 AS d, 0e0 AS b,
    t_low - t_mid AS lo, t_high - t_mid AS hi, CAST(NULL AS DOUBLE) AS per_c, false AS widens FROM summed
  UNION ALL SELECT well, ws, we, reference_rate, 'naive-persistence', last_rate, 0e0, 0e0,
    t_low - last_rate, t_high - last_rate, NULL, false FROM summed
  UNION ALL SELECT well, ws, we, reference_rate, 'exponential-decline', q_end, dec, 0e0, e_low, e_high, NULL, true FROM summed
  UNION ALL SELECT well, ws, we, reference_rate, 'hyperbolic-decline', q_end, dec,
    CASE WHEN dec > 0 THEN 5e-1 ELSE 0e0 END, CASE WHEN dec > 0 THEN h_low ELSE e_low END,
    CASE WHEN dec > 0 THEN h_high ELSE e_high END, NULL, true FROM summed WHERE dec <= 0 OR min_base > 0
  UNION ALL SELECT well, ws, we, reference_rate, 'choke-scaled', c_mid, 0e0, 0e0, c_low - c_mid,
    c_high - c_mid, ratio, true FROM summed WHERE n_c >= 5)"""


@query(
    "fitted_models",
    f"""WITH RECURSIVE {windows_sql(False)}, {FITS_SQL}
    SELECT well, CAST(ws AS VARCHAR) AS window_start, model, round(q0, 4) AS q_at_fit, round(d, 6) AS decline_rate,
      round(lo, 4) AS lower_offset, round(hi, 4) AS upper_offset, round(per_c, 4) AS rate_per_choke,
      round(reference_rate, 4) AS reference_rate FROM fits""",
)
def fitted_models(spark, folder) -> DataFrame:
    """Parameters of five models per window."""
    days = study_days(spark, folder)
    fits = oe.fit_models(ow.window_days(days, ow.stable_windows(days)))
    return fits.select(
        "well",
        day("window_start"),
        "model",
        rounded("q_at_fit"),
        rounded("decline_rate", digits=6),
        rounded("lower_offset"),
        rounded("upper_offset"),
        rounded("rate_per_choke"),
        rounded("reference_rate"),
    )


def predicted_sql(t: str, c: str) -> str:
    """Expected rate, band and flags from `fits` columns at step `t` and control `c`."""
    q = f"""greatest(CASE WHEN per_c IS NOT NULL AND {c} IS NOT NULL THEN per_c * {c}
      WHEN b > 0 THEN q0 / pow(greatest(1e0 + b * d * {t}, 1e-9), 1e0 / b)
      WHEN d <> 0 THEN q0 * exp(-d * {t}) ELSE q0 END, 0e0)"""
    return q


BACKTEST_SQL = (
    """ranked AS (
  SELECT well, production_date, q_24h AS q, choke_size AS c,
    row_number() OVER (PARTITION BY well ORDER BY production_date) AS r,
    count(*) OVER (PARTITION BY well) AS total FROM days WHERE day_class = 'valid_producing'),
lasts AS (
  SELECT w.well, w.ws, w.we, max(r) AS r0, any_value(total) AS total FROM windows w
  JOIN ranked k ON k.well = w.well AND k.production_date BETWEEN w.ws AND w.we GROUP BY ALL),
tested AS (
  SELECT l.well, l.ws, l.we, k.q, k.c, k.r - l.r0 AS step, l.total - l.r0 AS available FROM lasts l
  JOIN ranked k ON k.well = l.well AND k.r BETWEEN l.r0 + 1 AND l.r0 + 28),
predicted AS (
  SELECT t.*, f.model, f.lo, f.hi, CASE WHEN f.widens THEN sqrt(greatest(t.step, 1)) ELSE 1e0 END AS spread, """
    + predicted_sql("t.step", "t.c")
    + """ AS p FROM tested t JOIN fits f ON f.well = t.well AND f.ws = t.ws),
evaluated AS (
  SELECT e.*, h.horizon, greatest(p + lo * spread, 0e0) AS lower FROM predicted e
  JOIN (VALUES (7), (14), (28)) h(horizon) ON e.step <= h.horizon)"""
)
STUDY_SQL = f"{windows_sql(False)}, {FITS_SQL}, {BACKTEST_SQL}"


@query(
    "backtest_wape",
    f"""WITH RECURSIVE {STUDY_SQL}
    SELECT model, CAST(horizon AS INTEGER) AS horizon, count(*) AS rows, round(sum(abs(q - p)) / sum(abs(q)), 6) AS wape
    FROM evaluated GROUP BY model, horizon""",
)
def backtest_wape(spark, folder) -> DataFrame:
    """Pooled error per model and horizon."""
    pooled = ob.pooled_wape(study.evaluated(study_days(spark, folder)))
    return pooled.select("model", "horizon", "rows", rounded("wape", digits=6))


@query(
    "relative_wape_gate",
    f"""WITH RECURSIVE {STUDY_SQL}, w AS (
      SELECT model, horizon, sum(abs(q - p)) / sum(abs(q)) AS wape FROM evaluated GROUP BY ALL),
    best AS (SELECT horizon, min(wape) AS best FROM w WHERE model LIKE 'naive%' GROUP BY horizon)
    SELECT model, bool_and((best - wape) / best >= 0.1) AS passed, round(min((best - wape) / best), 6) AS smallest_gain
    FROM w JOIN best USING (horizon) WHERE model NOT LIKE 'naive%' GROUP BY model""",
)
def relative_wape_gate(spark, folder) -> DataFrame:
    """Gain on the better baseline at every horizon."""
    gate = ob.relative_wape_gate(study.evaluated(study_days(spark, folder)))
    return gate.select("model", "passed", rounded("smallest_gain", digits=6))


@query(
    "lower_tail_rates",
    f"""WITH RECURSIVE {STUDY_SQL}
    SELECT model, CAST(horizon AS INTEGER) AS horizon, coalesce(well, 'POOLED') AS well, count(*) AS n,
      count(*) FILTER (WHERE q < lower) AS k
    FROM evaluated GROUP BY GROUPING SETS ((model, horizon, well), (model, horizon))
    HAVING well IS NULL OR count(*) >= 150""",
)
def lower_tail_rates(spark, folder) -> DataFrame:
    """Days below the band per model, horizon and supplier, and pooled."""
    tail = ob.lower_tail(study.evaluated(study_days(spark, folder)))
    return tail.select("model", "horizon", F.coalesce("well", F.lit("POOLED")).alias("well"), "n", "k")


# An exact bound lies inside the band exactly if the binomial tail at the band's edge is at most half of what confidence leaves.
_TAIL = "list_sum(list_transform(range({first}, {last} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"
LOWER_TAIL_SQL = f"""per AS (
      SELECT model, horizon, well, count(*) AS n, count(*) FILTER (WHERE q < lower) AS k FROM evaluated GROUP BY model, horizon, well),
    pooled AS (
      SELECT model, horizon, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, count(*) FILTER (WHERE n >= 150) AS qualifying
      FROM per GROUP BY model, horizon),
    judged AS (
      SELECT model, n, k FROM per WHERE n >= 150
      UNION ALL SELECT p.model, n, k FROM pooled p JOIN (SELECT model, count(DISTINCT well) AS w FROM evaluated GROUP BY model) USING (model)
      WHERE qualifying < w / 2e0),
    tail_gate AS (
      SELECT model, bool_and({_TAIL.format(first="k", last="n", p=f"{fixed.LOWER_TAIL_BAND[0]}e0")} <= 0.025
        AND {_TAIL.format(first="0", last="k", p=f"{fixed.LOWER_TAIL_BAND[1]}e0")} <= 0.025) AS passed, count(*) AS lines
      FROM judged GROUP BY model)"""


@query(
    "lower_tail_gate",
    f"""WITH RECURSIVE {STUDY_SQL}, {LOWER_TAIL_SQL}
    SELECT model, passed, lines, lines > 0 AS evaluable FROM tail_gate""",
)
def lower_tail_gate(spark, folder) -> DataFrame:
    """Gate on the exact binomial interval."""
    return ob.lower_tail_gate(study.evaluated(study_days(spark, folder)))


@query(
    "bias_by_well",
    f"""WITH RECURSIVE {STUDY_SQL}, halves AS (
      SELECT model, horizon, well, ws, least(horizon, available) AS m,
        step > least(horizon, available) // 2 AS second, sum(q - p) AS r, sum(q) AS a, count(*) AS n
      FROM evaluated GROUP BY ALL)
    SELECT model, CAST(horizon AS INTEGER) AS horizon, well, CAST(sum(n) AS BIGINT) AS n, round(sum(r) / nullif(sum(a), 0), 6) AS ratio,
      count(*) FILTER (WHERE m >= 4 AND a <> 0 AND abs(r / a) > 0.05) AS drifting_halves
    FROM halves GROUP BY model, horizon, well HAVING sum(n) >= 60""",
)
def bias_by_well(spark, folder) -> DataFrame:
    """Mean bias per supplier and the half windows that drift."""
    found = ob.bias(study.evaluated(study_days(spark, folder)))
    return found.select("model", "horizon", "well", "n", rounded("ratio", digits=6), "drifting_halves")


@query(
    "selected_model",
    f"""WITH RECURSIVE {STUDY_SQL}, {LOWER_TAIL_SQL}, w AS (
      SELECT model, horizon, sum(abs(q - p)) / sum(abs(q)) AS wape FROM evaluated GROUP BY ALL),
    best AS (SELECT horizon, min(wape) AS best FROM w WHERE model LIKE 'naive%' GROUP BY horizon),
    gain_gate AS (
      SELECT model, bool_and((best - wape) / best >= 0.1) AS passed FROM w JOIN best USING (horizon) WHERE model NOT LIKE 'naive%' GROUP BY model),
    halves AS (
      SELECT model, horizon, well, ws, least(horizon, available) AS m,
        step > least(horizon, available) // 2 AS second, sum(q - p) AS r, sum(q) AS a, count(*) AS n
      FROM evaluated GROUP BY ALL),
    biased AS (
      SELECT model, sum(r) / nullif(sum(a), 0) AS ratio, count(*) FILTER (WHERE m >= 4 AND a <> 0 AND abs(r / a) > 0.05) AS drifting
      FROM halves GROUP BY model, horizon, well HAVING sum(n) >= 60),
    bias_gate AS (SELECT model, bool_and(ratio IS NULL OR (abs(ratio) <= 0.05 AND drifting = 0)) AS passed FROM biased GROUP BY model),
    chosen AS (
      SELECT arg_min(model, list_position({list(fixed.MODELS)}, model)) AS model
      FROM gain_gate g JOIN tail_gate t USING (model) JOIN bias_gate b USING (model) WHERE g.passed AND t.passed AND b.passed)
    SELECT coalesce(model, '{fixed.FALLBACK_MODEL}') AS selected_model FROM chosen""",
)
def selected_model(spark, folder) -> DataFrame:
    """The first candidate passing all gates, else the fallback (uses the binomial interval)."""
    return ob.select_model(study.evaluated(study_days(spark, folder)))


GOVERNED_SQL = (
    """spans AS (
  SELECT well, ws, we, lead(we) OVER (PARTITION BY well ORDER BY ws) AS next_end FROM windows),
governed AS (
  SELECT d.*, s.ws, s.we, f.q0, f.lo, f.hi, f.d, f.b, f.per_c, f.widens, f.reference_rate,
    1 + coalesce(sum(CAST(d.day_class = 'valid_producing' AS INTEGER)) OVER (
      PARTITION BY s.well, s.ws ORDER BY d.production_date
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step
  FROM days d JOIN spans s ON s.well = d.well AND d.production_date > s.we
    AND (s.next_end IS NULL OR d.production_date <= s.next_end)
  JOIN fits f ON f.well = s.well AND f.ws = s.ws AND f.model = 'naive-median28'),
expected AS (
  SELECT *, greatest(qx + lo, 0e0) AS lower, greatest(qx + hi, qx) AS upper,
    day_class = 'valid_producing' AS valid,
    coalesce(day_class = 'valid_producing' AND q_24h < greatest(qx + lo, 0e0), false) AS below
  FROM (SELECT *, """
    + predicted_sql("step", "choke_size")
    + """ AS qx FROM governed))"""
)
EPISODES_SQL = (
    GOVERNED_SQL
    + """, lows AS (
  SELECT well, ws, step, lag(step) OVER w AS prev, step - row_number() OVER w AS run
  FROM expected WHERE below WINDOW w AS (PARTITION BY well, ws ORDER BY step)),
chained AS (
  SELECT *, count(*) OVER (PARTITION BY well, ws, run) AS run_days,
    sum(CASE WHEN prev IS NULL OR step - prev > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY well, ws ORDER BY step) AS chain
  FROM lows),
opened AS (
  SELECT well, ws, chain, min(step) FILTER (WHERE run_days >= 7) AS a, max(step) AS z,
    arg_min(run_days, step) FILTER (WHERE run_days >= 7) AS trigger_run_days
  FROM chained GROUP BY well, ws, chain HAVING a IS NOT NULL),
span_totals AS (SELECT well, ws, count(*) FILTER (WHERE valid) AS span_valid FROM expected GROUP BY well, ws),
last_valid AS (SELECT well, max(production_date) AS last_day FROM days WHERE day_class = 'valid_producing' GROUP BY well),
episodes AS (
  SELECT * FROM (
    SELECT e.well, min(e.production_date) AS onset, max(e.production_date) AS "offset", e.ws, any_value(e.we) AS we,
      count(*) FILTER (WHERE valid) AS n, any_value(o.trigger_run_days) AS trigger_run_days,
      sum(CASE WHEN day_class IN ('downtime', 'partial', 'valid_producing')
          THEN qx * least(on_stream_hours, 24) / 24 - oil_volume_sm3 END) AS shortfall,
      sum(CASE WHEN day_class IN ('downtime', 'partial', 'valid_producing')
          THEN qx * (24 - least(on_stream_hours, 24)) / 24 END) AS deferred,
      any_value(reference_rate) AS reference_rate,
      count(*) FILTER (WHERE day_class IN ('quarantined', 'missing')) / CAST(count(*) AS DOUBLE) AS gap_fraction,
      any_value(t.span_valid - o.z) < 3 AS runs_on, any_value(l.last_day) AS last_day
    FROM expected e JOIN opened o ON o.well = e.well AND o.ws = e.ws AND e.step BETWEEN o.a AND o.z
      AND (e.valid OR e.step > o.a)
    JOIN span_totals t ON t.well = e.well AND t.ws = e.ws JOIN last_valid l ON l.well = e.well
    GROUP BY e.well, e.ws, o.chain)
  WHERE n >= 10 AND shortfall >= 0.15e0 * reference_rate * n)"""
)
EPISODE_STUDY_SQL = f"{windows_sql(False)}, {FITS_SQL}, {EPISODES_SQL}"


def episode_frames(spark, folder):
    """(days, windows, fits of the fallback model, episodes) of the driver's tables."""
    days = study_days(spark, folder)
    windows, fits = study.windows_and_fits(days)
    return days, windows, fits, op.sweep(days, windows, fits)


@query(
    "episodes",
    f"""WITH RECURSIVE {EPISODE_STUDY_SQL}
    SELECT well, CAST(onset AS VARCHAR) AS onset, CAST("offset" AS VARCHAR) AS offset_day, n AS valid_producing_days,
      trigger_run_days, round(shortfall, 3) AS shortfall, round(deferred, 3) AS deferred,
      round(reference_rate, 4) AS reference_rate, round(gap_fraction, 6) AS gap_fraction,
      runs_on AND "offset" = last_day AS open_ended, gap_fraction > 1e0 / 3 AS poorly_evidenced FROM episodes""",
)
def episodes(spark, folder) -> DataFrame:
    """Sustained underperformance episodes of every supplier (flagship)."""
    found = episode_frames(spark, folder)[3]
    return found.select(
        "well",
        day("onset"),
        day("offset", "offset_day"),
        "valid_producing_days",
        "trigger_run_days",
        rounded("cumulative_rate_shortfall_sm3", "shortfall", 3),
        rounded("deferred_volume_sm3", "deferred", 3),
        rounded("reference_rate_sm3_per_day", "reference_rate"),
        rounded("gap_fraction", digits=6),
        "open_ended",
        "poorly_evidenced",
    )


@query(
    "episode_ranking",
    f"""WITH RECURSIVE {EPISODE_STUDY_SQL}
    SELECT well, CAST(onset AS VARCHAR) AS onset, round(shortfall, 3) AS shortfall,
      row_number() OVER (ORDER BY shortfall DESC, well, onset) AS place FROM episodes""",
)
def episode_ranking(spark, folder) -> DataFrame:
    """Episodes, most costly first, each with its place."""
    ranked = op.ranked(episode_frames(spark, folder)[3])
    return ranked.select("well", day("onset"), rounded("cumulative_rate_shortfall_sm3", "shortfall", 3), "place")


@query(
    "episode_lookup",
    f"""WITH RECURSIVE {EPISODE_STUDY_SQL}, asked AS (
      SELECT well, onset FROM episodes UNION SELECT well, CAST(onset + 1 AS DATE) FROM episodes UNION SELECT 'nobody', min(onset) FROM episodes)
    SELECT a.well, CAST(a.onset AS VARCHAR) AS onset, e.well IS NOT NULL AS found, round(shortfall, 3) AS shortfall,
      CAST("offset" AS VARCHAR) AS offset_day
    FROM asked a LEFT JOIN episodes e ON e.well = a.well AND e.onset = a.onset""",
)
def episode_lookup(spark, folder) -> DataFrame:
    """Single episodes by well and onset; the day after an onset and an unknown well have none."""
    found = stored(episode_frames(spark, folder)[3], "episodes")
    asked = found.select("well", "onset").unionByName(found.select("well", F.date_add("onset", 1).alias("onset")))
    asked = asked.unionByName(found.agg(F.lit("nobody").alias("well"), F.min("onset").alias("onset")))
    return op.lookup(found, asked).select(
        "well", day("onset"), "found", rounded("cumulative_rate_shortfall_sm3", "shortfall", 3), day("offset", "offset_day")
    )


@query(
    "day_series",
    f"""WITH RECURSIVE {windows_sql(False)}, {FITS_SQL}, {GOVERNED_SQL}
    SELECT well, CAST(production_date AS VARCHAR) AS production_date, day_class,
      round(CASE WHEN valid THEN qx END, 4) AS expected, round(CASE WHEN valid THEN lower END, 4) AS lower,
      round(CASE WHEN valid THEN upper END, 4) AS upper, below AS below_band,
      round(CASE WHEN valid AND water_volume_sm3 + oil_volume_sm3 > 0
        THEN water_volume_sm3 / (water_volume_sm3 + oil_volume_sm3) END, 6) AS water_cut,
      CAST(ws AS VARCHAR) AS governing_window_start FROM expected""",
)
def day_series(spark, folder) -> DataFrame:
    """Per-day expectation, band and channels."""
    days = study_days(spark, folder)
    windows, fits = study.windows_and_fits(days)
    return op.series(days, windows, fits).select(
        "well",
        day("production_date"),
        "day_class",
        rounded("expected"),
        rounded("lower"),
        rounded("upper"),
        "below_band",
        rounded("water_cut", digits=6),
        day("governing_window_start"),
    )
