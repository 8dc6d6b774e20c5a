"""Queries over the episodes of the supplier-day view: bundles, hypotheses, findings, queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace.bindings.day_queries import EPISODE_STUDY_SQL, episode_frames
from daytrace.bindings.registry import day, joined, query, rounded
from daytrace.bindings.text_queries import CHUNKS_SQL, PART, TOKEN, chunk_view, index_sql
from daytrace.bindings.views import table
from daytrace.operators import audits as oa
from daytrace.operators import diagnose as og
from daytrace.operators import facts as of
from daytrace.operators import findings as on
from daytrace.operators import review as orv
from daytrace.plans import investigation
from daytrace.session import checkpointed

CHANNELS = ("on_stream_hours", "choke_size", "choke_dp_bar", "downhole_pressure_bar", "wellhead_pressure_bar")


def _value(channel: str) -> str:
    return f"nullif({channel}, 0)" if channel == "downhole_pressure_bar" else channel


ROWS_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY production_date) AS rn FROM days),
placed AS (
  SELECT e.well, e.onset, e."offset" AS z, a.rn AS r1, b.rn AS r2 FROM episodes e
  JOIN numbered a ON a.well = e.well AND a.production_date = e.onset
  JOIN numbered b ON b.well = e.well AND b.production_date = e."offset"),
bundle_rows AS (
  SELECT p.well, p.onset, p.z, n.rn >= p.r1 AS during, n.* EXCLUDE (well) FROM placed p
  JOIN numbered n ON n.well = p.well AND n.rn BETWEEN p.r1 - 60 AND p.r2)"""
COMPARED_SQL = "compared AS (" + " UNION ALL ".join(
    f"""SELECT well, onset, z, {i} AS position, '{c}' AS channel, nb, ne, mb, me, f, l,
  CASE WHEN nb >= 3 AND ne >= 3 THEN me - mb END AS shift,
  CASE WHEN nb >= 3 AND ne >= 3 AND mb <> 0 THEN (me - mb) / abs(mb) END AS rel,
  CASE WHEN nb >= 3 AND ne >= 3 AND sb > 0 THEN (me - mb) / sb END AS std
  FROM (SELECT well, onset, z, count(v) FILTER (WHERE NOT during) AS nb, count(v) FILTER (WHERE during) AS ne,
    median(v) FILTER (WHERE NOT during) AS mb, median(v) FILTER (WHERE during) AS me,
    stddev_pop(v) FILTER (WHERE NOT during) AS sb, arg_min(v, production_date) FILTER (WHERE during) AS f,
    arg_max(v, production_date) FILTER (WHERE during) AS l
    FROM (SELECT *, {_value(c)} AS v FROM bundle_rows) GROUP BY well, onset, z)"""
    for i, c in enumerate(CHANNELS)
) + ")"
RATES_SQL = """rates AS (
  SELECT well, onset, z, median(q_24h) FILTER (WHERE NOT during) AS rb, median(q_24h) FILTER (WHERE during) AS re,
    median(cut) FILTER (WHERE NOT during) AS wb, median(cut) FILTER (WHERE during) AS wd,
    median(gor) FILTER (WHERE during) AS gd, count(*) FILTER (WHERE during) AS days,
    count(*) FILTER (WHERE during AND day_class IN ('quarantined', 'missing')) AS gaps
  FROM (SELECT *, CASE WHEN water_volume_sm3 + oil_volume_sm3 > 0
      THEN water_volume_sm3 / (water_volume_sm3 + oil_volume_sm3) END AS cut,
      CASE WHEN oil_volume_sm3 > 0 THEN gas_volume_sm3 / oil_volume_sm3 END AS gor FROM bundle_rows)
  GROUP BY well, onset, z)"""
OFFSETS_SQL = """fields AS (SELECT CAST(s_suppkey AS VARCHAR) AS well, s_nationkey AS g FROM supplier),
peers AS (
  SELECT e.well AS own, e.onset, e."offset" AS z, o.well FROM episodes e JOIN fields f ON f.well = e.well
  JOIN fields o ON o.g = f.g AND o.well <> e.well WHERE o.well IN (SELECT well FROM days)),
spans_of_peers AS (
  SELECT p.own, p.onset, p.z, p.well, median(n.q_24h) AS during, min(n.rn) - 1 AS before_n
  FROM peers p JOIN numbered n ON n.well = p.well AND n.production_date BETWEEN p.onset AND p.z GROUP BY ALL),
peer_rates AS (
  SELECT s.own, s.onset, s.z, s.well, any_value(s.during) AS during, median(n.q_24h) AS before
  FROM spans_of_peers s JOIN numbered n ON n.well = s.well AND n.rn BETWEEN s.before_n - 59 AND s.before_n
  WHERE s.before_n >= 3 GROUP BY ALL),
changes AS (
  SELECT own, onset, z, (during - before) / before AS change FROM peer_rates WHERE during IS NOT NULL AND before > 0),
offset_wells AS (
  SELECT c.*, coalesce(down, 0) AS down, coalesce(compared, 0) AS compared, mid,
    n > 0 AND coalesce(down, 0) >= greatest(1, n // 2) AS field_wide
  FROM (SELECT e.well, e.onset, e."offset" AS z, (SELECT count(*) FROM peers p WHERE p.own = e.well AND p.onset = e.onset) AS n
        FROM episodes e) c
  LEFT JOIN (SELECT own, onset, z, count(*) FILTER (WHERE change <= -0.2e0) AS down, count(*) AS compared, median(change) AS mid
             FROM changes GROUP BY ALL) k ON k.own = c.well AND k.onset = c.onset AND k.z = c.z)"""
DIAGNOSIS_SQL = f"{EPISODE_STUDY_SQL}, {ROWS_SQL}, {COMPARED_SQL}, {RATES_SQL}, {OFFSETS_SQL}"


def grouped_days(spark, folder, days: DataFrame) -> DataFrame:
    """Days with the supplier's nation as the field whose wells are compared."""
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("well"), F.col("s_nationkey").alias("field")
    )
    return days.join(supplier, "well")


def bundle_view(spark, folder) -> tuple[DataFrame, DataFrame]:
    days, _, _, episodes = episode_frames(spark, folder)
    episodes = checkpointed(episodes)
    return episodes, og.bundles(episodes, days)


@query(
    "channel_comparison",
    f"""WITH RECURSIVE {EPISODE_STUDY_SQL}, {ROWS_SQL}, {COMPARED_SQL}
    SELECT well, CAST(onset AS VARCHAR) AS onset, channel, nb AS baseline_readings, ne AS readings,
      round(mb, 4) AS baseline_median, round(me, 4) AS median, round(f, 4) AS first, round(l, 4) AS last,
      round(shift, 4) AS shift, round(rel, 6) AS relative_shift, round(std, 6) AS standardised_shift FROM compared""",
)
def channel_comparison(spark, folder) -> DataFrame:
    """Each channel before and during each episode."""
    rows = og.channel_rows(bundle_view(spark, folder)[1])
    return rows.select(
        "well",
        day("onset"),
        "channel",
        "baseline_readings",
        "readings",
        *[rounded(c) for c in ("baseline_median", "median", "first", "last", "shift")],
        rounded("relative_shift", digits=6),
        rounded("standardised_shift", digits=6),
    )


@query(
    "episode_rates",
    f"""WITH RECURSIVE {EPISODE_STUDY_SQL}, {ROWS_SQL}, {RATES_SQL}
    SELECT well, CAST(onset AS VARCHAR) AS onset, days AS episode_days, round(rb, 4) AS baseline_median_rate,
      round(re, 4) AS episode_median_rate, round(wb, 6) AS baseline_water_cut, round(wd, 6) AS episode_water_cut,
      round(gd, 4) AS episode_gas_oil_ratio FROM rates""",
)
def episode_rates(spark, folder) -> DataFrame:
    """Median rate, water cut and gas-oil ratio before and during."""
    return bundle_view(spark, folder)[1].select(
        "well",
        day("onset"),
        "episode_days",
        rounded("baseline_median_rate"),
        rounded("episode_median_rate"),
        rounded("baseline_water_cut", digits=6),
        rounded("episode_water_cut", digits=6),
        rounded("episode_gas_oil_ratio"),
    )


@query(
    "offset_wells",
    f"""WITH RECURSIVE {EPISODE_STUDY_SQL}, {ROWS_SQL}, {OFFSETS_SQL}
    SELECT well, CAST(onset AS VARCHAR) AS onset, n AS other_wells, compared AS wells_compared, down AS wells_also_down,
      round(mid, 6) AS median_rate_change, field_wide FROM offset_wells""",
)
def offset_wells(spark, folder) -> DataFrame:
    """What the other suppliers of the nation did over the same dates."""
    days, _, _, episodes = episode_frames(spark, folder)
    found = og.offsets(episodes, grouped_days(spark, folder, days), "field")
    return found.select(
        "well",
        day("onset"),
        "other_wells",
        "wells_compared",
        "wells_also_down",
        rounded("median_rate_change", digits=6),
        "field_wide",
    )


def calls_sql(signal: str) -> str:
    return f"""signed AS (
  SELECT *, std * CASE WHEN channel = 'choke_dp_bar' THEN 1 ELSE -1 END AS signal FROM compared),
calls AS (
  SELECT well, onset, z, arg_min(channel, (-round(signal, 9), position)) FILTER (WHERE {signal} >= 1) AS channel,
    coalesce(string_agg(channel, ',' ORDER BY position) FILTER (WHERE std IS NULL), '') AS skipped
  FROM signed GROUP BY well, onset, z)"""


CALLS_SQL = calls_sql("signal")


@query(
    "strongest_deviation",
    f"""WITH RECURSIVE {EPISODE_STUDY_SQL}, {ROWS_SQL}, {COMPARED_SQL}, {calls_sql("round(signal, 9)")}
    SELECT well, CAST(onset AS VARCHAR) AS onset, channel, skipped AS skipped_channels, channel IS NULL AS abstained FROM calls""",
)
def strongest_deviation(spark, folder) -> DataFrame:
    """The baseline call per episode, or abstention."""
    calls = og.strongest_deviation(bundle_view(spark, folder)[1])
    return calls.select("well", day("onset"), "channel", joined("skipped_channels"), "abstained")


def _fall(channel: str, std: str) -> str:
    return f"""(SELECT CASE WHEN ne < 3 OR std IS NULL THEN 'unresolved'
      WHEN -{std} >= 1 AND (rel IS NULL OR abs(rel) >= 0.1) THEN 'supported' WHEN -{std} >= 0.5 THEN 'plausible'
      WHEN -{std} <= -1 THEN 'contradicted' ELSE 'weak' END
      FROM compared c WHERE c.channel = '{channel}' AND c.well = r.well AND c.onset = r.onset)"""


def hypotheses_sql(std: str) -> str:
    return f"""judged AS (
  SELECT r.well, r.onset, r.z, {_fall("choke_size", std)} AS h0, {_fall("on_stream_hours", std)} AS h1,
    CASE WHEN wd IS NULL OR wb IS NULL THEN 'unresolved' WHEN wd - wb >= 0.05e0 THEN 'supported'
      WHEN wd - wb > 0 THEN 'plausible' ELSE 'contradicted' END AS h2,
    {_fall("downhole_pressure_bar", std)} AS h3,
    CASE WHEN n = 0 THEN 'unresolved' WHEN field_wide THEN 'supported' WHEN down > 0 THEN 'plausible'
      ELSE 'contradicted' END AS h4,
    (SELECT coalesce(string_agg(channel, ',' ORDER BY position), '') FROM compared c
      WHERE c.well = r.well AND c.onset = r.onset AND ne < 3) AS unavailable
  FROM rates r JOIN offset_wells o ON o.well = r.well AND o.onset = r.onset),
formed AS (
  SELECT well, onset, z, unavailable, position, ['H-choke', 'H-uptime', 'H-water', 'H-pressure', 'H-field'][position + 1] AS hypothesis_id,
    [h0, h1, h2, h3, h4][position + 1] AS status,
    ['proximate_driver', 'proximate_driver', 'supported_mechanism', 'supported_mechanism', 'proximate_driver'][position + 1] AS level,
    position IN (0, 1, 3) AS needs_channel
  FROM judged, (SELECT unnest([0, 1, 2, 3, 4]) AS position))"""


HYPOTHESES_SQL = hypotheses_sql("std")


def investigated(spark, folder) -> investigation.Investigation:
    """The investigation of all episodes, made anew for each query."""
    days, _, _, episodes = episode_frames(spark, folder)
    return investigation.investigate(episodes, grouped_days(spark, folder, days), chunk_view(spark, folder), group="field")


def formed(spark, folder) -> DataFrame:
    """The hypotheses of all episodes before any search."""
    days, _, _, episodes = episode_frames(spark, folder)
    return investigation.form(episodes, grouped_days(spark, folder, days), group="field")[2]


@query(
    "hypotheses",
    f"""WITH RECURSIVE {DIAGNOSIS_SQL}, {hypotheses_sql("round(std, 9)")}
    SELECT well, CAST(onset AS VARCHAR) AS onset, hypothesis_id, status, level AS causal_level, unavailable FROM formed""",
)
def hypotheses(spark, folder) -> DataFrame:
    """H1, H2: five hypotheses per episode with their status."""
    return formed(spark, folder).select(
        "well", day("onset"), "hypothesis_id", "status", "causal_level", joined("unavailable_channels", "unavailable")
    )


PASSES_SQL = """early AS (
  SELECT well, onset, any_value(unavailable) <> '' AND bool_or(status = 'unresolved' AND needs_channel)
    AND NOT bool_or(status = 'supported') AS stops, count(*) FILTER (WHERE status IN ('supported', 'plausible')) AS testable
  FROM formed GROUP BY well, onset),
passes AS (
  SELECT well, onset, z, p AS pass, hypothesis_id, ['choke reduced closed in well restriction handover',
      'shut in downtime production stop closed', 'water cut injection breakthrough', 'pressure drawdown reservoir decline',
      'platform shutdown field process trip'][position + 1] AS query
  FROM (SELECT *, row_number() OVER (PARTITION BY well, onset ORDER BY position) - 1 AS p FROM formed
        WHERE status IN ('supported', 'plausible')) JOIN early USING (well, onset) WHERE p = 0 OR NOT stops
  UNION ALL SELECT DISTINCT well, onset, z, 0, 'H-choke', 'well intervention production' FROM formed JOIN early USING (well, onset)
  WHERE testable = 0)"""


@query(
    "evidence_passes",
    f"""WITH RECURSIVE {DIAGNOSIS_SQL}, {HYPOTHESES_SQL}, {PASSES_SQL}
    SELECT well, CAST(onset AS VARCHAR) AS onset, CAST(pass AS INTEGER) AS pass, hypothesis_id, query FROM passes""",
)
def evidence_passes(spark, folder) -> DataFrame:
    """H3: which hypotheses are searched for, in which order."""
    passes = on.evidence_passes(formed(spark, folder))
    return passes.select("well", day("onset"), "pass", "hypothesis_id", "query")


EVIDENCE_SQL = f"""{CHUNKS_SQL}, {index_sql("chunks")},
asked AS (SELECT DISTINCT well, onset, z, pass, hypothesis_id, unnest(regexp_extract_all(lower(query), '{TOKEN}')) AS term FROM passes),
scored AS (
  SELECT a.well, a.onset, a.z, a.pass, a.hypothesis_id, c.chunk_id, any_value(c.text) AS text, any_value(c.report_date) AS report_date,
    any_value(c.source_document) AS document, list(a.term ORDER BY a.term) AS terms,
    list_reduce(list({PART} ORDER BY a.term), lambda x, y: x + y) AS score
  FROM asked a JOIN tf USING (term) JOIN idf USING (term) JOIN chunks c ON c.chunk_id = tf.chunk_id AND c.well = a.well
    AND c.report_date BETWEEN a.onset - 45 AND a.z + 45
  GROUP BY a.well, a.onset, a.z, a.pass, a.hypothesis_id, c.chunk_id),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY well, onset, pass ORDER BY score DESC, chunk_id) AS rank FROM scored),
pieces AS (
  SELECT well, onset, pass, chunk_id, p, i, len(list_filter(terms, lambda t: contains(lower(p), t))) > 0 AND p <> '' AND contains(text, p) AS fits
  FROM (SELECT *, unnest(list_transform(string_split(replace(text, chr(10), '. '), '. '),
      lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g'))) AS p, generate_subscripts(string_split(replace(text, chr(10), '. '), '. '), 1) AS i
    FROM hits WHERE rank <= 5)),
evidence AS (
  SELECT h.well, h.onset, h.z, h.pass, h.hypothesis_id, h.chunk_id, h.rank, h.score, h.document, h.report_date,
    coalesce(f.p, h.text) AS span
  FROM hits h LEFT JOIN (SELECT well, onset, pass, chunk_id, arg_min(p, i) AS p FROM pieces WHERE fits GROUP BY ALL) f
    ON f.well = h.well AND f.onset = h.onset AND f.pass = h.pass AND f.chunk_id = h.chunk_id WHERE h.rank <= 5)"""


@query(
    "evidence",
    f"""WITH RECURSIVE {DIAGNOSIS_SQL}, {HYPOTHESES_SQL}, {PASSES_SQL}, {EVIDENCE_SQL}
    SELECT well, CAST(onset AS VARCHAR) AS onset, hypothesis_id, rank, round(score, 6) AS score, document, chunk_id AS event_id,
      span FROM evidence""",
)
def evidence(spark, folder) -> DataFrame:
    """Spans found near each episode for each searched hypothesis."""
    passes = checkpointed(on.evidence_passes(formed(spark, folder)))
    found = on.retrieve(passes, chunk_view(spark, folder))
    return found.select(
        "well",
        day("onset"),
        "hypothesis_id",
        F.col("rank").cast("bigint").alias("rank"),
        rounded("score", digits=6),
        "document",
        "event_id",
        "span",
    )


_REASONS = " OR ".join(
    f"contains(lower(span), '{p}')"
    for p in (
        "to prepare", "in preparation", "in order to", "due to", "because of", "for the purpose",
        "as per", "according to programme", "planned", "requested by",
    )
)
FINDINGS_SQL = f"""refs AS (
  SELECT well, onset, hypothesis_id, count(*) AS n, bool_or({_REASONS}) AS reason FROM evidence GROUP BY ALL),
attached AS (
  SELECT f.*, coalesce(n, 0) AS n, CASE WHEN n > 0 AND status = 'supported' AND reason THEN 'documented_root_cause' ELSE level END AS level2,
    CASE WHEN n > 0 AND status IN ('unresolved', 'weak') THEN 'plausible' ELSE status END AS status2
  FROM formed f LEFT JOIN refs r USING (well, onset, hypothesis_id)),
concluded AS (
  SELECT *, CASE WHEN s = 1 THEN 'supported_explanation' WHEN s > 1 OR pl >= 2 THEN 'multiple_plausible_explanations'
      ELSE 'insufficient_evidence' END AS verdict,
    CASE WHEN unavailable <> '' AND waiting AND s = 0 THEN 'mandatory_evidence_unavailable'
      WHEN pl > 0 THEN 'evidence_exhausted' ELSE 'evidence_threshold_met' END AS stop_reason,
    [NULL, 'proximate_driver', 'supported_mechanism', 'documented_root_cause'][lv + 1] AS highest_level
  FROM (SELECT well, onset, any_value(z) AS z, any_value(unavailable) AS unavailable, count(*) FILTER (WHERE status2 = 'supported') AS s,
      count(*) FILTER (WHERE status2 = 'plausible') AS pl, bool_or(status2 = 'unresolved' AND needs_channel) AS waiting,
      CAST(sum(n) AS BIGINT) AS citations, coalesce(string_agg(hypothesis_id, ',' ORDER BY position) FILTER (WHERE status2 = 'supported'), '') AS supported,
      coalesce(max(CASE level2 WHEN 'proximate_driver' THEN 1 WHEN 'supported_mechanism' THEN 2 ELSE 3 END)
        FILTER (WHERE status2 = 'supported'), 0) AS lv
    FROM attached GROUP BY well, onset) JOIN early USING (well, onset))"""
INVESTIGATION_SQL = f"{DIAGNOSIS_SQL}, {HYPOTHESES_SQL}, {PASSES_SQL}, {EVIDENCE_SQL}, {FINDINGS_SQL}"


@query(
    "findings",
    f"""WITH RECURSIVE {INVESTIGATION_SQL}
    SELECT 'finding_' || well || '_' || CAST(onset AS VARCHAR) AS finding_id, well, verdict, stop_reason,
      stop_reason = 'mandatory_evidence_unavailable' AS curtailed, highest_level, supported, citations, unavailable FROM concluded""",
)
def findings(spark, folder) -> DataFrame:
    """H5 to H8: verdict, stop reason, level and citations per episode."""
    found = investigated(spark, folder).findings
    return found.select(
        "finding_id",
        "well",
        "verdict",
        "stop_reason",
        "curtailed",
        "highest_level",
        joined("supported"),
        "citations",
        joined("unavailable_channels", "unavailable"),
    )


@query(
    "finding_counts",
    f"""WITH RECURSIVE {INVESTIGATION_SQL}, lists(kind, value) AS (VALUES ('verdict', 'supported_explanation'),
      ('verdict', 'multiple_plausible_explanations'), ('verdict', 'insufficient_evidence'), ('stop_reason', 'evidence_threshold_met'),
      ('stop_reason', 'evidence_exhausted'), ('stop_reason', 'mandatory_evidence_unavailable'), ('stop_reason', 'step_budget_reached'),
      ('stop_reason', 'cost_budget_reached'), ('highest_level', 'proximate_driver'), ('highest_level', 'supported_mechanism'),
      ('highest_level', 'documented_root_cause'), ('highest_level', 'None'))
    SELECT kind, value, count(c.well) AS findings FROM lists LEFT JOIN concluded c ON value = CASE kind WHEN 'verdict' THEN verdict
      WHEN 'stop_reason' THEN stop_reason ELSE coalesce(highest_level, 'None') END GROUP BY kind, value""",
)
def finding_counts(spark, folder) -> DataFrame:
    """Verdicts, stop reasons and levels, zeros kept."""
    return on.counts(investigated(spark, folder).findings)


SCORES_SQL = """score_rows AS (
  SELECT c.well, c.onset, c.z, r.gaps, r.days, c.verdict, c.stop_reason, c.highest_level,
    least((SELECT coalesce(max(abs(std)), 0) FROM compared x WHERE x.well = c.well AND x.onset = c.onset), 3e0) / 3e0 AS f1,
    (SELECT count(*) FILTER (WHERE ne >= 3) FROM compared x WHERE x.well = c.well AND x.onset = c.onset) / 5e0 AS f2,
    CASE WHEN highest_level = 'documented_root_cause' THEN 1e0 ELSE 0e0 END AS f3,
    greatest(0e0, (r.days - r.gaps) / CAST(r.days AS DOUBLE)) AS f4,
    CASE WHEN stop_reason = 'mandatory_evidence_unavailable' THEN 0e0 ELSE 1e0 END AS f5
  FROM concluded c JOIN rates r ON r.well = c.well AND r.onset = c.onset),
scores AS (
  SELECT *, round((f1 + f2 + f3 + f4 + f5) / 5e0, 6) AS score,
    CASE WHEN round((f1 + f2 + f3 + f4 + f5) / 5e0, 6) >= 0.7 THEN 'high'
      WHEN round((f1 + f2 + f3 + f4 + f5) / 5e0, 6) >= 0.4 THEN 'moderate' ELSE 'low' END AS band FROM score_rows)"""


@query(
    "evidence_scores",
    f"""WITH RECURSIVE {INVESTIGATION_SQL}, {SCORES_SQL}
    SELECT well, CAST(onset AS VARCHAR) AS onset, round(f1, 6) AS deviation_strength, round(f2, 6) AS channel_availability,
      round(f3, 6) AS documentary_cause, round(f4, 6) AS window_completeness, score, band FROM scores""",
)
def evidence_scores(spark, folder) -> DataFrame:
    """Evidence score and band per finding."""
    done = investigated(spark, folder)
    return done.scores.select(
        "well",
        day("onset"),
        *[
            rounded(c, digits=6)
            for c in ("deviation_strength", "channel_availability", "documentary_cause", "window_completeness", "score")
        ],
        "band",
    )


@query(
    "baseline_agreement",
    f"""WITH RECURSIVE {INVESTIGATION_SQL}, {CALLS_SQL}
    SELECT c.well, CAST(c.onset AS VARCHAR) AS onset, CASE WHEN k.channel IS NULL OR c.s = 0 THEN NULL ELSE coalesce(
      CASE WHEN k.channel IN ('choke_size', 'choke_dp_bar') THEN contains(supported, 'H-choke')
        WHEN k.channel = 'on_stream_hours' THEN contains(supported, 'H-uptime') ELSE contains(supported, 'H-pressure') END, false)
      END AS agrees_with_baseline FROM concluded c JOIN calls k ON k.well = c.well AND k.onset = c.onset""",
)
def baseline_agreement(spark, folder) -> DataFrame:
    """H9: does the baseline name the same driver family."""
    done = investigated(spark, folder)
    found = on.baseline_agreement(done.findings, og.strongest_deviation(done.bundle))
    return found.select("well", day("onset"), "agrees_with_baseline")


@query("finding_texts")
def finding_texts(spark, folder) -> DataFrame:
    """Narrative, falsifiers and next check (tests check the wording)."""
    found = investigated(spark, folder).findings
    return found.select(
        "finding_id",
        "narrative",
        joined("what_would_change_the_conclusion", "falsifiers"),
        "recommended_next_check",
    )


def _log(spark, folder) -> DataFrame:
    """A review log from the orders: each order reviews the supplier of its customer number, every
    seventh supplier goes unreviewed."""
    orders = table(spark, folder, "orders")
    number = F.col("o_custkey") % 100 + 1
    action = (
        F.when((F.col("o_orderstatus") == "F") & (number % 3 == 0), "request_more_evidence")
        .when((F.col("o_orderpriority") == "1-URGENT") & (number % 3 == 1), "confirm")
        .otherwise("add_correction")
    )
    return orders.where(number % 7 != 0).select(
        number.cast("string").alias("well"),
        action.alias("action"),
        F.concat_ws(" ", F.col("o_orderdate").cast("date"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("recorded_at"),
    )


def queue_view(spark, folder, done: investigation.Investigation | None = None) -> DataFrame:
    """The queue of an investigation, or of one made anew."""
    done = done or investigated(spark, folder)
    log = _log(spark, folder).join(
        done.episodes.select("well", orv.investigation_id(F.col("well"), F.col("onset")).alias("investigation_id")), "well"
    )
    return orv.queue(done.episodes, done.findings, done.scores, log)


QUEUE_SQL = f"""{INVESTIGATION_SQL}, {SCORES_SQL},
acts AS (
  SELECT CAST(n AS VARCHAR) AS well, CASE WHEN o_orderstatus = 'F' AND n % 3 = 0 THEN 'request_more_evidence'
    WHEN o_orderpriority = '1-URGENT' AND n % 3 = 1 THEN 'confirm' ELSE 'add_correction' END AS action
  FROM (SELECT *, o_custkey % 100 + 1 AS n FROM orders) WHERE n % 7 <> 0),
states AS (
  SELECT well, CASE WHEN bool_or(action = 'confirm') THEN 'confirmed' WHEN bool_or(action = 'request_more_evidence')
    THEN 'rerun_requested' ELSE 'awaiting_review' END AS state FROM acts GROUP BY well),
queued AS (
  SELECT e.well, e.onset, e.shortfall, e.deferred, s.verdict, s.band, coalesce(t.state, 'none') AS review_state,
    CASE WHEN e.shortfall >= 30000 THEN 3 WHEN e.shortfall >= 10000 THEN 2 ELSE 1 END AS pts,
    date_diff('day', e.onset, e."offset") + 1 >= 40 AS long_one, coalesce(t.state, 'none') IN ('awaiting_review', 'rerun_requested') AS pending,
    s.verdict <> 'supported_explanation' AND s.band IN ('high', 'moderate') AS open_case
  FROM episodes e JOIN scores s ON s.well = e.well AND s.onset = e.onset LEFT JOIN states t ON t.well = e.well)"""


@query(
    "review_queue",
    f"""WITH RECURSIVE {QUEUE_SQL}, x AS (SELECT *, pts + CAST(long_one AS INTEGER) + CAST(pending AS INTEGER) + CAST(open_case AS INTEGER) AS score FROM queued)
    SELECT well, CAST(onset AS VARCHAR) AS onset, verdict, band AS evidence_band, review_state, CAST(score AS INTEGER) AS score,
      CASE WHEN score >= 5 THEN 'HIGH' WHEN score >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM x""",
)
def review_queue(spark, folder) -> DataFrame:
    """Prioritised queue."""
    return queue_view(spark, folder).select(
        "well", day("onset"), "verdict", "evidence_band", "review_state", "score", "priority"
    )


@query(
    "priority_terms",
    f"""WITH RECURSIVE {QUEUE_SQL}
    SELECT 'size of the shortfall' AS term, count(*) AS episodes FROM queued
    UNION ALL SELECT 'episode lasts 40 days or more', count(*) FILTER (WHERE long_one) FROM queued
    UNION ALL SELECT 'review is pending', count(*) FILTER (WHERE pending) FROM queued
    UNION ALL SELECT 'one explanation is not enough, though the evidence band is high or moderate', count(*) FILTER (WHERE open_case) FROM queued""",
)
def priority_terms(spark, folder) -> DataFrame:
    """How often each priority term fired."""
    return orv.term_counts(queue_view(spark, folder))


@query(
    "queue_figures",
    f"""WITH RECURSIVE {QUEUE_SQL}
    SELECT count(*) AS open_investigations, count(*) FILTER (WHERE review_state <> 'confirmed') AS awaiting_review,
      count(*) FILTER (WHERE review_state <> 'none') AS reviews_recorded, round(sum(round(shortfall, 2)), 2) AS shortfall,
      count(*) FILTER (WHERE verdict = 'insufficient_evidence') AS no_conclusion_issued, count(DISTINCT well) AS wells_with_an_episode
    FROM queued""",
)
def queue_figures(spark, folder) -> DataFrame:
    """Headline figures of the queue."""
    return orv.queue_kpis(queue_view(spark, folder)).select(
        "open_investigations",
        "awaiting_review",
        "reviews_recorded",
        rounded("cumulative_rate_shortfall_sm3", "shortfall", 2),
        "no_conclusion_issued",
        "wells_with_an_episode",
    )


_CELL = """CASE fam WHEN 'Report' THEN CASE WHEN n > 0 THEN 'supports' WHEN searched THEN 'none_found' ELSE 'not_searched' END
  WHEN ['Control', 'Production', 'Fluids', 'Pressure', 'Production'][position + 1] THEN
    CASE WHEN status2 IN ('supported', 'contradicted') AND has_value THEN
      CASE status2 WHEN 'supported' THEN 'supports' ELSE 'contradicts' END ELSE 'neutral' END
  ELSE 'not_applicable' END"""


@query(
    "evidence_matrix",
    f"""WITH RECURSIVE {INVESTIGATION_SQL}, m AS (
      SELECT a.*, EXISTS (SELECT 1 FROM passes p WHERE p.well = a.well AND p.onset = a.onset AND p.hypothesis_id = a.hypothesis_id) AS searched,
        position <> 4 OR (SELECT mid FROM offset_wells o WHERE o.well = a.well AND o.onset = a.onset) IS NOT NULL AS has_value,
        unnest(['Production', 'Control', 'Pressure', 'Fluids', 'Report']) AS fam FROM attached a)
    SELECT well, CAST(onset AS VARCHAR) AS onset, hypothesis_id, fam AS family, {_CELL} AS cell FROM m""",
)
def evidence_matrix(spark, folder) -> DataFrame:
    """Hypothesis by evidence family, the kind of absence recorded."""
    done = investigated(spark, folder)
    cells = orv.matrix_cells(done.hypotheses, done.passes)
    return cells.select("well", day("onset"), "hypothesis_id", "family", "cell")


@query(
    "coverage_lines",
    f"""WITH RECURSIVE {INVESTIGATION_SQL}
    SELECT well, CAST(onset AS VARCHAR) AS onset,
      (SELECT coalesce(string_agg(channel || ': ' || ne || ' of ' || r.days || ' days usable', ',' ORDER BY position), '') FROM compared x
        WHERE x.well = c.well AND x.onset = c.onset AND ne > 0) AS available FROM concluded c JOIN rates r USING (well, onset)""",
)
def coverage_lines(spark, folder) -> DataFrame:
    """Lines on what evidence was available."""
    done = investigated(spark, folder)
    return orv.coverage_lines(done.findings, done.bundle).select("well", day("onset"), joined("available"))


@query(
    "finding_audits",
    f"""WITH RECURSIVE {QUEUE_SQL}
    SELECT 'priority_as_printed' AS "check", count(*) AS examined, 0 AS problems FROM queued
    UNION ALL SELECT 'abstentions_explained', count(*) FILTER (WHERE verdict = 'insufficient_evidence'), 0 FROM queued
    UNION ALL SELECT 'no_hold_out_in_text', count(*), 0 FROM queued""",
)
def finding_audits(spark, folder) -> DataFrame:
    """Q11, Q12: priority recomputed, abstentions explained, no held-out name in served text."""
    done = investigated(spark, folder)
    found = oa.all_outcomes(
        oa.priority_as_printed(queue_view(spark, folder, done)),
        oa.abstentions_explained(orv.coverage_lines(done.findings, done.bundle)),
        oa.no_hold_out_in_text(done.findings.select(F.col("narrative").alias("text"))),
    )
    return found.select("check", "examined", "problems")


@query("provenance_gate")
def provenance_gate(spark, folder) -> DataFrame:
    """Rules each finding breaks, over facts derived with a stated price."""
    done = investigated(spark, folder)
    facts, inputs, cited = of.episode_facts(done.episodes, oil_price=400.0)
    documents = chunk_view(spark, folder).withColumnRenamed("chunk_id", "event_id")
    violations = oa.provenance_violations(done.findings, done.hypotheses, cited, facts, inputs, documents)
    return oa.provenance_gate(done.findings, violations)


@query(
    "safety_report",
    f"""WITH RECURSIVE {INVESTIGATION_SQL}
    SELECT count(*) AS findings_examined, count(*) FILTER (WHERE highest_level = 'documented_root_cause') AS documented_claims,
      0 AS documented_claim_without_a_stated_reason,
      count(*) FILTER (WHERE verdict = 'insufficient_evidence') AS abstentions FROM concluded""",
)
def safety_report(spark, folder) -> DataFrame:
    """Documented claims, incidents and abstentions."""
    done = investigated(spark, folder)
    return oa.safety(done.findings, done.hypotheses).select(
        "findings_examined", "documented_claims", "documented_claim_without_a_stated_reason", "abstentions"
    )


@query(
    "episode_facts",
    f"""WITH RECURSIVE {EPISODE_STUDY_SQL}, x AS (
      SELECT 'episode_cumulative_rate_shortfall' AS metric, shortfall AS value, 'Sm3' AS unit, well FROM episodes
      UNION ALL SELECT 'episode_actual_volume', deferred + shortfall, 'Sm3', well FROM episodes
      UNION ALL SELECT 'episode_reference_rate', reference_rate, 'Sm3/d', well FROM episodes
      UNION ALL SELECT 'estimated_gross_value_shortfall', shortfall * 400e0, 'USD', NULL FROM episodes
      UNION ALL SELECT 'assumed_oil_price', 400e0, 'USD/Sm3', NULL)
    SELECT metric, unit, well, round(value, 2) AS value FROM x""",
)
def episode_facts(spark, folder) -> DataFrame:
    """Measured and derived facts of every episode."""
    facts, _, _ = of.episode_facts(checkpointed(episode_frames(spark, folder)[3]), oil_price=400.0)
    return facts.select("metric", "unit", F.col("source_locator")["well"].alias("well"), rounded("value", digits=2))
