"""Queries on labels, review logs, recorded steps, lineage, metrics, leakage and corrections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.bindings.day_queries import SPLIT_SQL
from daytrace.bindings.event_queries import BLOCKS_SQL, LANES_SQL, event_view
from daytrace.bindings.registry import joined, query, rounded
from daytrace.bindings.source_queries import BLOCK_ROWS_SQL, DOCTYPE, INCLUDE, MISNAMED, NOT_XML, TORN, report_texts
from daytrace.bindings.views import ANY_DIFFERS, DAYS_SQL, entity_days, raw_days, table
from daytrace.operators import audits as oa
from daytrace.operators import days as od
from daytrace.operators import facts as of
from daytrace.operators import labels as ol
from daytrace.operators import review as orv
from daytrace.operators import sampling as os_
from daytrace.session import shared_folder
from daytrace.sources import reports, store

# ---- label scoring over `labels` joined with `documents` --------------------------------

_GOLD = """CASE WHEN quality = 0 AND toxic = 1 THEN 'well_control' WHEN quality = 0 THEN 'hole_problem'
  WHEN toxic = 1 THEN 'equipment_failure' WHEN doc_id % 4 = 0 THEN 'not_stated' ELSE 'rig_service' END"""
LABELLED_SQL = f"""labelled AS (
  SELECT doc_id, {_GOLD} AS cause,
    CASE WHEN doc_id % 9 = 0 THEN 'not_stated' WHEN doc_id % 7 = 0 THEN 'rig_service' ELSE {_GOLD} END AS candidate,
    CASE WHEN doc_id % 5 = 0 THEN 'rig_service' ELSE {_GOLD} END AS forced,
    CASE lang WHEN 'en' THEN 'rig_service' WHEN 'fr' THEN 'hole_problem' ELSE 'not_stated' END AS echo_one,
    CASE WHEN n_chars % 3 = 0 THEN 'rig_service' WHEN n_chars % 3 = 1 THEN 'not_stated' ELSE 'hole_problem' END AS echo_two
  FROM labels JOIN documents USING (doc_id))"""


def labelled_view(spark, folder) -> DataFrame:
    """Labels as causes, with a candidate, a forced choice and two baselines per document."""
    c = F.col
    gold = (
        F.when((c("quality") == 0) & (c("toxic") == 1), "well_control")
        .when(c("quality") == 0, "hole_problem")
        .when(c("toxic") == 1, "equipment_failure")
        .when(c("doc_id") % 4 == 0, "not_stated")
        .otherwise("rig_service")
    )
    rows = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "lang", "n_chars", "text"), "doc_id"
    )
    return rows.select(
        "doc_id",
        c("doc_id").cast("string").alias("event_id"),
        gold.alias("cause"),
        F.lit("machine_assisted").alias("label_source"),
        F.when(c("doc_id") % 9 == 0, "not_stated").when(c("doc_id") % 7 == 0, "rig_service").otherwise(gold).alias("candidate"),
        F.when(c("doc_id") % 5 == 0, "rig_service").otherwise(gold).alias("forced"),
        F.when(c("lang") == "en", "rig_service").when(c("lang") == "fr", "hole_problem").otherwise("not_stated").alias("echo_one"),
        F.when(c("n_chars") % 3 == 0, "rig_service")
        .when(c("n_chars") % 3 == 1, "not_stated")
        .otherwise("hole_problem")
        .alias("echo_two"),
        F.when(c("doc_id") % 10 == 3, "a span that is nowhere").otherwise(F.left("text", F.lit(30))).alias("evidence_span"),
        c("text").alias("comment"),
    )


_SCORES = """s AS (
  SELECT g.label, g.support, coalesce(h.hits, 0) AS hits, coalesce(p.claimed, 0) AS claimed
  FROM (SELECT cause AS label, count(*) AS support FROM labelled GROUP BY cause) g
  LEFT JOIN (SELECT candidate AS label, count(*) AS claimed FROM labelled GROUP BY candidate) p USING (label)
  LEFT JOIN (SELECT cause AS label, count(*) AS hits FROM labelled WHERE cause = candidate GROUP BY cause) h USING (label))"""


@query(
    "class_scores",
    f"""WITH {LABELLED_SQL}, {_SCORES}
    SELECT label, support, round(coalesce(hits / nullif(CAST(claimed AS DOUBLE), 0), 0), 6) AS precision,
      round(hits / CAST(support AS DOUBLE), 6) AS recall, round(2 * hits / CAST(support + claimed AS DOUBLE), 6) AS f1,
      support >= 5 AS in_macro_average FROM s""",
)
def class_scores(spark, folder) -> DataFrame:
    """Precision, recall and F1 per class."""
    scores = ol.class_scores(labelled_view(spark, folder), "cause", "candidate")
    return scores.select(
        "label", "support", *[rounded(c, digits=6) for c in ("precision", "recall", "f1")], "in_macro_average"
    )


@query(
    "macro_f1",
    f"""WITH {LABELLED_SQL}, {_SCORES}
    SELECT round(avg(2 * hits / CAST(support + claimed AS DOUBLE)), 6) AS macro_f1, count(*) AS classes_in_average
    FROM s WHERE support >= 5""",
)
def macro_f1(spark, folder) -> DataFrame:
    """Macro-F1 over classes with enough support."""
    macro = ol.macro_f1(ol.class_scores(labelled_view(spark, folder), "cause", "candidate"))
    return macro.select(rounded("macro_f1", digits=6), "classes_in_average")


@query("bootstrap_margin")
def bootstrap_margin(spark, folder) -> DataFrame:
    """Bootstrap interval (random draws, so no SQL statement; tests check its distribution)."""
    rows = labelled_view(spark, folder).select(
        F.col("cause").alias("gold"), "candidate", F.col("echo_one").alias("baseline")
    )
    return ol.bootstrap_margin(spark, rows).select(rounded("low", digits=6), rounded("high", digits=6))


@query("selection_conditions")
def selection_conditions(spark, folder) -> DataFrame:
    """The four conditions, two of them suspended for machine-assisted labels."""
    rows = ol.selection_conditions(spark, labelled_view(spark, folder), ("echo_one", "echo_two"))
    return rows.select("name", "passed", "gates", rounded("value", digits=6))


@query(
    "selection_rules",
    f"""WITH {LABELLED_SQL}, long AS (
      SELECT cause, 'candidate' AS who, candidate AS said FROM labelled UNION ALL SELECT cause, 'echo_one', echo_one FROM labelled
      UNION ALL SELECT cause, 'echo_two', echo_two FROM labelled),
    f AS (
      SELECT g.who, g.cause, g.support, 2 * coalesce(h.hits, 0) / CAST(g.support + coalesce(p.claimed, 0) AS DOUBLE) AS f1
      FROM (SELECT who, cause, count(*) AS support FROM long GROUP BY ALL) g
      LEFT JOIN (SELECT who, said AS cause, count(*) AS claimed FROM long GROUP BY ALL) p USING (who, cause)
      LEFT JOIN (SELECT who, cause, count(*) AS hits FROM long WHERE cause = said GROUP BY ALL) h USING (who, cause)),
    m AS (SELECT max(f1) FILTER (WHERE who = 'candidate') AS own, max(f1) FILTER (WHERE who <> 'candidate') AS best
      FROM (SELECT who, avg(f1) AS f1 FROM f WHERE support >= 5 GROUP BY who)),
    x AS (
      SELECT count(*) FILTER (WHERE cause <> 'not_stated') AS stated, count(*) FILTER (WHERE cause <> 'not_stated' AND candidate <> 'not_stated') AS covered,
        count(*) FILTER (WHERE candidate <> 'not_stated' AND doc_id % 10 = 3) AS loose,
        count(*) FILTER (WHERE candidate <> 'not_stated' AND candidate = cause) / CAST(count(*) FILTER (WHERE candidate <> 'not_stated') AS DOUBLE)
          - count(*) FILTER (WHERE forced <> 'not_stated' AND forced = cause) / CAST(count(*) FILTER (WHERE forced <> 'not_stated') AS DOUBLE) AS margin
      FROM labelled)
    SELECT 'relative macro-F1 margin' AS name, (own - best) / best >= {fixed.RELATIVE_MARGIN} AS passed, false AS gates, round((own - best) / best, 6) AS value FROM m
    UNION ALL SELECT 'evidence spans verbatim', loose = 0, true, CAST(loose AS DOUBLE) FROM x
    UNION ALL SELECT 'abstention', covered / CAST(stated AS DOUBLE) >= {fixed.MIN_COVERAGE} AND margin >= {fixed.PRECISION_MARGIN}, true, round(margin, 6) FROM x""",
)
def selection_rules(spark, folder) -> DataFrame:
    """The conditions that draw no samples; a tenth of the spans is in no text, so one of them fails."""
    rows = ol.selection_conditions(spark, labelled_view(spark, folder), ("echo_one", "echo_two"))
    return rows.where("name <> 'margin survives resampling'").select("name", "passed", "gates", rounded("value", digits=6))


@query(
    "label_agreement",
    f"""WITH {LABELLED_SQL}
    SELECT count(*) FILTER (WHERE cause = forced) AS agreeing, count(*) AS shared FROM labelled WHERE doc_id % 3 <> 0""",
)
def label_agreement(spark, folder) -> DataFrame:
    """Agreement of two passes over the events both labelled."""
    rows = labelled_view(spark, folder)
    second = rows.where("doc_id % 3 <> 0").select("event_id", F.col("forced").alias("cause"))
    return ol.agreement(rows.select("event_id", "cause"), second)


@query(
    "label_distribution",
    f"""WITH {LABELLED_SQL}, c(cause) AS (VALUES {", ".join(f"('{c}')" for c in fixed.CAUSES)})
    SELECT c.cause, count(l.doc_id) AS rows FROM c LEFT JOIN labelled l ON l.cause = c.cause GROUP BY c.cause""",
)
def label_distribution(spark, folder) -> DataFrame:
    """Labels per class of the taxonomy, zeros kept."""
    return ol.distribution(labelled_view(spark, folder))


@query(
    "label_problems",
    f"""WITH {BLOCKS_SQL}, m AS (SELECT event_id, comment, CAST(s // 60000000 % 60 AS INTEGER) AS k FROM lost), l AS (
      SELECT event_id, CASE WHEN k % 6 = 0 THEN 'not_stated' WHEN k % 11 = 0 THEN 'bad' ELSE 'rig_service' END AS cause,
        CASE WHEN k % 4 = 0 THEN NULL WHEN k % 5 = 0 THEN 'not there' ELSE 'Pump' END AS span, comment FROM m)
    SELECT event_id, concat_ws(',', CASE WHEN cause = 'bad' THEN 'unknown_cause' END,
      CASE WHEN cause = 'not_stated' AND span IS NOT NULL THEN 'span_without_cause' END,
      CASE WHEN cause <> 'not_stated' AND span IS NULL THEN 'cause_without_span' END,
      CASE WHEN span IS NOT NULL AND NOT contains(comment, span) THEN 'span_not_verbatim' END) AS problems FROM l""",
)
def label_problems(spark, folder) -> DataFrame:
    """Labels joined to their events, rules broken."""
    events = event_view(spark, folder)
    n = F.minute("start_time")
    labels = events.select(
        "event_id",
        F.when(n % 6 == 0, "not_stated").when(n % 11 == 0, "bad").otherwise("rig_service").alias("cause"),
        F.lit("expert").alias("label_source"),
        F.when(n % 4 == 0, F.lit(None).cast("string")).when(n % 5 == 0, "not there").otherwise("Pump").alias("evidence_span"),
    )
    return ol.join_to_events(labels, events).select("event_id", joined("problems"))


@query(
    "baseline_report",
    f"""WITH {BLOCKS_SQL}, x AS (
      SELECT CASE WHEN hours > 1 THEN 'equipment_failure' ELSE 'not_stated' END AS cause,
        CASE subcategory WHEN 'repair' THEN 'equipment_failure' WHEN 'waiting on weather' THEN 'waiting_on_weather'
          WHEN 'fish' THEN 'hole_problem' ELSE 'not_stated' END AS a,
        CASE state_detail WHEN 'equipment failure' THEN 'equipment_failure' WHEN 'mud loss' THEN 'hole_problem' ELSE 'not_stated' END AS b
      FROM lost)
    SELECT count(*) AS labels, count(*) FILTER (WHERE cause = a) AS exact_subcategory, count(*) FILTER (WHERE a = b) AS consensus,
      count(*) FILTER (WHERE a = b AND cause = a) AS labels_match_consensus,
      count(*) FILTER (WHERE a = b AND a <> 'not_stated' AND cause = 'not_stated') AS asserted_labels_not_stated,
      count(*) FILTER (WHERE a <> 'not_stated' AND a <> cause) AS subcategory_contradicts FROM x""",
)
def baseline_report(spark, folder) -> DataFrame:
    """Labels against both baselines and their consensus."""
    rows = event_view(spark, folder).select(
        F.when(F.col("duration_hours") > 1, "equipment_failure").otherwise("not_stated").alias("cause"),
        "subcategory",
        "state_detail",
        F.lit(False).alias("source_coding_looks_wrong"),
    )
    return ol.baseline_report(rows).select(
        "labels",
        "exact_subcategory",
        "consensus",
        "labels_match_consensus",
        "asserted_labels_not_stated",
        "subcategory_contradicts",
    )


# ---- review log and recorded steps over `conversations` ---------------------------------

_ACTION = """CASE WHEN role = 'system' THEN 'request_more_evidence' WHEN length(text) % 11 = 0 THEN 'confirm'
  WHEN length(text) % 13 = 0 THEN 'dismiss' ELSE 'add_correction' END"""


def _actions(spark, folder) -> DataFrame:
    n = F.length("text")
    action = (
        F.when(F.col("role") == "system", "request_more_evidence")
        .when(n % 11 == 0, "confirm")
        .when(n % 13 == 0, "dismiss")
        .otherwise("add_correction")
    )
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("investigation_id"),
        action.alias("action"),
        F.col("turn").alias("recorded_at"),
        F.when(n % 2 == 0, F.col("role")).alias("note"),
        F.when(n % 7 == 0, "").otherwise("someone").alias("actor"),
    )


@query(
    "review_states",
    f"""WITH a AS (SELECT conv_id, turn, {_ACTION} AS action FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS investigation_id,
      CASE arg_min(action, turn) FILTER (WHERE action IN ('confirm', 'dismiss')) WHEN 'confirm' THEN 'confirmed'
        WHEN 'dismiss' THEN 'dismissed' ELSE CASE WHEN bool_or(action = 'request_more_evidence') THEN 'rerun_requested'
        ELSE 'awaiting_review' END END AS review_state, count(*) FILTER (WHERE action = 'add_correction') AS revision
    FROM a GROUP BY conv_id""",
)
def review_states(spark, folder) -> DataFrame:
    """State and revision per investigation."""
    return orv.review_states(_actions(spark, folder))


@query(
    "review_admission",
    f"""WITH a AS (SELECT conv_id, turn, {_ACTION} AS action, CASE WHEN length(text) % 2 = 0 THEN role END AS note,
        length(text) % 7 = 0 AS anonymous FROM conversations),
    w AS (SELECT *, coalesce(bool_or(action IN ('confirm', 'dismiss')) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS settled,
      count(*) FILTER (WHERE action = 'add_correction') OVER (PARTITION BY conv_id ORDER BY turn) AS revision FROM a)
    SELECT CAST(conv_id AS VARCHAR) AS investigation_id, turn AS recorded_at, revision,
      concat_ws(',', CASE WHEN anonymous THEN 'no_actor' END, CASE WHEN settled THEN 'already_settled' END,
        CASE WHEN action = 'add_correction' AND coalesce(trim(note), '') = '' THEN 'correction_without_note' END) AS reasons
    FROM w WHERE turn >= 2""",
)
def review_admission(spark, folder) -> DataFrame:
    """Which new review rows would be refused, and why; the first two turns are the log.

    The log is appended in two batches and read back; an investigation may be settled by it or by an
    earlier new row, and revisions go on from its corrections.
    """
    rows = _actions(spark, folder)
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    for turn in (0, 1):
        store.append_rows(rows.where(F.col("recorded_at") == turn), path)
    log = spark.read.schema(rows.schema).json(path)
    judged = orv.review_reasons(log, rows.where("recorded_at >= 2"))
    return judged.select("investigation_id", "recorded_at", "revision", joined("reasons"))


_STAGE = """CASE WHEN turn = 0 THEN 'validate_request' WHEN turn = 1 THEN 'form_hypotheses'
  WHEN length(text) % 5 = 0 THEN 'compose_finding' WHEN length(text) % 17 = 0 THEN 'diagnostic_bundle' ELSE 'retrieve_evidence' END"""


def _steps(spark, folder) -> DataFrame:
    n, turn = F.length("text"), F.col("turn")
    stage = (
        F.when(turn == 0, "validate_request")
        .when(turn == 1, "form_hypotheses")
        .when(n % 5 == 0, "compose_finding")
        .when(n % 17 == 0, "diagnostic_bundle")
        .otherwise("retrieve_evidence")
    )
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("run"),
        turn.alias("index"),
        stage.alias("stage"),
        F.when(stage == "retrieve_evidence", F.col("role")).alias("query"),
        n.cast("bigint").alias("tokens"),
        F.lit(0.25).alias("cost_usd"),
    )


@query(
    "stage_order",
    f"""WITH s AS (SELECT conv_id AS run, turn AS i, {_STAGE} AS stage FROM conversations),
    p AS (SELECT *, CASE stage WHEN 'validate_request' THEN 0 WHEN 'diagnostic_bundle' THEN 2 WHEN 'form_hypotheses' THEN 3
      WHEN 'compose_finding' THEN 7 END AS rank FROM s),
    o AS (SELECT run, stage, min(i) AS first, any_value(rank) AS rank, count(*) AS n FROM p WHERE rank IS NOT NULL GROUP BY run, stage),
    q AS (SELECT run, bool_or(n > 1) AS repeats, bool_or(first < reached) AS swapped FROM (
        SELECT *, max(first) OVER (PARTITION BY run ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM o) GROUP BY run),
    l AS (SELECT run, min(i) FILTER (WHERE stage = 'retrieve_evidence') AS a, max(i) FILTER (WHERE stage = 'retrieve_evidence') AS z,
        min(i) FILTER (WHERE stage = 'form_hypotheses') AS f, min(i) FILTER (WHERE stage = 'compose_finding') AS c FROM s GROUP BY run)
    SELECT l.run, concat_ws(',', CASE WHEN repeats THEN 'stage_repeats' END, CASE WHEN swapped THEN 'stages_out_of_order' END,
      CASE WHEN a IS NOT NULL AND (f IS NULL OR a < f) THEN 'loop_before_hypotheses' END,
      CASE WHEN z > c THEN 'loop_after_composing' END) AS problems FROM l LEFT JOIN q ON q.run = l.run""",
)
def stage_order(spark, folder) -> DataFrame:
    """Q8: order rules broken per recorded run."""
    return oa.stage_order_problems(_steps(spark, folder)).select("run", joined("problems"))


@query(
    "trajectory",
    f"""WITH s AS (SELECT conv_id AS run, {_STAGE} AS stage, role, length(text) AS tokens FROM conversations),
    r AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE stage = 'retrieve_evidence') AS passes, sum(tokens) AS tokens FROM s GROUP BY run)
    SELECT count(*) AS runs, CAST(sum(n) AS BIGINT) AS steps_total, min(n) AS steps_min, max(n) AS steps_max, round(avg(n), 6) AS steps_mean,
      CAST(sum(passes) AS BIGINT) AS passes_total, CAST(sum(tokens) AS BIGINT) AS tokens,
      (SELECT count(*) FROM (SELECT run, role FROM s WHERE stage = 'retrieve_evidence' GROUP BY ALL HAVING count(*) > 1)) AS repeated_queries FROM r""",
)
def trajectory(spark, folder) -> DataFrame:
    """Q9: steps, passes, repeated queries and totals over all runs."""
    return oa.trajectory(_steps(spark, folder)).select(
        "runs", "steps_total", "steps_min", "steps_max", rounded("steps_mean", digits=6), "passes_total", "tokens", "repeated_queries"
    )


@query(
    "repeated_queries",
    f"""WITH s AS (SELECT conv_id AS run, {_STAGE} AS stage, role FROM conversations)
    SELECT run, role AS query, count(*) AS times FROM s WHERE stage = 'retrieve_evidence' GROUP BY ALL HAVING count(*) > 1""",
)
def repeated_queries(spark, folder) -> DataFrame:
    """Q9: identical queries asked twice in one run."""
    return oa.repeated_queries(_steps(spark, folder))


# ---- lineage over region, nation, customer and orders -----------------------------------


def _chain(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Facts and inputs: regions are measured, everything below is derived from its parent."""

    def fact(df: DataFrame, prefix: str, key: str, unit: str) -> DataFrame:
        return df.select(
            F.concat(F.lit(prefix), key).alias("fact_id"),
            F.lit("measured" if prefix == "r" else "derived").alias("kind"),
            F.lit(prefix).alias("metric"),
            F.col(key).cast("double").alias("value"),
            F.lit(unit).alias("unit"),
            F.lit("table").alias("source"),
            F.lit(None).cast("map<string,string>").alias("source_locator"),
            F.lit(None).cast("date").alias("recorded_at"),
            F.lit("parent").alias("formula"),
            F.lit(False).alias("combines_units"),
        )

    region, nation = table(spark, folder, "region"), table(spark, folder, "nation")
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    facts = fact(region, "r", "r_regionkey", "Sm3").unionByName(fact(nation, "n", "n_nationkey", "Sm3"))
    facts = facts.unionByName(fact(customer, "c", "c_custkey", "Sm3")).unionByName(fact(orders, "o", "o_orderkey", "Sm3"))

    def edge(df: DataFrame, a: str, b: str, child: str, parent: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), child).alias("fact_id"), F.concat(F.lit(b), parent).alias("input_id"))

    inputs = edge(nation, "n", "r", "n_nationkey", "n_regionkey").unionByName(
        edge(customer, "c", "n", "c_custkey", "c_nationkey")
    )
    return facts, inputs.unionByName(edge(orders, "o", "c", "o_orderkey", "o_custkey"))


@query(
    "lineage",
    """WITH RECURSIVE e(child, parent) AS (
      SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
      UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
    walk(root_id, fact_id) AS (
      SELECT 'o' || o_orderkey, 'o' || o_orderkey FROM orders
      UNION SELECT w.root_id, e.parent FROM walk w JOIN e ON e.child = w.fact_id)
    SELECT root_id, fact_id FROM walk""",
)
def lineage(spark, folder) -> DataFrame:
    """Everything each order derives from."""
    _, inputs = _chain(spark, folder)
    starts = table(spark, folder, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("fact_id"))
    return of.lineage(starts, inputs)


@query(
    "lineage_problems",
    """SELECT 'o' || o_orderkey AS fact_id, 'missing_input' AS problem FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE c_nationkey = 7 UNION ALL
    SELECT 'o' || o_orderkey, 'missing_input' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def lineage_problems(spark, folder) -> DataFrame:
    """Orders whose lineage breaks because one nation's fact is missing."""
    facts, inputs = _chain(spark, folder)
    starts = facts.where("metric = 'o'").select("fact_id")
    return of.lineage_problems(starts, facts.where("fact_id <> 'n7'"), inputs)


def _fact_text(kind: str, metric: str, key: str) -> str:
    return f"'={kind}|={metric}|=' || CAST(CAST({key} AS DOUBLE) AS VARCHAR) || '|=Sm3|=table|~|~|=parent|=false'"


@query(
    "facts_digest",
    f"""WITH r AS (SELECT r_regionkey AS k, sha256({_fact_text("measured", "r", "r_regionkey")}) AS c FROM region),
    n AS (SELECT n_nationkey AS k, sha256({_fact_text("derived", "n", "n_nationkey")} || '|' || r.c) AS c FROM nation JOIN r ON r.k = n_regionkey),
    u AS (SELECT c_custkey AS k, sha256({_fact_text("derived", "c", "c_custkey")} || '|' || n.c) AS c FROM customer JOIN n ON n.k = c_nationkey),
    o AS (SELECT o_orderkey AS k, sha256({_fact_text("derived", "o", "o_orderkey")} || '|' || u.c) AS c FROM orders JOIN u ON u.k = o_custkey),
    every AS (SELECT c FROM r UNION ALL SELECT c FROM n UNION ALL SELECT c FROM u UNION ALL SELECT c FROM o)
    SELECT count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {LANES_SQL})) AS content_hash FROM (SELECT sha256(c) AS h FROM every)""",
)
def facts_digest(spark, folder) -> DataFrame:
    """Digest of the facts, independent of their ids; each hash holds those of the inputs."""
    return of.digest(*_chain(spark, folder))


# ---- metrics, leakage, corrections ------------------------------------------------------


@query(
    "metric_leaves",
    r"""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS manifest, regexp_extract(props, '(\d+)', 1) AS k, event_type, event_id FROM events)
    SELECT manifest, 'k' AS key, k AS value, true AS is_number FROM e
    UNION ALL SELECT manifest, 'run.name', event_type || ' {[" of ' || k, false FROM e WHERE event_id % 3 = 0
    UNION ALL SELECT manifest, 'run.parts.' || i || '.size', CAST(i * event_id AS VARCHAR), true FROM e, (SELECT unnest([0, 1]) AS i) WHERE event_id % 6 = 0""",
)
def metric_leaves(spark, folder) -> DataFrame:
    """Q10: JSON documents as (key, value) leaves; a third is nested, a sixth down to four levels."""
    n, k = F.col("event_id"), F.regexp_extract("props", r"(\d+)", 1)
    parts = F.array(*[F.struct((n * i).alias("size")) for i in (0, 1)])
    name = F.concat("event_type", F.lit(' {[" of '), k)
    run = F.when(n % 6 == 0, F.to_json(F.struct(name.alias("name"), parts.alias("parts")))).otherwise(F.to_json(F.struct(name.alias("name"))))
    whole = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "run": '), run, F.lit("}"))
    text = F.when(n % 3 == 0, whole).otherwise(F.col("props"))
    return oa.json_leaves(table(spark, folder, "events").select(n.cast("string").alias("manifest"), text.alias("json")))


@query(
    "metrics_uncovered",
    r"""SELECT CAST(event_id AS VARCHAR) AS manifest, 'k' AS key, 'uncovered' AS problem FROM events WHERE event_type = 'view'
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'j', 'unresolved' FROM events WHERE event_type = 'click'""",
)
def metrics_uncovered(spark, folder) -> DataFrame:
    """Q10: leaves without a metric row, and rows without a leaf."""
    events = table(spark, folder, "events").withColumn("manifest", F.col("event_id").cast("string"))
    leaves = oa.json_leaves(events.select("manifest", F.col("props").alias("json")))
    rows = events.where("event_type <> 'view'").select("manifest", F.lit("k").alias("key")).unionByName(
        events.where("event_type = 'click'").select("manifest", F.lit("j").alias("key"))
    )
    uncovered = oa.uncovered_metrics(rows, leaves).withColumn("problem", F.lit("uncovered"))
    unresolved = oa.unresolved_metrics(rows, leaves).withColumn("problem", F.lit("unresolved"))
    return uncovered.unionByName(unresolved.select(*uncovered.columns))


@query(
    "leakage_audit",
    f"""WITH {DAYS_SQL}, {SPLIT_SQL}, w AS (SELECT '15/9-F-' || (p_partkey % 17) AS well FROM part)
    SELECT 'hold_out_well_in_a_label' AS "check", count(*) AS examined,
      count(*) FILTER (WHERE well IN ('15/9-F-4', '15/9-F-5', '15/9-F-7', '15/9-F-9')) AS problems FROM w
    UNION ALL SELECT 'labelled_report_after_the_boundary', count(*), count(*) FILTER (WHERE CAST(o_orderdate AS DATE) > DATE '2000-01-01') FROM orders
    UNION ALL SELECT 'fitted_day_outside_development', count(*), count(*) FILTER (
      WHERE production_date >= (SELECT development_end FROM split)) FROM days WHERE day_class = 'valid_producing'
    UNION ALL SELECT 'hold_out_well_reaches_an_investigation', count(DISTINCT well),
      count(DISTINCT well) FILTER (WHERE well IN ('15/9-F-4', '15/9-F-5', '15/9-F-7', '15/9-F-9')) FROM w""",
)
def leakage_audit(spark, folder) -> DataFrame:
    """Q1 to Q5: held-out names and dates that reached labels, fits or investigations."""
    wells = table(spark, folder, "part").select(
        F.concat(F.lit("15/9-F-"), (F.col("p_partkey") % 17).cast("string")).alias("well")
    )
    dated = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("report_date"))
    days = entity_days(spark, folder)
    found = oa.all_outcomes(
        oa.labels_from_hold_out(wells),
        oa.labels_after_boundary(dated, "2000-01-01"),
        oa.fitted_outside_development(days.where("day_class = 'valid_producing'"), od.derive_split(days)),
        oa.hold_out_investigated(wells),
    )
    return found.select("check", "examined", "problems")


# Wells of the lost-time events, by user: a held-out one, two of development, and a name nobody can place.
_WELL = """CASE CAST(well AS BIGINT) % 40 % 7 WHEN 0 THEN '15/9-F-4' WHEN 1 THEN 'rig of user ' || well WHEN 2 THEN '15/9-F-12' ELSE '15/9-F-14' END"""
CORRECTIONS_SQL = f"""{BLOCKS_SQL}, m AS (
  SELECT *, CAST(s // 60000000 % 60 AS INTEGER) AS n, CAST(well AS BIGINT) AS u, {_WELL} AS named FROM lost),
corrections AS (
  SELECT event_id, u, n, 'batch ' || (u % 40) AS batch, concat_ws(',', CASE WHEN n % 5 = 0 AND u % 40 >= 20 THEN 'well_mismatch' END,
    CASE WHEN u % 40 % 7 < 2 THEN 'hold_out_well' END, CASE WHEN n % 3 = 0 AND u % 40 >= 20 THEN 'stale_old_value' END,
    CASE WHEN n % 4 = 0 AND u % 40 >= 20 THEN 'hold_out_text' END) AS reasons FROM m)"""


def _corrections(spark, folder) -> tuple[DataFrame, DataFrame]:
    """(events, corrections in batches): in half of the batches only a well can be wrong."""
    user = F.col("well").cast("bigint")
    kind = user % 40 % 7
    named = F.when(kind == 0, "15/9-F-4").when(kind == 1, F.concat(F.lit("rig of user "), "well")).when(kind == 2, "15/9-F-12").otherwise("15/9-F-14")
    events = event_view(spark, folder).withColumns({"user": user, "well": named})
    n = F.when(F.col("user") % 40 >= 20, F.minute("start_time")).otherwise(1)
    corrections = events.select(
        F.concat(F.lit("batch "), (F.col("user") % 40).cast("string")).alias("batch"),
        "event_id",
        F.when(n % 5 == 0, "15/9-F-11").otherwise(F.col("well")).alias("well"),
        F.lit("category").alias("field"),
        F.when(n % 3 == 0, "something else").otherwise(F.col("activity_code")).alias("old_value"),
        F.lit("drilling -- trip").alias("new_value"),
        F.lit("a person").alias("corrected_by"),
        F.lit("2024-02-01T00:00:00Z").alias("corrected_at"),
        F.lit("extractor-v0").alias("extractor_version"),
        F.when(n % 4 == 0, "as in report 15_9_F_4 of that day").alias("note"),
    )
    return events.drop("user"), corrections


@query("correction_admission", f"WITH {CORRECTIONS_SQL} SELECT event_id, reasons FROM corrections")
def correction_admission(spark, folder) -> DataFrame:
    """Why each correction would be refused; a name that cannot be placed fails closed."""
    events, corrections = _corrections(spark, folder)
    return orv.correction_reasons(corrections, events).select("event_id", joined("reasons"))


@query(
    "correction_batches",
    f"""WITH {CORRECTIONS_SQL}
    SELECT batch, count(*) AS rows, count(*) FILTER (WHERE reasons <> '') AS refused_rows, count(*) FILTER (WHERE reasons <> '') = 0 AS admitted
    FROM corrections GROUP BY batch""",
)
def correction_batches(spark, folder) -> DataFrame:
    """Batches are admitted whole or refused whole."""
    events, corrections = _corrections(spark, folder)
    return orv.batch_outcomes(corrections, events).select("batch", "rows", "refused_rows", "admitted")


@query(
    "corrections_stored",
    f"""WITH {CORRECTIONS_SQL}
    SELECT event_id, batch FROM corrections WHERE batch IN (SELECT batch FROM corrections GROUP BY batch HAVING count(*) FILTER (WHERE reasons <> '') = 0)""",
)
def corrections_stored(spark, folder) -> DataFrame:
    """The rows of the admitted batches, as one version of a store gives them back."""
    events, corrections = _corrections(spark, folder)
    kept = store.VersionedStore(spark, f"{shared_folder(spark)}/corrections-{uuid.uuid4().hex}")
    kept.write(orv.admitted_batches(corrections, events), "corrections-v1")
    return kept.read("corrections-v1").select("event_id", "batch")


@query(
    "unplaced_labels",
    f"WITH {BLOCKS_SQL} SELECT DISTINCT event_id || '_lost' AS event_id FROM lost WHERE CAST(well AS BIGINT) % 6 = 0",
)
def unplaced_labels(spark, folder) -> DataFrame:
    """Labelled ids that no event has; each is labelled twice."""
    events = event_view(spark, folder)
    lost = F.when(F.col("well").cast("bigint") % 6 == 0, F.concat("event_id", F.lit("_lost"))).otherwise(F.col("event_id"))
    labels = events.select(lost.alias("event_id"))
    return os_.unplaced_labels(labels.unionAll(labels), events)


@query(
    "fitted_union",
    f"""WITH {DAYS_SQL}, {SPLIT_SQL}, runs AS (
      SELECT well, production_date FROM days WHERE day_class = 'valid_producing' AND CAST(well AS BIGINT) % 3 <> 0
      UNION SELECT well, production_date FROM days WHERE day_class = 'valid_producing' AND choke_size = 60)
    SELECT 'fitted_day_outside_development' AS "check", count(*) AS examined,
      count(*) FILTER (WHERE production_date >= (SELECT development_end FROM split)) AS problems FROM runs""",
)
def fitted_union(spark, folder) -> DataFrame:
    """The dates that two runs were fitted on, each once, against the end of development."""
    days = entity_days(spark, folder)
    valid = days.where("day_class = 'valid_producing'")
    runs = oa.fitted_dates(valid.where(F.col("well").cast("bigint") % 3 != 0), valid.where("choke_size = 60"))
    return oa.fitted_outside_development(runs, od.derive_split(days)).select("check", "examined", "problems")


@query(
    "usable_corrections",
    """SELECT o_orderkey FROM (SELECT o_orderkey, o_orderkey % 4 AS v FROM orders) WHERE v IN (0, 1)""",
)
def usable_corrections(spark, folder) -> DataFrame:
    """Corrections made against an earlier extractor version (one shape is unreadable)."""
    v = F.col("o_orderkey") % 4
    name = F.when(v == 3, "extractor-v02x").otherwise(F.concat(F.lit("extractor-v"), v.cast("string")))
    rows = table(spark, folder, "orders").select("o_orderkey", name.alias("extractor_version"))
    return orv.usable_corrections(rows, "extractor-v2").select("o_orderkey")


@query(
    "proposed_corrections",
    f"WITH {BLOCKS_SQL} SELECT event_id, 'category' AS field, activity_code AS old_value FROM lost UNION ALL "
    f"SELECT event_id, 'cause_text', comment FROM lost",
)
def proposed_corrections(spark, folder) -> DataFrame:
    """R2: corrections proposed with the old value as recorded."""
    events = event_view(spark, folder)
    asked = events.select(
        "event_id",
        F.explode(F.array(F.lit("category"), F.lit("cause_text"))).alias("field"),
        F.lit("x").alias("new_value"),
        F.lit("a person").alias("corrected_by"),
        F.lit(None).cast("string").alias("note"),
    )
    return orv.propose(events, asked).select("event_id", "field", "old_value")


@query(
    "data_quality_set",
    f"""WITH {DAYS_SQL}, {SPLIT_SQL}, {BLOCK_ROWS_SQL},
    groups AS (SELECT {ANY_DIFFERS} AS differs FROM raw_days GROUP BY well, production_date),
    wells AS (SELECT DISTINCT CASE WHEN CAST(well AS BIGINT) % 2 = 0 THEN '15/9-F-' || well ELSE well END AS well FROM days),
    refused AS (SELECT DISTINCT named, fault FROM f WHERE fault IN ({DOCTYPE}, {TORN}, {MISNAMED}, {INCLUDE}, {NOT_XML}))
    SELECT 'zero_is_not_a_reading' AS "check", count(*) AS examined, count(*) FILTER (WHERE downhole_pressure_bar = 0) AS problems FROM days
    UNION ALL SELECT 'dates_present', count(*), count(*) FILTER (WHERE on_stream_hours = 3) FROM days
    UNION ALL SELECT 'names_resolve', count(*), count(*) FILTER (WHERE NOT starts_with(well, '15/9')) FROM wells
    UNION ALL SELECT 'units_convert', count(*), count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem
    UNION ALL SELECT 'duplicates_agree', count(*), count(*) FILTER (WHERE differs) FROM groups
    UNION ALL SELECT 'parse_failures_kept', count(*), count(*) FILTER (WHERE fault = {NOT_XML}) FROM refused
    UNION ALL SELECT 'fitted_day_outside_development', count(*), count(*) FILTER (
      WHERE production_date >= (SELECT development_end FROM split)) FROM days WHERE day_class = 'valid_producing'""",
)
def data_quality_set(spark, folder) -> DataFrame:
    """Q14: names, sentinel zeros, duplicates of the raw rows, dates, units, refused files and leakage, each with faults.

    Half of the names are plain numbers, days of three hours lose their date, and one kind of refusal its reason.
    """
    days = entity_days(spark, folder)
    half = F.when(F.col("well").cast("bigint") % 2 == 0, F.concat(F.lit("15/9-F-"), "well")).otherwise(F.col("well"))
    dated = F.when(~F.coalesce(F.col("on_stream_hours") == 3, F.lit(False)), F.col("production_date"))
    unit = F.when(F.col("l_returnflag") == "R", "barrelful").otherwise("m3")
    volumes = table(spark, folder, "lineitem").select(unit.alias("unit"), F.lit("liquid").alias("fluid"))
    refused = reports.refused(reports.judge(report_texts(spark, folder)))
    refused = refused.withColumn("reason", F.when(~F.endswith("source", F.lit(".txt")), F.col("reason")))
    leaked = oa.fitted_outside_development(days.where("day_class = 'valid_producing'"), od.derive_split(days))
    checks = oa.data_quality_set(days.withColumns({"well": half, "production_date": dated}), raw_days(spark, folder), volumes, refused)
    return oa.all_outcomes(checks, leaked).select("check", "examined", "problems")
