"""Audits over the driver's tables with planted faults, each counted by SQL on its own.

Names, money, corrections, labels and runs are views of the tables in which some rows break a rule;
what breaks is decided by numbers that both engines compute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.bindings.day_queries import SPLIT_SQL
from daytrace.bindings.event_queries import BLOCKS_SQL, event_view
from daytrace.bindings.registry import joined, query
from daytrace.bindings.views import ACTIVITY_SQL, DAYS_SQL, entity_days, order_activity, table
from daytrace.operators import audits as oa
from daytrace.operators import days as od
from daytrace.operators import labels as ol
from daytrace.operators import review as orv
from daytrace.operators import sampling as os_

_HELD = "('15/9-F-4', '15/9-F-5', '15/9-F-7', '15/9-F-9')"


def _outcomes(*parts: DataFrame) -> DataFrame:
    return oa.all_outcomes(*parts).select("check", "examined", "problems", "passed", "vacuous")


@query(
    "hold_out_audits",
    f"""WITH w AS (SELECT '15/9-F-' || (p_partkey % 17) AS well, p_partkey FROM part), n(well) AS (SELECT r_name FROM region),
    f AS (SELECT CASE WHEN page_id % 13 = 0 THEN 'labels Hold-Out ' ELSE 'labels ' END || page_id AS name FROM pages),
    x AS (SELECT p_partkey % 29 = 0 AS planted FROM part),
    counted AS (
      SELECT 'correction_from_the_hold_out' AS "check", count(*) AS examined, count(*) FILTER (WHERE well IN {_HELD} AND p_partkey % 23 <> 0) AS problems FROM w
      UNION ALL SELECT 'hold_out_label_file_exists', count(*), count(*) FILTER (WHERE contains(name, 'Hold')) FROM f
      UNION ALL SELECT 'hold_out_contained', (SELECT count(*) FROM w) + (SELECT count(*) FROM n),
        (SELECT count(*) FROM w WHERE well IN {_HELD}) + (SELECT count(*) FROM n)
      UNION ALL SELECT 'no_hold_out_in_text', count(*), count(*) FILTER (WHERE planted) FROM x)
    SELECT *, problems = 0 AS passed, problems = 0 AND examined = 0 AS vacuous FROM counted""",
)
def hold_out_audits(spark, folder) -> DataFrame:
    """Q4, Q5, Q6, Q12: held-out names in corrections, label files, registers and texts.

    A name that nobody can place (a region's) counts as held out, one without a well does not.
    """
    part = table(spark, folder, "part")
    wells = part.select("p_partkey", F.concat(F.lit("15/9-F-"), (F.col("p_partkey") % 17).cast("string")).alias("well"))
    corrections = wells.withColumn("well", F.when(F.col("p_partkey") % 23 != 0, F.col("well")))
    mark = F.when(F.col("page_id") % 13 == 0, "labels Hold-Out ").otherwise("labels ")
    named = table(spark, folder, "pages").select(F.concat(mark, "page_id").alias("file_name"))
    texts = part.select(F.when(F.col("p_partkey") % 29 == 0, "as in F-4, see below").otherwise("as in F-41, see F-1").alias("text"))
    return _outcomes(
        oa.corrections_from_hold_out(corrections),
        oa.hold_out_label_file(named),
        oa.hold_out_contained(wells, table(spark, folder, "region").select(F.col("r_name").alias("well"))),
        oa.no_hold_out_in_text(texts),
    )


@query(
    "money_audits",
    """WITH o AS (
      SELECT CASE WHEN k % 4 <> 0 THEN v END AS amount, CASE WHEN k % 4 = 0 AND k % 8 <> 0 THEN NULL WHEN k % 9 = 0 THEN 'a guess' ELSE 'stated assumption: 1' END AS assumption,
        CASE WHEN k % 11 <> 0 THEN k % 10 END AS rate FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders)),
    c AS (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS amount, c_custkey AS k FROM customer),
    counted AS (
      SELECT 'currency_disclosed' AS "check", count(amount) AS examined, count(*) FILTER (WHERE (amount IS NULL) <> (assumption IS NULL)
        OR amount IS NOT NULL AND (coalesce(rate, 0) <= 0 OR NOT contains(assumption, 'stated assumption'))) AS problems FROM o
      UNION ALL SELECT 'money_sound', count(*), count(*) FILTER (WHERE CASE WHEN amount IS NULL THEN k % 14 = 0 ELSE amount < 0 OR k % 10 = 0 END) FROM c)
    SELECT *, problems = 0 AS passed, problems = 0 AND examined = 0 AS vacuous FROM counted""",
)
def money_audits(spark, folder) -> DataFrame:
    """Q6, Q12: figures in money need a stated assumption, a rate and, where missing, a reason."""
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        F.when(k % 4 != 0, F.col("o_totalprice")).alias("cost_equivalent_usd"),
        F.when((k % 4 == 0) & (k % 8 != 0), F.lit(None).cast("string")).when(k % 9 == 0, "a guess").otherwise("stated assumption: 1").alias("cost_assumption"),
        F.when(k % 11 != 0, (k % 10).cast("double")).alias("day_rate_usd"),
    )
    c = F.col("c_custkey")
    tiles = table(spark, folder, "customer").select(
        F.when(c % 7 != 0, F.col("c_acctbal")).alias("amount"),
        F.when(c % 10 != 0, "stated").otherwise("").alias("assumption"),
        F.when(c % 14 != 0, "no price given").alias("reason"),
    )
    return _outcomes(oa.currency_disclosed(rows), oa.money_sound(tiles))


_RULED = f"""ruled AS (
  SELECT CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'rule ' || doc_id % 4 END AS applied_rule, doc_id % 3 = 0 AS spanned,
    {list(fixed.CAUSES)}[doc_id % {len(fixed.CAUSES)} + 1] AS cause,
    CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN NULL ELSE 'could be ' || {list(fixed.CAUSES)}[doc_id * 3 % {len(fixed.CAUSES)} + 1] END AS note
  FROM labels)"""


def _ruled(spark, folder) -> DataFrame:
    k = F.col("doc_id")
    causes = F.array(*[F.lit(c) for c in fixed.CAUSES])
    pick = lambda n: F.get(causes, (n % len(fixed.CAUSES)).cast("int"))
    return table(spark, folder, "labels").select(
        F.when(k % 5 != 0, F.concat(F.lit("rule "), (k % 4).cast("string"))).alias("applied_rule"),
        F.when(k % 3 == 0, "span").alias("evidence_span"),
        pick(k).alias("cause"),
        F.when(k % 7 == 0, "").when(k % 7 > 1, F.concat(F.lit("could be "), pick(k * 3))).alias("cause_notes"),
    )


@query("label_rules", f"WITH {_RULED} SELECT coalesce(applied_rule, 'None') AS applied_rule, count(*) AS rows FROM ruled GROUP BY ALL")
def label_rules(spark, folder) -> DataFrame:
    """Labels per rule that was applied."""
    return ol.rule_counts(_ruled(spark, folder))


@query(
    "label_notes",
    f"""WITH {_RULED}
    SELECT count(*) FILTER (WHERE coalesce(note, '') <> '') AS rows_with_a_note,
      count(*) FILTER (WHERE EXISTS (SELECT 1 FROM (SELECT unnest({list(fixed.CAUSES)}) AS c) WHERE contains(note, c) AND c <> cause)) AS rows_naming_another_label,
      count(*) FILTER (WHERE spanned) AS spans_cited FROM ruled""",
)
def label_notes(spark, folder) -> DataFrame:
    """Notes, and those that name another class than the label's."""
    return ol.note_counts(_ruled(spark, folder))
