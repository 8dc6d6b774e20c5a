"""Day, event and chunk views over the driver tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.operators import days as od
from daytrace.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_days(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item as a day row of its supplier; suppliers repeat days."""
    return _as_days(_line_items(spark, folder))


def _line_items(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("day"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
    )
    return spread(lines)


def _as_days(items: DataFrame, *kept: str) -> DataFrame:
    c = F.col
    depressed = (12 * F.year("day") + F.month("day") + c("l_suppkey")) % 8 == 0
    hours = (
        F.when(c("l_orderkey") % 97 == 0, F.lit(None).cast("double"))
        .when(c("l_quantity") == 1, 25.0)
        .when(c("l_quantity") <= 3, 0.0)
        .when(c("l_quantity") <= 6, 3.0)
        .otherwise(24.0)
    )
    full = (1000 + 5 * (c("l_partkey") % 7)).cast("double") * F.when(depressed, 0.6).otherwise(1.0)
    return (
        items.withColumns({"on_stream_hours": hours, "_full": full, "_depressed": depressed})
        .withColumn("oil_volume_sm3", c("_full") * c("on_stream_hours") / 24.0)
        .select(
            c("l_suppkey").cast("string").alias("well"),
            c("day").alias("production_date"),
            "on_stream_hours",
            "oil_volume_sm3",
            F.when(c("l_partkey") % 53 != 0, c("oil_volume_sm3") * 100.0).alias("gas_volume_sm3"),
            (c("oil_volume_sm3") * (c("l_linenumber") % 4).cast("double") / 8.0).alias("water_volume_sm3"),
            F.when(c("l_orderkey") % 211 == 0, "injecting")
            .when(c("l_orderkey") % 509 == 0, F.lit(None).cast("string"))
            .otherwise("producing")
            .alias("well_status"),
            (50 + 10 * (F.year("day") % 2)).cast("double").alias("choke_size"),
            F.lit("%").alias("choke_unit"),
            F.when(c("l_orderkey") % 13 == 0, 0.0)
            .when(c("_depressed") & (c("l_suppkey") % 3 == 0), (150 + c("l_partkey") % 7).cast("double"))
            .otherwise((200 + c("l_partkey") % 7).cast("double"))
            .alias("downhole_pressure_bar"),
            (30 + c("l_partkey") % 11).cast("double").alias("wellhead_pressure_bar"),
            F.when(c("l_suppkey") % 5 != 0, (2 + c("l_partkey") % 3).cast("double")).alias("choke_dp_bar"),
            F.concat_ws("-", c("l_orderkey"), c("l_linenumber")).alias("source"),
            *kept,
        )
    )


def entity_days(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier-days whose line items agree on every material field, classified.

    The rule of `collapse_duplicates`, with agreement told by a hash of the material fields: the
    aggregate then holds a few numbers per group, runs as a hash aggregate, and combines a busy
    supplier's rows before the shuffle. Days in conflict are what `duplicate_conflicts` returns.
    """
    material = [c for f in fixed.MATERIAL_FIELDS for c in (F.col(f), F.col(f).isNull())]
    kept = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    lines = _line_items(spark, folder)
    derived = _as_days(lines, "l_suppkey", "day", *kept)
    order = F.col("l_orderkey") * 1024 + F.col("l_linenumber")
    hashed = derived.select("l_suppkey", "day", *kept, F.xxhash64(*material).alias("hash"))
    first = hashed.groupBy("l_suppkey", "day").agg(
        *[F.min_by(c, order).alias(c) for c in kept], F.min("hash").alias("low"), F.max("hash").alias("high")
    )
    return od.classify(_as_days(first.where("low = high")))


def order_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Activity dates: urgent orders, each assigned to a supplier number."""
    urgent = table(spark, folder, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select(
        (F.col("o_custkey") % 100 + 1).cast("string").alias("well"),
        F.col("o_orderdate").cast("date").alias("activity_date"),
    ).distinct()


ACTIVITY_SQL = """activity AS (
  SELECT DISTINCT CAST(o_custkey % 100 + 1 AS VARCHAR) AS well, CAST(o_orderdate AS DATE) AS activity_date
  FROM orders WHERE o_orderpriority = '1-URGENT')"""

RAW_DAYS_SQL = """raw_days AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS well, d AS production_date, hours AS on_stream_hours,
         oil AS oil_volume_sm3,
         CASE WHEN l_partkey % 53 <> 0 THEN oil * 100e0 END AS gas_volume_sm3,
         oil * CAST(l_linenumber % 4 AS DOUBLE) / 8e0 AS water_volume_sm3,
         CASE WHEN l_orderkey % 211 = 0 THEN 'injecting' WHEN l_orderkey % 509 = 0 THEN NULL
              ELSE 'producing' END AS well_status,
         CAST(50 + 10 * (year(d) % 2) AS DOUBLE) AS choke_size, '%' AS choke_unit,
         CASE WHEN l_orderkey % 13 = 0 THEN 0e0
              WHEN depressed AND l_suppkey % 3 = 0 THEN CAST(150 + l_partkey % 7 AS DOUBLE)
              ELSE CAST(200 + l_partkey % 7 AS DOUBLE) END AS downhole_pressure_bar,
         CAST(30 + l_partkey % 11 AS DOUBLE) AS wellhead_pressure_bar,
         CASE WHEN l_suppkey % 5 <> 0 THEN CAST(2 + l_partkey % 3 AS DOUBLE) END AS choke_dp_bar,
         l_orderkey || '-' || l_linenumber AS source, l_orderkey, l_linenumber
  FROM (SELECT *, CAST(1000 + 5 * (l_partkey % 7) AS DOUBLE)
               * CASE WHEN depressed THEN 6e-1 ELSE 1e0 END * hours / 24e0 AS oil
        FROM (SELECT *, CAST(l_shipdate AS DATE) AS d,
                (12 * year(l_shipdate) + month(l_shipdate) + l_suppkey) % 8 = 0 AS depressed,
                CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_quantity = 1 THEN 25e0
                     WHEN l_quantity <= 3 THEN 0e0 WHEN l_quantity <= 6 THEN 3e0
                     ELSE 24e0 END AS hours
              FROM lineitem)))"""

DIFFERS = {
    f: f"(min({f}) <> max({f}) OR (count({f}) > 0 AND count({f}) <> count(*)))" for f in fixed.MATERIAL_FIELDS
}
ANY_DIFFERS = " OR ".join(f"coalesce({d}, false)" for d in DIFFERS.values())

DAYS_SQL = (
    RAW_DAYS_SQL
    + f""", agreed AS (SELECT well, production_date FROM raw_days GROUP BY well, production_date HAVING NOT ({ANY_DIFFERS})),
first_days AS (
  SELECT raw_days.* FROM raw_days JOIN agreed USING (well, production_date)
  QUALIFY row_number() OVER (PARTITION BY well, production_date ORDER BY l_orderkey, l_linenumber) = 1
), checked AS (
  SELECT *, (on_stream_hours < 0 OR on_stream_hours > 24) AS f_hours,
         coalesce(oil_volume_sm3 < 0, false) OR coalesce(gas_volume_sm3 < 0, false)
           OR coalesce(water_volume_sm3 < 0, false) AS f_negative,
         coalesce(on_stream_hours = 0 AND oil_volume_sm3 <> 0, false) AS f_zero,
         coalesce(well_status = 'producing' AND on_stream_hours > 0 AND oil_volume_sm3 = 0
           AND coalesce(gas_volume_sm3, 0) = 0 AND coalesce(water_volume_sm3, 0) = 0, false) AS f_dry
  FROM first_days
), days AS (
  SELECT *, CASE WHEN day_class = 'valid_producing' AND on_stream_hours > 0
                 THEN oil_volume_sm3 / on_stream_hours * 24e0 END AS q_24h
  FROM (SELECT *, CASE
      WHEN well_status IS NULL OR on_stream_hours IS NULL
           OR (well_status = 'producing' AND oil_volume_sm3 IS NULL) THEN 'missing'
      WHEN f_hours OR f_negative OR f_zero OR f_dry THEN 'quarantined'
      WHEN well_status <> 'producing' THEN 'non_producing'
      WHEN on_stream_hours = 0 THEN 'downtime'
      WHEN on_stream_hours < 6 THEN 'partial'
      ELSE 'valid_producing' END AS day_class FROM checked))"""
)
