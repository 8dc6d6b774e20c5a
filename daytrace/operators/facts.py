"""Facts, derived facts, lineage and its checks, content digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace.session import checkpointed
from daytrace.sources.store import content_digest

UNITLESS = ("percent", "ratio", "dimensionless")
CONTENT = ("kind", "metric", "value", "unit", "source", "source_locator", "recorded_at", "formula", "combines_units")


def _content_text(*more: Column) -> Column:
    parts = []
    for name in CONTENT:
        c = F.col(name)
        text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))) if name == "source_locator" else c.cast("string")
        parts.append(F.coalesce(F.concat(F.lit("="), text), F.lit("~")))
    return F.concat_ws("|", *parts, *more)


def _id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(text, 256), F.lit(16)))


def record(
    rows: DataFrame,
    metric: str | Column,
    value: Column,
    unit: str | Column,
    source: str,
    locator: dict[str, Column] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Measured facts, one per row. The id is a hash of the content, so it needs no counter.

    `keep` names columns of `rows` to carry along.
    """
    pairs = [x for k, v in (locator or {}).items() for x in (F.lit(k), v.cast("string"))]
    located = F.create_map(*pairs) if pairs else F.create_map()
    body = rows.select(
        *keep,
        F.lit("measured").alias("kind"),
        (metric if isinstance(metric, Column) else F.lit(metric)).alias("metric"),
        value.cast("double").alias("value"),
        (unit if isinstance(unit, Column) else F.lit(unit)).alias("unit"),
        F.lit(source).alias("source"),
        located.cast("map<string,string>").alias("source_locator"),
        F.lit(None).cast("date").alias("recorded_at"),
        F.lit(None).cast("string").alias("formula"),
        F.lit(None).cast("boolean").alias("combines_units"),
    )
    return body.select(*keep, _id("fact", _content_text()).alias("fact_id"), *CONTENT)


def derive(
    facts: DataFrame,
    links: DataFrame,
    metric: str,
    unit: str,
    formula: str,
    compute: Callable[[Column], Column],
    combines_units: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Derived facts and their inputs. `links` holds (derivation, position, input_id).

    `compute` maps the array of input values, in position order, to the value. An input that is
    no fact fails the job.
    """
    known = facts.select(F.col("fact_id").alias("input_id"), "value", F.lit(True).alias("_known"))
    joined = links.join(known, "input_id", "left").withColumn(
        "input_id",
        F.when(
            F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no such input fact: "), F.col("input_id"))).cast("string")
        ).otherwise(F.col("input_id")),
    )
    # the inputs of one formula, a handful per derivation
    gathered = joined.groupBy("derivation").agg(
        F.array_sort(F.collect_list(F.struct("position", "input_id", "value"))).alias("i")
    )
    none = F.lit(None)
    body = gathered.select(
        "i",
        F.lit("derived").alias("kind"),
        F.lit(metric).alias("metric"),
        compute(F.transform("i", lambda x: x["value"])).alias("value"),
        F.lit(unit).alias("unit"),
        none.cast("string").alias("source"),
        none.cast("map<string,string>").alias("source_locator"),
        none.cast("date").alias("recorded_at"),
        F.lit(formula).alias("formula"),
        F.lit(combines_units).alias("combines_units"),
    )
    inputs = F.array_join(F.array_sort(F.transform("i", lambda x: x["input_id"])), ",")
    keyed = body.select(_id("derived", _content_text(inputs)).alias("fact_id"), "i", *CONTENT)
    edges = keyed.select("fact_id", F.explode("i").alias("x")).select("fact_id", F.col("x.input_id").alias("input_id"))
    return keyed.drop("i"), edges


def episode_facts(episodes: DataFrame, oil_price: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, inputs, citations): three facts per episode, and a value only with a stated price.

    The three facts of an episode come from one pass over its row.
    """
    spark = episodes.sparkSession
    shortfall = F.col("cumulative_rate_shortfall_sm3")
    measured = (
        # deferred plus shortfall; named for what it holds
        ("actual_volume_fact_id", "episode_actual_volume", F.col("deferred_volume_sm3") + shortfall, "Sm3"),
        ("expected_volume_fact_id", "episode_reference_rate", F.col("reference_rate_sm3_per_day"), "Sm3/d"),
        ("shortfall_fact_id", "episode_cumulative_rate_shortfall", shortfall, "Sm3"),
    )
    entries = [
        F.struct(F.lit(field).alias("field"), F.lit(metric).alias("metric"), value.alias("value"), F.lit(unit).alias("unit"))
        for field, metric, value, unit in measured
    ]
    long = episodes.select("well", "onset", F.explode(F.array(*entries)).alias("e")).select("well", "onset", "e.*")
    rows = record(
        long, F.col("metric"), F.col("value"), F.col("unit"), "episode detector",
        {"well": F.col("well"), "onset": F.col("onset")}, keep=("well", "onset", "field"),
    )
    facts = rows.drop("well", "onset", "field")
    cited = rows.select("well", "onset", "field", "fact_id")
    if oil_price is None:
        return facts, spark.createDataFrame([], "fact_id string, input_id string"), cited
    price = record(
        spark.range(1), "assumed_oil_price", F.lit(float(oil_price)), "USD/Sm3", "stated assumption",
        {"basis": F.lit("documented assumption, not a market quote")},
    )
    base = facts.where("metric = 'episode_cumulative_rate_shortfall'").select("fact_id")
    price_id = price.select("fact_id").scalar()
    links = base.select(
        F.col("fact_id").alias("derivation"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("position"), F.col("fact_id").alias("input_id")),
                F.struct(F.lit(1).alias("position"), price_id.alias("input_id")),
            )
        ).alias("x"),
    ).select("derivation", "x.*")
    everything = facts.unionByName(price)
    values, edges = derive(
        everything, links, "estimated_gross_value_shortfall", "USD",
        "cumulative_rate_shortfall * assumed_oil_price", lambda v: v[0] * v[1], combines_units=True,
    )
    owner = cited.where("field = 'shortfall_fact_id'").select("well", "onset", F.col("fact_id").alias("input_id"))
    value_cites = edges.join(owner, "input_id").select(
        "well", "onset", F.lit("shortfall_value_fact_id").alias("field"), "fact_id"
    )
    return everything.unionByName(values), edges, cited.unionByName(value_cites)


def lineage(starts: DataFrame, inputs: DataFrame) -> DataFrame:
    """Every (root_id, fact_id) reachable from the starts, the start included.

    One join per level of the graph, over the newly found pairs only; the pairs found so far are
    checkpointed, so a lost executor repeats a level and not the walk. A cycle ends the walk
    because no pair is new.
    """
    found = starts.select(F.col("fact_id").alias("root_id"), "fact_id").distinct()
    frontier = found
    while True:
        step = (
            frontier.join(inputs, "fact_id")
            .select("root_id", F.col("input_id").alias("fact_id"))
            .distinct()
            .join(found, ["root_id", "fact_id"], "left_anti")
        )
        frontier = checkpointed(step)
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def roots(lineages: DataFrame, facts: DataFrame) -> DataFrame:
    """The measurements behind each root id."""
    return lineages.join(facts.where("kind = 'measured'").select("fact_id"), "fact_id")


def lineage_problems(starts: DataFrame, facts: DataFrame, inputs: DataFrame) -> DataFrame:
    """(fact_id, problem) for every start whose lineage does not hold."""
    asked = starts.select("fact_id").distinct()
    absent = asked.join(facts, "fact_id", "left_anti").select("fact_id", F.lit("no_such_fact").alias("problem"))
    walked = lineage(asked.join(facts.select("fact_id"), "fact_id", "left_semi"), inputs)
    steps = walked.join(facts.select("fact_id", "kind"), "fact_id", "left").groupBy("root_id").agg(
        F.bool_or(F.coalesce(F.col("kind") == "measured", F.lit(False))).alias("measured"),
        F.bool_or(F.col("kind").isNull()).alias("broken"),
    )
    broken = steps.select(
        F.col("root_id").alias("fact_id"),
        F.when(F.col("broken"), "missing_input").when(~F.col("measured"), "no_measurement").alias("problem"),
    ).where(F.col("problem").isNotNull())
    units = (
        inputs.join(asked, "fact_id", "left_semi")
        .join(facts.select(F.col("fact_id").alias("input_id"), F.col("unit").alias("_unit")), "input_id")
        .groupBy("fact_id")
        .agg(F.min("_unit").alias("_low"), F.max("_unit").alias("_high"))
        .where("_low <> _high")
    )
    mixed = (
        facts.where(~F.coalesce("combines_units", F.lit(False)) & ~F.col("unit").isin(*UNITLESS))
        .join(units, "fact_id", "left_semi")
        .select("fact_id", F.lit("mixed_units").alias("problem"))
    )
    return absent.unionByName(broken).unionByName(mixed)


def canonical_content(facts: DataFrame, inputs: DataFrame) -> DataFrame:
    """(fact_id, content): a hash of what a fact says and of what its inputs say, without any id.

    One round per level of the graph; facts whose inputs never resolve are left out.
    """
    done = facts.where("kind = 'measured'").select("fact_id", F.sha2(_content_text(), 256).alias("content"))
    open_facts = facts.where("kind = 'derived'")
    while True:
        ready = (
            inputs.join(open_facts.select("fact_id"), "fact_id", "left_semi")
            .join(done.withColumnsRenamed({"fact_id": "input_id"}), "input_id", "left")
            .groupBy("fact_id")
            .agg(
                F.count_if(F.col("content").isNull()).alias("_waiting"),
                F.array_join(F.array_sort(F.collect_list("content")), ",").alias("_inputs"),
            )
            .where("_waiting = 0")
        )
        new = checkpointed(
            open_facts.join(ready, "fact_id").select("fact_id", F.sha2(_content_text(F.col("_inputs")), 256).alias("content"))
        )
        if new.isEmpty():
            return done
        done = done.unionByName(new)
        open_facts = open_facts.join(new, "fact_id", "left_anti")


def digest(facts: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row: count and digest of the facts, the same whatever ids they were given."""
    return content_digest(canonical_content(facts, inputs), F.col("content"))
