"""Operator 12: how filters interact when they are applied one after another.

Each filter has a relation of failing ids, stored on its own in the shared folder. Left-semi and
left-anti joins with one relation after another deal the failing ids to groups of equal fate (the set of
filters that they fail); every id goes through one of the two joins, so none is lost. For every order of
the filters, left-anti joins of the groups with what an earlier filter of the order removes give the
removals of each step, left-semi joins its redundancies, and both with labels the label losses. The
groups are at most 2 ** filters, so the orders cost the same however many ids there are.

An id is (key, SHA-256 of the text): rows of equal key and text fail the same filters, and rows of
equal key with different texts are told apart. Rows are summed by id, part and labels before any
join, so a row that is repeated a million times is one row in each.

Defined cases: a null text is empty; a null part is the empty text; a null key is not smaller than any key
nor has it smaller ones, and no label; several labels of a key count if any of them is 1; an
empty table has no part and gives no rows; further columns of either table are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.llm.common import cut, new_folder

#: The id of a row.
ID = ["key", "digest"]
#: Orders are all permutations, so their number is bounded by this many filters.
MOST_FILTERS = 6
#: A group name that no id has.
ANY = "*"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def copies(rows: DataFrame) -> DataFrame:
    """Ids (key, digest) whose text a smaller key has: all but the smallest of each text."""
    known = rows.where(F.col("key").isNotNull()).select(*ID).distinct()
    return known.join(known.groupBy("digest").agg(F.min("key").alias("key")), ID, "left_anti")


def store_relations(failing: DataFrame) -> Callable[[str], DataFrame]:
    """The stored relation of a filter, by its name, from rows (filter, key, digest); each id once."""
    spark = failing.sparkSession
    path = new_folder(spark, "failing")
    every = failing.select("filter", *ID).distinct()
    every.write.partitionBy("filter").parquet(path)
    stored = spark.read.schema(every.schema).parquet(path)
    return lambda name: stored.where(F.col("filter") == name).select(*ID)


def _meets(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by id, where a null key equals a null key."""
    other = right.select(F.col("key").alias("_key"), F.col("digest").alias("_digest"))
    return left.join(other, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), how)


def fates(relation: Callable[[str], DataFrame], names: Sequence[str]) -> DataFrame:
    """Every failing id once, with `fails`: the names of its filters in the order given, put together.

    One semi and one anti join a filter; each level is cut, so no plan doubles.
    """
    dealt = cut(reduce(DataFrame.union, [relation(n) for n in names]).distinct().withColumn("fails", F.lit("")))
    for name in names:
        hit = _meets(dealt, relation(name), "left_semi").withColumn("fails", F.concat("fails", F.lit(name)))
        dealt = cut(hit.unionByName(_meets(dealt, relation(name), "left_anti")))
    return dealt


def steps_of(spark, names: list[str]) -> DataFrame:
    """Every order of the filters, a row per step: filter_order, step, filter."""
    if len(names) > MOST_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"at most {MOST_FILTERS} filters, named by one letter each")
    rows = [("".join(p), k + 1, f) for p in permutations(names) for k, f in enumerate(p)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string")


def effects(steps: DataFrame, names: list[str]) -> DataFrame:
    """What each step does to the ids of each group, as rows (filter_order, step, filter, fails, effect).

    'removed': the filter fails them and no earlier one of the order did; 'redundant': an earlier one did;
    'unique': they fail this filter only; 'kept': no filter up to this step fails them. A row with the
    group ANY and the effect 'none' stands for each step.
    """
    groups = ["".join(g) for n in range(len(names) + 1) for g in combinations(names, n)]
    paired = steps.withColumn("fails", F.explode(F.array(*[F.lit(g) for g in groups])))
    meeting = paired.where(F.contains("fails", "filter"))
    gone = meeting.groupBy("filter_order", "fails").agg(F.min("step").alias("_at"))
    same = (F.col("l.filter_order") == F.col("g.filter_order")) & (F.col("l.fails") == F.col("g.fails"))
    earlier, so_far = same & (F.col("_at") < F.col("step")), same & (F.col("_at") <= F.col("step"))

    def joined(left: DataFrame, on: Column, how: str, effect: str) -> DataFrame:
        return left.alias("l").join(gone.alias("g"), on, how).withColumn("effect", F.lit(effect))

    return reduce(
        DataFrame.unionByName,
        [
            joined(meeting, earlier, "left_anti", "removed"),
            joined(meeting, earlier, "left_semi", "redundant"),
            joined(paired, so_far, "left_anti", "kept"),
            meeting.where(F.col("fails") == F.col("filter")).withColumn("effect", F.lit("unique")),
            steps.withColumns({"fails": F.lit(ANY), "effect": F.lit("none")}),
        ],
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    conditions: Mapping[str, Column],
    copied: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    part: str = "source",
    good: str = "quality",
    bad: str = "toxic",
) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `conditions` are failure conditions over column `text` (null already made empty), named by one letter;
    `copied` names the filter that texts of a smaller key fail. Counts are of rows of the part.
    shapley is what the step's filter removes, summed over all orders.
    """
    whole = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
    )
    told = F.array_join(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]), "")
    # The text is read once; what goes on is its digest and the filters that it fails.
    judged = whole.select("key", F.unhex(F.sha2("text", 256)).alias("digest"), "part", told.alias("_told"))
    summed = cut(judged.groupBy("key", "digest", "part", "_told").agg(F.count("*").alias("rows")))
    failing = summed.select(*ID, F.explode(F.split("_told", "")).alias("filter")).where("filter <> ''")
    if copied is not None:
        failing = failing.unionByName(copies(summed).withColumn("filter", F.lit(copied)))
    names = sorted([*conditions, *([copied] if copied else [])])
    fate = fates(store_relations(failing), names).select(F.col("key").alias("_key"), F.col("digest").alias("_digest"), "fails")

    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(
        F.max((F.col(good) == 1).cast("int")).alias("good"), F.max((F.col(bad) == 1).cast("int")).alias("bad")
    )
    one = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    labelled = summed.join(said, F.col("key") == F.col("_k"), "left").select(*ID, "part", "rows", one("good"), one("bad"))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest"))
    counts = labelled.join(fate, same, "left").groupBy("part", F.coalesce("fails", F.lit("")).alias("fails")).agg(
        F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("good")).alias("n_good"), F.sum(F.col("rows") * F.col("bad")).alias("n_bad")
    )
    groups = cut(counts)
    zero = groups.select("part").distinct().select("part", F.lit(ANY).alias("fails"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "n_good", "n_bad")])
    # Orders x steps x groups: a number that the number of filters bounds, whatever the tables hold.
    found = F.broadcast(cut(effects(steps_of(docs.sparkSession, names), names)))
    of = lambda effect, c: F.sum(F.when(F.col("effect") == effect, F.col(c)).otherwise(0)).cast("bigint")
    counted = groups.unionByName(zero).join(found, "fails").groupBy("part", "filter_order", "step", "filter").agg(
        of("kept", "n").alias("kept"),
        of("removed", "n").alias("removed"),
        of("redundant", "n").alias("redundant"),
        of("unique", "n").alias("unique_fails"),
        of("removed", "n_good").alias("good_lost"),
        of("removed", "n_bad").alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")
