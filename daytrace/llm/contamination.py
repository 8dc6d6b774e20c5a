"""Operator 9: benchmark passages in training text, by a positional inverted index.

The index holds postings (term, document, position) of the terms that are looked up. A window of a
test item is looked up from its two rarest terms, rare meaning counted over all documents: every
posting of one of them, less its offset in the item, gives an alignment of item and document, and
an alignment stays only where both terms agree on it. For the few that stay the other terms are
compared at their offsets, which gives the exact phrases; proximity matches are windows whose two
rarest terms stand in one document at most `slack` positions away from where the phrase has them.

Counting and look-up stream over all words with the vocabulary of the test items on the other side;
that side is broadcast only if a count shows it is small. Frequent terms produce postings only in
windows that have no rarer ones, and no step brings all postings of a term to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.llm.common import LOWER, UPPER, cut, small

SPAN = 13
#: Everything but digits, letters and what lies beyond ASCII; capital letters are lowered word by word.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text in order, A to Z lowered; none for null."""
    parts = F.filter(F.split(text, _BETWEEN), lambda w: w != "")
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")).otherwise(
        F.transform(parts, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))
    )
    return F.coalesce(lowered, F.array().cast("array<string>"))


def items_of(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item (its id), words, row (a hash naming this id and text); items without words are left out."""
    rows = benchmark.select(F.col(key).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    return rows.withColumn("row", F.xxhash64("item", "words")).dropDuplicates(["row"])


def _tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_row"), words_of(F.col(text)).alias("_words"))
    return rows.select("_key", "_row", F.posexplode("_words").alias("pos", "term"))


def rare_pairs(items: DataFrame, docs: DataFrame, text: str = "text", span: int = SPAN) -> DataFrame:
    """row, start, terms (one or two of term and offset, rarest first) for every window that can occur.

    A window with a term that no document has is left out.
    """
    vocabulary = small(items.select(F.explode("words").alias("term")).distinct())
    stream = docs.select(F.explode(words_of(F.col(text))).alias("term"))
    counts = stream.join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts)
    starts = items.select("row", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - span, F.lit(0)))).alias("start"))
    inside = starts.select("row", "start", F.posexplode(F.slice("words", F.col("start") + 1, span)).alias("place", "term"))
    known = inside.join(small(counts), "term", "left").withColumn("offset", F.col("start") + F.col("place"))
    window = Window.partitionBy("row", "start")
    ranked = known.select(
        "row",
        "start",
        "term",
        "offset",
        F.min(F.coalesce("n", F.lit(0))).over(window).alias("least"),
        F.row_number().over(window.orderBy("n", "term", "offset")).alias("nth"),
    ).where("least > 0 AND nth <= 2")
    return cut(ranked.drop("least"))


def alignments(docs: DataFrame, items: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _row, row, delta: where the rarest terms of some window agree on the item's place."""
    looked_up = small(pairs.select("term", "row", "offset").distinct())
    postings = _tokens(docs, key, text).join(looked_up, "term")
    placed = postings.groupBy("_key", "_row", "row", (F.col("pos") - F.col("offset")).alias("delta")).agg(
        F.min("offset").alias("low"), F.max("offset").alias("high")
    )
    single = items.select(F.col("row").alias("one"), (F.size("words") == 1).alias("single"))
    return placed.join(small(single), F.col("row") == F.col("one")).where("single OR low < high").select("_key", "_row", "row", "delta")


def matched_starts(doc: Column, item: Column, delta: Column, span: int = SPAN) -> Column:
    """Window starts in the item whose words the document has at `delta`."""
    low = F.greatest(-delta, F.lit(0))
    here = F.slice(doc, delta + low + 1, F.size(item) - low)
    last = F.greatest(F.size(item) - span, F.lit(0))
    at = lambda s: F.slice(here, s - low + 1, span) == F.slice(item, s + 1, span)
    whole = F.size(here) >= F.least(F.size(item), F.lit(span))
    return F.when(whole, F.filter(F.sequence(F.least(low, last), last), lambda s: (s >= low) & at(s))).otherwise(
        F.array().cast("array<int>")
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    span: int = SPAN,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Per row of `docs`: key, n_words, n_hit, items (ids with occurring windows), contaminated, and the `carried` columns.

    A window is `span` item words in a row, or all words of a shorter item. Null and empty texts have
    no words; items without words occur nowhere; repeated items count once by id and a null id is not
    listed; rows of `docs` that are equal in key and text have equal results.
    """
    items = cut(items_of(benchmark, item_key))
    found = alignments(docs, items, rare_pairs(items, docs, text, span), key, text)
    named = items.select(F.col("row").alias("_item_row"), "item", "words")
    met = found.join(small(named), F.col("row") == F.col("_item_row"))
    per_doc = met.groupBy("_key", "_row").agg(F.collect_list(F.struct("item", "words", "delta")).alias("_at"))
    per_doc = per_doc.withColumnsRenamed({"_key": "_k", "_row": "_r"})
    rest = F.struct(*[F.col(c) for c in carried if c != text]) if set(carried) - {text} else F.lit(None)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_row"), rest.alias("_rest"))
    joined = rows.join(per_doc, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")), "left")
    kept = [F.col("_text") if c == text else F.col(f"_rest.{c}") for c in carried]
    joined = joined.select("_key", "_at", words_of(F.col("_text")).alias("_words"), *[k.alias(f"_c{i}") for i, k in enumerate(kept)])
    kept = [F.col(f"_c{i}") for i in range(len(kept))]

    def hits(doc: Column, at: Column) -> Column:
        starts = matched_starts(doc, at["words"], at["delta"], span)
        length = F.least(F.size(at["words"]), F.lit(span))
        places = F.flatten(F.transform(starts, lambda s: F.sequence(s + at["delta"], s + at["delta"] + length - 1)))
        return F.struct(at["item"].alias("item"), F.array_distinct(places).alias("places"))

    judged = joined.select(
        "_key",
        *kept,
        F.size("_words").alias("n_words"),
        F.filter(F.transform("_at", lambda at: hits(F.col("_words"), at)), lambda h: F.size(h["places"]) > 0).alias("_hits"),
    )
    n_hit = F.coalesce(F.size(F.array_distinct(F.flatten(F.col("_hits.places")))), F.lit(0))
    n_hit = F.when(F.col("_hits").isNull(), F.lit(0)).otherwise(n_hit).cast("bigint")
    names = F.coalesce(F.array_distinct(F.array_compact(F.col("_hits.item"))), F.array().cast("array<string>"))
    return judged.select(
        F.col("_key").alias(key),
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit.alias("n_hit"),
        names.alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        *[k.alias(c) for k, c in zip(kept, carried, strict=True)],
    )


def proximity(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    slack: int = 5,
    span: int = SPAN,
) -> DataFrame:
    """key, item, start, pos, off: windows whose two rarest terms stand `off` positions from the phrase's distance.

    `off` is at most `slack` either way; 0 includes the exact phrase. `pos` is the place of the rarest
    term. Items of one word have no pair and no row. The range is met on cells of positions, so a
    document's postings of a term are never paired with each other beyond neighbouring cells.
    """
    items = cut(items_of(benchmark, item_key))
    pairs = rare_pairs(items, docs, text, span)
    cell = 2 * slack + 1

    def placed(nth: int) -> DataFrame:
        terms = small(pairs.where(F.col("nth") == nth).select("row", "start", "term", "offset"))
        return _tokens(docs, key, text).join(terms, "term").withColumn("at", F.col("pos") - F.col("offset"))

    rarest = placed(1).withColumn("cell", F.explode(F.array(*[F.floor(F.col("at") / cell) + d for d in (-1, 0, 1)])))
    second = placed(2).select(
        F.col("_key").alias("k2"), F.col("_row").alias("r2"), F.col("row").alias("i2"), F.col("start").alias("s2"),
        F.col("at").alias("at2"), F.floor(F.col("at") / cell).alias("c2"),
    )
    same = (
        F.col("_key").eqNullSafe(F.col("k2")) & (F.col("_row") == F.col("r2")) & (F.col("row") == F.col("i2"))
        & (F.col("start") == F.col("s2")) & (F.col("cell") == F.col("c2"))
    )
    near = rarest.join(second, same).withColumn("off", F.col("at2") - F.col("at")).where(F.abs("off") <= slack)
    named = items.select(F.col("row").alias("_item_row"), "item")
    return near.join(small(named), F.col("row") == F.col("_item_row")).select(
        F.col("_key").alias(key), "item", "start", "pos", "off"
    )
