"""Operator 10: secret scan by fixed patterns and by Markov models of characters.

Three kinds of pattern give the base spans. The method adds tokens that look random: two first-order
Markov models over characters, one of random strings and one of ordinary identifiers, are counted
from labelled samples over all documents, and a token is added if its log-likelihood ratio reaches a
bound per character. The models are tables of 128 x 128 log ratios, whatever the input; scoring is
one pass inside the rows without a shuffle. All of it is built-in functions.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds of one start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")
#: What the method looks at: runs of token characters of at least this length.
TOKEN_LENGTH = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{TOKEN_LENGTH},}}"
SAMPLE_LENGTH = 12
SAMPLE = rf"[A-Za-z0-9+/_=-]{{{SAMPLE_LENGTH},}}"
#: Nats per character that a token must be likelier as a random string.
BOUND = 0.5
#: Added to every count of a character; weight of the single characters in a pair's probability.
SMOOTHING, BACKING = 0.5, 500.0
CODES = 128


_PLACED = "array<struct<start:int,end:int,value:string>>"


def _cut_up(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add, per pattern, the array of (start, end, value) of its matches, in code points.

    The pieces between matches and the matches themselves alternate, so places are running lengths.
    Both are columns of their own first: inside the lambdas a pattern would run once per match.
    """
    whole = F.col(text)
    raw = rows.select(
        "*", *[F.regexp_extract_all(whole, F.lit(p), F.lit(0)).alias(f"_m_{name}") for name, p in patterns.items()]
    )
    raw = raw.select("*", *[F.when(F.size(f"_m_{name}") > 0, F.split(whole, p)).alias(f"_p_{name}") for name, p in patterns.items()])
    placed = raw.select("*", *[_walked(F.col(f"_p_{name}"), F.col(f"_m_{name}")).alias(name) for name in patterns])
    return placed.drop(*[f"_{kind}_{name}" for name in patterns for kind in "mp"])


def _walked(pieces: Column, matches: Column) -> Column:
    empty = F.array().cast(_PLACED)
    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("value")))
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["value"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + x["gap"]).alias("start"),
                        (acc["at"] + x["gap"] + F.length(x["value"])).alias("end"),
                        x["value"].alias("value"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(matches) == 0, empty).otherwise(walked)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def assigned_value(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def base_spans(assign: Column, access: Column, hexes: Column) -> Column:
    """(start, kind, end) of the base patterns, by start, then kind; failing matches are dropped."""
    long = F.filter(assign, lambda s: F.length(assigned_value(s["value"])) >= ASSIGN_VALUE)
    return F.sort_array(F.concat(_spans(long, "assign"), _spans(access, "access"), _spans(hexes, "hex")))


def labelled_samples(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, random) from the documents themselves and from hashes.

    Random strings: values of assignments, access keys and hex runs that the base patterns catch, and
    one string a document that is random by construction, the base-64 form of its key's SHA-256.
    Ordinary identifiers: runs of SAMPLE_LENGTH or more token characters in what is left of the text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    values = F.filter(
        F.transform(F.regexp_extract_all(whole, F.lit(ASSIGN), F.lit(0)), assigned_value), lambda v: F.length(v) >= ASSIGN_VALUE
    )
    drawn = F.regexp_replace(F.base64(F.unhex(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256))), "=", "")
    caught = F.concat(
        values,
        F.regexp_extract_all(whole, F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(whole, F.lit(HEX), F.lit(0)),
        F.array(drawn),
    )
    rest = F.regexp_replace(F.regexp_replace(whole, ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    kinds = F.array(
        F.struct(caught.alias("tokens"), F.lit(True).alias("random")),
        F.struct(F.regexp_extract_all(rest, F.lit(SAMPLE), F.lit(0)).alias("tokens"), F.lit(False).alias("random")),
    )
    return docs.select(F.explode(kinds).alias("s")).select(F.explode("s.tokens").alias("token"), F.col("s.random").alias("random"))


def fit(samples: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each pair of ASCII codes, at code * 128 + next.

    `samples` has token and random (boolean); every token counts. The counts, at most two tables of
    128 x 128, are all that leaves Spark. A pair's probability backs off to its second character's, so
    that characters one sort of strings lacks speak against it. Without samples of either sort all ratios are 0.
    """
    codes = F.filter(F.transform(F.split("token", ""), lambda c: F.ascii(c)), lambda c: (c > 0) & (c < CODES))
    coded = samples.where("token is not null and random is not null").select("random", codes.alias("codes"))
    pairs = coded.where(F.size("codes") > 1).select(
        "random",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("codes") - 1), lambda i: F.get("codes", i - 1) * CODES + F.get("codes", i))).alias("pair"),
    )
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for row in pairs.groupBy("random", "pair").count().collect():
        counts[row["random"]][row["pair"]] = row["count"]
    if not counts[True] or not counts[False]:
        return [0.0] * (CODES * CODES)
    used = sorted({c for table in counts.values() for p in table for c in divmod(p, CODES)})
    ratios = [0.0] * (CODES * CODES)
    for random, sign in ((True, 1), (False, -1)):
        single, rows = dict.fromkeys(used, smoothing), dict.fromkeys(used, 0)
        for pair, n in counts[random].items():
            a, b = divmod(pair, CODES)
            single[b] += n
            rows[a] += n
        total = sum(single.values())
        for a in used:
            for b in used:
                p = (counts[random].get(a * CODES + b, 0) + BACKING * single[b] / total) / (rows[a] + BACKING)
                ratios[a * CODES + b] += sign * math.log(p)
    return [round(r, 4) for r in ratios]


def score(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per character pair of a token; above 0 is likelier random."""
    used = sorted({c for p, r in enumerate(ratios) if r for c in divmod(p, CODES)})
    place = F.from_json(F.lit(json.dumps([used.index(c) if c in used else -1 for c in range(CODES)])), "array<int>")
    table = F.from_json(F.lit(json.dumps([ratios[a * CODES + b] for a in used for b in used])), "array<double>")
    places = F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(place, F.ascii(c)), F.lit(-1)))
    steps = F.aggregate(
        places,
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(
            c.alias("last"),
            (acc["sum"] + F.when((acc["last"] >= 0) & (c >= 0), F.get(table, acc["last"] * len(used) + c)).otherwise(F.lit(0.0))).alias("sum"),
        ),
    )
    return steps["sum"] / F.greatest(F.length(token) - 1, F.lit(1))


def find_secrets(docs: DataFrame, ratios: list[float], key: str = "doc_id", text: str = "text", bound: float = BOUND) -> DataFrame:
    """Per row: key, base and spans, both arrays of (start, kind number, end) by start, then kind.

    `spans` holds the base spans and the tokens that the models call random and that touch no base
    span. Null counts as an empty text; places are code points, ends exclusive.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = _cut_up(rows, "_text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "tokens": TOKEN}).select(
        "_key",
        base_spans(F.col("assign"), F.col("access"), F.col("hex")).alias("base"),
        _spans(F.filter("tokens", lambda s: score(s["value"], ratios) >= bound), "markov").alias("likely"),
    )
    free = F.filter("likely", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.select(F.col("_key").alias(key), "base", F.sort_array(F.concat("base", free)).alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
