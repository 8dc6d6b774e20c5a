"""Operator 1: toxicity by a subsequence string kernel, Nyström landmarks and a linear machine.

The kernel counts common subsequences of 2 and 3 characters of two strings, each weighted down by the
span it takes in either (gaps included), and is normalised; inserted characters and gaps shrink it but
do not break it. Strings are the units of a sentence: its words with a start mark, words without the marks
inserted in them, and runs of single letters put together. A text scores by its strongest units.

Fitting takes a bounded sample of labelled texts to the driver as sets of units. Labels name texts, not
words, so the units that speak for toxic texts are found first by how much more often toxic texts hold
them, or one of their character n-grams, and then by the machine of the round before. Landmarks are
picked among those units and among the hardest clean ones; the kernel to the landmarks gives the Nyström
features, on which a squared-hinge support vector machine is solved. The three largest margins of a text
become a probability by a logistic curve fitted on the sampled texts.

Scoring goes over whole texts inside the rows, with the model (some kilobytes) in every task. A unit's
margin is computed once per worker and remembered in a bounded table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytrace.llm.common import held

#: Labelled texts that a fit takes at most: those with the smallest hashes of their keys.
FIT_TEXTS = 3000
#: Landmarks at most, and how many of them may come from units of toxic texts.
LANDMARKS, FROM_TOXIC = 40, 28
#: Characters of a landmark.
MARK = 8
#: Orders of the subsequences and the weight of one step of span.
ORDERS, DECAY = (2, 3), 0.8
#: The normalised kernel is raised to this power (which leaves it a kernel), so that likeness counts when it is close.
POWER = 3
#: Characters of a unit that meet the kernel at once; longer units are read in overlapping windows.
UNIT = 24
#: Clean units that a fit trains on at most; rounds of finding the units that speak for toxic texts.
CLEAN_UNITS, ROUNDS = 6000, 2
#: Units whose margins a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Texts scored together: more of them share more beginnings of units.
TEXTS = 2048
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n")
_MARKS = re.compile(r"[\W_]+")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def units(sentence: str) -> list[str]:
    """Small letters, no marks at ends; a word with marks inside also counts without them; single letters in a row are one unit."""
    out, run = [], []
    for word in sentence.split():
        word = word.strip(_EDGE)
        if len(word) > 1:
            out.append(word)
            if not word.isalnum() and len(inner := _MARKS.sub("", word)) > 2:
                out.append(inner)
        elif word:
            run.append(word)
            continue
        if len(run) > 2:
            out.append("".join(run))
        run = []
    if len(run) > 2:
        out.append("".join(run))
    return out


def text_units(text: str | None) -> set[str]:
    found: set[str] = set()
    for sentence in _SENTENCE.split((text or "").lower()):
        found.update(units(sentence))
    return found


def windows(unit: str) -> list[str]:
    """The unit with its start mark, in overlapping windows if it is long."""
    marked = "^" + unit
    if len(marked) <= UNIT:
        return [marked]
    return [marked[k : k + UNIT] for k in range(0, len(marked) - UNIT // 2, UNIT // 2)]


def _codes(strings: list[str], pad: int) -> np.ndarray:
    width = max(map(len, strings))
    out = np.full((len(strings), width), pad, dtype=np.int32)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<i4")
    return out


def _before(ends: np.ndarray) -> np.ndarray:
    """Along axis 0: the decayed sum of everything before each place."""
    out = np.zeros_like(ends)
    for i in range(1, len(ends)):
        np.add(out[i - 1], ends[i - 1], out=out[i])
        out[i] *= np.float32(DECAY)
    return out


def selves(codes: np.ndarray) -> list[np.ndarray]:
    """Of each order the kernel of every string with itself; rows of characters, padded by -1."""
    columns = np.ascontiguousarray(codes.T)
    same = ((columns[:, None] == columns[None, :]) & (columns >= 0)[:, None]).astype(np.float32)
    ends, found = same * np.float32(DECAY * DECAY), []
    for _ in ORDERS:
        ends = same * _before(_before(ends).swapaxes(0, 1)).swapaxes(0, 1)
        found.append(np.maximum(ends.sum(axis=(0, 1)), 1e-12))
    return found


class Kernel:
    """The normalised kernel of order 2 and 3 between strings and a fixed list of others.

    Strings are met in sorted order: what a shared beginning gives is computed once for all of them.
    """

    def __init__(self, others: list[str]):
        codes = _codes(others, -1)
        self.own = np.sqrt(np.stack(selves(codes)))
        self.alphabet = np.unique(codes[codes >= 0])
        # By character: where the others have it, (place, other); the last row is for characters none has.
        self.equal = np.zeros((len(self.alphabet) + 1, *codes.T.shape), dtype=np.float32)
        for i, c in enumerate(self.alphabet):
            self.equal[i] = (codes == c).T

    def __call__(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(self.own[0])), dtype=np.float32)
        order = sorted(range(len(strings)), key=strings.__getitem__)
        for k in range(0, len(order), 512):
            part = order[k : k + 512]
            codes = _codes([strings[i] for i in part], -1)
            norms = np.sqrt(np.stack(selves(codes)))
            value = self._by_order(codes) / (norms[:, :, None] * self.own[:, None, :])
            out[part] = value.mean(axis=0) ** POWER
        return out

    def _by_order(self, codes: np.ndarray) -> np.ndarray:
        n, width = codes.shape
        decay = np.float32(DECAY)
        place = np.searchsorted(self.alphabet, codes)
        place[(place == len(self.alphabet)) | (self.alphabet[np.minimum(place, len(self.alphabet) - 1)] != codes)] = len(self.alphabet)
        length = (codes >= 0).sum(axis=1)
        shared = np.zeros(n, dtype=np.int64)
        shared[1:] = np.cumprod(codes[1:] == codes[:-1], axis=1).sum(axis=1)
        shape = self.equal.shape[1:]
        # Values are kept over decay ** (place in the string + place in the other), so that sums need no decay.
        along = decay ** np.arange(shape[0], dtype=np.float32)
        single = self.equal * (decay * decay / along)[:, None]
        # One node per distinct beginning: sums of what ended so far, of single characters (a1) and of pairs (a2).
        node = np.zeros(n, dtype=np.int64)
        a1 = a2 = np.zeros((1, *shape), dtype=np.float32)
        sums = np.zeros((2, 1, shape[1]), dtype=np.float32)
        out = np.zeros((2, n, shape[1]), dtype=np.float32)
        for depth in range(width):
            live = np.nonzero(length > depth)[0]
            first = (shared[live] <= depth) | (np.concatenate(([-2], live[:-1])) != live - 1)
            heads = live[first]
            up = node[heads]
            node[live] = np.cumsum(first) - 1
            char = place[heads, depth]
            equal = self.equal[char]
            r1, r2 = a1[up], a2[up]
            pairs, triples = equal * self._before_here(r1), equal * self._before_here(r2)
            r1 += single[char] * np.float32(DECAY**-depth)
            r2 += pairs
            sums = sums[:, up]
            sums[0] += np.matmul(along, pairs) * np.float32(DECAY**depth)
            sums[1] += np.matmul(along, triples) * np.float32(DECAY**depth)
            a1, a2 = r1, r2
            done = live[length[live] == depth + 1]
            out[:, done] = sums[:, node[done]]
        return out

    @staticmethod
    def _before_here(x: np.ndarray) -> np.ndarray:
        """Along the others' places: the sum of everything before each."""
        out = np.zeros_like(x)
        np.cumsum(x[:, :-1], axis=1, out=out[:, 1:])
        return out


class Sample(NamedTuple):
    """A labelled text: its label, its distinct units, and a sketch by which near copies are known."""

    label: int
    units: list[str]
    sketch: list[int] = []


class Model(NamedTuple):
    """Landmark strings, one weight each (the machine's, through the Nyström map), and the curve over the largest margins."""

    landmarks: tuple[str, ...]
    weights: tuple[float, ...]
    offset: float
    curve: tuple[float, ...]


#: What a text without units has as each of its largest margins, and how many there are.
LOWEST, TOP = -0.5, 3
NOTHING = Model(("^",), (0.0,), -1.0, (0.0,) * TOP + (-30.0,))


def margins(model: Model, kernel: Kernel, some: list[str]) -> np.ndarray:
    """The strongest window's margin of each unit."""
    parts = [windows(u) for u in some]
    flat = kernel([w for p in parts for w in p]) @ np.array(model.weights) + model.offset
    ends = np.cumsum([len(p) for p in parts])
    return np.maximum.reduceat(flat, ends - [len(p) for p in parts]) if len(flat) else flat


def largest(values: list[float]) -> list[float]:
    """The TOP largest margins of a text's units, none under LOWEST."""
    return (sorted((max(v, LOWEST) for v in values), reverse=True) + [LOWEST] * TOP)[:TOP]


def probability(model: Model, tops: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(tops @ np.array(model.curve[:-1]) + model.curve[-1], -30, 30)))


def sketch(text: str | None, size: int = 16) -> list[int]:
    """The smallest hashes of three words in a row; near copies share most of them."""
    words = (text or "").lower().split()
    return sorted({crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(len(words) - 2, 0))})[:size]


def sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, texts: int = FIT_TEXTS) -> list[Sample]:
    """(label, units, sketch) of at most `texts` labelled documents, those with the smallest hashes of their keys.

    Keys are chosen from the labels alone and are few enough to broadcast; then only their texts are
    read. A key with labels of both values, or with several texts, counts once (label 0; the first units).
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id"))
    chosen = usable.agg(F.min(label).cast("int").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(texts)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id"))
    kind = rows.schema["_key"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(2).to_pylist()
            found = pa.array([sorted(text_units(t)) for t in some], pa.list_(pa.string()))
            low = pa.array([sketch(t) for t in some], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], found, low], names=["_key", "label", "units", "sketch"])

    split_up = rows.select("_key", "label", "text").mapInArrow(split, f"_key {kind}, label int, units array<string>, sketch array<bigint>")
    once = split_up.groupBy("_key").agg(F.min(F.struct("label", "units", "sketch")).alias("row"))
    return [Sample(*r["row"]) for r in once.collect()]


def _grams(unit: str) -> set[str]:
    marked = "^" + unit
    return {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}


def _unlike(texts: list[Sample]) -> list[list[str]]:
    """The units of the texts that are no near copies of earlier ones, which share half of their sketches."""
    seen: dict[int, list[int]] = {}
    kept = []
    for i, text in enumerate(texts):
        shared = Counter(j for h in text.sketch for j in seen.get(h, ()))
        if not shared or max(shared.values()) * 2 < len(text.sketch):
            kept.append(text.units)
            for h in text.sketch:
                seen.setdefault(h, []).append(i)
    return kept


def _speaking(toxic: list[Sample], clean: list[Sample]) -> dict[str, int]:
    """Units that toxic texts hold far more often, and for texts without one their most telling unit, with counts.

    The latter holds the n-gram that is the strongest sign of toxic texts. Copies of a text count once,
    and a unit or n-gram has to be in three toxic texts and in one of a hundred.
    """
    toxic, clean = _unlike(toxic), _unlike(clean)
    inside, outside = Counter(u for some in toxic for u in some), Counter(u for some in clean for u in some)
    a, b, least = len(toxic) + 1, len(clean) + 1, max(3, len(toxic) // 100)
    odds = lambda n, m: np.log((n + 0.5) / a) - np.log((m + 0.5) / b)
    found = {u: n for u, n in inside.items() if n >= least and odds(n, outside[u]) >= 2.5}
    bare = [some for some in toxic if not any(u in found for u in some)]
    within, without = Counter(), Counter()
    for texts, count in ((toxic, within), (clean, without)):
        for some in texts:
            count.update(set().union(*map(_grams, some)))
    for some in bare:
        weight = lambda u: max((odds(within[g], without[g]) for g in _grams(u) if within[g] >= least), default=-9.0)
        best = max((weight(u), u) for u in some)
        if best[0] >= 2.5:
            found[best[1]] = found.get(best[1], 0) + 1
    return found


def _spread(strings: list[str], wanted: int) -> list[str]:
    """Up to `wanted` strings in the order given, first those that are not much like one already picked."""
    strings = list(dict.fromkeys(strings))
    if len(strings) <= wanted:
        return strings
    alike = Kernel(strings)(strings)
    picked: list[int] = []
    for limit in (0.05, 0.12, 0.25, 0.5, 0.8, 1.1):
        for i in range(len(strings)):
            if len(picked) < wanted and i not in picked and (not picked or alike[i, picked].max() < limit):
                picked.append(i)
    return [strings[i] for i in picked]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4) -> np.ndarray:
    """Weights and offset of the squared-hinge machine, by Newton steps on its active rows."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    ridge = np.eye(x.shape[1]) * penalty * weight.sum()
    ridge[-1, -1] *= 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        a = x[active] * weight[active, None]
        new = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _noisy(unit: str, draw: np.random.Generator) -> str:
    """The unit with a mark between some of its characters."""
    marks = ".-*_ x"
    return "".join(c + (marks[draw.integers(5)] if draw.random() < 0.5 else "") for c in unit)


def fit(sample: list[Sample], seed: int = 7) -> Model:
    """The model of labelled texts. Without texts of both labels every text scores 0.

    The sample may hold empty unit lists; equal samples give equal models, whatever their order.
    """
    sample = sorted(sample)
    some_toxic, some_clean = ([s for s in sample if s.label == y and s.units] for y in (1, 0))
    found = _speaking(some_toxic, some_clean) if some_toxic and some_clean else {}
    toxic, clean = [s.units for s in some_toxic], [s.units for s in some_clean]
    if not found:
        return NOTHING
    draw = np.random.default_rng(seed)
    seen = Counter(u for some in clean for u in some)
    common = sorted(seen, key=lambda u: (-seen[u], u))
    drawn = [common[i] for i in sorted(draw.permutation(len(common))[: CLEAN_UNITS // 2])]
    base = list(dict.fromkeys(common[: CLEAN_UNITS // 2] + drawn))
    held = Counter(u for some in toxic for u in some)
    hard: list[str] = []
    for _ in range(ROUNDS):
        positive = sorted(found, key=lambda u: (-found[u], u))
        negative = [u for u in dict.fromkeys(hard + base) if u not in found]
        marks = _spread([windows(u)[0][:MARK] for u in positive[:400]], FROM_TOXIC)
        marks += _spread([windows(u)[0][:MARK] for u in negative[:400]], LANDMARKS - len(marks))
        marks = list(dict.fromkeys(marks))
        kernel = Kernel(marks)
        values, vectors = np.linalg.eigh(kernel(marks).astype(np.float64))
        root = (vectors / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
        strings = [windows(u)[0] for u in positive + [_noisy(u, draw) for u in positive] + negative]
        y = np.array([1.0] * (2 * len(positive)) + [-1.0] * len(negative))
        share = np.array([min(found[u], 20) * k for k in (1.0, 0.25) for u in positive] + [1.0] * len(negative))
        share[y > 0] *= 0.5 * len(negative) / share[y > 0].sum()
        w = _svm(kernel(strings) @ root, y, share)
        model = Model(tuple(marks), tuple((root @ w[:-1]).tolist()), float(w[-1]), NOTHING.curve)
        # Margins of every unit of the sample: more units that speak, harder clean ones, the curve.
        every = sorted({u for some in toxic + clean for u in some})
        value = dict(zip(every, margins(model, kernel, every).tolist(), strict=True))
        found |= {u: held[u] for u in held if value[u] > 0.3 and seen[u] * len(toxic) < 0.2 * held[u] * len(clean) and u not in found}
        hard = sorted((u for u in seen if u not in found), key=lambda u: (-value[u], u))[: CLEAN_UNITS // 4]
    tops = np.array([largest([value[u] for u in some]) for some in toxic + clean])
    return model._replace(curve=_curve(tops, np.array([1.0] * len(toxic) + [0.0] * len(clean))))


def _curve(tops: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic weights of the largest margins and an offset, by Newton steps with a small ridge."""
    x = np.hstack([tops, np.ones((len(tops), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 0.3 * np.eye(len(w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


class Margins:
    """Margins by a 128-bit hash of the unit, 24 bytes each, in the order of the first half of the hash."""

    def __init__(self) -> None:
        self.marks = np.zeros((0, 2), dtype=np.uint64)
        self.values = np.zeros(0)

    def __len__(self) -> int:
        return len(self.values)

    def find(self, marks: np.ndarray) -> np.ndarray:
        """NaN for what is not known."""
        if not len(self):
            return np.full(len(marks), np.nan)
        at = np.minimum(np.searchsorted(self.marks[:, 0], marks[:, 0]), len(self) - 1)
        return np.where((self.marks[at] == marks).all(axis=1), self.values[at], np.nan)

    def add(self, marks: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(marks[:, 0], kind="stable")
        at = np.searchsorted(self.marks[:, 0], marks[order, 0])
        self.marks = np.insert(self.marks, at, marks[order], axis=0)
        self.values = np.insert(self.values, at, values[order])


def _marks_of(some: list[str]) -> np.ndarray:
    digests = b"".join(xxhash.xxh3_128_digest(u.encode("utf-8", "surrogatepass")) for u in some)
    return np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2)


def _scores(model: Model, texts: list[str | None]) -> np.ndarray:
    tables = held("toxicity")
    if model not in tables:
        tables.clear()
        tables[model] = (Kernel(list(model.landmarks)), Margins())
    kernel, known = tables[model]
    sets = [text_units(t) for t in texts]
    some = list(set().union(*sets))
    marks = _marks_of(some)
    value = known.find(marks)
    new = sorted(np.flatnonzero(np.isnan(value)).tolist(), key=some.__getitem__)
    for k in range(0, len(new), 65536):
        part = new[k : k + 65536]
        value[part] = margins(model, kernel, [some[i] for i in part])
    if len(known) + len(new) > REMEMBERED:
        known = Margins()
        tables[model] = (kernel, known)
    known.add(marks[new], value[new])
    of = dict(zip(some, value.tolist(), strict=True))
    tops = np.array([largest([of[u] for u in s]) for s in sets]).reshape(len(sets), TOP)
    found = probability(model, tops)
    found[[not s for s in sets]] = 0.0
    return found


def _scored(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """All columns of `docs` and `_score`, in one pass without a shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__toxicity", T.DoubleType())])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                found = pa.array(_scores(model, part.column(place).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*batch.schema.names, "__toxicity"])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) and predicted (score >= 0.5) of every whole text; null and empty score 0."""
    scored = _scored(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), model, "_text")
    return scored.select(F.col("_key").alias(key), F.col("__toxicity").alias("score"), (F.col("__toxicity") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores under 0.5, with their columns."""
    return _scored(docs, model, text).where("__toxicity < 0.5").drop("__toxicity")
