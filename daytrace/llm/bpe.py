"""Operator 3: byte-level BPE by monoid tree reduction.

Texts are cut by the pre-token pattern, and every match is encoded on its own. The encoding of a match
is a reduction over a binary tree: its bytes are halved until a part is a token (or one byte), and the
encodings of neighbours are joined. A join re-encodes a window around the boundary, one token from
either side at first, and lets the window grow on a side until the token outside it and the first
token inside provably stay apart.

The proof: a token sequence is the encoding of its bytes exactly if every two neighbours are, taken
alone, encoded as themselves, since merges are chosen by rank and the first merge that could cross a
boundary between two tokens would already cross it in their pair. So a window is final once the pair
at each of its edges is stable. For that, every token has to encode to itself by merges; tokens of
a vocabulary for which that fails are found once per vocabulary and never used as shortcuts.

Decoding is the same tree without the windows: bytes of halves are concatenated upwards.

A match of n bytes is joined in about log n levels, so one match of a megabyte needs no quadratic time.
Encoded matches are remembered in a bounded table per Python worker. Ranks come from a file named by
parameter, are read on the driver and reach tasks as one broadcast of known size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytrace.llm.common import held

#: Entries after which the tables of encoded pairs and parts, and of encoded matches, start anew.
REMEMBERED = 200_000
WORDS = 1_000_000
#: Bytes up to which the encodings of parts are remembered too.
PART = 8
#: Bytes up to which merging scans all neighbours; longer parts use a heap.
SCANNED = 32
NONE = 1 << 62
#: Tokens concatenated at a leaf of the decoding tree.
LEAF = 256
#: Rows of a text batch encoded before a result batch is passed on.
ROWS = 128


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines: base-64 token, blank, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes and decodes with one table of ranks. All 256 single bytes have to be tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no rank, {missing[0]} among them")
        self.ranks = ranks
        self.matches = regex.compile(pattern).findall
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.parts: dict[bytes, list[int]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.whole: dict[bytes, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The definition: of all neighbours that form a token merge the lowest rank, leftmost first, until none does."""
        n = len(data)
        ranks = self.ranks
        if n <= SCANNED:
            return self._scanned([data[i : i + 1] for i in range(n)])
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = nxt[i]
            if j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                if (r := ranks.get(data[i : end[nxt[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[j]]))
            if (p := prev[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def _scanned(self, parts: list[bytes]) -> list[int]:
        """The same for a few bytes, looking at all neighbours each time."""
        get = self.ranks.get
        near = [get(parts[i] + parts[i + 1], NONE) for i in range(len(parts) - 1)]
        while near:
            low = min(near)
            if low == NONE:
                break
            i = near.index(low)
            parts[i] += parts.pop(i + 1)
            near.pop(i)
            if i < len(near):
                near[i] = get(parts[i] + parts[i + 1], NONE)
            if i:
                near[i - 1] = get(parts[i - 1] + parts[i], NONE)
        return [self.ranks[p] for p in parts]

    def pair(self, left: int, right: int) -> tuple[int, ...]:
        """What the bytes of two tokens encode as."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = tuple(self.merged(self.bytes_of[left] + self.bytes_of[right]))
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens, taken alone, encode as themselves."""
        return self.pair(left, right) == (left, right)

    def is_whole(self, data: bytes) -> bool:
        """Whether a token's bytes merge to the token itself."""
        known = self.whole.get(data)
        if known is None:
            known = self.whole[data] = self.merged(data) == [self.ranks[data]]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings in a row."""
        if not left or not right:
            return left or right
        window = self.pair(left[-1], right[0])
        if window == (left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            if i > 1 or j > 1:
                data = b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j]))
                window = self.merged(data)
            left_ok = i == len(left) or self.apart(left[-i - 1], window[0])
            right_ok = j == len(right) or self.apart(window[-1], right[j])
            if left_ok and right_ok:
                return [*left[: len(left) - i], *window, *right[j:]]
            i, j = i if left_ok else 2 * i, j if right_ok else 2 * j

    def tree(self, data: bytes) -> list[int]:
        if len(data) == 1 or (data in self.ranks and self.is_whole(data)):
            return [self.ranks[data]]
        half = len(data) // 2
        if len(data) > PART:
            return self.join(self.tree(data[:half]), self.tree(data[half:]))
        known = self.parts.get(data)
        if known is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            known = self.parts[data] = self.join(self.tree(data[:half]), self.tree(data[half:]))
        return known

    def match(self, word: str) -> tuple[int, ...]:
        """One match; one that is a token is that token, whatever its merges say."""
        data = word.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(data)
        return (rank,) if rank is not None else tuple(self.tree(data))

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for word in self.matches(text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= WORDS:
                    known.clear()
                ids = self.match(word)
                if len(word) <= 64:
                    known[word] = ids
            out += ids
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The worker's encoder for a broadcast table of ranks; what it remembers serves later tasks."""
    key = (id(ranks), pattern)  # the encoder holds the table, so its id stays taken
    encoders = held("bpe")
    if key not in encoders:
        if len(encoders) >= 2:
            encoders.pop(next(iter(encoders)))
        encoders[key] = Encoder(ranks, pattern)
    return encoders[key]


def _mapped(df: DataFrame, source: str, added: dict[str, T.DataType], ranks_path: str, pattern: str, work) -> DataFrame:
    """`df` with columns that `work` makes of an encoder and a value of `source`; a column so named is replaced."""
    rest = [c for c in df.columns if c not in added]
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(n, k) for n, k in added.items()])
    kinds = [pa.list_(pa.int32()) if isinstance(k, T.ArrayType) else pa.binary() for k in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared.value, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                made = list(zip(*(work(own, v) for v in part.column(0).to_pylist()), strict=True))
                columns = [pa.array(m, kind) for m, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=[*rest, *added])

    return df.select(F.col(source).alias("__bpe_source"), *rest).mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """`df` with the token ids of every whole text, without special tokens; null encodes as empty.

    A column named `into` is replaced.
    """
    work = lambda own, text: (own.encode(text or ""),)
    return _mapped(df, text, {into: T.ArrayType(T.IntegerType())}, ranks_path, pattern, work)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`df` with the bytes of its token ids; null decodes as empty. A column named `into` is replaced."""
    return _mapped(df, ids, {into: T.BinaryType()}, ranks_path, "", lambda own, ids: (own.decode(ids or []),))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids", back: str = "decoded") -> DataFrame:
    """`encode` and `decode` in one pass: the ids, and the bytes that the ids decode to."""

    def work(own: Encoder, text: str | None) -> tuple[list[int], bytes]:
        ids = own.encode(text or "")
        return ids, own.decode(ids)

    return _mapped(df, text, {into: T.ArrayType(T.IntegerType()), back: T.BinaryType()}, ranks_path, pattern, work)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by single blanks."""
    return F.array_join(ids.cast("array<string>"), " ")
