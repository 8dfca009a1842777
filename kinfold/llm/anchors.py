"""Repeated windows of a corpus, found through content-defined anchors.

A window is `width` consecutive symbols (bytes or words) of one document. Its anchor is the
leftmost of its `gram`-symbol pieces with the smallest hash, so equal windows have equal
anchors at equal offsets. Consecutive windows with the same anchor form a run; a run's key
is (a, c): the anchor's hash and the hash of all the run covers. One run stands for about
`(width - gram) / 2` windows, so the corpus is shuffled as run keys, not as windows.

A window can only occur twice if its anchor does. `candidates` keeps the runs whose anchor
occurs at least twice (counted with map-side partial sums, joined with splittable joins);
operators compare only those. Runs of equal content collapse to one class first, so a
passage that a third of all documents share is one row for what follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialise

#: Odd multiplier of the polynomial hashes, and the constants of the splitmix64 finaliser. Fixed values.
BASE, MIX1, MIX2, GOLDEN = 0x9E6C63D0876A46AD, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
#: Symbols looked at together; longer documents are cut with an overlap (cutting a run is always safe).
PIECE = 1 << 16
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser; wraps modulo 2**64."""
    x = x ^ (x >> U(30))
    x = x * U(MIX1)
    x ^= x >> U(27)
    x *= U(MIX2)
    x ^= x >> U(31)
    return x


class _Powers:
    """BASE**i and BASE**-i modulo 2**64, grown on demand."""

    up = down = np.ones(1, U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PIECE + 4096)
            up, down = np.full(size, U(BASE)), np.full(size, U(pow(BASE, -1, 1 << 64)))
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up[:n], cls.down[:n]


class Rolling:
    """Hashes of any pieces of a symbol array."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = _Powers.of(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


_BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(GOLDEN))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def byte_symbols(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends) of each byte."""
    at = np.arange(len(raw))
    return _BYTE_CODES[raw], at, at + 1


def word_symbols(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends) of the words `[^\\x20\\x09-\\x0D]+`."""
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, U), starts, ends
    return Rolling(_BYTE_CODES[raw]).of(starts, ends) + U(GOLDEN) * (ends - starts).astype(U), starts, ends


def runs_of(codes: np.ndarray, doc_end: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of a piece: (first window, number of windows, anchor's offset, a, c).

    doc_end: for each symbol, where its document ends in this piece; windows never cross that.
    """
    n, m = len(codes), width - gram + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.astype(U), none.astype(U)
    roll = Rolling(codes)
    h = roll.grams(gram)
    low, step = h, 1
    while 2 * step <= m:  # sliding minimum by doubling
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if m > step:
        low = np.minimum(low[: len(h) - m + 1], low[m - step :])
    w = len(low)
    valid = doc_end[:w] >= np.arange(width, width + w)
    fresh = valid.copy()
    stay = valid[:-1] & (low[1:] == low[:-1]) & (h[: w - 1] != low[:-1]) & (doc_end[1:w] == doc_end[: w - 1])
    fresh[1:] &= ~stay
    s = np.flatnonzero(fresh)
    if not len(s):
        return none, none, none, none.astype(U), none.astype(U)
    last = np.minimum(np.append(s[1:], w) - 1, doc_end[s] - width)
    a = low[s]
    off = np.full(len(s), m - 1)
    ask = np.flatnonzero((h[s + m - 1] != a) | (np.concatenate([[U(0)], low])[s] <= a))  # else only the newest piece can be the anchor
    for i in range(0, len(ask), 2048):
        x = ask[i : i + 2048]
        off[x] = np.argmax(h[s[x, None] + np.arange(m)] == a[x, None], axis=1)
    c = roll.of(s, last + width) + U(GOLDEN) * (last - s + 1).astype(U)
    return s, last - s + 1, off, a, c


def pieces(texts: pa.Array, width: int, symbols: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, doc_end, doc, position in doc) of stretches of the batch; long documents are cut with an overlap."""
    held, n = [], 0

    def out():
        codes, docs, at = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = np.flatnonzero((np.diff(docs) != 0) | (np.diff(at) != 1)) + 1
        sizes = np.diff(np.concatenate([[0], cut, [len(codes)]]))
        return codes, np.repeat(np.append(cut, len(codes)), sizes), docs, at

    for i, t in enumerate(texts):
        raw = np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid else np.zeros(0, np.uint8)
        if len(raw) < width:
            continue
        codes = symbols(raw)[0]
        for at in range(0, max(1, len(codes) - width + 1), PIECE):
            part = codes[at : at + PIECE + width - 1]
            if len(part) < width:
                continue
            held.append((part, np.full(len(part), i, np.int32), np.arange(at, at + len(part), dtype=np.int32)))
            n += len(part)
            if n >= PIECE:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def keyed(docs: DataFrame, id: str, text: str, *others: Column) -> DataFrame:
    """(d, g, t, and `others`): id, a tag that keeps texts of one id apart, and the text. Equal rows are equal.

    Where ids are unique, as one look at the id column tells, the tag is a constant, which costs no room in shuffles.
    """
    t = F.col(text).cast("string")
    repeated = docs.groupBy(id).agg(F.count("*").alias("n_")).where("n_ > 1").limit(1).count()
    tag = F.hash(t) if repeated else F.lit(0)
    return docs.select(F.col(id).alias("d"), tag.alias("g"), F.coalesce(t, F.lit("")).cast("binary").alias("t"), *others)


def occurrences(docs: DataFrame, width: int, gram: int, symbols: Callable) -> DataFrame:
    """(a, c, d, g, p, more, n, off): runs of `keyed` documents; p: where the run begins, more: where else in the same stretch, or null."""
    kind = docs.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for codes, doc_end, doc, place in pieces(b.column(2), width, symbols):
                s, n, off, a, c = runs_of(codes, doc_end, width, gram)
                if not len(s):
                    continue
                # repetitive texts have the same run again and again
                owner = doc[s]
                order = np.lexsort((s, c, a, owner))
                ka, kc, kd = a[order], c[order], owner[order]
                new = np.concatenate([[True], (ka[1:] != ka[:-1]) | (kc[1:] != kc[:-1]) | (kd[1:] != kd[:-1])])
                first = np.flatnonzero(new)
                rows = order[first]
                begins = place[s[order]]
                size = np.diff(np.append(first, len(s)))
                rest = np.ones(len(s), bool)
                rest[first] = False
                more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size - 1)]).astype(np.int32)), pa.array(begins[rest]))
                more = pc.if_else(pa.array(size > 1), more, pa.scalar(None, more.type))
                who = pa.array(owner[rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[rows].view(np.int64)), pa.array(c[rows].view(np.int64)), b.column(0).take(who), b.column(1).take(who), pa.array(begins[first]), more, pa.array(n[rows].astype(np.int16)), pa.array(off[rows].astype(np.int16))],
                    names=["a", "c", "d", "g", "p", "more", "n", "off"],
                )

    return docs.mapInArrow(run, f"a long, c long, d {kind}, g int, p int, more array<int>, n short, off short")


def candidates(found: DataFrame, across: bool = False) -> DataFrame:
    """The occurrences whose anchor occurs at least twice; `across`: in at least two ids."""
    if across:
        often = found.groupBy("a").agg(F.min("d").alias("x"), F.max("d").alias("y"), F.max(F.col("d").isNull()).alias("z")).where("x <> y OR (z AND x IS NOT NULL)")
    else:
        often = found.groupBy("a").agg(F.sum(times()).alias("k")).where("k > 1")
    # a table of its own: a join of two plain exchanges is one whose hot keys the planner can split
    return found.join(materialise(often.select("a")).hint("shuffle_hash"), "a")


def times() -> Column:
    """How often a row of `occurrences` stands for its run."""
    return F.coalesce(F.size("more"), F.lit(0)) + 1


def begins() -> Column:
    """All places of a row of `occurrences`."""
    return F.concat(F.array("p"), F.coalesce("more", F.array().cast("array<int>")))


def with_runs(docs: DataFrame, runs: DataFrame, how: str = "left") -> DataFrame:
    """`keyed` docs, all columns, with `runs`, an array of structs made of the other columns of `runs` for each document."""
    own = [x for x in runs.columns if x not in ("d", "g")]
    each = runs.groupBy(F.col("d").alias("d_"), F.col("g").alias("g_")).agg(F.collect_list(F.struct(*own)).alias("runs"))
    return docs.join(each, docs.d.eqNullSafe(each.d_) & (docs.g == each.g_), how).select(*docs.columns, "runs")
