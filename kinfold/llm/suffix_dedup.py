"""Byte-level substring dedup with a distributed, sparse suffix array.

A byte is removed if a `width`-byte string that covers it starts anywhere else too, the same
document included; matches never cross documents, strings are judged on the input.

1. `anchors` finds the runs of windows whose anchor occurs twice or more (a repeated window
   cannot lack one) and collapses runs of equal content to a class with its count.
2. Each class becomes one suffix, the text from its anchor on, with its left context. Sampled
   splitters range-partition the suffixes by their leading bytes. Suffixes with equal leading bytes
   fall into one bucket, so no match runs across a bucket's boundary; an anchor with more than
   `hot` classes is dealt out window by window and salted by the window's content instead.
3. A bucket sorts its suffixes, and its reversed left contexts, by multikey quicksort over
   8-byte symbols and takes the common prefixes of neighbours. Two windows are equal if the
   neighbours between them share the part right of the anchor and the part left of it.
4. Repeated windows go back to every occurrence of the class, and to the texts.

With `keep_first` the first place of each repeated string stays: a byte goes if a string that covers it also starts
earlier, in a document before (by id, null last, then by a hash of the text) or before in the same one. Equal rows are one place.

Results: one row per input row. A null text is empty: 0 bytes, nothing removed. Equal rows
repeat each other wholly (if `width` bytes or longer) and each keeps its row. A null id is
kept. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from kinfold.llm import anchors
from kinfold.session import materialise, release, ship

LEAD = 16


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and each row's common prefix with the row before it in that order.

    Multikey quicksort with 8-byte symbols, breadth first: a level sorts all still tied
    segments by their next symbol; a segment of one row is never looked at again.
    """
    m, width = keys.shape
    words = np.ascontiguousarray(keys).view(">u8").astype(np.uint64)
    order = np.arange(m)
    segment = np.zeros(m, np.int64)
    tied = np.arange(m)
    for k in range(words.shape[1]):
        if not len(tied):
            break
        symbol = words[order[tied], k]
        by = np.lexsort((symbol, segment[tied]))
        order[tied] = order[tied][by]
        symbol, old = symbol[by], segment[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        start = np.flatnonzero(new)
        segment[tied] = tied[start][np.cumsum(new) - 1]
        alone = np.diff(np.append(start, len(tied))) == 1
        tied = tied[~np.repeat(alone, np.diff(np.append(start, len(tied))))]
    lcp = np.zeros(m, np.int64)
    done = words[order]
    differ = done[1:] != done[:-1]
    col = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    inside = np.zeros(m - 1 if m else 0, np.int64)
    some = np.flatnonzero(col < words.shape[1])
    x = done[some + 1, col[some]] ^ done[some, col[some]]
    for byte in range(7):  # equal leading bytes of the first differing symbol
        inside[some] += (x >> np.uint64(56 - 8 * byte)) == 0
    lcp[1:] = col * 8 + inside
    return order, lcp


def _matrix(strings: list[bytes]) -> np.ndarray:
    size = np.array([len(s) for s in strings])
    wide = max(8, -(-int(size.max()) // 8) * 8)
    out = np.zeros((len(strings), wide), np.uint8)
    out[np.arange(wide) < size[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return out


def repeated_windows(rights: list[bytes], lefts: list[bytes], n: np.ndarray, count: np.ndarray, rank: np.ndarray, place: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each class (right part, reversed left part, n windows, count occurrences, document's rank and place of the first one)
    which of its windows occur twice or more, and which of all are first in this class."""
    m = len(rights)
    longest = np.array([len(x) for x in lefts])
    out = (np.arange(int(n.max())) < n[:, None]) & (count > 1)[:, None]
    own = np.arange(int(n.max())) < n[:, None]
    r_order, r_lcp = multikey_sort(_matrix(rights))
    shared = r_lcp >= gram  # neighbours with one anchor
    shared[:-1] |= shared[1:].copy()
    rows = np.flatnonzero(shared)
    if not len(rows):
        return out, own
    rows = np.sort(r_order[rows])
    l_order, l_lcp = multikey_sort(_matrix(lefts))
    r_rank, l_rank = np.empty(m, np.int64), np.empty(m, np.int64)
    r_rank[r_order] = l_rank[l_order] = np.arange(m)
    low, high = longest[rows] - n[rows] + 1, longest[rows]
    for d in range(int(low.min()), int(high.max()) + 1):  # windows that begin d bytes left of the anchor
        i = rows[(low <= d) & (d <= high)]
        if len(i) < 2:
            continue
        key = (np.cumsum(r_lcp < width - d)[r_rank[i]] << 32) | np.cumsum(l_lcp < d)[l_rank[i]]
        by = np.lexsort((place[i] + longest[i] - d, rank[i], key))
        i, key = i[by], key[by]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(i)))
        twice = np.repeat(np.add.reduceat(count[i], start) > 1, size)
        out[i[twice], (longest[i] - d)[twice]] = True
        head = np.repeat(i[start], size)  # equal rows are at one place
        later = (rank[i] != rank[head]) | (place[i] + longest[i] != place[head] + longest[head])
        own[i[later], (longest[i] - d)[later]] = False
    return out, own


def _suffixes(width: int):
    """Suffix rows of the classes' first occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lead", "salt", "rest", "back", "a", "c", "first", "n", "k", "p"]
        types = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        rows: list[tuple] = []

        def out():
            made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*made, pa.concat_arrays(owners), pa.concat_arrays(tags)], names=[*names, "d", "g"])

        owners: list[pa.Array] = []
        tags: list[pa.Array] = []
        for b in batches:
            for at, (t, runs) in enumerate(zip(b.column(0), b.column(1), strict=True)):
                text = t.as_py()
                for x in runs.as_py():
                    p, n, off = x["p"], x["n"], x["off"]
                    anchor = text[p + off : p + n - 1 + width]
                    begun = len(rows)
                    if not x["hot"]:
                        rows.append((anchor[:LEAD], 0, anchor, text[p : p + off][::-1], x["a"], x["c"], 0, n, x["k"], p))
                    else:
                        for i in range(n):
                            window = text[p + i : p + i + width]
                            rows.append((anchor[:LEAD], xxhash.xxh64_intdigest(window) - (1 << 63), window[off - i :], window[: off - i][::-1], x["a"], x["c"], i, 1, x["k"], p + i))
                    which = pa.array([at] * (len(rows) - begun), pa.int64())
                    owners.append(b.column(2).take(which))
                    tags.append(b.column(3).take(which))
                    if len(rows) >= 4096:
                        yield out()
                        rows.clear()
                        owners.clear()
                        tags.clear()
        if rows:
            yield out()

    return run


def _bucket(width: int, gram: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out(t: pa.Table):
            n, k, p = (t[x].to_numpy().astype(np.int64) for x in ("n", "k", "p"))
            # documents in the order of (id, tag), null last
            order = pc.sort_indices(pa.table({"d": t["d"], "g": t["g"]}), [("d", "ascending"), ("g", "ascending")], null_placement="at_end").to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            by_d, by_g = t["d"].combine_chunks().take(pa.array(order)), t["g"].to_numpy()[order]
            same = pc.fill_null(pc.equal(by_d[1:], by_d[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(by_d[1:]).to_numpy(zero_copy_only=False) & pc.is_null(by_d[:-1]).to_numpy(zero_copy_only=False))
            rank[order] = np.concatenate([[0], np.cumsum(~(same & (by_g[1:] == by_g[:-1])))])
            found, own = repeated_windows(t["rest"].to_pylist(), t["back"].to_pylist(), n, k, rank, p, width, gram)
            keep = np.flatnonzero(found.any(axis=1))
            bits, firsts = (np.packbits(x[keep], axis=1, bitorder="little") for x in (found, own))
            for i in range(0, len(keep), 4096):
                packed = (pa.array([x.tobytes() for x in y[i : i + 4096]], pa.binary()) for y in (bits, firsts))
                yield pa.RecordBatch.from_arrays([*(t[x].combine_chunks().take(pa.array(keep[i : i + 4096])) for x in ("a", "c", "first")), *packed], names=["a", "c", "first", "bits", "own"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= room:  # suffixes with equal leading bytes and salt stay together
                t = pa.Table.from_batches(held)
                lead, salt = np.frombuffer(b"".join(t["lead"].to_pylist()), ">u8").reshape(-1, LEAD // 8), t["salt"].to_numpy()
                edge = np.flatnonzero((lead[1:] != lead[:-1]).any(axis=1) | (salt[1:] != salt[:-1])) + 1
                if len(edge):
                    cut = int(edge[-1])
                    yield from out(t.slice(0, cut).combine_chunks())
                    held, size = t.slice(cut).combine_chunks().to_batches(), size - cut
        if held:
            yield from out(pa.Table.from_batches(held).combine_chunks())

    return run


def covered(size: int, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal stretches that windows at `starts` cover."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    edge = np.diff(np.concatenate([[0], np.cumsum(step[:-1]) > 0, [0]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _removal(width: int, whole_chars: bool, id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                rows = []
                for t, runs in zip(b.column(2), b.column(3), strict=True):
                    text = t.as_py()
                    begin = end = np.zeros(0, np.int64)
                    if runs.is_valid and len(runs):
                        starts = []
                        for x in runs.as_py():
                            hit = np.flatnonzero(np.unpackbits(np.frombuffer(x["bits"], np.uint8), bitorder="little"))
                            if x["keep"] is None:
                                starts.append((np.array(x["at"])[:, None] + (hit + x["first"])).ravel())
                                continue
                            owned = np.unpackbits(np.frombuffer(x["own"], np.uint8), bitorder="little")[hit] == 1
                            for at_ in x["at"]:
                                starts.append(at_ + x["first"] + (hit[~owned] if at_ == x["keep"] else hit))
                        begin, end = covered(len(text), np.unique(np.concatenate(starts)), width)
                        if whole_chars:  # give back the parts of characters that a stretch cuts
                            cont = (np.frombuffer(text + b" ", np.uint8) & 0xC0) == 0x80
                            while (bad := cont[begin]).any():
                                begin = begin + bad
                            while (bad := cont[end]).any():
                                end = end - bad
                    spans = list(zip(begin.tolist(), end.tolist(), strict=True))
                    kept, last = [], 0
                    for x, y in spans:
                        kept.append(text[last:x])
                        last = y
                    kept.append(text[last:])
                    rows.append((len(text), sum(y - x for x, y in spans), len(spans), [{"begin": x, "end": y} for x, y in spans], b"".join(kept)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[id, "others", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run


def remove_repeats(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 200, gram: int = 32, hot: int = 20_000, room: int = 30_000, whole_chars: bool = False, keep_first: bool = False
) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, spans (begin, end), kept (binary), and others: a struct of all other columns.

    `whole_chars`: a span gives back the parts of UTF-8 characters that it would cut. `keep_first`: the first place of a string stays.
    """
    if not LEAD <= gram <= width:
        raise ValueError(f"gram must lie between {LEAD} and width")
    ship(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    keyed = anchors.keyed(docs, id, text)
    runs = materialise(anchors.candidates(anchors.occurrences(keyed, width, gram, anchors.byte_symbols)))
    if keep_first:  # the first occurrence stands for its class
        first = F.min(F.struct(F.col("d").isNull().alias("z"), "d", "g", "p", "n", "off")).alias("x")
        classes = runs.groupBy("a", "c").agg(F.sum(anchors.times()).alias("k"), first).select("a", "c", "k", *[F.col(f"x.{x}").alias(x) for x in ("d", "g", "p", "n", "off")])
    else:  # any may; these aggregates all take the first row
        classes = runs.groupBy("a", "c").agg(F.sum(anchors.times()).alias("k"), *[F.first(x).alias(x) for x in ("d", "g", "p", "n", "off")])
    # a table of its own, hardly ever of any rows: the join on the anchor then shuffles nothing
    hottest = materialise(runs.groupBy("a").agg(F.count("*").alias("n_")).where(F.col("n_") > hot).select("a", F.lit(True).alias("hot")))
    chosen = classes.join(hottest, "a", "left").select("d", "g", "p", "a", "c", "n", "off", "k", F.coalesce("hot", F.lit(False)).alias("hot"))
    suffixes = anchors.with_runs(keyed, chosen, "inner").select("t", "runs", "d", "g").mapInArrow(
        _suffixes(width), f"lead binary, salt long, rest binary, back binary, a long, c long, first int, n int, k long, p int, d {kind}, g int"
    )
    sorted_ = suffixes.repartitionByRange("lead", "salt").sortWithinPartitions("lead", "salt")
    repeated = materialise(sorted_.mapInArrow(_bucket(width, gram, room), "a long, c long, first int, bits binary, own binary"))
    places = runs.select("a", "c", "d", "g", "p", anchors.begins().alias("at"))
    if keep_first:
        stands = classes.select("a", "c", F.col("d").alias("d1"), F.col("g").alias("g1"), F.col("p").alias("p1"))
        here = F.col("d").eqNullSafe(F.col("d1")) & (F.col("g") == F.col("g1")) & F.array_contains("at", F.col("p1"))
        found = places.join(repeated.join(stands, ["a", "c"]), ["a", "c"]).withColumn("keep", F.when(here, F.col("p1")))
    else:
        found = places.join(repeated.withColumn("own", F.lit(None).cast("binary")), ["a", "c"]).withColumn("keep", F.lit(None).cast("int"))
    spans = materialise(found.select("d", "g", "at", "first", "bits", "own", "keep"))
    release(runs, repeated, hottest)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (id, text)] or [F.lit(True).alias("_")])
    texts = anchors.keyed(docs, id, text, others.alias("o"))
    # no DDL: names of other columns may be anything
    schema = StructType().add(id, docs.schema[id].dataType).add("others", texts.schema["o"].dataType)
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    schema = schema.add("spans", ArrayType(StructType().add("begin", "long").add("end", "long"))).add("kept", "binary")
    return anchors.with_runs(texts, spans).select("d", "o", "t", "runs").mapInArrow(_removal(width, whole_chars, id), schema)
