"""Word-level substring dedup by relative Lempel-Ziv parsing.

Every document is factored against all documents with a smaller id, the reference. The
reference is indexed by blocks: `anchors` cuts each document into runs of windows that share
an anchor, and blocks of equal content are one entry under their first document, so a passage
shared by a third of the corpus is one entry. Entries with the same anchor but different
surroundings are aligned at the anchor and indexed window by window (map-side partial minimum).

A document's hits are its windows of `width` words that the index has. In each stretch of neighbouring hits the documents
that the index names are candidates, each on its diagonal. If there is more than one, their words beside the
stretch are fetched, so that a match is followed through the reference document itself, also where the index
names another. Then the parse is greedy: a factor starts at the first hit not yet passed and takes the candidate that goes on
longest. Where it ends, the windows that straddle its end are looked up in the index: what they cover goes too. As any
hit lies inside a factor or straddles the end of one, the words removed are exactly those that a hit covers.

Of more than LOOK candidates in one stretch the ones with most hits are followed beyond them, so that no
document brings more than LOOK times its own words together; factors may be shorter then, the words removed are the same.

Results: one row per input row, with its factors. Null texts have no words. Repeats within one id
(also of equal rows) do not count. A null id is larger than any other and is never a reference.
Only the id and text columns are read. Very long texts are parsed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinfold.llm import anchors
from kinfold.session import materialise, release, ship

#: Candidates of a stretch that are fetched for all of it, and requests that one copy of a reference document serves.
LOOK, ASKED = 4, 2048


def _slices(b: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def _fields(runs: pa.ListArray, names: tuple[str, ...]) -> tuple[np.ndarray, list[pa.Array]]:
    """For each struct of a list column its row, and the named fields."""
    flat, size = runs.flatten(), np.array(runs.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(runs)), size), [flat.field(n) for n in names]


def _windows(width: int):
    """Rows (a, c, i, h, rd, rg, rp) of each window of the given blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for big in batches for x in _slices(big)):
            # a space keeps the words of neighbouring texts apart
            texts = [t.as_py() for t in b.column(2)]
            codes, starts, _ = anchors.word_symbols(np.frombuffer(b" ".join(texts), np.uint8))
            roll = anchors.Rolling(codes)
            offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
            base = np.searchsorted(starts, offsets)  # number of words before each text
            row, (a, c, p, n) = _fields(b.column(3), ("a", "c", "p", "n"))
            p, n = p.to_numpy().astype(np.int64), n.to_numpy().astype(np.int64)
            which = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            s = p[which] + i
            at = base[row[which]] + s
            owner = pa.array(row[which])
            yield pa.RecordBatch.from_arrays(
                [a.take(pa.array(which)), c.take(pa.array(which)), pa.array(i.astype(np.int32)), pa.array(roll.of(at, at + width).view(np.int64)), b.column(0).take(owner), b.column(1).take(owner), pa.array(s.astype(np.int32))],
                names=["a", "c", "i", "h", "rd", "rg", "rp"],
            )

    return run


def _short(raw: memoryview | bytes | pa.Buffer) -> np.ndarray:
    """32-bit hashes of a text's words. They only steer which factor goes on longest: what is followed lies in a stretch of hits, which goes in any case."""
    return (anchors.word_symbols(np.frombuffer(raw, np.uint8))[0] >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Hits:
    """The hits of a batch of documents, looked at document by document: where they start, and where the document that the index names has them."""

    def __init__(self, found: pa.ListArray):
        flat = found.flatten()
        size = np.array(found.value_lengths().fill_null(0))
        self.ends = np.concatenate([[0], np.cumsum(size)])
        self.p, self.m, self.rg, self.rp = (flat.field(n).to_numpy().astype(np.int64) for n in ("p", "m", "rg", "rp"))
        coded = pc.dictionary_encode(flat.field("rd"))
        self.code, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of document k's hits, and its pieces: (begin, end, code of the document, tag, begin there) of each run of starts that follows one diagonal."""
        own = slice(self.ends[k], self.ends[k + 1])
        m = self.m[own]
        which = np.repeat(np.arange(len(m)), m)
        i = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
        start, first = np.unique(self.p[own][which] + i, return_index=True)  # a window is known once, whatever block told it
        which = which[first]
        code, tag, pos = self.code[own][which], self.rg[own][which], self.rp[own][which] + i[first]
        new = np.ones(len(start), bool)
        new[1:] = (np.diff(start) != 1) | (np.diff(code) != 0) | (np.diff(tag) != 0) | (np.diff(pos) != 1)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(start)))
        return start, np.stack([start[head], start[head] + size, code[head], tag[head], pos[head]])


def _requests(width: int):
    """For each stretch with several candidates: which words (from x, n of them) of which document, shift places on, to fetch."""
    names = ["d", "g", "x", "n", "shift", "rd", "rg"]

    def asked(pieces: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(x, n, shift, code, tag) of a document."""
        begin, end, code, tag, pos = pieces
        stretch = np.cumsum(np.concatenate([[0], begin[1:] != end[:-1]]))
        for first, last in _runs(stretch):
            if last - first < 2:
                continue
            low, high = int(begin[first]), int(end[last - 1])
            hits: dict[tuple, int] = {}
            for c, t, by, n in zip(code[first:last].tolist(), tag[first:last].tolist(), (pos - begin)[first:last].tolist(), (end - begin)[first:last].tolist(), strict=True):
                hits[c, t, by] = hits.get((c, t, by), 0) + n
            if len(hits) > 1:
                for c, t, by in sorted(hits, key=lambda x: (-hits[x], x[2]))[:LOOK]:
                    x = max(low, -by)
                    yield x, high + width - 1 - x, by, c, t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for big in batches for x in _slices(big, 1024)):
            h = Hits(b.column(2))
            rows = [(k, *x) for k in range(b.num_rows) for x in asked(h.of(k)[1])]
            if rows:
                who, x, n, by, code, tag = zip(*rows, strict=True)
                owner = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(owner), b.column(1).take(owner), *(pa.array(v, pa.int32()) for v in (x, n, by)), h.names.take(pa.array(code, pa.int64())), pa.array(tag, pa.int32())], names=names
                )

    return run


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of equal values."""
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, int)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, g, x, shift, rd, rg, words): hashes of the words asked for, a few at a time."""
    names = ["d", "g", "x", "shift", "rd", "rg", "words"]
    for b in batches:
        for k in range(b.num_rows):
            asked = b.column(3)[k].values
            codes = _short(b.column(2)[k].as_buffer())
            x, n, by = (asked.field(f).to_numpy().astype(np.int64) for f in ("x", "n", "shift"))
            begin, end = np.minimum(x + by, len(codes)), np.minimum(x + by + n, len(codes))
            upto, at = np.cumsum(end - begin), 0
            while at < len(x):
                last = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 18), "right")))
                cut = [codes[i:j] for i, j in zip(begin[at:last].tolist(), end[at:last].tolist(), strict=True)]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int32))
                same = pa.array(np.full(len(cut), k))
                own = [asked.field(f).slice(at, len(cut)) for f in ("d", "g", "x", "shift")]
                yield pa.RecordBatch.from_arrays([*own, b.column(0).take(same), b.column(1).take(same), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(cut)))], names=names)
                at = last


def greedy(start: np.ndarray, intervals: list[tuple], width: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Factors (begin, length, ref, ref_begin) and what they and the hits at their ends cover; intervals: (begin, end, ref, tag, ref_begin) of matches."""
    intervals = sorted(intervals, key=lambda x: x[0])
    queue: list[tuple] = []
    factors, spans = [], []
    i, k, n = 0, 0, len(start)
    while k < n:
        s = int(start[k])
        while i < len(intervals) and intervals[i][0] <= s:
            a, e, ref, tag, at = intervals[i]
            heappush(queue, (-e, ref, tag, at - a))
            i += 1
        while -queue[0][0] < s + width:
            heappop(queue)
        e, ref, _, shift = queue[0]
        factors.append((s, -e - s, ref, s + shift))
        k = int(np.searchsorted(start, -e))  # the first hit behind the factor; the one before it may straddle the end
        spans.append((s, max(-e, int(start[k - 1]) + width)))
    return factors, spans


def _parse(width: int, id: str, kind: pa.DataType):
    """Greedy factors of each document, and the words that they leave."""
    factor = pa.struct([("begin", pa.int64()), ("length", pa.int64()), ("ref", kind), ("ref_begin", pa.int64())])

    def followed(text: bytes, fetched: pa.StructArray) -> Iterator[tuple]:
        """Matches along the diagonals whose words were fetched."""
        codes = _short(text)
        flat, ends = fetched.field("words").flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.array(fetched.field("words").value_lengths()))])
        for j, (x, by, ref, tag) in enumerate(zip(*(fetched.field(n).to_pylist() for n in ("x", "shift", "rd", "rg")), strict=True)):
            theirs = flat[ends[j] : ends[j + 1]]
            same = codes[x : x + len(theirs)] == theirs
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
            for a, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - a >= width:
                    yield x + a, x + e, ref, tag, x + a + by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for big in batches for x in _slices(big)):
            n_words, n_removed, texts, lists = [], [], [], []
            h = Hits(b.column(2))
            names = h.names.to_pylist()
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py()
                words = kept = text.split()  # at ASCII white space, as the contract's words
                factors: list[tuple] = []
                if h.ends[k] < h.ends[k + 1]:
                    start, (begin, end, code, tag, pos) = h.of(k)
                    intervals = list(zip(begin.tolist(), (end + (width - 1)).tolist(), [names[c] for c in code.tolist()], tag.tolist(), pos.tolist(), strict=True))
                    if (fetched := b.column(3)[k]).is_valid and len(fetched):
                        intervals += followed(text, fetched.values)
                    factors, spans = greedy(start, intervals, width)
                    kept, last = [], 0
                    for x, y in spans:
                        kept += words[last : max(x, last)]
                        last = max(y, last)
                    kept += words[last:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept))
                lists.append(factors)
            flat = [f for x in lists for f in x]
            begin, length, ref, at = zip(*flat, strict=True) if flat else [()] * 4
            parts = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(ref, kind), pa.array(at, pa.int64())], fields=list(factor))
            found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)), parts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), found, pa.array(texts, pa.binary())], names=[id, "n_words", "n_removed", "factors", "kept"])

    return run


def factor_documents(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 13, gram: int = 5) -> DataFrame:
    """id, n_words, n_removed, factors (begin, length, ref, ref_begin; in words), kept (binary: words joined by a space)."""
    ship(docs.sparkSession)
    kind = docs.schema[id].dataType
    name = kind.simpleString()
    keyed = anchors.keyed(docs, id, text)
    runs = materialise(anchors.candidates(anchors.occurrences(keyed, width, gram, anchors.word_symbols), across=True))
    # the first document of each class stands for it (a null id only if there is no other)
    blocks = materialise(
        runs.groupBy("a", "c").agg(F.min("d").alias("d"), *[F.coalesce(F.min_by(x, "d"), F.first(x)).alias(x) for x in ("g", "p")], F.first("n").cast("int").alias("n"))
    )
    contexts = blocks.groupBy("a").agg(F.count("*").alias("k"))
    alone = blocks.join(contexts.where("k = 1").select("a"), "a").select("a", "c", F.lit(0).alias("i"), F.col("n").alias("m"), F.col("d").alias("rd"), F.col("g").alias("rg"), F.col("p").alias("rp"))
    several = blocks.join(contexts.where("k > 1").select("a"), "a").select("d", "g", "a", "c", "p", "n")
    each = materialise(anchors.with_runs(keyed, several, "inner").select("d", "g", "t", "runs").mapInArrow(_windows(width), f"a long, c long, i int, h long, rd {name}, rg int, rp int"))
    first = each.where(F.col("rd").isNotNull()).groupBy("a", "h").agg(F.min("rd").alias("rd"), *[F.min_by(x, "rd").alias(x) for x in ("rg", "rp")])
    aligned = each.select("a", "c", "i", "h").join(first, ["a", "h"]).select("a", "c", "i", F.lit(1).alias("m"), "rd", "rg", "rp")
    index = materialise(alone.where(F.col("rd").isNotNull()).unionByName(aligned).groupBy("a", "c").agg(F.collect_list(F.struct("i", "m", "rd", "rg", "rp")).alias("blocks")))
    release(blocks, each)
    earlier = F.filter("blocks", lambda x: F.coalesce(x.rd < F.col("d"), F.col("d").isNull()))
    found = runs.join(index, ["a", "c"]).select("d", "g", anchors.begins().alias("at"), earlier.alias("blocks")).where(F.size("blocks") > 0)
    windows = F.flatten(F.transform("at", lambda p: F.transform("blocks", lambda x: F.struct((p + x.i).alias("p"), x.m.alias("m"), x.rd.alias("rd"), x.rg.alias("rg"), x.rp.alias("rp")))))
    hits = materialise(found.select("d", "g", F.inline(windows)).groupBy("d", "g").agg(F.collect_list(F.struct("p", "m", "rd", "rg", "rp")).alias("hits")))
    release(runs, index)

    asked = materialise(hits.mapInArrow(_requests(width), f"d {name}, g int, x int, n int, shift int, rd {name}, rg int"))
    # a table of its own, so that the joins with it can split a document that very many ask for
    copies = materialise(asked.groupBy("rd", "rg").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts")))
    salted = asked.join(copies, ["rd", "rg"]).withColumn("z", F.pmod(F.xxhash64("d", "g", "x", "shift"), "parts").cast("int"))
    lists = salted.groupBy("rd", "rg", "z").agg(F.collect_list(F.struct("d", "g", "x", "n", "shift")).alias("asked"))
    # of texts with one id and tag any will do: they are equal
    theirs = keyed.join(copies, keyed.d.eqNullSafe(F.col("rd")) & (keyed.g == F.col("rg"))).select("rd", "rg", "t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("z"))
    fetched = theirs.join(lists, ["rd", "rg", "z"]).select("rd", "rg", "t", "asked").mapInArrow(_fetch, f"d {name}, g int, x int, shift int, rd {name}, rg int, words array<int>")
    fetched = materialise(fetched)
    beside = fetched.groupBy(F.col("d").alias("d_"), F.col("g").alias("g_")).agg(F.collect_list(F.struct("x", "shift", "rd", "rg", "words")).alias("fetched"))
    own = hits.select(F.col("d").alias("d1"), F.col("g").alias("g1"), "hits")
    known = keyed.join(own, keyed.d.eqNullSafe(F.col("d1")) & (keyed.g == F.col("g1")), "left")
    known = known.join(beside, keyed.d.eqNullSafe(F.col("d_")) & (keyed.g == F.col("g_")), "left")
    release(asked, copies)
    return known.select("d", "t", "hits", "fetched").mapInArrow(
        _parse(width, id, to_arrow_type(kind)),
        f"`{id}` {name}, n_words long, n_removed long, factors array<struct<begin:long,length:long,ref:{name},ref_begin:long>>, kept binary",
    )
