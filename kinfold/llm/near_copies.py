"""SimHash near-duplicates by word-shingle Jaccard similarity: the part of `simhash` for similarities that a few bits do not reach.

1. A row's set is its distinct `width`-word shingles, its fingerprint their SimHash. Its prefix is the first
   n - ceil(similarity * n) + 1 hashes of the set in one fixed order: two sets of that similarity
   have a hash in common within their prefixes, so no pair is missed. The order puts shingles that are
   frequent in a sample last; the sample decides speed only.
2. Equal texts become one class. Prefix hashes of one class only go at once.
3. Candidates are classes that share a prefix hash early enough in both prefixes (from the first hash that two sets share on, the
   rest of either must still hold as many as the similarity asks for), of sizes that allow it, and whose fingerprints are within `radius(similarity)` bits: a bit of two such sets
   differs with probability acos(2s / (1 + s)) / pi, and the radius is six standard deviations above that mean. At
   0.8 that is 26 of 64 bits: eleven of twelve unrelated pairs go. No pivot discards anything at such a radius.
4. In each of ROUNDS rounds each class is compared with the two ends of its groups in an order of that round,
   the ones of them that it shares most hashes with; what is linked is contracted, so a large group of near copies
   never meets all its pairs. In the first round one end is the class with the fewest rarer hashes: in a group of edited copies the least edited.
5. Then all pairs of classes of different components that share a hash are made in bounded groups (`simhash.in_groups`), where
   places, sizes, components and fingerprints discard pairs. Classes that have any left meet once more with a histogram of
   their hashes over BUCKETS buckets: two sets differ in at least as many hashes as their histograms do, so what this discards is
   beyond the similarity for certain. Only then are pairs emitted, and verified.
6. Components by large-star/small-star.

Verification compares the shingles' words, not hashes. Words are A-Z-lowered runs between white space; a text of
fewer words than `width` is one shingle. Null and word-free texts are copies of each other. Very long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.simhash import CHUNK, in_groups, shingle_hashes, simhashes, within
from kinfold.operators.components import connected_components
from kinfold.session import materialise, release, ship

#: Rows sampled for frequent shingles (or SHARE of all, if that is more), and how many of these are kept.
SAMPLE, SHARE, FREQUENT = 5000, 0.02, 1 << 18
ROUNDS = 2
BUCKETS = 128
#: Pairs that one copy of a text is compared with; a text asked for more often is dealt out in copies.
ASKED = 64


def text_key(text: str = "text") -> Column:
    """A key of a row's text; null has its own."""
    return F.coalesce(F.unhex(F.md5(F.col(text).cast("string").cast("binary"))), F.lit(b"null"))


def radius(similarity: float, deviations: float = 6, bits: int = 64) -> int:
    """Bits within which fingerprints of sets of this Jaccard similarity lie."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(bits, int(bits * p + deviations * math.sqrt(bits * p * (1 - p))))


def _sets(raw: bytes, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(raw, width), np.uint64).view(np.int64))


def frequent(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that several sampled rows have, sorted by hash."""
    share = min(1.0, max(SHARE, SAMPLE / max(1, docs.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_sets(t.as_py() or b"", width) for t in pc.cast(b.column(0), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["h"])

    sampled = (docs.sample(share, 7) if share < 1 else docs).select(F.col(text).cast("string"))
    top = sampled.mapInArrow(run, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    h, n = (np.asarray(top.column(c).combine_chunks()).astype(np.int64) for c in ("h", "count"))
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(docs: DataFrame, id: str, text: str, width: int, ratio: Fraction) -> DataFrame:
    """(d, t, n, fp, b, p): id, text key, size of the set, its fingerprint, histogram and prefix."""
    seen = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, width))
    p, q = ratio.numerator, ratio.denominator
    names = ["d", "t", "n", "fp", "b", "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = seen.value
        for b in batches:
            sizes, heads, prints, counts_ = [], [], [], []
            for t in pc.cast(b.column(2), pa.binary()):
                h = _sets(t.as_py() or b"", width)
                n = len(h)
                prints.append(simhashes(h, np.array([n])))
                counts_.append(_histogram(h))
                if n and len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.lexsort((h, np.where(common[at] == h, counts[at], 0)))]
                sizes.append(n)
                heads.append(h[: n - -(-p * n // q) + 1])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            fps = np.concatenate(prints).view(np.int64) if prints else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(fps), pa.array(counts_, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=names)

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("d"), text_key(text).alias("t"), F.col(text).cast("string").alias("x"))
    return rows.mapInArrow(run, f"d {kind}, t binary, n int, fp long, b binary, p array<long>")


def _shingles(raw: bytes, width: int) -> set[bytes]:
    words = raw.lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, width: int, ratio: Fraction) -> DataFrame:
    """The pairs (a, b) of classes whose texts have the similarity. A text that many pairs ask for is dealt out in copies."""
    p, q = ratio.numerator, ratio.denominator
    asked = pairs.groupBy(F.col("b").alias("c")).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    asked = materialise(asked.unionByName(pairs.select(F.col("a").alias("c"), F.lit(0).alias("parts"))).groupBy("c").agg(F.max("parts").alias("parts")))
    keys = classes.join(asked, "c").select("c", F.col("k").alias("t"), "parts")
    texts = materialise(docs.select(text_key(text).alias("t"), F.col(text).cast("string").alias("x")).join(keys, "t").dropDuplicates(["c"]).select("c", "x", "parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for b in batches:
            a_, b_ = b.column(0), b.column(1)
            ok = []
            for y, u, v in zip(b_.to_pylist(), pc.cast(b.column(2), pa.binary()), pc.cast(b.column(3), pa.binary()), strict=True):
                if y != last:
                    last, held = y, _shingles(v.as_py(), width)
                mine = _shingles(u.as_py(), width)
                both = len(mine & held)
                ok.append(q * both >= p * (len(mine) + len(held) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a_.filter(keep), b_.filter(keep)], names=["a", "b"])

    salted = pairs.join(asked.select(F.col("c").alias("b"), "parts"), "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("z"))
    left = salted.join(texts.select(F.col("c").alias("a"), F.col("x").alias("u")), "a")
    right = texts.where("parts > 0").select(F.col("c").alias("b"), F.col("x").alias("v"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("z"))
    out = materialise(left.join(right, ["b", "z"]).select("a", "b", "u", "v").mapInArrow(run, "a long, b long"))
    release(texts, asked)
    return out


def _apart(x: str, y: str, most_bits: int, ratio: Fraction) -> Column:
    """Whether what two structs (n, i, fp, g) of classes with a hash in common tell leaves a link of different components possible."""
    p, q = ratio.numerator, ratio.denominator
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.i"), F.col(f"{y}.n") - F.col(f"{y}.i")).cast("long")
    enough = left * (p + q) >= (F.col(f"{x}.n") + F.col(f"{y}.n")).cast("long") * p
    return (F.col(f"{x}.g") != F.col(f"{y}.g")) & enough & (F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) <= most_bits)


def _histogram(h: np.ndarray) -> bytes:
    """How many hashes fall into each bucket, at most 255."""
    return np.minimum(np.bincount((h.view(np.uint64) >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _candidates(placed: DataFrame, histograms: DataFrame, most_bits: int, ratio: Fraction, chunk: int) -> DataFrame:
    """(a, b) of all pairs of different components that may have the similarity; placed: h, c, n, i, fp, g; histograms: c, b."""
    p, q = ratio.numerator, ratio.denominator

    def pairs(group, side, c, n, i, fp, g) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = (n - i).astype(np.int64) * (p + q)
        for x, y in within(fp.view(np.uint64), group, side, most_bits):
            keep = (g[x] != g[y]) & (np.minimum(left[x], left[y]) >= (n[x].astype(np.int64) + n[y]) * p)
            yield x[keep], y[keep]

    def concerned(group, side, c, *rest) -> Iterator[pa.RecordBatch]:
        for x, y in pairs(group, side, c, *rest):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([c[x], c[y]])))], names=["c"])

    def work(group, side, c, n, i, fp, g, b) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(b"".join(b), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
        for xs, ys in pairs(group, side, c, n, i, fp, g):
            for at in range(0, len(xs), 1 << 16):
                x, y = xs[at : at + (1 << 16)], ys[at : at + (1 << 16)]
                apart = np.abs(counts[x] - counts[y]).sum(axis=1, dtype=np.int64)
                both = n[x].astype(np.int64) + n[y]
                keep = (both - apart) * (p + q) >= 2 * p * both  # common hashes are at most (both - apart) / 2
                found = np.unique(np.sort(np.stack([c[x[keep]], c[y[keep]]]), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def met(rows: DataFrame, more: list[str], job, schema: str) -> DataFrame:
        mixed = rows.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("n_")).where("lo < hi").select("h", "n_")
        return in_groups(rows.join(mixed, "h"), ["h"], ["c", "n", "i", "fp", "g", *more], job, schema, chunk).distinct()

    some = materialise(met(placed, [], concerned, "c long"))
    rows = materialise(placed.join(some, "c", "left_semi").join(histograms, "c"))
    out = materialise(met(rows, ["b"], work, "a long, b long"))
    release(some, rows)
    return out


def near_copies(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """id, text_key, fingerprint, component_id and root for each row: the smallest id of its group of near copies, and a number for the group."""
    ship(docs.sparkSession)
    ratio = Fraction(str(similarity))
    bits = radius(similarity)
    prints = materialise(prefixes(docs, id, text, width, ratio).withColumn("r", F.monotonically_increasing_id()))
    key = F.when(F.col("n") == 0, F.lit(b"")).otherwise(F.col("t"))
    classes = materialise(prints.groupBy(key.alias("k")).agg(F.min("r").alias("c"), F.min("d").alias("first")))
    own = prints.join(classes.select("c"), F.col("r") == F.col("c"), "left_semi")
    single = own.select(F.col("r").alias("c"), "n", "fp", F.posexplode("p").alias("i", "h"))
    shared = single.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    member = materialise(single.join(shared.hint("shuffle_hash"), "h"))

    links, known = None, None
    for turn in range(ROUNDS):
        placed = member.withColumn("g", F.col("c")) if known is None else member.join(known, "c", "left").withColumn("g", F.coalesce("component", "c")).drop("component")
        placed = placed.select("h", "c", F.struct("c", "n", "i", "fp", "g").alias("x"))
        # first by the number of rarer hashes, so that the text most like all others is at one end; then at random
        by = F.struct(F.col("x.i") if turn == 0 else F.lit(0), F.xxhash64(F.lit(turn), "x.g", "c"), "x")
        ends = placed.groupBy("h").agg(F.min(by).getField("x").alias("lo"), F.max(by).getField("x").alias("hi")).where("lo.c <> hi.c")
        star = placed.join(ends, "h").select("c", "x", F.explode(F.array(F.struct(F.lit(True).alias("low"), F.col("lo").alias("o")), F.struct(F.lit(False).alias("low"), F.col("hi").alias("o")))).alias("e"))
        star = star.select("c", "x", F.col("e.low").alias("low"), F.col("e.o").alias("o")).where(_apart("x", "o", bits, ratio))
        best = star.groupBy("c", "low", F.col("o.c").alias("b")).count().groupBy("c", "low").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
        pairs = materialise(best.select(F.col("c").alias("a"), "b").distinct())
        found = verified(pairs, classes, docs, text, width, ratio)
        release(pairs)
        before, links = links, found if links is None else materialise(links.unionByName(found))
        if not found.limit(1).count():
            break
        was, known = known, materialise(connected_components(links).select(F.col("node").alias("c"), "component"))
        release(*(x for x in (before, was) if x is not None))

    placed = member.withColumn("g", F.col("c")) if known is None else member.join(known, "c", "left").withColumn("g", F.coalesce("component", "c")).drop("component")
    pairs = _candidates(placed, own.select(F.col("r").alias("c"), "b"), bits, ratio, chunk)
    last = verified(pairs, classes, docs, text, width, ratio)
    ends = materialise(connected_components(links.unionByName(last)).select(F.col("node").alias("c"), "component"))
    rooted = classes.join(ends, "c", "left").select("k", "first", F.coalesce("component", "c").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(lowest, "root").select("k", "root", "component_id"))
    out = prints.select("d", "t", "fp", key.alias("k")).join(named, "k")
    out = materialise(out.select(F.col("d").alias(id), F.col("t").alias("text_key"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root"))
    release(prints, classes, member, pairs, last, ends, named, *(x for x in (links, known) if x is not None))
    return out
