"""Near-duplicate documents by SimHash, with pivot distance tables.

1. A 64-bit fingerprint for each document (Arrow batches; XXH64 of word shingles).
2. Equal fingerprints become one class, so exact copies cost one row from here on.
3. Pairs: a pivot table alone keeps about half of all random pairs per reference, so it
   cannot replace partitioning. Fingerprints are first dealt out by every choice of
   `blocks - distance` bit blocks (two words within `distance` bits agree on one such
   choice: complete). In each bucket the Hamming distances to the reference
   fingerprints are tabulated once. By the triangle inequality a pair whose coordinates
   differ by more than `distance` anywhere is no link: the bucket is sorted by its first two coordinates
   and swept, so that most such pairs are never made; the other coordinates discard most of the rest
   and survivors are verified.
4. A bucket gives a spanning forest of its links, never all its pairs; a bucket of more
   than `chunk` members is cut into chunks whose pairs of chunks are separate groups.
5. Components by large-star/small-star.

`near_duplicates(similarity=...)` links texts by the Jaccard similarity of their distinct shingles instead: see `near_copies`,
which uses the same fingerprints, groups and sweep at the radius that such a similarity needs.

Results: one row per input row. Null or word-free texts have fingerprint zero and are
linked like any other. A component without any non-null id has a null component_id.
Repeated ids are separate rows. Only the id and text columns are read. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.components import connected_components
from kinfold.session import materialise, release, ship

#: How many reference fingerprints a pivot table has.
PIVOTS = 16
CHUNK = 4096
#: From this distance on no pivot tells anything: coordinates of random words differ by 5.7 on average, by 16 hardly ever.
WIDE = 12


def shingle_hashes(raw: bytes, width: int, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of A-Z-lowered words, repeats included; fewer words: of the whole sequence."""
    words = raw.lower().split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(b" ".join(words), seed)]
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [x - 1 for x in starts[width:]]
    ends.append(at - 1)
    return [h(joined[a:b], seed) for a, b in zip(starts, ends, strict=False)]


def simhashes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: a bit is set if it is in over half of a run; zero for an empty run."""
    fp = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        fp[full] = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return fp


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 3, chunk_bytes: int = 1 << 20) -> DataFrame:
    """(id, fp): the SimHash of each row as a signed long; bit set if set in over half the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, hashes, sizes, held = [], [], [], 0
            for t in pc.cast(b.column(1), pa.binary()):
                raw = t.as_py() or b""
                mine = shingle_hashes(raw, width)
                hashes += mine
                sizes.append(len(mine))
                held += len(raw)
                if held > chunk_bytes:
                    done.append(simhashes(np.array(hashes, np.uint64), np.array(sizes)))
                    hashes, sizes, held = [], [], 0
            done.append(simhashes(np.array(hashes, np.uint64), np.array(sizes, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(done).view(np.int64))], names=[id, "fp"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id), F.col(text).cast("string")).mapInArrow(run, f"`{id}` {kind}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: n pseudo-random words, the same on every machine."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", 42) for i in range(n)], np.uint64)


def sweep(fp: np.ndarray, group: np.ndarray, distance: int, room: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (as indices) of each run of equal `group` whose first two pivot coordinates differ by `distance` at most; about `room` pairs at a time.

    Rows sorted by (group, first, second coordinate) have the partners of a row in one stretch for each value of the first.
    """
    n = len(fp)
    near, far = (np.bitwise_count(fp ^ p).astype(np.int64) for p in pivots(2))
    number = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if n else group
    wide = 65 + 2 * distance
    key = (number * wide + near + distance) * wide + far + distance
    order = np.argsort(key, kind="stable")
    key = key[order]
    for step in range(distance + 1):
        low = np.searchsorted(key, key + step * wide - distance, "left")
        high = np.searchsorted(key, key + step * wide + distance, "right")
        if step == 0:
            low = np.arange(1, n + 1)  # each pair once
        size = np.maximum(high - low, 0)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, "right")))
            rows = size[at:upto]
            left = np.repeat(np.arange(at, upto), rows)
            right = np.arange(len(left)) - np.repeat(np.cumsum(rows) - rows, rows) + low[left]
            if len(left):
                yield order[left], order[right]
            at = upto


def within(fp: np.ndarray, group: np.ndarray, side: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (as indices) of each run of equal `group` within `distance`: swept, discarded by the pivot table, verified. See `in_groups` for `side`."""
    table = [np.bitwise_count(fp ^ p).astype(np.int8) for p in pivots()[2:]] if distance < WIDE else []
    for i, j in sweep(fp, group, distance):
        keep = (side[i] == 0) | (side[i] != side[j])
        i, j = i[keep], j[keep]
        for column in table:
            keep = np.abs(column[i] - column[j]) <= distance
            i, j = i[keep], j[keep]
            if not len(i):
                break
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        yield i[keep], j[keep]


def _forest(fp: np.ndarray, group: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as indices) that span, in each run of equal `group`, the components under Hamming distance <= `distance`."""
    parent = np.arange(len(fp))
    for i, j in within(fp, group, side, distance):
        while True:
            a, b = parent[i], parent[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    linked = np.flatnonzero(parent != np.arange(len(fp)))
    return linked, parent[linked]


def in_groups(member: DataFrame, keys: list[str], columns: list[str], work: Callable, schema: str, chunk: int) -> DataFrame:
    """work(group, side, *columns) over the rows of equal `keys`; `member` has keys, columns and `n_`, how many rows its key has.

    A key of more than `chunk` rows is cut into chunks. Each chunk is a group, with side 0, and so is each pair of chunks, with sides
    1 and 2, where only pairs of different sides are asked for: no pair of rows is left out or met twice, and no group has
    over about 2 * `chunk` rows. A key of one chunk is one group.
    """
    parts = F.ceil(F.col("n_") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64(*columns), parts).cast("int")
    spread = member.select(*keys, *columns, own.alias("own_"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other_"))
    all_keys = [*keys, "p_", "q_"]
    side = F.when(F.col("own_") == F.col("other_"), 0).when(F.col("own_") < F.col("other_"), 1).otherwise(2)
    spread = spread.select(*keys, F.least("own_", "other_").alias("p_"), F.greatest("own_", "other_").alias("q_"), side.alias("side_"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        last, number, size = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(c) for c in b.columns]
            marks, rest = cols[: len(all_keys)], cols[len(all_keys) :]
            new = np.zeros(b.num_rows, bool)
            for c in marks:
                new[1:] |= c[1:] != c[:-1]
            new[0] = tuple(c[0] for c in marks) != last
            last = tuple(c[-1] for c in marks)
            group = number + np.cumsum(new)
            number = int(group[-1])
            held.append([group, *rest])
            size += b.num_rows
            if size > 1 << 18:  # the last group may be unfinished
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(whole[0], number))
                yield from work(*(x[:cut] for x in whole))
                held, size = [[x[cut:] for x in whole]], len(whole[0]) - cut
        if held:
            yield from work(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return spread.repartition(*all_keys).sortWithinPartitions(*all_keys).mapInArrow(run, schema)


def links(fps: DataFrame, *, fp: str = "fp", distance: int = 3, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span the components under Hamming distance <= `distance`."""
    if blocks is None:  # wider keys for more rows; complete for any choice
        blocks = distance + 2 if fps.count() < 1 << 26 else distance + 3
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - distance):
        m = sum(((1 << (cuts[c + 1] - cuts[c])) - 1) << cuts[c] for c in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    dealt = fps.select(F.col(fp).alias("fp"), F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(fp).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("x")).select("x.c", "x.k", "fp")
    sizes = dealt.groupBy("c", "k").agg(F.count("*").alias("n_")).where("n_ > 1")
    member = dealt.join(sizes, ["c", "k"])

    def work(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = _forest(fp.view(np.uint64), group, side, distance)
        yield pa.RecordBatch.from_arrays([pa.array(fp[x]), pa.array(fp[y])], names=["a", "b"])

    return in_groups(member, ["c", "k"], ["fp"], work, "a long, b long", chunk).distinct()


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3, similarity: float | None = None) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: the smallest id reachable over links.

    Links are fingerprints within `distance`; or, with `similarity`, texts of that Jaccard similarity of their distinct shingles,
    and then the fingerprints are of the distinct shingles and a column text_key (`near_copies.text_key`) tells rows of one id apart.
    """
    if similarity is not None:
        from kinfold.llm.near_copies import near_copies

        return near_copies(docs, id=id, text=text, width=width, similarity=similarity)
    ship(docs.sparkSession)
    prints = materialise(fingerprints(docs, id=id, text=text, width=width))
    classes = materialise(prints.groupBy("fp").agg(F.min(id).alias("first")))
    found = connected_components(links(classes, distance=distance))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(lowest, "root").select("fp", "component_id"))
    release(classes)
    return prints.join(named, "fp").select(id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
