"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

A test item leaks into a document that contains at least `threshold` of the item's distinct word
shingles. Items are partitioned by size (powers of two of their number of shingles); an item's
signature is its bottom-k MinHash, the shingles with the smallest hashes, with k set by its
partition: k = size - ceil(threshold * size) + 1 for the partition's largest size. A document
that holds `threshold` of n shingles misses at most n - ceil(threshold * n), so it must hold one
of the signature: no leak is missed, however long the document (banded MinHash, whose recall
falls with the document's length, could not promise that). Documents probe the signatures with all their
shingles; candidates are verified by exact containment of the shingles' words.

The item side is broadcast only if its measured size is within `broadcast_bytes`; beyond it, the
probe is a shuffled join of hashes, ids and text hashes. Each pair of a document and an item is verified once, however
many of its shingles hit; no text goes through the probe, whatever its length.

Words are lower-cased runs of letters and digits. An item of fewer words than `shingle` is one shingle of
all its words. Items or documents without words, or with a null text, never match. One row for each
(document, item) that matches; equal rows give equal results once. Null ids match like others.
Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialise

SEPARATOR = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATOR), "")


def _runs(words: Column, length: int) -> Column:
    """Each run of `length` words as a struct; built and taken apart in generated code, unlike a lambda."""
    n = F.greatest(F.size(words) - (length - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(words, j + 1, n).alias(f"w{j}") for j in range(length)])


def signatures(items: DataFrame, id: str, text: str, shingle: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(sig: h, item), (item, length, size, shingles): each item's bottom-k MinHash by size partition, and its shingles."""
    words = items.select(F.col(id).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(shingle))
    pieces = F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))
    full = words.select("item", length.alias("length"), F.array_distinct(pieces).alias("p")).select("item", "length", F.size("p").alias("size"), "p")
    largest = F.pow(F.lit(2), F.ceil(F.log2("size")))  # of the item's partition
    k = (largest - F.ceil(largest * threshold) + 1).cast("int")
    # a piece's hash chains its words, as xxhash64 does for several columns
    hashed = F.transform("p", lambda s: F.when(F.col("length") == shingle, F.xxhash64(*[F.get(s, F.lit(j)) for j in range(shingle)])).otherwise(_chain(s, shingle)))
    sig = full.select("item", F.explode(F.slice(F.array_sort(hashed), F.lit(1), k)).alias("h")).distinct()
    return sig, full.select("item", "length", "size", F.transform("p", lambda s: F.concat(F.lit(" "), F.array_join(s, " "), F.lit(" "))).alias("shingles")).distinct()


def _chain(s: Column, shingle: int) -> Column:
    out = F.lit(None).cast("long")
    for n in range(shingle - 1, 0, -1):
        out = F.when(F.size(s) == n, F.xxhash64(*[F.get(s, F.lit(j)) for j in range(n)])).otherwise(out)
    return out


def find_leaks(
    docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    shingle: int = 5, threshold: float = 0.8, broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """id, item_id, n_shingles, n_matched, containment for each document that holds `threshold` of an item's shingles."""
    sig, full = (materialise(x) for x in signatures(items, item_id, item_text, shingle, threshold))
    about = full.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s))), F.lit(0)).alias("bytes"), F.array_sort(F.collect_set("length")).alias("lengths")).first()
    fits = about.bytes + 64 * about.n <= broadcast_bytes
    small = F.broadcast if fits else (lambda df: df)
    tag = F.xxhash64(F.col(text).cast("string"))  # tells texts of one id apart
    words = docs.select(F.col(id).alias("d"), tag.alias("g"), words_of(F.col(text)).alias("w"))

    def hashed(n: int) -> DataFrame:
        """A row for each run of n words."""
        runs = words.select("d", "g", F.explode(_runs(F.col("w"), n)).alias("r"))
        return runs.select("d", "g", F.xxhash64(*[F.col(f"r.w{j}") for j in range(n)]).alias("h"))

    probes = [hashed(n) for n in about.lengths or [shingle]]  # one length, unless some items are very short
    hits = reduce(DataFrame.unionByName, probes).join(small(sig), "h").select(F.col("d").alias("d_"), F.col("g").alias("g_"), "item").distinct()
    hits = materialise(hits)  # the words stay behind; texts are read again for candidates only, each once for an item
    few = F.broadcast(hits) if hits.count() * 64 <= broadcast_bytes else hits
    candidate = docs.select(F.col(id).alias("d"), tag.alias("g"), F.col(text).alias("x")).join(few, F.col("d").eqNullSafe(F.col("d_")) & (F.col("g") == F.col("g_")))
    candidate = candidate.select("d", "item", F.concat(F.lit(" "), F.array_join(words_of(F.col("x")), " "), F.lit(" ")).alias("t"))
    checked = (
        candidate.join(small(full.withColumnRenamed("item", "item_")), F.col("item").eqNullSafe(F.col("item_")))
        .select("d", "item", "size", F.size(F.filter("shingles", lambda s: F.contains(F.col("t"), s))).alias("m"))
        .where(F.col("m") >= F.col("size") * F.lit(threshold))
    )
    out = checked.groupBy("d", "item").agg(F.max("size").alias("size"), F.max("m").alias("m"))
    return out.select(
        F.col("d").alias(id), F.col("item").alias(item_id), F.col("size").cast("long").alias("n_shingles"), F.col("m").cast("long").alias("n_matched"), (F.col("m") / F.col("size")).alias("containment")
    )
