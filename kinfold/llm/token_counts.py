"""Token counts with a map-side two-tier lookup.

Tier one is a broadcast table of frequent pre-tokens and their token counts, bounded by
`table_size`; tier two is a bounded cache in each Python worker in front of the tokenizer.
Every text is split where it lies: no pre-token is shuffled to count tokens. The frequent
table only decides speed: it comes from a sample whose share is `sample_share`, and any
pre-token it lacks is encoded by the library itself.

Results: one row per input row, duplicates included. A null text counts as empty (0 bytes,
0 tokens). A null id is kept. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import ship

#: The byte-level pre-tokenizer's published split pattern, with the white-space property spelt out
#: (`\s` of the regex module also has U+001C..1F). Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
LONGEST_KEPT = 40
_workers: dict[str, "Counts"] = {}


class Table(dict):
    """Known lengths of pre-tokens, the frequent ones first of all; what is not known counts 0 and is noted in `missed`."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.missed: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.missed.append(piece)
        return 0


class Counts:
    """A tokenizer in one worker: counts(texts) as the library gives them."""

    def __init__(self, path: str, frequent: dict[str, int], cache_size: int = 400_000):
        self.cache_size, self.frequent, self.table = cache_size, frequent, Table(frequent)
        self.two_tier, self.special = False, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.encode = lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.two_tier = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.split, self.pieces, self.alike = regex.compile(SPLIT).findall, tok.pre_tokenizer, {}

    def same_class(self, c: str) -> bool:
        """Whether this module's Unicode tables and the tokenizer's split around character `c` alike."""
        if c not in self.alike:
            tries = (f"a{c}a", f"1{c}1", f"!{c}!", f" {c} a", f"a{c}")
            self.alike[c] = all([t[x:y] for _, (x, y) in self.pieces.pre_tokenize_str(t)] == self.split(t) for t in tries)
        return self.alike[c]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.two_tier:
            return self.encode(texts)
        out, direct, unknown = [], [], {}
        table, split = self.table, self.split
        for i, text in enumerate(texts):
            if any(s in text for s in self.special) or not (text.isascii() or all(map(self.same_class, set(text)))):
                out.append(0)
                direct.append(i)
                continue
            out.append(sum(map(table.__getitem__, split(text))))
            if table.missed:
                unknown[i] = table.missed
                table.missed = []
        if unknown:
            pieces = list({x for m in unknown.values() for x in m})
            new = dict(zip(pieces, self.encode(pieces), strict=True))
            for i, missed in unknown.items():
                out[i] += sum(map(new.__getitem__, missed))
            if len(table) + len(new) > self.cache_size + len(self.frequent):
                table.clear()
                table.update(self.frequent)
            table.update((k, v) for k, v in new.items() if len(k) <= LONGEST_KEPT)
        for i, n in zip(direct, self.encode([texts[i] for i in direct]) if direct else [], strict=True):
            out[i] = n
        return out


def _frequent_of(path: str, keep: int):
    """For each task its `keep` most frequent pre-tokens (one summary, whatever the task's size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = regex.compile(SPLIT).findall, Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(x for x in split(t.as_py() or "") if len(x) <= LONGEST_KEPT)
                if len(seen) > 20 * keep:
                    seen = Counter(dict(seen.most_common(5 * keep)))
        top = seen.most_common(keep)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([k for k, _ in top], pa.string()), "n": pa.array([v for _, v in top], pa.int64())})

    return run


def frequent_table(docs: DataFrame, path: str, text: str, table_size: int, sample_share: float, seed: int = 7) -> dict[str, int]:
    """The `table_size` most frequent pre-tokens of a sample and their token counts: at most a few MB."""
    worker = Counts(path, {})
    if not worker.two_tier or not table_size:
        return {}
    sample = docs.select(F.col(text).cast("string").alias("t")).sample(sample_share, seed)
    top = (
        sample.mapInArrow(_frequent_of(path, max(1000, table_size // 8)), "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_size).collect()
    )
    pieces = [r.piece for r in top]
    return dict(zip(pieces, worker.encode(pieces) if pieces else [], strict=True))


def count_tokens(
    docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", limit: int = 512,
    table_size: int = 20_000, sample_share: float = 0.02, chunk_bytes: int = 1 << 20,
) -> DataFrame:
    """Return id, n_bytes, n_tokens, over_limit for each row of `docs`. See the module's docstring for odd inputs."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(frequent_table(docs, tokenizer, text, table_size, sample_share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _workers.get(tokenizer)
        if worker is None or worker.frequent is not shared.value:
            worker = _workers[tokenizer] = Counts(tokenizer, shared.value)
        for b in batches:
            texts = b.column(1)
            sizes = [0 if x is None else x for x in pa.compute.binary_length(texts).to_pylist()]
            counts: list[int] = []
            at = 0
            while at < len(sizes):  # a few texts at a time, so a batch of long ones is never decoded at once
                end, held = at, 0
                while end < len(sizes) and (end == at or held + sizes[end] <= chunk_bytes):
                    held += sizes[end]
                    end += 1
                counts += worker.counts([x or "" for x in texts.slice(at, end - at).to_pylist()])
                at = end
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), n, pa.compute.greater(n, limit)], names=[id, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id), F.col(text).cast("string")).mapInArrow(run, f"`{id}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
