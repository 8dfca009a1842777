r"""Chat formatting by token-level assembly.

Each segment (a role, a text) is encoded by itself with a lossless byte-level vocabulary;
the template's marks are ids above that vocabulary, spliced between the segments, so no
merge crosses a boundary and no text can produce a mark. In the formatted text the marks
are control strings, and control strings inside a role or text get one more backslash in
front of them (reversible: `\`*n + mark becomes `\`*(n+1) + mark). The loss mask is the
prefix sum of +1 at the start and -1 at the end of each learned segment.

Results: one row per conversation. Turns go by (turn, role, text), nulls first; equal rows
each count. A null text or role is the empty string. Rows with a null conversation id form
one conversation of their own. An empty table gives an empty result. Only the id, turn,
role and text columns are read. A text of any length is one segment; a conversation must fit a worker.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import ship


@dataclass(frozen=True)
class Template:
    """start role mid text end, for each turn. All of `controls` are escaped inside segments."""

    start: str = "<s>[INST]"
    mid: str = "\n[/INST]\n"
    end: str = "\n</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned_roles: tuple[str, ...] = ("assistant",)

    def patterns(self):
        marks = "|".join(regex.escape(x) for x in sorted(self.controls, key=len, reverse=True))
        return regex.compile(rf"\\*(?:{marks})"), regex.compile(rf"\\(\\*(?:{marks}))")


class Formatter:
    """Encodes, splices, masks and reads back with one vocabulary (a rank file) and one template."""

    def __init__(self, ranks_file: str, pattern: str, template: Template):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.base = max(ranks.values()) + 1
        self.t, (self.to_escape, self.escaped) = template, template.patterns()
        #: reserved ids: start, mid, end
        self.start, self.mid, self.end = (self.base + i for i in range(3))
        self.marks = dict(zip((self.start, self.mid, self.end), (template.start, template.mid, template.end), strict=True))

    def escape(self, s: str) -> str:
        return self.to_escape.sub(lambda m: "\\" + m[0], s)

    def unescape(self, s: str) -> str:
        return self.escaped.sub(lambda m: m[1], s)

    def assemble(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the conversation and its loss mask."""
        parts: list[list[int]] = []
        learned: list[int] = []
        for role, text in zip(roles, texts, strict=True):
            body = self.enc.encode_ordinary(self.escape(text))
            parts += [[self.start], self.enc.encode_ordinary(self.escape(role)), [self.mid], body, [self.end]]
            learned += [0, 0, 0, role in self.t.learned_roles, 0]
        ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, int)
        ids = np.fromiter((x for p in parts for x in p), np.int32, int(ends[-1]) if len(ends) else 0)
        step = np.zeros(len(ids) + 1, np.int32)
        on = np.flatnonzero(learned)
        np.add.at(step, ends[on] - np.array([len(parts[i]) for i in on], int), 1)
        np.add.at(step, ends[on], -1)
        return ids, np.cumsum(step[:-1]).astype(np.int8)

    def text_of(self, ids: np.ndarray) -> str:
        """The formatted text."""
        out, cuts = [], np.flatnonzero(ids >= self.base)
        at = 0
        for c in [*cuts.tolist(), len(ids)]:
            out.append(self.enc.decode(ids[at:c].tolist()))
            out.append(self.marks[int(ids[c])] if c < len(ids) else "")
            at = c + 1
        return "".join(out)

    def turns_of(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """The (role, text) pairs, read back."""
        cuts = np.flatnonzero(ids >= self.base).tolist()
        plain = [self.unescape(self.enc.decode(ids[a + 1 : b].tolist())) for a, b in zip(cuts, cuts[1:], strict=False)]
        return [(plain[i], plain[i + 1]) for i in range(0, len(plain), 3)]

    def learned_of(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """Texts under the loss mask, each run unescaped by itself."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
        return [self.unescape(self.enc.decode(ids[a:b].tolist())) for a, b in zip(edge[::2], edge[1::2], strict=True)]


_formatters: dict[tuple, Formatter] = {}


def _formatter(*key) -> Formatter:
    if key not in _formatters:
        _formatters[key] = Formatter(*key)
    return _formatters[key]


def format_chats(
    turns: DataFrame, ranks_file: str, pattern: str, template: Template = Template(), *,
    id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: id, n_turns, ids, loss_mask, formatted."""
    ship(turns.sparkSession)
    kind = turns.schema[id].dataType.simpleString()
    whole = (
        turns.select(F.col(id).alias("c"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("x"))
        .groupBy("c").agg(F.sort_array(F.collect_list("x")).alias("x"))
        .select("c", F.col("x.role").alias("roles"), F.col("x.text").alias("texts"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _formatter(ranks_file, pattern, template)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                done = [f.assemble(r, t) for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) for x in part.column(1)], pa.int64()),
                    pa.array([x for x, _ in done], pa.list_(pa.int32())), pa.array([m for _, m in done], pa.list_(pa.int8())),
                    pa.array([f.text_of(x) for x, _ in done], pa.string()),
                ], names=[id, "n_turns", "ids", "loss_mask", "formatted"])

    return whole.mapInArrow(run, f"`{id}` {kind}, n_turns long, ids array<int>, loss_mask array<byte>, formatted string")


def digest(formatted: DataFrame, ranks_file: str, pattern: str, template: Template = Template(), *, id: str = "conv_id") -> DataFrame:
    """Digests read back from the output's ids and mask: what a reader of the output recovers."""
    kind = formatted.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _formatter(ranks_file, pattern, template)
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                ids, mask = b.column(1)[i].values.to_numpy(zero_copy_only=False), b.column(2)[i].values.to_numpy(zero_copy_only=False)
                turns, loss = f.turns_of(ids), "".join(f.learned_of(ids, mask))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(b.column(3)[i].as_py())))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], names=[id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(id, "ids", "loss_mask", "formatted").mapInArrow(
        run, f"`{id}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
