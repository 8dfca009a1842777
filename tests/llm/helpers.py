"""Small corpora with awkward rows, and brute-force versions of the operators."""

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; they must not mind such columns.
CLASHES = ["n_words", "kept", "a", "c", "d", "g", "h", "t", "p", "size", "taken", "runs", "fp", "item", "w", "k", "bad", "x"]


def prose(rng, n, words=400):
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéü", k=rng.randrange(2, 9))) for _ in range(words)]
    return " ".join(rng.choices(vocabulary, k=n))


def corpus(seed=1, n=40):
    """(doc_id, text): prose, exact and near copies, shared passages, repetition, odd white space, nulls, a long text, repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(5, 160)) for _ in range(n)]
    shared = prose(rng, 60)
    for i in range(3, n, 7):
        texts[i] = texts[i] + "\n" + shared + " " + prose(rng, 30)
    for i in range(5, n, 9):
        texts[i] = texts[i - 2]
    for i in range(6, n, 11):
        w = texts[i - 4].split(" ")
        w[len(w) // 2] = "changed"
        texts[i] = " ".join(w)
    texts += [None, "", "  \n\t ", "one", "one two", "so it goes " * 60, "aaaa" * 150, "x\x0by\x0cz w  v", prose(rng, 4000), "", None, "éé" * 90 + shared]
    rows = list(enumerate(texts))
    return rows + [rows[3], rows[n + 6]]


def frame(spark, rows, clash=True):
    full = [(i, t, "en", f"s{i % 3}" if i is None or i % 5 else None, len(t) if t is not None else None) if i is not None else (None, t, "en", "s0", None) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASHES})
    return df


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_windows(rows, width):
    """For op2: kept words of each row."""
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for s in range(len(w) - width + 1):
                key = tuple(w[s : s + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            f = first.get(tuple(w[s : s + width]))
            if f is not None and (i is None or f < i):
                gone[s : s + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return sorted(out, key=repr)


def brute_bytes(rows, width, keep_first=False):
    """For op5: n_bytes, n_removed, n_spans, kept of each row. keep_first: ids must be unique, but for equal rows."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + width] for _, b in raw for s in range(len(b) - width + 1))
    first = {}
    for i, b in raw:
        for s in range(len(b) - width + 1):
            first[b[s : s + width]] = min(first.get(b[s : s + width], (True, 0, 0)), (i is None, i or 0, s))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1 and not (keep_first and first[b[s : s + width]] == (i is None, i or 0, s)):
                gone[s : s + width] = [True] * width
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def targets(rows, cap=3):
    """For op6: (target, size) of each source of (source, size) rows, reshared round by round."""
    total = {}
    for s, n in rows:
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, fixed = {s: i % 3 + 1 for i, s in enumerate(order)}, {}
    while True:
        free = [s for s in order if s not in fixed]
        left = sum(total.values()) - sum(fixed.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > cap * total[s]]
        if not over:
            return {s: fixed.get(s, left * weight[s] / sum(weight[x] for x in free) if free else 0) for s in order}, total
        fixed |= {s: float(cap * total[s]) for s in over}
