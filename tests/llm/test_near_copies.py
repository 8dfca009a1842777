import random

import numpy as np
import pytest

from kinfold.llm.near_copies import near_copies, radius
from kinfold.llm.simhash import simhashes

from .helpers import SCHEMA, prose, words

pipeline = pytest.importorskip("corpus_pipeline")


def shingles(t, width=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def brute_near_dedup(rows):
    """Of (id, text, ...) with distinct non-null ids: the ids that stay."""
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    return sorted({min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))})


def edited(rng, text, changes):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), changes):
        w[i] = f"new{rng.randrange(1 << 40)}"
    return " ".join(w)


def test_near_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    base = [prose(rng, n, 3000) for n in (60, 100, 200, 400, 800, 1500)]
    texts = base + [edited(rng, t, max(1, round(len(t.split(" ")) * share))) for t in base for share in (0.002, 0.01, 0.015, 0.02, 0.024, 0.03, 0.04)]
    passage = prose(rng, 60, 3000)
    texts += [prose(rng, 30, 3000) + " " + passage for _ in range(12)]  # much in common, yet no copies
    texts += [edited(rng, base[2], 2) for _ in range(30)]
    texts += [" ".join(base[3].split(" ")[:k]) for k in (300, 318, 319, 320, 321, 330)]  # about 0.8 of the shingles
    texts += [base[1].upper(), base[1].replace(" ", "\n "), None, "", " \n", "one two", "ONE two", "one two three", base[0]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "en", "s", None) for i, t in zip(ids, texts, strict=True)]
    near = [jaccard(shingles(x), shingles(y)) for i, x in enumerate(texts[:48]) for y in texts[:i]]
    assert sum(0.8 <= x < 0.95 for x in near) > 9 and sum(0.7 <= x < 0.8 for x in near) > 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == brute_near_dedup(rows)
    small = near_copies(docs, chunk=4)  # groups cut into chunks
    assert {r.component_id for r in small.collect()} == set(brute_near_dedup(rows))


def test_radius_holds_what_is_similar():
    rng = random.Random(9)
    assert radius(0.8) == 26
    for n in (20, 60, 300, 1500):
        for _ in range(40):
            keep, other = n - round(n / 9), round(n / 9)  # a Jaccard similarity of 0.8
            a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
            b = np.concatenate([a[:keep], np.array([rng.getrandbits(64) for _ in range(other)], np.uint64)])
            x, y = (int(simhashes(h, np.array([len(h)]))[0]) for h in (a, b))
            assert (x ^ y).bit_count() <= radius(0.8)
