import random

import numpy as np
import pytest
import xxhash

from kinfold.llm import anchors
from kinfold.llm.lz_dedup import factor_documents
from kinfold.llm.simhash import fingerprints, links, near_duplicates, pivots, sweep, within
from kinfold.llm.suffix_dedup import multikey_sort, remove_repeats
from kinfold.operators.components import connected_components

from .helpers import brute_bytes, brute_windows, corpus, frame, words


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 3000).astype(np.uint8)
    raw[500:700], raw[900:1100] = raw[1500:1700], 97
    for width, gram in ((13, 5), (20, 4), (20, 20)):
        s, n, off, a, _ = anchors.runs_of(anchors.byte_symbols(raw)[0], np.full(3000, 3000), width, gram)
        assert n.sum() == 3000 - width + 1
        seen = {}
        for si, ni, oi, ai in zip(s, n, off, a, strict=True):
            for j in range(ni):
                assert 0 <= oi - j <= width - gram
                assert seen.setdefault(raw[si + j : si + j + width].tobytes(), (ai, oi - j)) == (ai, oi - j)


def test_multikey_sort():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2, (500, 24)).astype(np.uint8)
    order, lcp = multikey_sort(keys)
    rows = [keys[i].tobytes() for i in order]
    assert rows == sorted(rows)
    for x, y, n in zip(rows, rows[1:], lcp[1:], strict=False):
        assert x[:n] == y[:n] and (n == 24 or x[n] != y[n])


@pytest.mark.parametrize("rows", [corpus(), corpus(2, 15) + [(None, corpus(2, 15)[3][1]), (7, "same id, other text " * 9)], []], ids=["corpus", "nulls", "empty"])
def test_lz_factors_match_brute_force(spark, rows):
    got = factor_documents(frame(spark, rows), width=13).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got], key=repr) == brute_windows(rows, 13)
    text = {i: words(t) for i, t in rows if i != 7}
    for r in got:
        for f in r.factors:
            if r.doc_id != 7 and f.ref != 7 and r.doc_id is not None:
                assert f.ref < r.doc_id and text[r.doc_id][f.begin : f.begin + f.length] == text[f.ref][f.ref_begin : f.ref_begin + f.length]


def test_a_copy_is_one_factor(spark):
    rng = random.Random(3)
    w = [f"w{i}" for i in range(200)]
    middle, head, tail = w[:30], w[40:60], w[60:80]
    rows = [(0, " ".join(w[100:110] + middle)), (1, " ".join(head + middle + tail)), (2, " ".join(head + middle + tail)), (3, " ".join(middle + tail))]
    rng.shuffle(rows)
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in factor_documents(frame(spark, rows)).collect()}
    # document 1 has but the middle of 0; the first words of 3 are named for 0, yet 1 goes on longer
    assert got == {0: [], 1: [(20, 30, 0, 10)], 2: [(0, 70, 1, 0)], 3: [(0, 50, 1, 20)]}


def _greedy(rows, width):
    """Factors of each document: in each stretch of hits the first documents of its windows, each on its diagonal, are followed word by word."""
    text = {i: words(t) for i, t in rows}
    first = {}
    for i in sorted(text):
        for s in range(len(text[i]) - width + 1):
            first.setdefault(tuple(text[i][s : s + width]), (i, s))
    out = {}
    for i, w in text.items():
        named = [first[tuple(w[s : s + width])] for s in range(len(w) - width + 1)]
        hit = [n[0] < i for n in named]
        factors, s = [], 0
        while s < len(hit):
            if not hit[s]:
                s += 1
                continue
            a, b = s, s
            while a and hit[a - 1]:
                a -= 1
            while b < len(hit) and hit[b]:
                b += 1
            best = None
            for x in range(a, b):
                ref, shift = named[x][0], named[x][1] - x
                v, n = text[ref], 0
                while s + n < min(len(w), b - 1 + width) and 0 <= s + n + shift < len(v) and w[s + n] == v[s + n + shift]:
                    n += 1
                if n >= width and (best is None or (-n, ref, shift) < best):
                    best = (-n, ref, shift)
            factors.append((s, -best[0], best[1], s + best[2]))
            s -= best[0]
        out[i] = factors
    return out


def test_factors_are_greedy(spark):
    rng = random.Random(4)
    fresh = iter(range(10**6))
    texts = []
    for _ in range(120):
        parts = [f"n{next(fresh)}" for _ in range(rng.randrange(5, 30))]
        for _ in range(rng.randrange(4)):
            if texts:
                other = rng.choice(texts)
                a = rng.randrange(len(other))
                piece = other[a : a + rng.randrange(5, 60)]
                if not set(piece) & set(parts):  # no word twice in a text, so each window has one place in it
                    parts += piece
        texts.append(parts + [f"n{next(fresh)}" for _ in range(rng.randrange(10))])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = _greedy(rows, 5)
    assert sum(len(x) for x in want.values()) > 25 and any(len(x) > 1 for x in want.values())
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in factor_documents(frame(spark, rows), width=5, gram=2).collect()}
    assert got == want


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"room": 2}], ids=["plain", "hot", "small buckets"])
def test_suffix_dedup_matches_brute_force(spark, options):
    rows = corpus(3, 25)
    got = remove_repeats(frame(spark, rows), width=40, gram=16, **options).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=repr) == brute_bytes(rows, 40)
    assert {r.others.kept for r in got} == {"clash"}


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"room": 2}], ids=["plain", "hot", "small buckets"])
def test_suffix_dedup_can_keep_the_first_place(spark, options):
    rows = corpus(3, 25) + [(None, corpus(3, 25)[3][1])]
    got = remove_repeats(frame(spark, rows), width=40, gram=16, keep_first=True, **options).collect()
    want = brute_bytes(rows, 40, keep_first=True)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=repr) == want
    assert sum(x[2] for x in want) < sum(x[2] for x in brute_bytes(rows, 40))


def test_suffix_dedup_whole_characters_and_empty_table(spark):
    rows = [(1, "a" + "é" * 40), (2, "b" + "é" * 40), (3, None)]
    for r in remove_repeats(frame(spark, rows), width=41, gram=16, whole_chars=True).collect():
        bytes(r.kept).decode()
        assert r.n_removed == sum(s.end - s.begin for s in r.spans)
    assert remove_repeats(frame(spark, [])).collect() == []


def _fingerprint(t, width=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = words(t)
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < width else [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_matches_brute_force(spark):
    rows = corpus(4, 60)
    f = [_fingerprint(t) for _, t in rows]
    root = _components(len(rows), [(i, j) for i in range(len(f)) for j in range(i) if bin(f[i] ^ f[j]).count("1") <= 3])
    lowest = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((rows[i][0], f"{f[i]:016x}", lowest[root[i]]) for i in range(len(rows)))
    assert near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("chunk", [3, 4096])
def test_links_of_dense_groups(spark, chunk):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4, dtype=np.int64)
    values = {int(b ^ sum(1 << int(x) for x in rng.choice(62, rng.integers(0, 4), replace=False))) for b in base for _ in range(40)}
    values = sorted(values)
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 3]
    want = _components(len(values), pairs)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = links(df, chunk=chunk)
    assert found.count() < len(values) * 10 * (2 if chunk > 3 else 60)
    index = {v: i for i, v in enumerate(values)}
    got = _components(len(values), [(index[r.a], index[r.b]) for r in found.collect()])
    assert got == want


def test_pivots_avoid_pairs():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 1 << 63, 900, dtype=np.int64).astype(np.uint64)
    fp[600:] = fp[:300] ^ np.array([sum(1 << int(x) for x in rng.choice(62, 3, replace=False)) for _ in range(300)], np.uint64)
    fp, group = rng.permutation(fp), np.sort(rng.integers(0, 2, 900))
    close = {(i, j) for i in range(900) for j in range(i + 1, 900) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}
    pairs = sum(int(n) * (int(n) - 1) // 2 for n in np.bincount(group))
    made = [(int(i), int(j)) for a, b in sweep(fp, group, 3, room=1000) for i, j in zip(a, b, strict=True)]
    assert len(made) == len({tuple(sorted(x)) for x in made}) < 0.3 * pairs
    table = np.stack([np.bitwise_count(fp ^ p).astype(int) for p in pivots()])
    assert all((abs(table[:2, i] - table[:2, j]) <= 3).all() for i, j in made)
    for side in (np.zeros(900, int), rng.integers(1, 3, 900)):
        got = {tuple(sorted((int(i), int(j)))) for a, b in within(fp, group, side, 3) for i, j in zip(a, b, strict=True)}
        assert got == {(i, j) for i, j in close if not side[i] or side[i] != side[j]}
    assert len(close) > 100


def test_fingerprints_keep_every_row(spark):
    rows = corpus(6, 10) + [(None, "a b c")]
    assert fingerprints(frame(spark, rows)).count() == len(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_repeated_ids_with_other_texts_stay_apart(spark):
    rows = [(1, "p q r s t u v w x y z aa bb cc " * 2), (1, "other"), (2, "p q r s t u v w x y z aa bb cc")]
    got = factor_documents(frame(spark, rows)).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 0), (1, 28, 0), (2, 14, 14)]
