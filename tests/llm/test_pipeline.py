import math
import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from .helpers import SCHEMA, prose  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("tables")
    item = prose(rng, 40)
    clean = [(i, prose(rng, 120, 3000), "en", f"s{i % 3}", None) for i in range(80)]
    passage = prose(rng, 60, 3000)
    docs = clean + [
        (100, clean[5][1], "en", "s0", None),
        (101, clean[6][1] + " " + passage, "en", "s1", None),
        (102, prose(rng, 100, 3000) + " " + passage + " " + prose(rng, 60, 3000), "fr", "s1", None),
        (103, prose(rng, 90, 3000) + " " + item + " " + prose(rng, 90, 3000), "en", None, None),
        (104, None, "en", "s2", None),
        (105, "short", "en", "s2", None),
        (106, "so it goes " * 60, "en", "s2", None),
        (107, prose(rng, 90, 3000) + " " + passage, "en", "s1", None),
    ]
    docs.append(docs[7])
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, passage


def test_decisions_take_effect(spark, tables):
    folder, docs, passage = tables
    out = {r.doc_id: r for r in pipeline.run(spark, folder).collect()}
    assert set(out) == set(range(80)) | {101, 102, 107}  # copy, leak, short, empty and repetitive ones are gone
    text = {d[0]: d[1] for d in docs}
    assert [i for i in sorted(out) if passage in out[i].text] == [101]  # its first place
    for i, r in out.items():
        if i < 102:
            assert r.text == (text[i] if i != 101 else " " + passage)
        assert r.n_chars is None or r.n_chars == len(r.text)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]


#: Names that stages and operators use inside, or might.
NAMES = ["d_", "s_", "size_", "size", "target", "copies", "taken", "keep_", "leak_", "a.b", "row", "d", "t", "s", "r", "x", "k", "root", "others", "had_text", "kept", "z", "again", "fits"]


@pytest.mark.parametrize("clash", [False, True])
def test_stages_keep_columns_and_take_empty_tables(spark, tables, clash):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    if clash:
        docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")) for c in NAMES})
    last = pipeline.STAGES[-1][0]
    for name, stage in pipeline.STAGES:
        columns = docs.columns if name != last else [c for c in docs.columns if c not in ("size", "target", "copies", "taken")] + ["size", "target", "copies", "taken"]
        assert stage(spark, docs.where("false"), folder).count() == 0, name
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        rows = docs.collect()
        assert rows
        for r in rows if clash else []:
            assert all(r[c] == f"{c} {r.doc_id}" for c in NAMES if name != last or c not in ("size", "target", "copies", "taken"))


def test_decisions_tell_rows_of_one_id_apart(spark, tables):
    folder, docs, _ = tables
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    rng = random.Random(12)
    clean, other, leak = prose(rng, 90, 3000), prose(rng, 90, 3000), prose(rng, 30, 3000) + " " + item
    rows = [(None, clean, "en", "s0", None), (None, leak, "en", "s0", None), (5, other, "en", "s0", None), (5, leak + " x", "en", "s0", None), (6, clean + " end", "en", "s1", None), (None, None, "en", "s1", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = pipeline.decontamination(spark, df, folder).collect()
    assert sorted((tuple(r) for r in kept), key=repr) == sorted((rows[i] for i in (0, 2, 4, 5)), key=repr)
    rows += [(7, leak, "en", "s1", None), (5, other + " end", "en", "s1", None), (None, "q " + prose(rng, 70, 3000), "en", "s1", None)]
    kept = pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()
    fives = [t for _, t, *_ in rows if t and t.startswith(other)]
    got = [(r.doc_id, r.text) for r in kept]
    assert sum(t in fives for _, t in got) == 1
    assert sorted([x for x in got if x[1] not in fives], key=repr) == sorted([(5, leak + " x"), (6, clean + " end"), (None, None), (None, rows[-1][1])], key=repr)


def test_mixing_makes_the_copies(spark, tables):
    folder, *_ = tables
    rng = random.Random(13)
    docs = spark.createDataFrame([(i, prose(rng, rng.randrange(20, 200)), "en", f"s{i % 3}", None) for i in range(150)], SCHEMA)
    plan = pipeline.mixing(spark, docs, folder)
    copies = {r.doc_id: r.copies for r in plan.collect()}
    assert len(copies) == 150 and set(copies.values()) >= {0, 1, 2}
    taken = pipeline.take(plan)
    assert taken.columns == plan.columns
    assert sorted(r.doc_id for r in taken.collect()) == sorted(i for i, n in copies.items() for _ in range(n))


def test_run_matches_brute_force(spark, tmp_path):
    """All five stages over a corpus with near copies, passages, leaks and bad labels."""
    from kinfold.llm.quality_rules import learn

    from .helpers import brute_bytes, targets, words
    from .test_near_copies import brute_near_dedup, edited
    from .test_rows import _counts, _shingles

    rng = random.Random(21)
    item, passage = prose(rng, 30, 3000), prose(rng, 70, 3000)
    texts = [prose(rng, rng.randrange(60, 200), 3000) for _ in range(60)]
    texts += [" ".join(w + rng.choice(["##", "$$", ""]) for w in prose(rng, 90, 3000).split()) for _ in range(30)]  # bad ones
    texts += [edited(rng, texts[i], 1) for i in range(0, 30, 3)] + [texts[5], texts[7]]
    texts += [prose(rng, 60, 3000) + " " + passage + " " + prose(rng, 20, 3000) for _ in range(5)]
    texts += [prose(rng, 60, 3000) + " " + item + " " + prose(rng, 60, 3000) for _ in range(3)] + [None, "", "short one", "so it goes " * 40]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None) for i, t in zip(order, texts, strict=True)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(order[k], int(not 60 <= k < 90), 0) for k in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    rules = learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert rules

    def good(t):
        n, chars, symbols, dup, again = _counts(t)
        if n < 50 or 100 * again > 50 * n:
            return False
        lines = [x for x in t.split("\n") if words(x)]
        x = {"words": n, "word_length": chars / n, "symbol_share": symbols / n, "dup_line_share": dup / len(lines), "repeat_share": again / n, "vocabulary_growth": math.log(len(set(words(t)))) / math.log(n)}
        return not any(all((x[c.feature] > c.cut) == c.above for c in rule) for rule in rules)

    left = [r for r in rows if good(r[1])]
    assert len(left) < len(rows) - 30
    stays = set(brute_near_dedup(left))
    left = [r for r in left if r[0] in stays]
    cut = {i: kept.decode() for i, _, _, _, kept in brute_bytes([(r[0], r[1]) for r in left], 200, keep_first=True)}
    left = [(r[0], cut[r[0]], *r[2:]) for r in left]
    shingles, _ = _shingles(item)
    leaks = {r[0] for r in left if len(shingles & {tuple(w[k : k + 5]) for w in [_shingles(r[1])[1]] for k in range(len(w) - 4)}) >= 0.8 * len(shingles)}
    assert leaks  # where the item repeats it has been cut, but for its first place
    left = [r for r in left if r[0] not in leaks]
    want, total = targets([(r[3], len(words(r[1]))) for r in left])

    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r[0], r[1]) for r in left)
    for r in got:
        assert r["size"] == len(words(r.text)) and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    for s, t in want.items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 0.02 * t + 2
