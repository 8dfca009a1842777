"""Learned quality rules: a decision list over text statistics, in DataFrame functions only.

`statistics` derives counts from each whole text with built-in functions. `learn` takes a
bounded sample of labelled rows (`max_rows`, the ones with the smallest hash of their id), keeps those that
pass the base rules, lets Spark count them by binned statistics, and covers the bad ones sequentially: a rule grows by the
threshold with the best FOIL gain on two thirds of the sample, is pruned on the other third, and is
kept if it is precise there; the rows it covers are then set aside. `verdict` turns the rules into one
ordered conditional expression, evaluated inside the scan's stage.

Results: one row per input row. A null text has no words and fails the base rules. Labels that are
null, or for unknown ids, are ignored; without labels the list is empty and only the base
rules reject. Equal rows get equal verdicts; labels repeated for one id all count.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialise, release

#: The white space that separates words, and the characters counted as symbols. Fixed values.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, the first included."""
    n = F.size(w)

    def in_sorted(p: Column) -> Column:  # p: (hash of the window, its place), sorted
        again = F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]))
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"].cast("long"))

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(pairs, in_sorted))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_let(hashes, of_hashes))


#: Counts, in the order of the struct that `statistics` gives.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines")


def statistics(text: Column) -> Column:
    """A struct of COUNTS for a text column."""

    def counted(x: Column) -> Column:
        w, lines, t = x["w"], x["lines"], x["t"]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    def parts(t: Column) -> Column:
        words = F.array_remove(F.split(F.translate(t, SPACE, " " * len(SPACE)), " "), "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
        return _let(F.struct(t.alias("t"), words.alias("w"), lines.alias("lines")), counted)

    return _let(F.coalesce(text.cast("string"), F.lit("")), parts)


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


#: What the rules test, from the counts.
FEATURES = {
    "words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _share("word_chars", "n_words"),
    "symbol_share": lambda: _share("n_symbols", "n_words"),
    "dup_line_share": lambda: _share("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _share("n_repeat_words", "n_words"),
    # the exponent by which the vocabulary grows with the text; unlike a share it does not fall for long texts
    "vocabulary_growth": lambda: F.when(F.col("n_words") > 1, F.log("n_distinct_words") / F.log("n_words")).otherwise(F.lit(1.0)),
}
#: Cut points are these quantiles of each feature over the bad and over the good rows of the sample.
QUANTILES = [0.0, *[i / 64 for i in range(1, 64)], 1.0]


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        x = FEATURES[self.feature]()
        return x > self.cut if self.above else x <= self.cut


def learn(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000, max_rules: int = 12, max_tests: int = 4, precision: float = 0.9) -> list[list[Test]]:
    """Ordered rules, each a conjunction of tests; a row that meets any is bad (label 0).

    At most `max_rules` rules of at most `max_tests` tests: bounds on how long a list stays readable. The list ends before if no further rule gains.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("k_"), (F.col(label) == 0).alias("bad"))
    chosen = chosen.orderBy(F.xxhash64("k_"), "k_", "bad").limit(max_rows)
    counts = docs.select(F.col(id).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("k") == F.col("k_")).select("bad", (F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(3)) == 0).alias("held"), F.explode(F.array(statistics(F.col("t")))).alias("x"))
    # out of a generator, so that no filter on them is pushed below it and evaluates them anew
    passed = counts.select("bad", "held", "x.*").where(~base_failed())
    sample = materialise(passed.select("bad", "held", *[f().alias(n) for n, f in FEATURES.items()]))
    both = sample.groupBy("bad").agg(*[F.percentile_approx(n, QUANTILES, 10_000).alias(n) for n in FEATURES]).collect()
    cuts = {n: sorted({x for r in both for x in r[n]}) for n in FEATURES}
    if len(both) < 2:
        release(sample)
        return []
    bins = [_bin(n, cuts[n]) for n in FEATURES]
    # at most max_rows rows: the sample, counted by bins
    table = [(r.held, r.p, r.n, tuple(r[3:])) for r in sample.select("held", "bad", *bins).groupBy("held", *FEATURES).agg(F.sum(F.col("bad").cast("int")).alias("p"), F.sum((~F.col("bad")).cast("int")).alias("n")).select("held", "p", "n", *FEATURES).orderBy("held", *FEATURES).collect()]
    found = cover(table, list(FEATURES), {n: len(c) for n, c in cuts.items()}, max_rules, max_tests, precision)
    # a cut stands midway between the values that it parts
    used = sorted({(n, b) for rule in found for n, _, b in rule})
    near = sample.agg(F.lit(0).alias("_"), *[f(F.when(side, F.col(n))).alias(f"{w}{k}") for k, (n, b) in enumerate(used) for w, f, side in (("a", F.max, F.col(n) <= cuts[n][b]), ("b", F.min, F.col(n) > cuts[n][b]))]).first()
    middle = {u: cuts[u[0]][u[1]] if near[f"a{k}"] is None or near[f"b{k}"] is None else (near[f"a{k}"] + near[f"b{k}"]) / 2 for k, u in enumerate(used)}
    release(sample)
    return [[Test(n, above, middle[n, b]) for n, above, b in rule] for rule in found]


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many cuts the feature is above."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(feature))).alias(feature)


def cover(table: list[tuple], names: list[str], sizes: dict[str, int], max_rules: int, max_tests: int, precision: float) -> list[list[tuple]]:
    """Sequential covering of counts by bins: (held out, bad, good, bins). A test (name, above, b) is bin > b or bin <= b."""

    def meets(bins: tuple, rule: list[tuple]) -> bool:
        return all((bins[names.index(n)] > b) == above for n, above, b in rule)

    rules: list[list[tuple]] = []
    least = max(1, sum(r[1] for r in table if r[0]) // 100)  # a rule must matter: a hundredth of the bad rows held out
    while len(rules) < max_rules:
        rule: list[tuple] = []
        rows = [r for r in table if not r[0]]
        while len(rule) < max_tests:
            p0, n0 = sum(r[1] for r in rows), sum(r[2] for r in rows)
            if not p0 or not n0:
                break
            base, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
            for k, name in enumerate(names):
                low = [[0, 0] for _ in range(sizes[name] + 1)]
                for _, p, n, bins in rows:
                    low[bins[k]][0] += p
                    low[bins[k]][1] += n
                p = n = 0
                for b in range(sizes[name]):
                    p, n = p + low[b][0], n + low[b][1]
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        if pp and (gain := pp * (math.log2(pp / (pp + nn)) - base)) > best[0]:
                            best = (gain, (name, above, b))
            if best[1] is None:
                break
            rule.append(best[1])
            rows = [r for r in rows if meets(r[3], [best[1]])]
        held = [r for r in table if r[0]]

        def worth(r: list[tuple]) -> tuple[float, int]:
            hit = [x for x in held if meets(x[3], r)]
            p, n = sum(x[1] for x in hit), sum(x[2] for x in hit)
            return (p - n) / (p + n) if p + n else -1.0, p

        if not rule:
            break
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        value, hits = worth(rule)
        if value < 2 * precision - 1 or hits < least:
            break
        rules.append(rule)
        table = [r for r in table if not meets(r[3], rule)]
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """Whether a row is kept, by the first rule that it meets; over the columns of COUNTS."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def judge(docs: DataFrame, rules: list[list[Test]], *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, the counts, base_failed and kept for each row."""
    counted = docs.select(F.col(id).alias("k_"), F.explode(F.array(statistics(F.col(text)))).alias("x_")).select("k_", "x_.*")
    return counted.select(F.col("k_").alias(id), *COUNTS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[list[Test]], *, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass the base rules and the learned list, all columns as they are."""
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.explode(F.array(statistics(F.col(text)))).alias("x_")).select("row_", "x_.*")
    return counted.where(~base_failed() & verdict(rules)).select("row_.*")
