"""Mixing sources to target token weights by entropy balancing.

Of all document rates with the wanted tokens per source and no rate above `cap`, entropy
balancing takes the one closest (in Kullback-Leibler divergence) to taking each document once.
Its dual is convex with one multiplier per source, and the rates are exponentially tilted:
rate = min(cap, exp(multiplier * size / mean size of the source)). Documents are summed up to
(source, size, count) once; each Newton iteration is one distributed aggregation over that table
joined with the multipliers, kept inside a bracket so it cannot diverge.

Rates become copies: the whole part, plus one more copy where a hash-based uniform number falls below
the fraction, moved by one threshold per source so that the tokens taken meet the target. The
threshold comes from two histograms (4096 bins, then 4096 bins of the bin where it falls), so a
source of any size is never gathered in one task. What is then still missing is brought nearer by
one copy more or less of the document whose size fits best, FITS times over.

All that is decided is a row per source, the plan. `with_copies` reads the copies off it where the documents
lie: no text is shuffled as long as the plan fits a broadcast; beyond that the join is salted.

Results: one row per input row. A null or word-free text has size 0, rate 1 and takes nothing. A null
source is a source of its own, last in order. Equal rows get the same copies. Reruns agree: sums are exact
decimals. A table without words has targets of 0. Only the id, text and source columns are read. Very long
texts count like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.session import materialise, release

BINS = 4096
#: A plan of up to this many bytes is broadcast.
BROADCAST_BYTES = 32 << 20
SALTS = 32
FITS = 3
WORD = r"[^\x20\x09-\x0D]+"
NEW = ("size", "source_size", "target", "rate", "copies", "taken")


def words_in(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def beside(rows: DataFrame, per_source: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`rows` (with d, s, size) next to what `per_source` (one row for each `s`) says of their source; inner join."""
    size = per_source.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("s"), F.lit(0)) + 40 * len(per_source.columns)), F.lit(0))).first()[0]
    few = per_source.withColumnRenamed("s", "s_")
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(few), rows.s.eqNullSafe(few.s_)).drop("s_")
    few = few.withColumn("z_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("z", F.pmod(F.xxhash64("d", "size"), F.lit(SALTS)).cast("int"))
    return dealt.join(few, dealt.s.eqNullSafe(few.s_) & (dealt.z == few.z_)).drop("s_", "z", "z_")


def ranked(totals: DataFrame) -> DataFrame:
    """`totals` with `k`, the place of `s` by code point from 1 on, null last; counted range by range."""
    order = F.col("s").asc_nulls_last()
    at = F.monotonically_increasing_id()
    placed = materialise(totals.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", at))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one a task
    before, rows = 0, []
    for p, n in counts:
        rows.append((p, before))
        before += n
    starts = totals.sparkSession.createDataFrame(rows, "part long, before long")
    return placed.join(F.broadcast(starts), part == F.col("part")).withColumn("k", F.col("before") + row + 1).drop("at", "part", "before")


def source_targets(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(s, k, source_size, docs, target): the share of each source by weight, stopped at `cap` times its size.

    What the stopped sources leave is shared anew by weight until no further source is above its stop;
    each time is one sum over the sources.
    """
    totals = sized.groupBy("s").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    known = materialise(ranked(totals).withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))))
    everything = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, stopped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("w") > F.col("most")
        now = known.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)).alias("most"), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)).alias("w")).first()
        if now.n == stopped:
            break
        level, stopped = (everything - now.most) / now.w if now.w else 0.0, now.n
    return known.select("s", "k", "source_size", "docs", F.least(F.lit(level) * F.col("w"), F.col("most")).alias("target"))


def tilted(multiplier: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(multiplier * F.col("size") / F.col("mean"), F.lit(50.0))))


def solve(histogram: DataFrame, goals: DataFrame, cap: float, tolerance: float = 1e-6, rounds: int = 200) -> DataFrame:
    """(k, multiplier): Newton iterations on the dual, one aggregation each. histogram: k, size, n; goals: k, mean, target.

    Raises if a source's tokens are not within `tolerance` of its target after `rounds`.
    """
    exact = "decimal(38,6)"  # sums that do not depend on their order
    widest = F.col("mean") * 60
    state = goals.select("k", F.lit(0.0).alias("x"), (-widest).alias("low"), widest.alias("high"))
    for _ in range(rounds):
        rate = tilted(F.col("x"), cap)
        f = F.sum((F.col("n") * F.col("size") * rate).cast(exact)).cast("double")
        slope = F.sum(F.when(rate < cap, F.col("n") * F.col("size") * F.col("size") / F.col("mean") * rate).otherwise(0.0).cast(exact)).cast("double")
        at = histogram.join(state, "k").join(goals, "k").groupBy("k").agg(f.alias("f"), slope.alias("slope"), *[F.first(c).alias(c) for c in ("target", "x", "low", "high")])
        under = F.col("f") < F.col("target")
        low, high = F.when(under, F.col("x")).otherwise(F.col("low")), F.when(under, F.col("high")).otherwise(F.col("x"))
        step = F.when(F.col("slope") > 0, F.col("x") - (F.col("f") - F.col("target")) / F.col("slope"))
        error = F.abs(F.col("f") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        at = at.select("k", "x", low.alias("low"), high.alias("high"), step.alias("step"), error.alias("error"))
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        moved = F.when(F.col("error") <= tolerance, F.col("x")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        before, state = state, materialise(at.select("k", moved.alias("x"), "low", "high", "error"))
        release(before)
        worst = state.agg(F.max("error")).first()[0]
        if (worst or 0.0) <= tolerance:
            return state.select("k", F.col("x").alias("multiplier"))
    raise RuntimeError(f"the multipliers did not settle in {rounds} rounds: tokens are off by a share of {worst}")


def _rated(rows: DataFrame, cap: int, seed: int) -> DataFrame:
    """`rows` (d, size, and mean, target, multiplier of their source) with rate, whole copies, and the bins of their draw."""
    u = F.pmod(F.xxhash64(F.lit(seed), "d", "size"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    full = F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)  # a source at its stop needs no finite multiplier
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("multiplier").isNull(), full).otherwise(tilted(F.col("multiplier"), cap))
    rated = rows.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("long"))
    score = (u - (F.col("rate") - F.col("whole")) + 1.0) * (BINS / 2)
    rated = rated.withColumn("score", score)
    return rated.withColumn("bin", F.floor("score").cast("int")).withColumn("fine", F.floor((F.col("score") - F.floor("score")) * BINS).cast("int"))


def _may(cap: int) -> Column:
    return (F.col("whole") < cap) & (F.col("size") > 0) & (F.col("target") > 0)


def _drawn(cap: int) -> Column:
    """Copies by the plan's threshold."""
    below = (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & (F.col("fine") <= F.col("last")))
    return F.col("whole") + F.when(_may(cap) & F.coalesce(below, F.lit(True)), 1).otherwise(0)


def make_plan(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, seed: int = 17,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per source: s, k, source_size, docs, target, mean, multiplier, edge, last (the threshold), and fits (the last corrections)."""
    sized = materialise(docs.select(F.col(id).alias("d"), F.col(source).alias("s"), words_in(text).alias("size")))
    goals = materialise(source_targets(sized, weights, cap).withColumn("mean", F.col("source_size") / F.col("docs")))
    histogram = materialise(beside(sized.where("size > 0"), goals.select("s", "k"), broadcast_bytes).groupBy("k", "size").agg(F.count("*").alias("n")))
    free = goals.where((F.col("target") > 0) & (F.col("target") < cap * F.col("source_size")))
    plan = materialise(goals.join(solve(histogram, free.select("k", "mean", "target"), cap), "k", "left"))
    rated = materialise(_rated(beside(sized, plan.select("s", "k", "target", "mean", "multiplier"), broadcast_bytes), cap, seed))
    release(histogram, goals)
    can = rated.where(_may(cap))
    missing = rated.groupBy("k").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"))

    def running(hist: DataFrame, by: str, start: Column) -> DataFrame:
        w = Window.partitionBy("k").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)  # at most BINS rows each
        return hist.withColumn("upto", F.sum("tokens").over(w) + start)

    coarse = running(can.groupBy("k", "bin").agg(F.sum("size").alias("tokens")), "bin", F.lit(0)).join(missing, "k").where("upto > need")
    crossed = coarse.groupBy("k").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("tokens")).alias("below"), "need"), "bin").alias("x"))
    cross = materialise(crossed.join(plan.select("s", "k"), "k").select("s", "k", F.col("x.bin").alias("edge"), "x.below", "x.need"))
    inner = beside(can.select("d", "s", "size", "bin", "fine"), cross, broadcast_bytes).where("bin = edge")
    fine = running(inner.groupBy("k", "fine").agg(F.sum("size").alias("tokens"), F.first("below").alias("below"), F.first("need").alias("need")), "fine", F.col("below"))
    # a fine bin is taken if that brings the tokens nearer to the target
    nearer = F.abs(F.col("upto") - F.col("need")) <= F.abs(F.col("upto") - F.col("tokens") - F.col("need"))
    last = fine.where(nearer).groupBy("k").agg(F.max("fine").alias("last"))
    limits = cross.join(last, "k", "left").select("k", "edge", F.coalesce("last", F.lit(-1)).alias("last"))
    edged = materialise(plan.join(limits, "k", "left"))
    release(plan, cross)

    drawn = beside(rated.select("d", "s", "k", "size", "target", "whole", "bin", "fine"), edged.select("s", "edge", "last"), broadcast_bytes).withColumn("copies", _drawn(cap))
    same = materialise(drawn.where((F.col("size") > 0) & (F.col("target") > 0)).groupBy("k", "s", "d", "size", "copies").agg(F.count("*").alias("n")))  # equal rows go together
    out = edged.withColumn("fits", F.expr(f"cast(array() as array<struct<d:{docs.schema[id].dataType.simpleString()},size:bigint,step:int>>)"))
    for _ in range(FITS):
        gap = edged.join(same.groupBy("k").agg(F.sum(F.col("n") * F.col("size") * F.col("copies")).alias("now")), "k").select("s", (F.col("target") - F.col("now")).alias("gap"))
        each = beside(same, materialise(gap), broadcast_bytes).select("k", "d", "size", "copies", "gap", (F.col("n") * F.col("size")).alias("tokens"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("step"))
        off = F.abs(F.col("gap") - F.col("step") * F.col("tokens"))
        each = each.where((F.col("copies") + F.col("step")).between(0, cap)).withColumn("off", off).where(F.col("off") < F.abs("gap"))
        best = each.groupBy("k").agg(F.min(F.struct("off", "step", F.xxhash64("d", "size").alias("h"), "d", "size")).alias("x"))
        best = materialise(best.join(edged.select("k", "s"), "k").select("k", "s", F.struct("x.d", "x.size", "x.step").alias("fit")))
        before, out = out, materialise(out.join(best.select("k", "fit"), "k", "left").withColumn("fits", F.when(F.col("fit").isNull(), F.col("fits")).otherwise(F.array_append("fits", F.col("fit")))).drop("fit"))
        fits = F.col("d").eqNullSafe(F.col("fit.d")) & (F.col("size") == F.col("fit.size"))
        few = F.broadcast(best.select(F.col("k").alias("k_"), "fit")) if best.count() * 100 <= broadcast_bytes else best.select(F.col("k").alias("k_"), "fit")
        moved = same.join(few, (F.col("k") == F.col("k_")) & fits, "left").withColumn("copies", F.col("copies") + F.coalesce("fit.step", F.lit(0))).drop("k_", "fit")
        was, same = same, materialise(moved)
        release(before, was)
    release(sized, rated, same, edged)
    return out


def with_copies(
    docs: DataFrame, plan: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", cap: int = 3, seed: int = 17, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """`row` (a struct of all columns of `docs`) and NEW for each row, by the plan that `make_plan` made of these documents."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id).alias("d"), F.col(source).alias("s"), words_in(text).alias("size"))
    planned = _rated(beside(rows, plan, broadcast_bytes), cap, seed)
    own = F.filter("fits", lambda x: x.d.eqNullSafe(F.col("d")) & (x.size == F.col("size")))
    copies = _drawn(cap) + F.aggregate(own, F.lit(0), lambda a, x: a + x.step)
    return planned.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select("row", *NEW)


def mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """id, source, size, source_size, target, rate, copies, taken for each row of `docs`."""
    plan = make_plan(docs, id=id, text=text, source=source, weights=weights, cap=cap, seed=seed)
    mixed = with_copies(docs.select(id, source, text), plan, id=id, text=text, source=source, cap=cap, seed=seed)
    return mixed.select(F.col("row").getField(id).alias(id), F.col("row").getField(source).alias(source), *NEW)
