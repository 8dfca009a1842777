"""A corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns the
columns of documents; the last adds the mix. A stage's decisions take effect in its result: rows
go, or texts change. Columns beyond doc_id, text, source and n_chars pass through, whatever their names; only the last
stage's own columns (size, target, copies, taken) replace columns of these names. Stages take empty tables, null and
empty texts, null and repeated ids, and texts of any length.

Texts are not shuffled to drop rows or to add the mix: decisions are small tables, broadcast if their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.decontaminate import find_leaks
from kinfold.llm.mixing import make_plan, with_copies
from kinfold.llm.near_copies import text_key
from kinfold.llm.quality_rules import keep_good, learn
from kinfold.llm.simhash import near_duplicates
from kinfold.llm.suffix_dedup import remove_repeats
from kinfold.session import materialise, release, table

#: Tables of decisions of up to this many bytes are broadcast; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or meet a learned rule go."""
    return keep_good(docs, learn(docs, table(spark, sf_dir, "labels")))


def _boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """`row`, a struct of all columns, and `more`: nothing clashes with what is joined to it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[x.alias(n) for n, x in more.items()])


def _unboxed(boxed: DataFrame, columns: list[str]) -> DataFrame:
    return boxed.select(*[F.col("row").getField(c).alias(c) for c in columns])


def _small(decisions: DataFrame, row_bytes: int = 100) -> DataFrame:
    """`decisions`, for a broadcast if it is small enough."""
    return F.broadcast(decisions) if decisions.count() * row_bytes <= BROADCAST_BYTES else decisions


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of 0.8 or more, and what that links) stays.

    It is the one with the smallest id, and among texts of one id the one with the smallest text key; null ids come
    last. Rows are told apart by id and text; of equal rows one stays. Null and word-free texts are copies of each other.
    """
    rows = near_duplicates(docs, width=5, similarity=0.8).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "root")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("z"), "d", "t")).alias("x")).select(F.col("root").alias("r"), "x.d", "x.t")
    first = materialise(first)  # joined as a plain table, so that a large group's rows can be split
    same = F.col("o.d").eqNullSafe(F.col("f.d")) & (F.col("o.t") == F.col("f.t"))
    each = rows.groupBy("d", "t", "root").count()
    told = materialise(each.alias("o").join(first.alias("f"), F.col("o.root") == F.col("f.r")).select("o.d", "o.t", "count", same.alias("stays")).where("not stays or count > 1"))
    keyed = _boxed(docs, d=F.col("doc_id"), t=text_key())

    def match(decisions: DataFrame) -> tuple[DataFrame, Column]:
        few = _small(decisions.select(F.col("d").alias("d_"), F.col("t").alias("t_")))
        return few, F.col("d").eqNullSafe(F.col("d_")) & (F.col("t") == F.col("t_"))

    kept = keyed.join(*match(told.where("not stays")), "left_anti")
    again = told.where("stays")
    if again.limit(1).count():  # of equal rows that stay one does
        few, on = match(again)
        kept = kept.join(few, on, "left_anti").unionByName(kept.join(few, on, "left_semi").dropDuplicates(["d", "t"]))
    return _unboxed(kept, docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 or more that stand earlier too (by document id, then by place) are cut out; the first place of each stays.

    Every document stays, if need be with an empty text. n_chars is counted anew where a text changes.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    out = remove_repeats(docs.select("doc_id", "text", F.col("text").isNotNull().alias("had_text"), rest), whole_chars=True, keep_first=True)
    text, row = F.decode("kept", "UTF-8"), F.col("others.row")
    columns = {"text": F.when(F.col("others.had_text"), text)}
    columns["n_chars"] = F.when(F.col("n_removed") == 0, row.getField("n_chars")).otherwise(F.char_length(text).cast("long"))
    return out.select(*[columns.get(c, row.getField(c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; which ones is a matter of their texts, so null or repeated ids do not matter."""
    found = find_leaks(docs.select(text_key().alias("t"), "text"), table(spark, sf_dir, "benchmark"), id="t")
    leaks = materialise(found.select(F.col("t").alias("t_")).distinct())
    return _unboxed(_boxed(docs, t=text_key()).join(_small(leaks), F.col("t") == F.col("t_"), "left_anti"), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A plan of the mix, not the mixed rows: every document once, with size, target, copies and taken, which replace columns of these names.

    Documents of no copies, which the mix excludes, are in it; `take` makes the mixed corpus of it.
    """
    new = ["size", "target", "copies", "taken"]
    planned = with_copies(docs, make_plan(docs))
    return planned.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], *new)


def take(planned: DataFrame) -> DataFrame:
    """The mixed corpus of what `mixing` or `run` returns: each row as often as its copies say, those of none not at all."""
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("again")
    columns = [F.col("row").getField(c).alias(c) for c in planned.columns]
    return planned.where("copies > 0").select(F.struct(*[F.col(f"`{c}`") for c in planned.columns]).alias("row"), again).select(*columns)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Fingerprints, learned rules and hash-drawn copies are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        before, docs = docs, materialise(out)
        release(before)
