"""Incremental fusion of arriving records (an extension; the batch engine does not need it).

State is a versioned table of normalised records with their cluster. A batch is linked only
through the keys and names it carries: old clusters are single nodes, so a batch costs what it touches, plus
one pass that relabels merged clusters. A version is written once per batch id from the version before it,
so a batch that is tried again gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators import resolve as R
from kinfold.operators.components import connected_components
from kinfold.session import materialise


def state(spark: SparkSession, folder: str, version: int) -> DataFrame | None:
    """The state after batch `version`; None before the first."""
    return spark.read.parquet(f"{folder}/version={version}") if version >= 0 else None


def merge_batch(batch: DataFrame, folder: str, version: int) -> None:
    """Add the records of `batch` to the state; writes version `version`."""
    spark = batch.sparkSession
    new = materialise(R.normalised(batch).withColumn("cluster_id", F.col("rec_idx")))
    old = state(spark, folder, version - 1)
    both = new if old is None else old.join(new.select("rec_idx"), "rec_idx", "left_anti").unionByName(new)
    fresh = R.signals(new).select("sig_type", "sig_value").distinct()
    touched = R.signals(both).join(fresh, ["sig_type", "sig_value"])
    names = fresh.where("sig_type = 'name'").select(F.col("sig_value").alias("n_name"))
    edges = R.star_edges(touched).unionByName(R.name_edges(both.join(names, "n_name", "left_semi")))
    label = both.select("rec_idx", "cluster_id")
    ends = edges.join(label.toDF("src", "a"), "src").join(label.toDF("dst", "b"), "dst").select("a", "b")
    found = connected_components(ends).select(F.col("node").alias("cluster_id"), "component")
    out = both.join(found, "cluster_id", "left").withColumn("cluster_id", F.coalesce("component", "cluster_id"))
    out.select(*new.columns).write.mode("overwrite").parquet(f"{folder}/version={version}")


def fuse_stream(records: DataFrame, folder: str, available_now: bool = False) -> StreamingQuery:
    """Start a query that adds every micro-batch of a stream of records to the state in `folder`."""
    writer = records.writeStream.foreachBatch(lambda df, i: merge_batch(df, folder, i)).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
