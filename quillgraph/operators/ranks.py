"""Ranks, running sums and earlier values of groups of any size.

A window takes a whole group into one task. That is right for small groups; where the largest, which is measured, is a hub,
rows are dealt into ranges of (group, order) instead: each range is summed up by itself, the few summaries of a group
are added up in order of ranges, and a row's value is its own range's plus what came before."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.plans.lineage import checkpoint

#: Rows of a group up to which one window holds it.
HUB = 1 << 20


def has_hub(df: DataFrame, group: Sequence[str]) -> bool:
    return (df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > HUB


def _dealt(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_part``, the number of its range; written out, for the ranges' ends come from a sample."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))


def _with(df: DataFrame, summaries: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each row with its range's summary of its group; null groups are groups."""
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_part"]]
    kept = [F.col(f"b.{c}") for c in summaries.columns if c not in (*group, "_part")]
    return df.alias("a").join(summaries.alias("b"), reduce(and_, keys)).select("a.*", *kept)


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the group's rows up to and with this one; rows alike in the order come in any order."""
    if not has_hub(df, group):
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    parts = _dealt(df.withColumn("_v", value), group, order)
    own = F.sum("_v").over(Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = parts.groupBy("_part", *group).agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    summaries = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_s")
    return _with(parts.withColumn(name, own), summaries, group).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_v", "_before")


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with each row's place in its group, from 1."""
    return running(df, group, order, F.lit(1).cast("long"), name)


def prior(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """``df`` with the ``value`` of the group's row before this one; null for the first."""
    if not has_hub(df, group):
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*group).orderBy(*order)))
    parts = _dealt(df, group, order)
    own = Window.partitionBy("_part", *group).orderBy(*order)
    parts = parts.withColumn(name, F.lag(F.struct(F.col(value).alias("v"))).over(own)).withColumn("_next", F.lead(F.lit(1)).over(own))
    last = parts.filter("_next is null").select("_part", *group, F.struct(F.col(value).alias("v")).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*group).orderBy("_part"))
    return _with(parts, last.withColumn("_before", before).drop("_last"), group).withColumn(name, F.coalesce(name, "_before")["v"]).drop("_part", "_next", "_before")
