"""Joins with one row per key on one side, whose large keys are split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with more than one in HEAVY of all rows is split, so at most HEAVY keys are.
HEAVY = 1000
#: Parts of a split key.
PARTS = 64


def split_join(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, spread_by: str | list[str],
               how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their class; no task gets all rows of a large class.

    ``classes`` has one row per key and the number of its rows in ``size``. Keys
    with more than one in ``HEAVY`` of all rows, which are fewer than ``HEAVY`` by
    arithmetic and so can be broadcast, are dealt to ``PARTS`` parts each by the
    columns ``spread_by``. The shuffle that made ``classes`` is used again, not
    repeated, for the total and the list of large keys.
    """
    total = classes.agg(F.sum(size)).scalar()
    marked = classes.withColumn("_heavy", F.col(size) * HEAVY > total)
    heavy = marked.filter("_heavy").select(*keys, F.lit(True).alias("_hot"))
    spread_by = [spread_by] if isinstance(spread_by, str) else spread_by
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(heavy), keys, "left").withColumn("_part", part).drop("_hot")
    parts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    marked = marked.withColumn("_part", F.explode(parts)).drop("_heavy")
    return rows.join(marked, [*keys, "_part"], how).drop("_part")
