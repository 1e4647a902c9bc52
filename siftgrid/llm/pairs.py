"""Counting pairs of items within baskets, with large baskets cut into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64


def _within(items: Column) -> Column:
    """All pairs of a sorted array as structs (a, b), a before b."""
    return F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _across(left: Column, right: Column) -> Column:
    """All pairs of an item of each array as structs (a, b) with a < b."""
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))


def pair_counts(entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b, f_ab), a < b: in how many baskets of distinct entries (basket, item) both items stand.

    Null baskets or items are ignored. A basket is cut into chunks of about ``chunk`` items by the hash of the item, and
    every pair of chunks becomes a row of its own that any task may take: no task holds more than two chunks of a
    basket, and no basket is dropped or thinned. An ordinary basket is one chunk. Equal pairs are summed before they are
    shuffled.
    """
    entries = entries.select("basket", "item").filter("basket IS NOT NULL AND item IS NOT NULL")
    sizes = entries.groupBy("basket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("basket", F.ceil(F.col("size") / chunk).cast("int").alias("chunks"))
    placed = entries.join(sizes, "basket").withColumn("own", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int"))
    spread = placed.select("basket", "item", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select("basket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "item", (F.col("own") > F.col("other")).alias("second"))
    # by chunk pair, not by basket as the join left it
    cells = spread.repartition("basket", "i", "j").groupBy("basket", "i", "j").agg(F.sort_array(F.collect_list(F.when(~F.col("second"), F.col("item")))).alias("left"), F.collect_list(F.when(F.col("second"), F.col("item"))).alias("right"))
    pairs = cells.select(F.explode(F.when(F.col("i") == F.col("j"), _within(F.col("left"))).otherwise(_across(F.col("left"), F.col("right")))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("f_ab"))
