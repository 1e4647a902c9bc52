"""Problem 3: items that appear together, by large-basket blocking, and their association scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrid.llm.pairs import CHUNK, pair_counts
from siftgrid.llm.terms import distinct_terms


def association(n: Column, f_a: Column, f_b: Column, f_ab: Column) -> Column:
    """How many times more often than chance: f_ab * n / (f_a * f_b); null where a frequency is 0 or null."""
    return F.try_divide(f_ab.cast("double") * n, f_a.cast("double") * f_b)


def strong(least: int, share: int, lift: int) -> Column:
    """f_ab >= least, f_ab >= n / share and f_ab * n >= lift * f_a * f_b, in exact integers."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return (F.col("f_ab") >= least) & (F.col("f_ab") * share >= F.col("n")) & (big("f_ab") * big("n") >= F.lit(lift).cast("decimal(10,0)") * (big("f_a") * big("f_b")).cast("decimal(28,0)"))


def basket_entries(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(basket, item): the distinct terms of each record; rows of one id are united, rows without id or terms give none."""
    return rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("basket"), F.explode(distinct_terms(F.col(text_col))).alias("item")).distinct()


def cooccurrence(entries: DataFrame, n: int, least: int = 8, share: int = 1000, lift: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(item_1, item_2, n, f_a, f_b, f_ab, association) of pairs that are ``strong``; entries (basket, item) distinct.

    Before pairing, items that can be in no such pair are left out, which changes no result: f_ab is at most
    either frequency, so both are at least ``least`` and n / share; and f_ab * n >= lift * f_a * f_b
    then needs f_a, f_b <= n / lift. The second bound removes exactly the terms that most baskets hold. The
    first leaves at most ``share`` items per entry of an average basket. Empty input gives no rows.
    """
    f = entries.groupBy("item").agg(F.count(F.lit(1)).alias("f")).filter((F.col("f") >= least) & (F.col("f") * share >= n) & (F.col("f") * lift <= n))
    pairs = pair_counts(entries.join(f, "item", "left_semi"), chunk).filter((F.col("f_ab") >= least) & (F.col("f_ab") * share >= n))
    a, b = f.select(F.col("item").alias("a"), F.col("f").alias("f_a")), f.select(F.col("item").alias("b"), F.col("f").alias("f_b"))
    counted = pairs.join(a, "a").join(b, "b").withColumn("n", F.lit(n).cast("bigint"))
    return counted.filter(strong(least, share, lift)).select(F.col("a").alias("item_1"), F.col("b").alias("item_2"), "n", "f_a", "f_b", "f_ab", association(F.col("n"), F.col("f_a"), F.col("f_b"), F.col("f_ab")).alias("association"))


def summed_reports(reports: DataFrame) -> DataFrame:
    """(item_1, item_2, n, f_a, f_b, f_ab, association), item_1 < item_2: reported counts summed over segments.

    A segment's report of a pair counts once, in whichever order it names the keys; of several that differ,
    the earliest. Reports with a null count, a null key, or f_ab above f_a or f_b do not count.
    """
    key = lambda s: F.concat(F.col(f"col_{s}"), F.lit("="), F.col(f"value_{s}"))
    sound = reports.withColumn("ka", key("a")).withColumn("kb", key("b")).filter("n IS NOT NULL AND f_ab <= f_a AND f_ab <= f_b AND ka <> kb")
    turned = F.col("ka") > F.col("kb")
    one = sound.select(
        "segment", F.least("ka", "kb").alias("item_1"), F.greatest("ka", "kb").alias("item_2"),
        F.struct("computed_at", "n", F.when(turned, F.col("f_b")).otherwise(F.col("f_a")).alias("f_a"), F.when(turned, F.col("f_a")).otherwise(F.col("f_b")).alias("f_b"), "f_ab").alias("r"),
    )
    one = one.groupBy("segment", "item_1", "item_2").agg(F.min("r").alias("r"))
    total = one.groupBy("item_1", "item_2").agg(*(F.sum(f"r.{c}").alias(c) for c in ("n", "f_a", "f_b", "f_ab")))
    return total.withColumn("association", association(F.col("n"), F.col("f_a"), F.col("f_b"), F.col("f_ab")))
