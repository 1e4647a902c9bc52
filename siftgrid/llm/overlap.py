"""Problem 4: overlap sizes between many large sets, by coordinated sampling of identifiers.

One hash of the identifier decides for all sets at once whether it is retained, so an identifier retained in
one set is retained in every set that holds it, and co-occurrences among the retained ones are a fair sample of
every intersection. The rate follows from the smallest set that counts as large: it leaves ``per_set``
identifiers of such a set, so the sample holds about per_set * share identifiers however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrid.lineage import cut
from siftgrid.llm.frequency import posting_key, shards_of
from siftgrid.llm.pairs import CHUNK, pair_counts

PER_SET, BROADCAST = 400, 100_000


def large_sets(postings: DataFrame, least: int, share: int) -> tuple[DataFrame, DataFrame, int]:
    """Of postings (col, value_num, value_str, row_id): entries (item INT, row_id), distinct, of the large keys; the keys
    (key, item, f) that hold at least ``least`` and at least n / share identifiers; and n, the number of identifiers.

    Entries with repeats bound a key's size from above and are summed in each task, so that only entries of keys that may
    be large are reduced to distinct ones. Such keys number at most share times the entries of an average identifier.
    """
    entries = postings.select(posting_key().alias("key"), "row_id").filter("key IS NOT NULL AND row_id IS NOT NULL")
    n = entries.select("row_id").distinct().count()
    most = cut(entries.groupBy("key").agg(F.count(F.lit(1)).alias("most")).filter((F.col("most") >= least) & (F.col("most") * share >= n)).select("key", F.monotonically_increasing_id().alias("item")))
    small = F.broadcast(most) if most.count() <= BROADCAST else most
    own = cut(entries.join(small, "key").select("item", "row_id").distinct())
    sizes = own.groupBy("item").agg(F.count(F.lit(1)).alias("f")).filter((F.col("f") >= least) & (F.col("f") * share >= n))
    return own, cut(most.join(sizes, "item").select("key", "item", "f")), n


def sampling_rate(n: int, least: int, share: int, per_set: int = PER_SET) -> float:
    """The share of identifiers to retain: ``per_set`` of the smallest large set, or all."""
    return min(1.0, per_set / max(least, n / share, 1))


def _retained(identifier: str, rate: float) -> Column:
    return F.lit(True) if rate >= 1 else F.xxhash64(identifier) < F.lit(int(-(2**63) + rate * 2**64))


def overlap_estimates(entries: DataFrame, large: DataFrame, rate: float, z: float = 1.96, chunk: int = CHUNK) -> DataFrame:
    """(item_1, item_2, key_1, key_2, f_1, f_2, sampled, estimate, low, high), key_1 < key_2, of the pairs of ``large``
    (key, item, f) that share a retained identifier; entries are (item, row_id), distinct.

    ``low`` and ``high`` are score bounds of the Poisson count ``sampled`` at ``z`` standard deviations, scaled
    by 1 / rate and kept within 0 and the smaller set; at rate 1 both equal the exact overlap. A pair that is
    not there has the bounds 0 and z² (1 - rate) / rate.
    """
    kept = entries.filter(_retained("row_id", rate)).join(large.select("item"), "item", "left_semi")
    pairs = pair_counts(kept.select(F.col("row_id").alias("basket"), "item"), chunk)
    side = lambda x, i: large.select(F.col("item").alias(x), F.struct("key", "item", "f").alias(i))
    c = F.col("f_ab").cast("double")
    spread = F.lit(z) * F.sqrt((c + z * z / 4) * (1 - rate))
    turned = F.col("x.key") > F.col("y.key")
    one, two = F.when(turned, F.col("y")).otherwise(F.col("x")), F.when(turned, F.col("x")).otherwise(F.col("y"))
    named = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("f_ab", one.alias("x"), two.alias("y"))
    most = F.least("x.f", "y.f").cast("double")
    return named.select(
        F.col("x.item").alias("item_1"), F.col("y.item").alias("item_2"), F.col("x.key").alias("key_1"), F.col("y.key").alias("key_2"), F.col("x.f").alias("f_1"), F.col("y.f").alias("f_2"), F.col("f_ab").alias("sampled"),
        F.least(c / rate, most).alias("estimate"),
        F.greatest(F.lit(0.0), (c + z * z / 2 * (1 - rate) - spread) / rate).alias("low"),
        F.least((c + z * z / 2 * (1 - rate) + spread) / rate, most).alias("high"),
    )


def exact_overlaps(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item_1, item_2, f_ab): the exact number of identifiers that the given pairs (item_1, item_2) share; entries are
    (item, row_id), distinct.

    Only entries of named items are read on; each meets the partners of its own item, not all items of its identifier. Items
    are salted by identifier, so that one held by a third of all rows is spread; the salts follow from the entries.
    """
    salts = shards_of(entries)
    named = pairs.select(F.explode(F.array("item_1", "item_2")).alias("item")).distinct()
    own = entries.join(named, "item", "left_semi").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    spread = pairs.select("item_1", "item_2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    left = own.select(F.col("item").alias("item_1"), "row_id", "salt").join(spread, ["item_1", "salt"]).select("item_1", "item_2", "row_id")
    both = left.join(own.select(F.col("item").alias("item_2"), "row_id"), ["item_2", "row_id"], "left_semi")
    return both.groupBy("item_1", "item_2").agg(F.count(F.lit(1)).alias("f_ab"))
