"""Posting sets: sets of positions within 0..n-1 with their algebra.

A set is a frame of distinct ``row_id`` and its length n. Binary operations are equi joins on row_id, so sets that come
from one index share its partitioning; counts never materialise the set. The packed form holds 64 positions a word.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BitSet:
    positions: DataFrame
    n: int

    @staticmethod
    def of_positions(spark: SparkSession, positions: Iterable[int], n: int) -> BitSet:
        return BitSet(spark.createDataFrame([(int(i),) for i in sorted(set(positions))], "row_id bigint"), n)

    @staticmethod
    def of_booleans(spark: SparkSession, values: Iterable[bool]) -> BitSet:
        values = list(values)
        return BitSet.of_positions(spark, (i for i, v in enumerate(values) if v), len(values))

    @staticmethod
    def of_column(rows: DataFrame, condition: Column, n: int) -> BitSet:
        """The rows where the condition holds; null is false."""
        return BitSet(rows.filter(condition).select("row_id").distinct(), n)

    @staticmethod
    def empty(spark: SparkSession, n: int) -> BitSet:
        return BitSet(spark.createDataFrame([], "row_id bigint"), n)

    def _same(self, other: BitSet) -> None:
        if self.n != other.n:
            raise ValueError(f"sets of lengths {self.n} and {other.n}")

    def contains(self, i: int) -> bool:
        return not self.positions.filter(F.col("row_id") == i).isEmpty()

    def count(self) -> int:
        return self.positions.count()

    def trues(self) -> DataFrame:
        return self.positions.orderBy("row_id")

    def vector(self) -> DataFrame:
        """(row_id, value) for all n positions."""
        marked = self.positions.withColumn("value", F.lit(True))
        return self._all().join(marked, "row_id", "left").select("row_id", F.coalesce("value", F.lit(False)).alias("value"))

    def _all(self) -> DataFrame:
        return self.positions.sparkSession.range(self.n).withColumnRenamed("id", "row_id")

    def and_(self, other: BitSet) -> BitSet:
        self._same(other)
        return BitSet(self.positions.join(other.positions, "row_id", "left_semi"), self.n)

    def and_not(self, other: BitSet) -> BitSet:
        self._same(other)
        return BitSet(self.positions.join(other.positions, "row_id", "left_anti"), self.n)

    def not_(self) -> BitSet:
        return BitSet(self._all().join(self.positions, "row_id", "left_anti"), self.n)

    def concat(self, other: BitSet) -> BitSet:
        """This set followed by the other: length n + other.n."""
        return BitSet(self.positions.unionByName(other.positions.select((F.col("row_id") + self.n).alias("row_id"))), self.n + other.n)

    def slice(self, start: int, until: int) -> BitSet:
        start, until = max(0, start), min(self.n, until)
        return BitSet(self.positions.filter((F.col("row_id") >= start) & (F.col("row_id") < until)).select((F.col("row_id") - start).alias("row_id")), max(0, until - start))

    def and_count(self, *others: BitSet) -> int:
        """The size of the intersection with all others."""
        out = self
        for other in others:
            out = out.and_(other)
        return out.count()

    def seek(self, at: int) -> int | None:
        """The first true position from ``at`` on."""
        return self.positions.filter(F.col("row_id") >= at).agg(F.min("row_id")).first()[0]

    def head(self) -> int | None:
        return self.seek(0)

    def is_dense(self) -> bool:
        """Whether more than one position in 256 is true."""
        return self.count() * 256 > self.n

    def update(self, i: int, value: bool) -> BitSet:
        kept = self.positions.filter(F.col("row_id") != i)
        return BitSet(kept.unionByName(self.positions.sparkSession.range(i, i + 1).withColumnRenamed("id", "row_id")) if value else kept, self.n)

    def words(self) -> DataFrame:
        """(word_id, word) of all 64-bit words, position 64 w + k in bit k; the tail is zero."""
        packed = pack_words(self.positions)
        every = self.positions.sparkSession.range(-(-self.n // 64)).withColumnRenamed("id", "word_id")
        return every.join(packed, "word_id", "left").select("word_id", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))

    def to_string(self) -> str:
        """The bits as 0 and 1, for small sets."""
        at = {r["row_id"] for r in self.positions.collect()}
        return "".join("1" if i in at else "0" for i in range(self.n))


def pack_words(positions: DataFrame, *keys: str) -> DataFrame:
    """(*keys, word_id, word) of the words that hold a position, combined map-side by bit_or."""
    bit = F.expr("shiftleft(1L, cast(row_id % 64 as int))")
    return positions.groupBy(*keys, F.expr("row_id div 64").alias("word_id")).agg(F.bit_or(bit).alias("word"))


def unpack_words(words: DataFrame) -> DataFrame:
    """The positions of (word_id, word)."""
    return words.select("word_id", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).filter(F.expr("shiftright(word, k) & 1L") == 1).select((F.col("word_id") * 64 + F.col("k")).alias("row_id"))


def words_and_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """(f) of two packed sets: bits of the words both hold."""
    both = a.join(b.withColumnRenamed("word", "other"), "word_id")
    return both.agg(F.coalesce(F.sum(F.bit_count(F.col("word").bitwiseAND(F.col("other")))), F.lit(0)).cast("bigint").alias("f"))


def reshard(positions: DataFrame, bounds: list[int]) -> DataFrame:
    """(segment, row_id) of a set cut at ascending ``bounds`` (0 first, the length last), positions from 0 in each."""
    segment = F.lit(-1)
    for b in bounds[:-1]:
        segment = segment + (F.col("row_id") >= b).cast("int")
    starts = F.array(*(F.lit(b).cast("bigint") for b in bounds))
    return positions.withColumn("segment", segment).select("segment", (F.col("row_id") - F.element_at(starts, F.col("segment") + 1)).alias("row_id"))
