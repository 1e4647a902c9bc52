"""The inverted index: postings of every (column, token), their dictionary, and frames that carry both.

A key is (col, value_num, value_str): booleans are 0 / 1 and integers stand in value_num, strings in value_str. Postings
are a long table, one row per key and position, which partitions, prunes and compresses by key however many keys there
are. Null values have no tokens.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgrid import schema
from siftgrid.analyzers import IndexConf
from siftgrid.functions.stats import CoStats
from siftgrid.operators.bits import BitSet

KEY = ("col", "value_num", "value_str")
Value = bool | int | str


def indexed_columns(rows: DataFrame, conf: IndexConf) -> list[str]:
    """The columns that are indexed, in order; one of a type without order among keys raises TypeError."""
    names = [c for c in schema.field_names(rows) if conf.is_analyzed(c)]
    for c in names:
        if not isinstance(rows.schema[c].dataType, schema.INDEXABLE) and c not in conf.analyzers:
            raise TypeError(f"column {c} of type {rows.schema[c].dataType.simpleString()} cannot be indexed; leave it out with without_field")
    return names


def build_postings(rows: DataFrame, conf: IndexConf = IndexConf()) -> DataFrame:
    """(col, value_num, value_str, row_id), distinct. One scan: the tokens of all columns are exploded at once."""

    def keys(c: str) -> Column:
        kind = rows.schema[c].dataType
        element = kind.elementType if isinstance(kind, T.ArrayType) else kind
        text = isinstance(element, T.StringType)
        num = lambda t: F.lit(None).cast("bigint") if text else (t.cast("int") if isinstance(element, T.BooleanType) else t).cast("bigint")
        return F.transform(F.coalesce(conf.analyze(c), F.array().cast(T.ArrayType(element))), lambda t: F.struct(F.lit(c).alias("col"), num(t).alias("value_num"), (t if text else F.lit(None).cast("string")).alias("value_str")))

    columns = indexed_columns(rows, conf)
    if not columns:
        return rows.sparkSession.createDataFrame([], "col string, value_num bigint, value_str string, row_id bigint")
    tokens = rows.select("row_id", F.explode(F.concat(*map(keys, columns))).alias("k"))
    return tokens.select("k.col", "k.value_num", "k.value_str", F.col("row_id").cast("bigint").alias("row_id")).distinct()


def frequencies(postings: DataFrame) -> DataFrame:
    """(col, value_num, value_str, f): the size of each key's posting set, summed map-side first."""
    return postings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("f"))


def build_dictionary(postings: DataFrame) -> DataFrame:
    """(col, value_num, value_str, f, ordinal): keys numbered in key order, by a range-partitioned sort."""
    return schema.dense_positions(frequencies(postings), *KEY, name="ordinal")


def key_is(col: str, value: Value) -> Column:
    """The condition for one key; it reaches the scan of stored postings as a pushed filter."""
    if isinstance(value, str):
        return (F.col("col") == col) & (F.col("value_str") == value)
    return (F.col("col") == col) & (F.col("value_num") == int(value))


def _order(col: str, value: Value, less: bool) -> Column:
    name = "value_str" if isinstance(value, str) else "value_num"
    value = value if isinstance(value, str) else int(value)
    near = F.col(name) <= value if less else F.col(name) >= value
    other = F.col("col") < col if less else F.col("col") > col
    return other | ((F.col("col") == col) & near)


def floor_and_ceil(dictionary: DataFrame, col: str, value: Value) -> DataFrame:
    """(hit, floor, ceil): the key's ordinal or -1, the last ordinal not above it (-1 if none), the first not below it (the
    number of keys if none)."""
    return dictionary.agg(
        F.coalesce(F.max(F.when(key_is(col, value), F.col("ordinal"))), F.lit(-1)).cast("bigint").alias("hit"),
        F.coalesce(F.max(F.when(_order(col, value, True), F.col("ordinal"))), F.lit(-1)).cast("bigint").alias("floor"),
        F.coalesce(F.min(F.when(_order(col, value, False), F.col("ordinal"))), F.count(F.lit(1))).cast("bigint").alias("ceil"),
    )


@dataclass(frozen=True)
class IndexedFrame:
    """Rows with positions and the postings of their index. Positions are those of ``row_id``; n is their number."""

    rows: DataFrame
    postings: DataFrame
    conf: IndexConf = IndexConf()
    known: DataFrame | None = None
    known_n: int | None = None

    @staticmethod
    def create(rows: DataFrame, conf: IndexConf = IndexConf()) -> IndexedFrame:
        return IndexedFrame(rows, build_postings(rows, conf), conf)

    @cached_property
    def n(self) -> int:
        """The number of positions: one beyond the last, which holds for rows delivered twice too."""
        if self.known_n is not None:
            return self.known_n
        last = self.rows.agg(F.max("row_id")).first()[0]
        return 0 if last is None else last + 1

    @cached_property
    def dictionary(self) -> DataFrame:
        return self.known if self.known is not None else build_dictionary(self.postings)

    def index(self, col: str, value: Value) -> BitSet:
        """The key's posting set; a key that is not there has the empty set."""
        return BitSet(self.postings.filter(key_is(col, value)).select("row_id"), self.n)

    def index_at(self, ordinal: int) -> BitSet:
        key = self.dictionary.filter(F.col("ordinal") == ordinal).select(*KEY)
        same = reduce(lambda a, b: a & b, (F.col(f"p.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KEY))
        return BitSet(self.postings.alias("p").join(F.broadcast(key).alias("k"), same, "left_semi").select("row_id"), self.n)

    def frequency(self, col: str, value: Value) -> int:
        return self.index(col, value).count()

    def ordinal_of(self, col: str, value: Value) -> int:
        """The key's ordinal, -1 if it is not there."""
        found = self.dictionary.filter(key_is(col, value)).select("ordinal").first()
        return -1 if found is None else found[0]

    def col_values(self, col: str) -> DataFrame:
        """(value_num, value_str, ordinal) of a column's keys in order."""
        return self.dictionary.filter(F.col("col") == col).orderBy("ordinal").select("value_num", "value_str", "ordinal")

    def view(self, start: int, until: int) -> IndexedFrame:
        return IndexedFrame(schema.view(self.rows, start, until), schema.view(self.postings, start, until), self.conf)

    def cast(self, to: T.StructType) -> IndexedFrame:
        """The rows under another schema, by name; the index is that of the columns that stay."""
        kept = [f.name for f in to.fields]
        return IndexedFrame(schema.cast_by_name(self.rows, to), self.postings.filter(F.col("col").isin(kept)), self.conf)

    def co_stats(self, a: tuple[str, Value], b: tuple[str, Value]) -> DataFrame:
        """(n, f_a, f_b, f_ab, statistics) of one pair, in one pass over the postings of both keys."""
        both = self.postings.filter(key_is(*a) | key_is(*b)).groupBy("row_id").agg(F.max(key_is(*a).cast("int")).alias("a"), F.max(key_is(*b).cast("int")).alias("b"))
        zero = F.lit(0).cast("bigint")
        counts = both.agg(F.coalesce(F.sum("a"), zero).alias("f_a"), F.coalesce(F.sum("b"), zero).alias("f_b"), F.coalesce(F.sum(F.col("a") * F.col("b")), zero).alias("f_ab"))
        counts = counts.withColumn("n", F.lit(self.n).cast("bigint"))
        return counts.select("n", "f_a", "f_b", "f_ab", *CoStats(F.col("n"), F.col("f_a"), F.col("f_b"), F.col("f_ab")).columns())


def all_pair_counts(postings: DataFrame, left: Column, right: Column, apart: bool = True) -> DataFrame:
    """(col_a, num_a, str_a, col_b, num_b, str_b, f_a, f_b, f_ab) of every key that meets ``left`` with every one that meets
    ``right``; pairs without a common row are included unless ``apart`` is false.

    Common rows come from one join on row_id, summed map-side. Statistics are defined for pairs that have none as well;
    with ``apart`` the result has a row for each pair of keys, which the conditions are to restrict: that, and not the
    rows, is what the product of the two dictionaries costs. Without it no product is made. A pair of a key with
    itself is left out.
    """
    a = postings.filter(left).select(*(F.col(c).alias(x) for c, x in zip(KEY, ("col_a", "num_a", "str_a"), strict=True)), "row_id")
    b = postings.filter(right).select(*(F.col(c).alias(x) for c, x in zip(KEY, ("col_b", "num_b", "str_b"), strict=True)), "row_id")
    ka, kb = ["col_a", "num_a", "str_a"], ["col_b", "num_b", "str_b"]
    met = a.join(b, "row_id").groupBy(*ka, *kb).agg(F.count(F.lit(1)).alias("f_ab"))
    da, db = a.groupBy(*ka).agg(F.count(F.lit(1)).alias("f_a")), b.groupBy(*kb).agg(F.count(F.lit(1)).alias("f_b"))
    both = lambda u, v, names: reduce(lambda p, q: p & q, (F.col(f"{u}.{c}").eqNullSafe(F.col(f"{v}.{c}")) for c in names))
    own = reduce(lambda p, q: p & q, (F.col(f"{'x' if apart else 'y'}.{p_}").eqNullSafe(F.col(f"{'x' if apart else 'y'}.{q_}")) for p_, q_ in zip(ka, kb, strict=True)))
    if not apart:
        counted = met.alias("y").filter(~own).join(da.alias("a"), both("y", "a", ka)).join(db.alias("b"), both("y", "b", kb))
        return counted.select(*(f"y.{c}" for c in (*ka, *kb)), "a.f_a", "b.f_b", "y.f_ab")
    x, y = da.crossJoin(db).alias("x"), met.alias("y")
    return x.join(y, both("x", "y", (*ka, *kb)), "left").filter(~own).select(*(f"x.{c}" for c in (*ka, *kb)), "x.f_a", "x.f_b", F.coalesce("y.f_ab", F.lit(0)).cast("bigint").alias("f_ab"))
