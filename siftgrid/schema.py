"""Rows with explicit positions: Spark frames are unordered, so a frame's rows carry ``row_id`` 0..n-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgrid.lineage import cut

#: Types whose values can be index keys.
NUMERIC_KEYS = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
INDEXABLE = (*NUMERIC_KEYS, T.StringType)


def field_names(df: DataFrame) -> list[str]:
    """The fields in the engine's column order, which is alphabetical; ``row_id`` and ``segment`` are no fields."""
    return sorted(c for c in df.columns if c not in ("row_id", "segment"))


def dense_positions(df: DataFrame, *order: Column | str, name: str = "row_id") -> DataFrame:
    """``df`` with ``name`` = its rank 0.. in the given order, without a single-partition sort.

    Rows are range-partitioned and sorted; each partition's size (one number a partition) gives the offset of the next.
    Ties get neighbouring positions in no particular order. An empty frame stays empty.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = cut(placed)
    part = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    if not offsets:
        return placed.drop("__at").withColumn(name, F.lit(None).cast("bigint"))
    starts = df.sparkSession.createDataFrame(list(offsets.items()), "__p bigint, __start bigint")
    located = placed.withColumn("__p", part).join(F.broadcast(starts), "__p")
    return located.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__at", "__start")


def from_columns(spark, columns: dict[str, list], types: dict[str, str]) -> DataFrame:
    """A frame of equally long columns, with row_id; ragged columns raise ValueError."""
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise ValueError(f"columns differ in length: { {k: len(v) for k, v in columns.items()} }")
    names = sorted(columns)
    schema = ", ".join(["row_id bigint", *(f"`{c}` {types[c]}" for c in names)])
    return spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*(columns[c] for c in names), strict=True))], schema)


def column_at(df: DataFrame, i: int) -> str:
    """The name of the i-th field; out of range raises IndexError."""
    return field_names(df)[i]


def project(df: DataFrame, field: str | int) -> DataFrame:
    """(row_id, field) by name or by ordinal; an unknown name raises ValueError."""
    name = column_at(df, field) if isinstance(field, int) else field
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.select("row_id", name)


def view(df: DataFrame, start: int, until: int) -> DataFrame:
    """Rows start..until-1 with positions from 0; views of views compose. Also slices postings."""
    return df.filter((F.col("row_id") >= start) & (F.col("row_id") < until)).withColumn("row_id", F.col("row_id") - start)


def cast_by_name(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of ``schema`` by name: present ones cast, missing booleans false, other missing ones null."""

    def one(f: T.StructField) -> Column:
        if f.name in df.columns:
            return F.col(f.name).cast(f.dataType).alias(f.name)
        return F.lit(False if isinstance(f.dataType, T.BooleanType) else None).cast(f.dataType).alias(f.name)

    return df.select("row_id", *(one(f) for f in schema.fields if f.name != "row_id"))


def filled(spark, n: int, value, kind: str) -> DataFrame:
    """n rows of one constant."""
    return spark.range(n).select(F.col("id").alias("row_id"), F.lit(value).cast(kind).alias("value"))


def is_defined_at(n: int, position: int) -> bool:
    """Whether a frame or sequence of n rows has a row at the position."""
    return 0 <= position < n


def row_at(df: DataFrame, position: int) -> DataFrame:
    """The row at a position, as a frame that reads only what the filter on stored positions leaves; empty if there is none."""
    return df.filter(F.col("row_id") == position)


def cell_at(df: DataFrame, field: str | int, position: int) -> DataFrame:
    """(field) of the row at a position, by the field's name or ordinal."""
    return row_at(project(df, field), position).drop("row_id")
