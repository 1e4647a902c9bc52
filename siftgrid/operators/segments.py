"""Segments: several frames as one, virtually or physically. Indexes are merged as they are, never built again."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgrid.analyzers import IndexConf
from siftgrid.operators.bits import BitSet
from siftgrid.operators.index import KEY, IndexedFrame
from siftgrid.schema import dense_positions


def _shifted(df: DataFrame, by: int) -> DataFrame:
    return df.withColumn("row_id", F.col("row_id") + by) if by else df


def multi_frame(frames: Sequence[tuple[DataFrame, int]], empty: DataFrame | None = None) -> DataFrame:
    """The frames (rows, n) one after the other. None at all give ``empty``, a frame without rows but with the schema."""
    if not frames:
        if empty is None:
            raise ValueError("no frames and no schema")
        return empty
    parts, start = [], 0
    for rows, n in frames:
        parts.append(_shifted(rows, start))
        start += n
    return reduce(DataFrame.unionByName, parts)


def multi_indexed(frames: Sequence[IndexedFrame], empty: IndexedFrame | None = None) -> IndexedFrame:
    """The indexed frames as one. A key that a frame lacks simply has no postings there."""
    if not frames:
        if empty is None:
            raise ValueError("no frames and no schema")
        return empty
    rows = multi_frame([(f.rows, f.n) for f in frames])
    postings = multi_frame([(f.postings, f.n) for f in frames])
    known = None
    if all(f.known is not None for f in frames):
        # stored dictionaries are summed, the postings need not be counted again
        summed = reduce(DataFrame.unionByName, (f.known.select(*KEY, "f") for f in frames)).groupBy(*KEY).agg(F.sum("f").alias("f"))
        known = dense_positions(summed, *KEY, name="ordinal")
    return IndexedFrame(rows, postings, frames[0].conf, known, sum(f.n for f in frames))


def merged_keys(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """(*key, sources, at): the distinct keys of all sorted lists, which lists hold each, and the place within each
    (``at`` maps the list's number to it)."""
    numbered = [f.select(*key, F.col("ordinal")).withColumn("source", F.lit(i)) for i, f in enumerate(frames)]
    grouped = reduce(DataFrame.unionByName, numbered).groupBy(*key)
    return grouped.agg(F.count(F.lit(1)).alias("sources"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "ordinal")))).alias("at"))


def multi_bits(sets: Sequence[BitSet]) -> BitSet:
    """The sets one after the other."""
    return reduce(BitSet.concat, sets)


def segment_starts(rows: DataFrame) -> DataFrame:
    """(segment, start, n): where each segment's rows begin when segments follow one another; a row for each segment."""
    from pyspark.sql import Window

    sizes = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint")).select("segment", "start", "n")


def place_segments(entries: DataFrame, starts: DataFrame) -> DataFrame:
    """Entries (segment, row_id, ...) with row_id moved to the segment's place in the whole."""
    return entries.join(F.broadcast(starts.select("segment", "start")), "segment").withColumn("row_id", F.col("row_id") + F.col("start")).drop("start")


def empty_indexed(rows: DataFrame, conf: IndexConf = IndexConf()) -> IndexedFrame:
    """No rows of the schema of ``rows``: all columns, no keys."""
    return IndexedFrame.create(rows.limit(0), conf)
