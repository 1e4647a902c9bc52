"""Frames and indexes on disk, as Parquet folders.

``rows`` and ``postings`` are folders of one frame; postings are range-partitioned and sorted by key and row, one folder a
column, so a key lookup reads one column's folder and few row groups, and a key that most rows hold is spread over many
files. Writes go through Spark's commit protocol. An index has several folders: each write makes a new version of all of them and
then switches one pointer to it, so that readers see the old version or the new one, never parts of both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgrid import schema
from siftgrid.analyzers import IndexConf
from siftgrid.lineage import cut
from siftgrid.operators.index import KEY, IndexedFrame, build_dictionary
from siftgrid.operators.segments import multi_frame, multi_indexed


def write_frame(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def open_frame(spark: SparkSession, path: str, of: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(of) if of else spark.read).parquet(path)


def write_typed(spark: SparkSession, items: Iterable[dict], of: T.StructType, path: str) -> None:
    """Items as rows numbered from 0."""
    names = sorted(of.fieldNames())
    full = T.StructType([T.StructField("row_id", T.LongType()), *(of[c] for c in names)])
    write_frame(spark.createDataFrame([(i, *(item[c] for c in names)) for i, item in enumerate(items)], full), path)


def create_typed(spark: SparkSession, items: Iterable[dict], of: T.StructType, path: str) -> DataFrame:
    write_typed(spark, items, of, path)
    return open_frame(spark, path)


def write_sequence(spark: SparkSession, values: Sequence, kind: str, path: str) -> None:
    write_frame(schema.from_columns(spark, {"value": list(values)}, {"value": kind}), path)


_STORED = "value_num bigint, value_str string, row_id bigint, col string"


def _current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that the pointer names, if there is one: the pointer is the newest name in ``versions``."""
    names = [int(x) for x in list_names(spark, f"{path}/versions") if x.isdigit()]
    return f"{path}/v{max(names)}" if names else None


def write_indexed(frame: IndexedFrame, path: str) -> None:
    """Rows, postings, dictionary and length as a new version, which becomes the current one as a whole when all are there.

    The version before stays for readers that have it open; versions older than that are removed.
    """
    spark = frame.rows.sparkSession
    known = [int(x) for x in list_names(spark, f"{path}/versions") if x.isdigit()]
    number = max(known, default=0) + 1
    to = f"{path}/v{number}"
    write_frame(frame.rows, f"{to}/rows")
    # computed once: the ranges are drawn from the table, not from the texts again
    cut(frame.postings).repartitionByRange(*KEY, "row_id").sortWithinPartitions(*KEY, "row_id").write.mode("overwrite").partitionBy("col").parquet(f"{to}/postings")
    stored = spark.read.schema(_STORED).parquet(f"{to}/postings")
    write_frame(build_dictionary(stored).select(*KEY, "ordinal", "f"), f"{to}/dictionary")
    write_frame(frame_size(open_frame(spark, f"{to}/rows")) if frame.known_n is None else spark.range(1).select(F.lit(frame.known_n).cast("bigint").alias("n")), f"{to}/length")
    made, fs = _path(spark, f"{path}/versions/{number}")
    fs.mkdirs(made.getParent())
    fs.create(made, True).close()
    for old in known:
        if old < number - 1:
            for gone in (f"{path}/versions/{old}", f"{path}/v{old}"):
                fs.delete(_path(spark, gone)[0], True)


def open_indexed(spark: SparkSession, path: str, conf: IndexConf = IndexConf()) -> IndexedFrame:
    """The current version; a path without one raises FileNotFoundError. Lookups read the postings of one key, the length is stored."""
    at = _current(spark, path)
    if at is None:
        raise FileNotFoundError(path)
    postings = spark.read.schema(_STORED).parquet(f"{at}/postings").select(*KEY, "row_id")
    return IndexedFrame(open_frame(spark, f"{at}/rows"), postings, conf, open_frame(spark, f"{at}/dictionary"), open_frame(spark, f"{at}/length").first()[0])


def create_indexed(frame: IndexedFrame, path: str) -> IndexedFrame:
    write_indexed(frame, path)
    return open_indexed(frame.rows.sparkSession, path, frame.conf)


def have_indexed(spark: SparkSession, path: str, provide: Callable[[], IndexedFrame], conf: IndexConf = IndexConf()) -> IndexedFrame:
    """Opens what is there; only if no version is complete, ``provide`` is called and written."""
    if _current(spark, path) is None:
        write_indexed(provide(), path)
    return open_indexed(spark, path, conf)


def write_merged(frames: Sequence[tuple[DataFrame, int]], path: str, empty: DataFrame | None = None) -> None:
    write_frame(multi_frame(frames, empty), path)


def write_merged_indexed(frames: Sequence[IndexedFrame], path: str, empty: IndexedFrame | None = None) -> None:
    """Compacts the frames and their indexes as they are; nothing is tokenized again."""
    write_indexed(multi_indexed(frames, empty), path)


def open_multi_indexed(spark: SparkSession, paths: Sequence[str], conf: IndexConf = IndexConf()) -> IndexedFrame:
    return multi_indexed([open_indexed(spark, p, conf) for p in paths])


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    made, fs = _path(spark, path)
    return fs.exists(made)


def list_names(spark: SparkSession, path: str) -> list[str]:
    made, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(made)) if fs.exists(made) else []


def byte_size(spark: SparkSession, path: str) -> int:
    made, fs = _path(spark, path)
    return fs.getContentSummary(made).getLength()


def free_id(spark: SparkSession, path: str) -> int:
    """The first number that names nothing in a folder."""
    taken = {int(x) for x in list_names(spark, path) if x.isdigit()}
    return next(i for i in range(len(taken) + 1) if i not in taken)


def frame_size(df: DataFrame) -> DataFrame:
    """(n) of a frame: one beyond its last position, 0 if it has none."""
    return df.agg(F.coalesce(F.max("row_id") + 1, F.lit(0)).cast("bigint").alias("n"))
