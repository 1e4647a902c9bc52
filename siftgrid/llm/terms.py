"""Terms of a features string, and records as sets of terms."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPLIT = re.compile(r"[\s,;|]+")


def split_text(text: str) -> list[str]:
    """Compose (NFC), lower, split at white space, commas, semicolons and vertical bars; no empty terms."""
    return [x for x in _SPLIT.split(unicodedata.normalize("NFC", text).lower()) if x]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType())])))
def _counted(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())]))
    return pa.array([[{"term": t, "n": n} for t, n in Counter(split_text(x)).items()] if x else [] for x in texts.to_pylist()], kind)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _distinct(texts: pa.Array) -> pa.Array:
    return pa.array([list(dict.fromkeys(split_text(x))) if x else [] for x in texts.to_pylist()], pa.list_(pa.string()))


def counted_terms(text: Column) -> Column:
    """ARRAY<STRUCT<term, n>>: the distinct terms of one row with their occurrences; null and blank texts give []."""
    return _counted(text)


def distinct_terms(text: Column) -> Column:
    """ARRAY<STRING>: the distinct terms of one row in order of first occurrence; null and blank texts give []."""
    return _distinct(text)


def record_sets(rows: DataFrame, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    """(id BIGINT, terms ARRAY<STRING> sorted by code point, *keep): one row per non-null id with at least one term.

    Rows of one id are united. ``keep`` are aggregate expressions over the id's rows, each with an alias.
    Terms are exploded before the grouping, so repeated rows are reduced map-side to the distinct terms;
    what one group holds is the record itself, whatever number of rows delivered it.
    """
    tokens = rows.filter(F.col(id_col).isNotNull()).withColumn("__terms", distinct_terms(F.col(text_col))).withColumn("__term", F.explode("__terms"))
    return tokens.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.sort_array(F.collect_set("__term")).alias("terms"), *keep)
