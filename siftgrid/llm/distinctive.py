"""Problem 5: how distinctive a term is per record, by a parsimonious language model.

A record's terms are taken as a mixture of its own distribution and the background of the whole collection.
Expectation-maximisation moves mass from terms that the background explains to those it does not; the converged
own probabilities rank the terms. As a term counts once per record, its own probability falls with the number
of records that hold it, and equally frequent terms stay equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITERATIONS, OWN_SHARE, HOT = 40, 0.5, 1000


def document_frequencies(records: DataFrame) -> DataFrame:
    """(term, df) of records (id, terms), summed map-side before the shuffle."""
    return records.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def with_frequencies(records: DataFrame, df: DataFrame, total: int) -> DataFrame:
    """(id, term, df): each term of each record with the records that hold it.

    Terms in more than 1 / HOT of all term tokens number at most HOT, whatever the data: they are broadcast,
    and their tokens take random join keys that match nothing. All others meet ``df`` in a shuffled join, in which
    no key has more than that share of the tokens.
    """
    tokens = records.select("id", F.explode("terms").alias("term"))
    hot = F.broadcast(df.filter(F.col("df") * HOT > total).withColumnRenamed("df", "hot_df"))
    spread = tokens.join(hot, "term", "left").withColumn("on", F.when(F.col("hot_df").isNull(), F.col("term")).otherwise(F.concat(F.lit("\u0000 "), F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("string"))))
    rare = df.select(F.col("term").alias("on"), "df")
    return spread.join(rare, "on", "left").select("id", "term", F.coalesce("hot_df", "df").alias("df"))


def _em(own_share: float, iterations: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            if not batch.num_rows:
                continue
            offsets = np.asarray(terms.offsets)
            flat = terms.flatten()
            offsets = offsets - offsets[0]
            df = np.asarray(flat.field(0), dtype=np.float64)
            size = np.diff(offsets)
            starts, background = offsets[:-1], (1 - own_share) * df / total
            p = np.repeat(1.0 / np.maximum(size, 1), size)
            for _ in range(iterations):
                own = own_share * p
                e = own / (own + background)
                p = e / np.repeat(np.add.reduceat(e, starts), size)
            most = np.repeat(np.maximum.reduceat(p, starts), size)
            ids = np.repeat(np.asarray(batch.column("id")), size)
            yield pa.RecordBatch.from_arrays([pa.array(ids), flat.field(1), pa.array(df.astype(np.int64)), pa.array(p), pa.array((p >= most * (1 - 1e-9)) & (df == np.repeat(df[starts], size)))], ["id", "term", "df", "weight", "top"])

    return run


def distinctive_terms(counted: DataFrame, total: int, own_share: float = OWN_SHARE, iterations: int = ITERATIONS) -> DataFrame:
    """(id, term, df, weight, top) of counted (id, term, df), each term once per record; ``total`` is the number
    of term tokens of the collection. weight is the record's own probability of the term (the weights of a record
    sum to 1); top marks the terms of the largest weight, all of them if several tie, after a check that their
    df is exactly the record's smallest (weights of almost equal df may agree in all digits)."""
    sets = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("terms"))
    return sets.mapInArrow(_em(own_share, iterations, total), "id bigint, term string, df bigint, weight double, top boolean")
