"""Problem 1: frequency of every distinct value or term, by last-seen counters.

Tokens are hash-partitioned by (field, term, shard of the record) and ordered by record inside. Each
term then needs only three numbers while its run is read: occurrences, records and the last record seen.
A token opens a new record of its term exactly where the record differs from the last one seen (a window
``lag``), so no set of records is ever kept. Sharding by record splits a term that a third of all records
hold; as the shards hold disjoint records, their counters simply add up. The number of shards follows from that of the tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrid.llm.terms import counted_terms

#: Tokens that one shard of a term that stands in every third record would have at most.
PER_SHARD = 1_000_000


def text_tokens(rows: DataFrame, field: str, id_col: str, text_col: str) -> DataFrame:
    """(field, record, term, n): the terms of each row with their occurrences in it; rows without an id are left out."""
    return (
        rows.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("bigint").alias("record"), F.explode(counted_terms(F.col(text_col))).alias("t"))
        .select(F.lit(field).alias("field"), "record", "t.term", F.col("t.n").cast("bigint").alias("n"))
    )


def posting_key() -> Column:
    """``col=value`` of an index entry, its value exactly as it stands; null where column or value is missing."""
    return F.concat(F.col("col"), F.lit("="), F.coalesce(F.col("value_str"), F.col("value_num").cast("string")))


def key_tokens(postings: DataFrame, field: str) -> DataFrame:
    """(field, record, term, n) of index entries; entries without row_id, column or value do not count."""
    entries = postings.select(F.lit(field).alias("field"), F.col("row_id").alias("record"), posting_key().alias("term"))
    return entries.filter("record IS NOT NULL AND term IS NOT NULL").withColumn("n", F.lit(1).cast("bigint"))


def shards_of(rows: DataFrame) -> int:
    """Shards for a count of ``rows``, from their number: a table's is in its footers."""
    return max(1, -(-rows.count() // (3 * PER_SHARD)))


def term_counters(tokens: DataFrame, shards: int = 1) -> DataFrame:
    """(field, term, occurrences, records) of tokens (field, record, term, n).

    Repeated tokens add to occurrences only. Tokens without record or term are ignored. An empty input gives no rows.
    """
    own = tokens.filter("record IS NOT NULL AND term IS NOT NULL").select("field", "term", "record", "n", F.pmod(F.xxhash64("record"), F.lit(shards)).cast("int").alias("shard"))
    run = Window.partitionBy("field", "term", "shard").orderBy("record")
    last = own.withColumn("last", F.lag("record").over(run))
    return last.groupBy("field", "term").agg(F.sum("n").cast("bigint").alias("occurrences"), F.count(F.when(F.col("last").isNull() | (F.col("last") != F.col("record")), 1)).alias("records"))


def record_counts(tokens: DataFrame) -> DataFrame:
    """(field, n): the records of each field, reduced to distinct ones in each task before they are shuffled."""
    return tokens.filter("record IS NOT NULL AND term IS NOT NULL").select("field", "record").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def marked_terms(counters: DataFrame, totals: DataFrame, rare: int = 2, common: int = 5) -> DataFrame:
    """(field, term, occurrences, records, n, marks): marks holds ``rare`` where records <= rare and ``common``
    where common * records > n, n being the field's records; both may apply. The totals (field, n) are one row per field, hence the broadcast."""
    marks = F.array_compact(F.array(F.when(F.col("records") <= rare, F.lit("rare")), F.when(F.lit(common) * F.col("records") > F.col("n"), F.lit("common"))))
    return counters.join(F.broadcast(totals), "field").select("field", "term", "occurrences", "records", "n", marks.alias("marks"))
