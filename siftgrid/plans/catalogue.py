"""The queries of the engine's operators over the test tables, and the SQL each is compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgrid import schema
from siftgrid.analyzers import IndexConf, java_split
from siftgrid.functions import stats
from siftgrid.lineage import cut, ensure_checkpoint_dir
from siftgrid.operators import bits, index, knn, segments
from siftgrid.operators.bits import BitSet
from siftgrid.operators.index import IndexedFrame
from siftgrid.sources import store
from siftgrid.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


ITEM_FIELDS = ("bignumber", "name", "property", "quantity", "text")
ITEM_CONF = IndexConf().with_analyzer("text", java_split)
ANIMAL_CONF = IndexConf().with_analyzer("features", java_split)


def item_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "example_item").select("row_id", "segment", *ITEM_FIELDS)


def item_frame(spark: SparkSession, d: str) -> IndexedFrame:
    return IndexedFrame.create(item_rows(spark, d), ITEM_CONF)


def animal_frame(spark: SparkSession, d: str) -> IndexedFrame:
    """Animals, each row once; their row_id is a key, so positions are its values."""
    rows = table(spark, d, "animal").select("row_id", "legs", "features", "noise", "is_duck").dropDuplicates(["row_id"])
    return IndexedFrame.create(rows, ANIMAL_CONF)


def _split(c: str) -> str:
    return f"(CASE WHEN {c} <> '' AND rtrim({c}, ' ') = '' THEN [] ELSE string_split(rtrim({c}, ' '), ' ') END)"


def _num(c: str, source: str, kind: str = "BIGINT") -> str:
    return f"SELECT DISTINCT '{c}' AS col, CAST({'CAST(' + c + ' AS INT)' if kind == 'BOOLEAN' else c} AS BIGINT) AS value_num, CAST(NULL AS VARCHAR) AS value_str, row_id FROM {source} WHERE {c} IS NOT NULL"


def _str(c: str, source: str) -> str:
    return f"SELECT DISTINCT '{c}', CAST(NULL AS BIGINT), {c}, row_id FROM {source} WHERE {c} IS NOT NULL"


def _words(c: str, source: str) -> str:
    return f"SELECT DISTINCT '{c}', CAST(NULL AS BIGINT), unnest({_split(c)}), row_id FROM {source} WHERE {c} IS NOT NULL"


_P = f"p AS ({_num('bignumber', 'example_item')} UNION ALL {_str('name', 'example_item')} UNION ALL {_num('property', 'example_item', 'BOOLEAN')} UNION ALL {_num('quantity', 'example_item')} UNION ALL {_words('text', 'example_item')})"
_D = f"{_P}, f AS (SELECT col, value_num, value_str, count(*) AS f FROM p GROUP BY ALL), d AS (SELECT *, row_number() OVER (ORDER BY col, value_num, value_str NULLS FIRST) - 1 AS ordinal FROM f)"
_N = "n AS (SELECT max(row_id) + 1 AS n FROM example_item)"
_BITS = "a AS (SELECT DISTINCT row_id FROM example_item WHERE property), b AS (SELECT DISTINCT row_id FROM example_item WHERE quantity = 0), c AS (SELECT DISTINCT row_id FROM example_item WHERE quantity = 1)"


# projection, row access, slices, casts


@query("SELECT c_custkey AS row_id, c_mktsegment FROM customer")
def project_column(spark, d):
    return schema.project(table(spark, d, "customer").withColumnRenamed("c_custkey", "row_id"), "c_mktsegment")


@query("SELECT c_custkey AS row_id, c_acctbal FROM customer")
def project_ordinal(spark, d):
    return schema.project(table(spark, d, "customer").withColumnRenamed("c_custkey", "row_id"), 0)


@query("SELECT p_name FROM part WHERE p_partkey = 7")
def cell_lookup(spark, d):
    return schema.cell_at(table(spark, d, "part").withColumnRenamed("p_partkey", "row_id"), "p_name", 7)


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_partkey = 42")
def row_lookup(spark, d):
    return schema.row_at(table(spark, d, "part").withColumnRenamed("p_partkey", "row_id"), 42).select(F.col("row_id").alias("p_partkey"), "p_name", "p_brand", "p_type", "p_size")


@query("SELECT o_orderkey - 100 AS row_id, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def row_slice(spark, d):
    return schema.view(table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus"), 100, 900)


@query("SELECT o_orderkey - 150 AS row_id, o_orderstatus FROM orders WHERE o_orderkey >= 150 AND o_orderkey < 250")
def row_slice_of_slice(spark, d):
    return schema.view(schema.view(table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus"), 100, 900), 50, 150)


@query("SELECT DISTINCT row_id, name, CAST(quantity AS BIGINT) AS quantity, false AS flagged, CAST(NULL AS VARCHAR) AS note FROM example_item")
def cast_by_name(spark, d):
    to = T.StructType([T.StructField("flagged", T.BooleanType()), T.StructField("name", T.StringType()), T.StructField("note", T.StringType()), T.StructField("quantity", T.LongType())])
    return schema.cast_by_name(item_rows(spark, d), to).distinct()


@query("SELECT DISTINCT row_id, quantity * 2 + 1 AS mapped FROM example_item")
def map_column(spark, d):
    return item_rows(spark, d).select("row_id", (F.col("quantity") * 2 + 1).alias("mapped")).distinct()


@query("SELECT range AS row_id, 7 AS value FROM range(1000)")
def filled_sequence(spark, d):
    return schema.filled(spark, 1000, 7, "int")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events")
def dense_row_ids(spark, d):
    return schema.dense_positions(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "row_id")


@query("SELECT count(*) AS n FROM lineitem")
def frame_size(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


# index


@query(f"WITH {_D} SELECT col, value_num, value_str, f, ordinal FROM d")
def index_dictionary(spark, d):
    return item_frame(spark, d).dictionary.select("col", "value_num", "value_str", "f", "ordinal")


@query(f"WITH {_P} SELECT * FROM p")
def index_postings(spark, d):
    return item_frame(spark, d).postings


@query(f"WITH {_P} SELECT col, value_num, value_str, count(*) AS f FROM p GROUP BY ALL")
def index_frequency(spark, d):
    return index.frequencies(item_frame(spark, d).postings)


@query("SELECT row_id FROM example_item WHERE false")
def index_missing_key(spark, d):
    return item_frame(spark, d).index("name", "no such name").positions


@query("SELECT DISTINCT row_id FROM example_item WHERE quantity = -3")
def index_lookup(spark, d):
    return item_frame(spark, d).index("quantity", -3).positions


@query(f"WITH {_D} SELECT row_id FROM p JOIN d ON p.col = d.col AND p.value_num IS NOT DISTINCT FROM d.value_num AND p.value_str IS NOT DISTINCT FROM d.value_str WHERE ordinal = 30")
def index_at_ordinal(spark, d):
    return item_frame(spark, d).index_at(30).positions


@query(f"WITH {_D} SELECT ordinal FROM d WHERE col = 'quantity' AND value_num = 2")
def index_ordinal(spark, d):
    return item_frame(spark, d).dictionary.filter(index.key_is("quantity", 2)).select("ordinal")


@query(f"WITH {_D} SELECT CAST(-1 AS BIGINT) AS hit, max(CASE WHEN col < 'name' OR col = 'name' AND value_str <= 'm' THEN ordinal END) AS floor, min(CASE WHEN col > 'name' OR col = 'name' AND value_str >= 'm' THEN ordinal END) AS ceil FROM d")
def index_floor_ceil(spark, d):
    return index.floor_and_ceil(item_frame(spark, d).dictionary, "name", "m")


@query(f"WITH {_P} SELECT DISTINCT value_num FROM p WHERE col = 'quantity'")
def column_values(spark, d):
    return index.frequencies(item_frame(spark, d).postings.filter("col = 'quantity'")).select("value_num")


@query(f"WITH {_D} SELECT value_str, ordinal FROM d WHERE col = 'name'")
def column_values_with_index(spark, d):
    return item_frame(spark, d).col_values("name").select("value_str", "ordinal")


@query(f"WITH {_P} SELECT col, count(*) AS entries FROM p WHERE col NOT IN ('bignumber', 'text') GROUP BY 1")
def index_without_field(spark, d):
    conf = ITEM_CONF.without_field("bignumber", "text")
    return IndexedFrame.create(item_rows(spark, d), conf).postings.groupBy("col").agg(F.count(F.lit(1)).alias("entries"))


@query(f"SELECT token, count(DISTINCT doc_id) AS f FROM (SELECT doc_id, unnest({_split('text')}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def index_tokens(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return index.frequencies(IndexedFrame.create(rows, ITEM_CONF).postings).select(F.col("value_str").alias("token"), "f")


@query("SELECT col, value_num, value_str, count(DISTINCT row_id) AS f FROM posting WHERE row_id IS NOT NULL AND (value_num IS NOT NULL OR value_str IS NOT NULL) GROUP BY ALL")
def stored_index_frequency(spark, d):
    stored = table(spark, d, "posting").filter("row_id IS NOT NULL AND (value_num IS NOT NULL OR value_str IS NOT NULL)").select(*index.KEY, "row_id").distinct()
    return index.frequencies(stored)


@query(f"WITH {_P} SELECT col, value_num, value_str, row_id - 50 AS row_id FROM p WHERE row_id >= 50 AND row_id < 400")
def index_view(spark, d):
    return item_frame(spark, d).view(50, 400).postings


# stores: each query writes to a folder of its own beside the session's checkpoints and reads from it


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"


def _stored_items(spark, d) -> IndexedFrame:
    return store.create_indexed(item_frame(spark, d), _folder(spark))


def _half(spark, d, h: int) -> IndexedFrame:
    """The items of every other row, renumbered from 0."""
    rows = item_rows(spark, d).filter(F.col("row_id") % 2 == h).withColumn("row_id", F.expr("row_id div 2"))
    return IndexedFrame.create(rows, ITEM_CONF)


_HALVES = f"m AS (SELECT max(row_id) // 2 + 1 AS half FROM example_item WHERE row_id % 2 = 0), {_P}, q AS (SELECT col, value_num, value_str, CASE WHEN row_id % 2 = 0 THEN row_id // 2 ELSE half + row_id // 2 END AS row_id FROM p, m)"


@query(f"WITH {_D} SELECT col, value_num, value_str, f, ordinal FROM d")
def stored_dictionary(spark, d):
    return _stored_items(spark, d).dictionary.select(*index.KEY, "f", "ordinal")


@query("SELECT row_id, bignumber, name, property, quantity, text FROM example_item")
def stored_rows(spark, d):
    return _stored_items(spark, d).rows.select("row_id", *ITEM_FIELDS)


@query("SELECT DISTINCT row_id FROM example_item WHERE quantity = -3")
def stored_lookup(spark, d):
    return _stored_items(spark, d).index("quantity", -3).positions


@query(f"WITH {_D} SELECT ordinal FROM d WHERE col = 'quantity' AND value_num = 2")
def stored_ordinal(spark, d):
    frame = _stored_items(spark, d)
    return spark.createDataFrame([(frame.ordinal_of("quantity", 2),)], "ordinal bigint")


@query("SELECT DISTINCT row_id FROM example_item WHERE property")
def stored_once(spark, d):
    """A second call opens what the first has written and does not ask for the items again."""
    path = _folder(spark)
    store.have_indexed(spark, path, lambda: item_frame(spark, d), ITEM_CONF)
    return store.have_indexed(spark, path, lambda: item_frame(spark, d).view(0, 0), ITEM_CONF).index("property", True).positions


@query(f"WITH {_HALVES} SELECT * FROM q")
def stored_segments(spark, d):
    paths = [_folder(spark), _folder(spark)]
    for h, path in enumerate(paths):
        store.write_indexed(_half(spark, d, h), path)
    return store.open_multi_indexed(spark, paths, ITEM_CONF).postings


@query(f"WITH {_HALVES}, g AS (SELECT col, value_num, value_str, count(*) AS f FROM q GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY col, value_num, value_str NULLS FIRST) - 1 AS ordinal FROM g")
def stored_merged(spark, d):
    paths = [_folder(spark), _folder(spark)]
    for h, path in enumerate(paths):
        store.write_indexed(_half(spark, d, h), path)
    path = _folder(spark)
    store.write_merged_indexed([store.open_indexed(spark, p, ITEM_CONF) for p in paths], path)
    return store.open_indexed(spark, path, ITEM_CONF).dictionary.select(*index.KEY, "f", "ordinal")


# sets


def _abc(spark, d) -> tuple[BitSet, BitSet, BitSet]:
    frame = item_frame(spark, d)
    return frame.index("property", True), frame.index("quantity", 0), frame.index("quantity", 1)


@query(f"WITH {_BITS} SELECT r.range AS row_id, r.range IN (SELECT row_id FROM a) AS present FROM range(20) r")
def bits_membership(spark, d):
    a = _abc(spark, d)[0]
    return spark.range(20).withColumnRenamed("id", "row_id").join(a.positions.withColumn("p", F.lit(True)), "row_id", "left").select("row_id", F.coalesce("p", F.lit(False)).alias("present"))


@query(f"WITH {_BITS}, {_N} SELECT r.range AS row_id, r.range IN (SELECT row_id FROM a) AS present FROM range((SELECT n FROM n)) r")
def bits_membership_all(spark, d):
    a = _abc(spark, d)[0]
    return spark.range(a.n).withColumnRenamed("id", "row_id").join(a.positions.withColumn("p", F.lit(True)), "row_id", "left").select("row_id", F.coalesce("p", F.lit(False)).alias("present"))


@query(f"WITH {_BITS}, {_N} SELECT count(*) AS f, any_value(n) AS n FROM a, n")
def bits_count(spark, d):
    a = _abc(spark, d)[0]
    return a.positions.agg(F.count(F.lit(1)).alias("f")).withColumn("n", F.lit(a.n).cast("bigint"))


@query(f"WITH {_BITS} SELECT row_id FROM b")
def bits_trues(spark, d):
    return _abc(spark, d)[1].trues()


@query(f"WITH {_BITS}, {_N} SELECT r.range AS row_id, b.row_id IS NOT NULL AS value FROM range((SELECT n FROM n)) r LEFT JOIN b ON r.range = b.row_id")
def bits_vector(spark, d):
    return _abc(spark, d)[1].vector()


@query(f"""WITH {_BITS}, {_N}, w AS (SELECT row_id // 64 AS word_id, sum(1::HUGEINT << (row_id % 64)::INT) AS w FROM a GROUP BY 1)
SELECT r.range AS word_id, CAST(coalesce(CASE WHEN w >= 9223372036854775808::HUGEINT THEN w - 18446744073709551616::HUGEINT ELSE w END, 0) AS BIGINT) AS word FROM range((SELECT (n + 63) // 64 FROM n)) r LEFT JOIN w ON r.range = w.word_id""")
def bits_words(spark, d):
    return _abc(spark, d)[0].words()


@query(f"WITH {_BITS} SELECT row_id FROM a")
def bits_words_unpacked(spark, d):
    return bits.unpack_words(_abc(spark, d)[0].words())


@query(f"WITH {_BITS} SELECT row_id FROM a JOIN b USING (row_id)")
def bits_and(spark, d):
    a, b, _ = _abc(spark, d)
    return a.and_(b).positions


@query(f"WITH {_BITS} SELECT row_id FROM a WHERE row_id NOT IN (SELECT row_id FROM b)")
def bits_and_not(spark, d):
    a, b, _ = _abc(spark, d)
    return a.and_not(b).positions


@query(f"WITH {_BITS}, {_N} SELECT range AS row_id FROM range((SELECT n FROM n)) WHERE range NOT IN (SELECT row_id FROM a)")
def bits_not(spark, d):
    return _abc(spark, d)[0].not_().positions


@query(f"WITH {_BITS}, {_N} SELECT row_id FROM a UNION ALL SELECT row_id + n FROM b, n")
def bits_concat(spark, d):
    a, b, _ = _abc(spark, d)
    return a.concat(b).positions


@query(f"WITH {_BITS} SELECT row_id - 100 AS row_id FROM a WHERE row_id >= 100 AND row_id < 600")
def bits_slice(spark, d):
    return _abc(spark, d)[0].slice(100, 600).positions


@query(f"WITH {_BITS} SELECT count(*) AS f FROM a JOIN b USING (row_id)")
def bits_and_count(spark, d):
    a, b, _ = _abc(spark, d)
    return a.and_(b).positions.agg(F.count(F.lit(1)).alias("f"))


@query(f"WITH {_BITS} SELECT CAST(count(*) AS BIGINT) AS f FROM a JOIN b USING (row_id)")
def bits_words_and_count(spark, d):
    a, b, _ = _abc(spark, d)
    return bits.words_and_count(a.words(), b.words())


@query(f"WITH {_P} SELECT count(*) AS f FROM (SELECT DISTINCT row_id FROM example_item WHERE property) JOIN (SELECT DISTINCT row_id FROM example_item WHERE quantity = 0) USING (row_id) JOIN (SELECT DISTINCT row_id FROM example_item WHERE bignumber = 0) USING (row_id)")
def bits_three_way(spark, d):
    frame = item_frame(spark, d)
    return frame.index("property", True).and_(frame.index("quantity", 0)).and_(frame.index("bignumber", 0)).positions.agg(F.count(F.lit(1)).alias("f"))


@query(f"WITH {_BITS} SELECT min(row_id) AS at FROM b WHERE row_id >= 37")
def bits_seek(spark, d):
    return _abc(spark, d)[1].positions.filter("row_id >= 37").agg(F.min("row_id").alias("at"))


@query(f"WITH {_P}, {_N} SELECT col, value_num, value_str, count(*) * 256 > any_value(n) AS dense FROM p, n GROUP BY col, value_num, value_str")
def bits_density(spark, d):
    frame = item_frame(spark, d)
    return index.frequencies(frame.postings).select(*index.KEY, (F.col("f") * 256 > frame.n).alias("dense"))


@query(f"WITH {_BITS} SELECT row_id FROM b UNION SELECT 1")
def bits_update(spark, d):
    return _abc(spark, d)[1].update(1, True).positions


# statistics

_STAT_CTE = """m AS (SELECT *, (fa + 2) / (n + 4) AS pa, (fb + 2) / (n + 4) AS pb FROM i),
  s AS (SELECT *, (1 - pa) * (1 - pb) AS n0, pa * (1 - pb) AS n1, (1 - pa) * pb AS n2, pa * pb AS n3 FROM m),
  q AS (SELECT *, (n - fa - fb + fab + 2) / (n + 2 / n0) AS s0, (fa - fab + 2) / (n + 2 / n1) AS s1, (fb - fab + 2) / (n + 2 / n2) AS s2, (fab + 2) / (n + 2 / n3) AS s3 FROM s),
  t AS (SELECT *, s0 * log2(s0 / n0) + s1 * log2(s1 / n1) + s2 * log2(s2 / n2) + s3 * log2(s3 / n3) AS mi FROM q)"""
_ONE_PAIR = f"WITH {_BITS}, {_N}, i AS (SELECT (SELECT n FROM n)::DOUBLE AS n, (SELECT count(*) FROM a)::DOUBLE AS fa, (SELECT count(*) FROM b)::DOUBLE AS fb, (SELECT count(*) FROM a JOIN b USING (row_id))::DOUBLE AS fab), {_STAT_CTE}"


def _pair(spark, d) -> DataFrame:
    return item_frame(spark, d).co_stats(("property", True), ("quantity", 0))


def _rounded(df: DataFrame, *names: str) -> list:
    return [F.round(F.col(c), 9).alias(c) for c in names]


@query(f"{_ONE_PAIR} SELECT n::BIGINT AS n, fa::BIGINT AS f_a, fb::BIGINT AS f_b, fab::BIGINT AS f_ab, round(pa, 9) AS p_a, round(pb, 9) AS p_b, round(s0, 9) AS ps_0, round(s1, 9) AS ps_1, round(s2, 9) AS ps_2, round(s3, 9) AS ps_3 FROM t")
def costats_pair(spark, d):
    p = _pair(spark, d)
    return p.select("n", "f_a", "f_b", "f_ab", *_rounded(p, "p_a", "p_b", "ps_0", "ps_1", "ps_2", "ps_3"))


@query(f"{_ONE_PAIR} SELECT round(-pa * log2(pa) - (1 - pa) * log2(1 - pa), 9) AS h_a, round(-pb * log2(pb) - (1 - pb) * log2(1 - pb), 9) AS h_b FROM t")
def entropy(spark, d):
    p = _pair(spark, d)
    return p.select(*_rounded(p, "h_a", "h_b"))


@query(f"{_ONE_PAIR} SELECT round(mi, 9) AS mi FROM t")
def mutual_information(spark, d):
    p = _pair(spark, d)
    return p.select(*_rounded(p, "mi"))


@query(f"{_ONE_PAIR} SELECT round(s0 / n0, 9) AS d_0, round(s1 / n1, 9) AS d_1, round(s2 / n2, 9) AS d_2, round(s3 / n3, 9) AS d_3 FROM t")
def lift_states(spark, d):
    p = _pair(spark, d)
    return p.select(*_rounded(p, "d_0", "d_1", "d_2", "d_3"))


_ALL = f"""WITH {_P}, {_N}, x AS (SELECT col, value_num, row_id FROM p WHERE col IN ('property', 'quantity')), y AS (SELECT value_str, row_id FROM p WHERE col = 'name'),
  fx AS (SELECT col, value_num, count(*) AS fa FROM x GROUP BY ALL), fy AS (SELECT value_str, count(*) AS fb FROM y GROUP BY ALL), xy AS (SELECT col, value_num, value_str, count(*) AS fab FROM x JOIN y USING (row_id) GROUP BY ALL),
  i AS (SELECT col AS col_a, value_num AS num_a, value_str AS str_b, n::DOUBLE AS n, fa::DOUBLE AS fa, fb::DOUBLE AS fb, coalesce(fab, 0)::DOUBLE AS fab FROM fx CROSS JOIN fy CROSS JOIN n LEFT JOIN xy USING (col, value_num, value_str)), {_STAT_CTE}"""


@query(f"{_ALL} SELECT col_a, num_a, str_b, fa::BIGINT AS f_a, fb::BIGINT AS f_b, fab::BIGINT AS f_ab, round(s3 / n3, 6) AS d_3, round(mi, 6) AS mi FROM t")
def costats_all_pairs(spark, d):
    frame = item_frame(spark, d)
    pairs = index.all_pair_counts(frame.postings, F.col("col").isin("property", "quantity"), F.col("col") == "name")
    s = stats.CoStats(F.lit(frame.n).cast("bigint"), F.col("f_a"), F.col("f_b"), F.col("f_ab"))
    return pairs.select("col_a", "num_a", "str_b", "f_a", "f_b", "f_ab", F.round(s.lift(3), 6).alias("d_3"), F.round(s.mi, 6).alias("mi"))


@query("SELECT p_partkey, round((p_size / 2.0 + p_retailprice / 3.0) / (1 / 2.0 + 1 / 3.0), 6) AS mean FROM part")
def inverse_variance(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(stats.inverse_variance_weighting(F.col("p_size").cast("double"), F.lit(2.0), F.col("p_retailprice"), F.lit(3.0)), 6).alias("mean"))


@query("""WITH b AS (SELECT segment, col_a, value_a, col_b, value_b, computed_at, f_ab::DOUBLE AS f, n::DOUBLE AS n FROM costats WHERE n > 0 AND f_ab IS NOT NULL),
  c AS (SELECT *, 0.25 - (f + 0.25 * (4 / 0.1875)) / (n + 4 / 0.1875) AS off FROM b)
SELECT segment, col_a, value_a, col_b, value_b, computed_at, round(((f / n) / (1 / n) + 0.25 / (0.1875 + off * off)) / (1 / (1 / n) + 1 / (0.1875 + off * off)), 6) AS p FROM c""")
def estimated_probability(spark, d):
    rows = table(spark, d, "costats").filter("n > 0 AND f_ab IS NOT NULL")
    return rows.select("segment", "col_a", "value_a", "col_b", "value_b", "computed_at", F.round(stats.ep2(F.col("f_ab"), F.col("n"), 0.25), 6).alias("p"))


# segments: events split by event_id % 4, positions from 0 in each


def _event_segments(spark, d) -> DataFrame:
    return table(spark, d, "events").select((F.col("event_id") % 4).cast("int").alias("segment"), F.expr("event_id div 4").alias("row_id"), "event_type", "user_id")


_SEG = "s AS (SELECT CAST(event_id % 4 AS INT) AS segment, event_id // 4 AS row_id, event_type, user_id FROM events), z AS (SELECT segment, count(*) AS n FROM s GROUP BY 1), o AS (SELECT segment, coalesce(sum(n) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM z), g AS (SELECT row_id + start AS row_id, s.segment, event_type, user_id FROM s JOIN o USING (segment))"


def _placed(spark, d) -> DataFrame:
    rows = _event_segments(spark, d)
    return segments.place_segments(rows, segments.segment_starts(rows))


def _segment_frames(spark, d) -> list[IndexedFrame]:
    rows = _event_segments(spark, d)
    return [IndexedFrame.create(rows.filter(F.col("segment") == s).drop("segment"), IndexConf().without_field("user_id")) for s in range(4)]


@query(f"WITH {_SEG} SELECT row_id, event_type, user_id FROM g")
def multi_concat(spark, d):
    return _placed(spark, d).select("row_id", "event_type", "user_id")


@query(f"WITH {_SEG} SELECT event_type AS value_str, count(*) AS f FROM g GROUP BY 1")
def multi_index_frequency(spark, d):
    return index.frequencies(segments.multi_indexed(_segment_frames(spark, d)).postings).select("value_str", "f")


@query(f"WITH {_SEG} SELECT row_id FROM g WHERE event_type = 'click'")
def merged_bits(spark, d):
    return segments.multi_indexed(_segment_frames(spark, d)).index("event_type", "click").positions


@query("""WITH p AS (SELECT DISTINCT segment % 2 AS h, col, value_num, value_str FROM posting WHERE row_id IS NOT NULL AND (value_num IS NOT NULL OR value_str IS NOT NULL)),
  d AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY col, value_num, value_str NULLS FIRST) - 1 AS o FROM p)
SELECT col, value_num, value_str, count(*) AS sources, max(CASE WHEN h = 0 THEN o END) AS at_0, max(CASE WHEN h = 1 THEN o END) AS at_1 FROM d GROUP BY ALL""")
def multi_key_merge(spark, d):
    rows = table(spark, d, "posting").filter("row_id IS NOT NULL AND (value_num IS NOT NULL OR value_str IS NOT NULL)")
    lists = [index.build_dictionary(rows.filter(F.col("segment") % 2 == h)) for h in range(2)]
    return segments.merged_keys(lists, index.KEY).select(*index.KEY, "sources", F.col("at")[0].alias("at_0"), F.col("at")[1].alias("at_1"))


@query(f"WITH {_SEG} SELECT segment, count(*) AS f FROM s WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY 1")
def multi_sharded_and(spark, d):
    rows = _event_segments(spark, d)
    a, b = rows.filter("event_type = 'click'").select("segment", "row_id"), rows.filter("user_id % 2 = 0").select("segment", "row_id")
    return a.join(b, ["segment", "row_id"], "left_semi").groupBy("segment").agg(F.count(F.lit(1)).alias("f"))


@query(f"WITH {_BITS}, h AS (SELECT row_id, (row_id >= 100)::INT + (row_id >= 350)::INT AS segment FROM a) SELECT segment, row_id - [0, 100, 350][segment + 1] AS row_id FROM h")
def bits_reshard(spark, d):
    a = _abc(spark, d)[0]
    return bits.reshard(a.positions, [0, 100, 350, a.n])


@query("SELECT row_id, bignumber, name, property, quantity, text FROM example_item WHERE false")
def merge_empty(spark, d):
    rows = item_rows(spark, d).drop("segment")
    return segments.multi_indexed([], segments.empty_indexed(rows, ITEM_CONF)).rows


@query("SELECT col, value_num, value_str, row_id FROM posting WHERE false")
def merge_empty_index(spark, d):
    return segments.multi_indexed([], segments.empty_indexed(item_rows(spark, d), ITEM_CONF)).postings


# nearest neighbours: animals by legs and features, the target is being a duck

_AP = f"""r AS (SELECT DISTINCT row_id, legs, features, noise, is_duck FROM animal), p AS ({_num('legs', 'r')} UNION ALL {_words('features', 'r')}), nn AS (SELECT max(row_id) + 1 AS n FROM r),
  t AS (SELECT row_id FROM r WHERE is_duck), def AS (SELECT row_id FROM r WHERE is_duck IS NOT NULL)"""


def _weight_sql(masked: bool) -> str:
    n = "(SELECT count(*) FROM def)" if masked else "(SELECT n FROM nn)"
    inside = "count(*) FILTER (WHERE row_id IN (SELECT row_id FROM def))" if masked else "count(*)"
    return f"""{_AP}, k AS (SELECT col, value_num, value_str, {n}::DOUBLE AS n, {inside}::DOUBLE AS fa, (SELECT count(*) FROM t)::DOUBLE AS fb, count(*) FILTER (WHERE row_id IN (SELECT row_id FROM t))::DOUBLE AS fab FROM p GROUP BY col, value_num, value_str),
  i AS (SELECT * FROM k), {_STAT_CTE.replace('t AS (', 'u AS (')}, w AS (SELECT col, value_num, value_str, abs(ln((s2 / n2) / (s0 / n0))) AS w1, abs(ln((s3 / n3) / (s1 / n1))) AS w2 FROM u)"""


_QUERY_LEGS, _QUERY_TEXT = 4, "hövä gujaranta möbysto"
_BASE = "b AS (SELECT r.row_id, coalesce(sum(w1), 0) AS base FROM r LEFT JOIN p ON r.row_id = p.row_id LEFT JOIN w ON p.col = w.col AND p.value_num IS NOT DISTINCT FROM w.value_num AND p.value_str IS NOT DISTINCT FROM w.value_str GROUP BY 1)"
_DIST = f"""{_BASE}, v AS (SELECT w.* FROM w WHERE col = 'legs' AND value_num = {_QUERY_LEGS} OR col = 'features' AND value_str IN ({", ".join(f"'{x}'" for x in _QUERY_TEXT.split())})),
  off AS (SELECT row_id, sum(w1 + w2) AS off FROM p JOIN v ON p.col = v.col AND p.value_num IS NOT DISTINCT FROM v.value_num AND p.value_str IS NOT DISTINCT FROM v.value_str GROUP BY 1),
  x AS (SELECT b.row_id, round(base + (SELECT coalesce(sum(w2), 0) FROM v) - coalesce(off, 0), 9) AS distance FROM b LEFT JOIN off USING (row_id))"""


def _animal_weights(spark, d, masked: bool = False, least: float = 0.0) -> tuple[IndexedFrame, DataFrame]:
    frame = animal_frame(spark, d)
    defined = BitSet.of_column(frame.rows, F.col("is_duck").isNotNull(), frame.n) if masked else None
    return frame, knn.key_value_weights(frame, ["legs", "features"], frame.index("is_duck", True), defined, least)


def _animal_distances(spark, d) -> tuple[IndexedFrame, DataFrame]:
    frame, weights = _animal_weights(spark, d)
    weights = cut(weights)
    item = spark.createDataFrame([(0, _QUERY_LEGS, _QUERY_TEXT)], "row_id bigint, legs int, features string")
    return frame, knn.distances(frame, weights, knn.base_distances(frame, weights), index.build_postings(item, ANIMAL_CONF))


@query(f"WITH {_weight_sql(False)} SELECT col, value_num, value_str, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM w")
def knn_weights(spark, d):
    return _animal_weights(spark, d)[1].select(*index.KEY, F.round("w1", 6).alias("w1"), F.round("w2", 6).alias("w2"))


@query(f"WITH {_weight_sql(True)} SELECT col, value_num, value_str, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM w WHERE w1 >= 0.05")
def knn_weights_masked(spark, d):
    return _animal_weights(spark, d, True, 0.05)[1].select(*index.KEY, F.round("w1", 6).alias("w1"), F.round("w2", 6).alias("w2"))


@query(f"WITH {_weight_sql(False)}, {_BASE} SELECT row_id, round(base, 6) AS base FROM b")
def knn_base_distance(spark, d):
    frame, weights = _animal_weights(spark, d)
    return knn.base_distances(frame, weights).select("row_id", F.round("base", 6).alias("base"))


@query(f"WITH {_weight_sql(False)}, {_DIST} SELECT row_id, round(distance, 6) AS distance FROM x")
def knn_distances(spark, d):
    return _animal_distances(spark, d)[1].select("row_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_weight_sql(False)}, {_DIST} SELECT row_id, round(distance, 6) AS distance FROM (SELECT * FROM x ORDER BY distance, row_id LIMIT 10)")
def knn_topk(spark, d):
    return knn.nearest(_animal_distances(spark, d)[1], 10).select("row_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_weight_sql(False)}, {_DIST} SELECT row_id, round(distance, 6) AS distance FROM (SELECT * FROM x WHERE row_id % 2 = 1 ORDER BY distance, row_id LIMIT 10)")
def knn_topk_filtered(spark, d):
    return knn.nearest(_animal_distances(spark, d)[1], 10, F.col("row_id") % 2 == 1).select("row_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_weight_sql(False)}, {_DIST}, nb AS (SELECT row_id FROM x ORDER BY distance, row_id LIMIT 25)
SELECT round(avg((coalesce(r.noise::INT, 0) + 1) / (1 + 2)), 6) AS rate FROM nb JOIN r USING (row_id)""")
def knn_ctr_predict(spark, d):
    frame, found = _animal_distances(spark, d)
    outcomes = frame.rows.select("row_id", F.coalesce(F.col("noise").cast("int"), F.lit(0)).alias("hits"), F.lit(1).alias("n"))
    return knn.predict_rate(knn.nearest(found, 25), outcomes).select(F.round("rate", 6).alias("rate"))


@query(f"""WITH {_weight_sql(False)}, {_BASE}, t2 AS (SELECT p.row_id AS query_id, w.* FROM p JOIN w ON p.col = w.col AND p.value_num IS NOT DISTINCT FROM w.value_num AND p.value_str IS NOT DISTINCT FROM w.value_str WHERE p.row_id % 20 = 0),
  ln AS (SELECT query_id, sum(w2) AS line FROM t2 GROUP BY 1), so AS (SELECT query_id, p.row_id, sum(w1 + w2) AS o FROM t2 JOIN p ON p.col = t2.col AND p.value_num IS NOT DISTINCT FROM t2.value_num AND p.value_str IS NOT DISTINCT FROM t2.value_str GROUP BY ALL),
  each_query AS (SELECT DISTINCT row_id AS query_id FROM r WHERE row_id % 20 = 0),
  x AS (SELECT query_id, b.row_id, round(base + coalesce(line, 0) - coalesce(o, 0), 9) AS distance FROM each_query CROSS JOIN b LEFT JOIN ln USING (query_id) LEFT JOIN so USING (query_id, row_id) WHERE b.row_id IS NOT NULL)
SELECT query_id, row_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM x) WHERE rank <= 5""")
def knn_batch(spark, d):
    """The five nearest of all animals for each animal whose id is divisible by 20."""
    frame, weights = _animal_weights(spark, d)
    weights = cut(weights)
    queries = frame.rows.filter("row_id % 20 = 0").select(F.col("row_id").alias("query_id")).distinct()
    tokens = frame.postings.filter("col IN ('legs', 'features') AND row_id % 20 = 0").withColumnRenamed("row_id", "query_id")
    return knn.nearest_of_each(frame, weights, knn.base_distances(frame, weights), queries, tokens, 5).select("query_id", "row_id", F.round("distance", 6).alias("distance"), "rank")
