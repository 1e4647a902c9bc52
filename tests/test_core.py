"""Sets, frames, storage, segments and the stream against plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgrid import schema
from siftgrid.analyzers import IndexConf, java_split
from siftgrid.functions import stats
from siftgrid.operators import bits, index, segments
from siftgrid.operators.bits import BitSet
from siftgrid.operators.index import IndexedFrame
from siftgrid.sources import store
from siftgrid.streaming.segments import append_segments


def on(b):
    return {r.row_id for r in b.positions.collect()}


@pytest.mark.parametrize("k", [0, 1, 3, 6])
def test_sets_against_python(spark, k):
    rng = random.Random(k)
    n, m = rng.randint(100, 700), rng.randint(1, 200)
    a, b = ({i for i in range(n) if rng.random() < 2**-k} for _ in range(2))
    c = {i for i in range(m) if rng.random() < 0.5}
    x, y, z = BitSet.of_positions(spark, a, n), BitSet.of_positions(spark, b, n), BitSet.of_positions(spark, c, m)
    assert on(x.and_(y)) == a & b and x.and_count(y) == len(a & b)
    assert on(x.and_not(y)) == a - b == on(x.and_(y.not_()))
    assert on(x.not_()) == set(range(n)) - a
    assert on(x.concat(z)) == a | {n + i for i in c} and x.concat(z).n == n + m
    assert on(x.slice(10, 90)) == {i - 10 for i in a if 10 <= i < 90} and x.slice(10, 90).n == 80
    assert on(x.slice(10, 90).slice(5, 20)) == on(x.slice(15, 30))
    words = x.words()
    assert {r.word_id: r.word & (2**64 - 1) for r in words.collect()} == {w: sum(1 << (i % 64) for i in a if i // 64 == w) for w in range(-(-n // 64))}
    assert {r.row_id for r in bits.unpack_words(words).collect()} == a
    assert bits.words_and_count(words, y.words()).first().f == len(a & b)
    assert [r.value for r in x.vector().orderBy("row_id").collect()] == [i in a for i in range(n)]
    assert x.is_dense() == (len(a) * 256 > n)
    assert x.seek(50) == min((i for i in a if i >= 50), default=None) and x.head() == min(a, default=None)
    assert on(x.update(7, True)) == a | {7} and on(x.update(7, False)) == a - {7}
    assert x.contains(3) == (3 in a)


def test_small_sets(spark):
    b1, b2 = BitSet.of_booleans(spark, [False, False, True, False, True]), BitSet.of_booleans(spark, [False, True, True, False])
    assert (b1.to_string(), b1.count(), b1.n) == ("00101", 2, 5)
    assert on(b1.concat(b2)) == {2, 4, 6, 7} and b1.concat(b2).n == 9
    b3 = BitSet.of_positions(spark, range(0, 150, 3), 150)
    assert (b3.concat(b3).count(), b3.concat(b3).n) == (100, 300)
    with pytest.raises(ValueError):
        b1.and_(b2)
    empty = BitSet.empty(spark, 1024)
    assert empty.count() == 0 and empty.not_().count() == 1024 and empty.head() is None
    cut = {(r.segment, r.row_id) for r in bits.reshard(b3.positions, [0, 40, 150]).collect()}
    assert cut == {(int(i >= 40), i - 40 * (i >= 40)) for i in range(0, 150, 3)}


def test_java_split(spark):
    cases = {"a b ": ["a", "b"], " ": [], "": [""], " a": ["", "a"], "a  b": ["a", "", "b"], None: None, "a\n b": ["a\n", "b"]}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", java_split(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == cases


def test_index_of_dirty_rows(spark):
    """Nulls have no tokens, repeated tokens and rows count once, unsupported types are refused."""
    rows = spark.createDataFrame([(0, None, "b b", None, 1), (0, None, "b b", None, 1), (1, True, "", 2.5, 2), (2, False, None, 1.0, 2)], "row_id bigint, flag boolean, text string, price double, col int")
    with pytest.raises(TypeError):
        index.build_postings(rows)
    frame = IndexedFrame.create(rows, IndexConf().with_analyzer("text", java_split).without_field("price"))
    got = {(r.col, r.value_num, r.value_str, r.row_id) for r in frame.postings.collect()}
    assert got == {("flag", 1, None, 1), ("flag", 0, None, 2), ("text", None, "b", 0), ("text", None, "", 1), ("col", 1, None, 0), ("col", 2, None, 1), ("col", 2, None, 2)}
    assert frame.n == 3 and frame.postings.count() == 7
    nothing = IndexedFrame.create(rows.limit(0), frame.conf)
    assert (nothing.n, nothing.postings.count(), nothing.dictionary.count(), nothing.index("flag", True).count()) == (0, 0, 0, 0)
    assert IndexedFrame.create(rows, frame.conf.without_field("flag", "text", "col")).postings.count() == 0


def test_views_casts_and_columns(spark):
    frame = IndexedFrame.create(schema.from_columns(spark, {"b": list(range(10)), "a": list("abcabcabca")}, {"a": "string", "b": "int"}))
    assert schema.field_names(frame.rows) == ["a", "b"]
    part = frame.view(2, 8).view(1, 4)
    assert [(r.row_id, r.a, r.b) for r in part.rows.orderBy("row_id").collect()] == [(0, "a", 3), (1, "b", 4), (2, "c", 5)]
    assert on(part.index("a", "c")) == {2} and part.n == 3
    to = T.StructType([T.StructField("a", T.StringType()), T.StructField("x", T.BooleanType()), T.StructField("y", T.LongType())])
    cast = frame.cast(to)
    assert cast.rows.filter("row_id = 0").first() == (0, "a", False, None)
    assert cast.frequency("a", "a") == 4 and cast.frequency("b", 3) == 0
    assert schema.project(frame.rows, 1).columns == ["row_id", "b"]
    with pytest.raises(ValueError):
        schema.project(frame.rows, "c")
    with pytest.raises(ValueError):
        schema.from_columns(spark, {"a": [1], "b": [1, 2]}, {"a": "int", "b": "int"})
    assert schema.filled(spark, 5, "v", "string").filter("value = 'v'").count() == 5


def test_dense_positions(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, i % 3) for i in range(1000)], "k bigint, row_id bigint").drop("row_id").repartition(7)
    got = schema.dense_positions(rows, "k").collect()
    assert sorted((r.k, r.row_id) for r in got) == [(i, i) for i in range(1000)]
    assert schema.dense_positions(rows.limit(0), "k").count() == 0


def test_all_pair_counts(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, rng.choice("abc"), rng.randrange(3)) for i in range(50)] + [(50, "z", 9)], "row_id bigint, n string, q int")
    frame = IndexedFrame.create(rows)
    got = {(r.str_a, r.num_b): (r.f_a, r.f_b, r.f_ab) for r in index.all_pair_counts(frame.postings, F.col("col") == "n", F.col("col") == "q").collect()}
    data = [(r.n, r.q) for r in rows.collect()]
    want = {(a, b): (sum(x == a for x, _ in data), sum(y == b for _, y in data), sum(p == (a, b) for p in data)) for a in "abcz" for b in (0, 1, 2, 9)}
    assert got == want and want["z", 0][2] == 0
    met = {(r.str_a, r.num_b): (r.f_a, r.f_b, r.f_ab) for r in index.all_pair_counts(frame.postings, F.col("col") == "n", F.col("col") == "q", apart=False).collect()}
    assert met == {k: v for k, v in want.items() if v[2]}
    one = frame.co_stats(("n", "a"), ("q", 1)).first()
    assert (one.n, one.f_a, one.f_b, one.f_ab) == (51, *want["a", 1])
    none = frame.co_stats(("n", "no"), ("q", 77)).first()
    assert (none.f_a, none.f_b, none.f_ab) == (0, 0, 0) and none.mi is not None


def test_probability_estimates(spark):
    f, n = F.lit(3), F.lit(10)
    row = spark.range(1).select(stats.ep(f, n, 0.5, 2).alias("ep"), stats.ep2(f, F.lit(0), 0.3).alias("none"), stats.ep2(f, n, 1.0).alias("sure"), stats.ep2(f, n, 0.5).alias("ep2"), stats.binary_entropy(F.lit(0.5)).alias("h"), stats.binary_entropy(F.lit(0.0)).alias("h0"), stats.information(F.lit(0.25)).alias("l")).first()
    assert (row.ep, row.none, row.sure, row.h, row.h0, row.l) == (4 / 12, 0.3, 1.0, 1.0, 0.0, 2.0)
    off = 0.5 - (3 + 0.5 * 16) / 26
    v = 0.25 + off * off
    assert row.ep2 == pytest.approx((0.3 / 0.1 + 0.5 / v) / (1 / 0.1 + 1 / v))


def test_storage(spark, tmp_path):
    path, calls = str(tmp_path / "x"), []
    rows = schema.from_columns(spark, {"a": list("abca"), "b": [1, 2, 3, 1]}, {"a": "string", "b": "int"})

    def provide():
        calls.append(1)
        return IndexedFrame.create(rows)

    first, again = store.have_indexed(spark, path, provide), store.have_indexed(spark, path, provide)
    assert calls == [1] and first.n == again.n == 4
    assert on(again.index("a", "a")) == {0, 3} and again.frequency("b", 2) == 1 and again.frequency("b", 99) == 0
    assert again.ordinal_of("b", 1) == 3 and {(r.col, r.ordinal) for r in again.dictionary.collect()} == {("a", 0), ("a", 1), ("a", 2), ("b", 3), ("b", 4), ("b", 5)}
    plan = again.index("a", "a").positions._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(col" in plan and "PushedFilters: [IsNotNull(value_str), EqualTo(value_str,a)]" in plan
    assert store.byte_size(spark, path) > 0 and store.exists(spark, path) and not store.exists(spark, path + "y")
    assert store.list_names(spark, path) == ["v1", "versions"] and store.list_names(spark, path + "/v1") == ["dictionary", "length", "postings", "rows"] and store.free_id(spark, path) == 0
    other = str(tmp_path / "y")
    store.write_merged_indexed([again, again], other)
    both = store.open_indexed(spark, other)
    assert both.n == 8 and on(both.index("a", "a")) == {0, 3, 4, 7}
    assert on(store.open_multi_indexed(spark, [path, other]).index("a", "c")) == {2, 6, 10}
    of = T.StructType([T.StructField("z", T.IntegerType()), T.StructField("a", T.StringType())])
    assert [tuple(r) for r in store.create_typed(spark, [{"a": "x", "z": 1}, {"a": "y", "z": 2}], of, str(tmp_path / "t")).orderBy("row_id").collect()] == [(0, "x", 1), (1, "y", 2)]
    store.write_sequence(spark, [5, 6], "int", str(tmp_path / "s"))
    assert [r.value for r in store.open_frame(spark, str(tmp_path / "s")).orderBy("row_id").collect()] == [5, 6]


def test_no_segments(spark, tmp_path):
    rows = schema.from_columns(spark, {"a": ["x"], "b": [1]}, {"a": "string", "b": "int"})
    nothing = segments.multi_indexed([], segments.empty_indexed(rows))
    assert (nothing.rows.count(), nothing.rows.columns, nothing.postings.count(), nothing.index("a", "x").count()) == (0, ["row_id", "a", "b"], 0, 0)
    store.write_merged_indexed([], str(tmp_path / "e"), nothing)
    empty = store.open_indexed(spark, str(tmp_path / "e"))
    assert (empty.rows.count(), empty.n, empty.dictionary.count()) == (0, 0, 0)
    with pytest.raises(ValueError):
        segments.multi_indexed([])


def test_merged_keys(spark):
    a, b = (spark.createDataFrame([(k, i) for i, k in enumerate(x)], "k string, ordinal bigint") for x in ("ace", "bc"))
    got = {r.k: (r.sources, r["at"]) for r in segments.merged_keys([a, b], ["k"]).collect()}
    assert got == {"a": (1, {0: 0}), "b": (1, {1: 0}), "c": (2, {0: 1, 1: 1}), "e": (1, {0: 2})}


def test_stream_of_segments(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (range(5), range(5, 9)):
        spark.createDataFrame([(i, f"k{i % 3}") for i in part], "id bigint, name string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id bigint, name string").parquet(source)
        append_segments(stream, path, str(tmp_path / "ck"), ["id"]).awaitTermination()
    whole = store.open_multi_indexed(spark, [f"{path}/{i}" for i in store.list_names(spark, path)])
    assert whole.n == 9 and whole.frequency("name", "k0") == 3
    assert [r.id for r in whole.rows.orderBy("row_id").collect()] == list(range(9))


def test_an_index_is_replaced_as_a_whole(spark, tmp_path):
    """A version whose pointer is missing is not seen; the version before the current one stays, older ones go."""
    path = str(tmp_path / "i")
    frames = [IndexedFrame.create(schema.from_columns(spark, {"a": list("x" * n)}, {"a": "string"})) for n in (1, 2, 3)]
    for n, frame in enumerate(frames, 1):
        store.write_indexed(frame, path)
        assert store.open_indexed(spark, path).n == store.open_indexed(spark, path).frequency("a", "x") == n
    assert store.list_names(spark, path) == ["v2", "v3", "versions"]
    (tmp_path / "i" / "versions" / "3").unlink()
    assert store.open_indexed(spark, path).n == 2
    with pytest.raises(FileNotFoundError):
        store.open_indexed(spark, str(tmp_path / "none"))


def test_cells_and_rows(spark):
    rows = schema.from_columns(spark, {"a": ["x", None], "b": [1, 2]}, {"a": "string", "b": "int"})
    assert [schema.cell_at(rows, c, i).first()[0] for c, i in (("a", 0), ("a", 1), (1, 1))] == ["x", None, 2]
    assert schema.row_at(rows, 1).first().b == 2 and schema.row_at(rows, 2).count() == 0
    assert [schema.is_defined_at(2, i) for i in (-1, 0, 1, 2)] == [False, True, True, False]
