"""The acceptance numbers of FIXTURES.md: a seeded generator, index sizes, checksums, neighbours and weights."""

import math
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from siftgrid.analyzers import IndexConf, java_split
from siftgrid.functions.stats import CoStats
from siftgrid.operators import index, knn, segments
from siftgrid.operators.bits import BitSet
from siftgrid.operators.index import IndexedFrame
from siftgrid.plans import catalogue

LETTERS = "abcdefghijklmnopqrstuvxyz"
ITEM = "row_id bigint, bigNumber bigint, name string, property boolean, quantity int, text string"


class JavaRandom:
    """The 48-bit linear congruential generator of the Java platform, from its public specification."""

    def __init__(self, seed):
        self.state, self.spare = (seed ^ 0x5DEECE66D) & (2**48 - 1), None

    def bits(self, n):
        self.state = (self.state * 0x5DEECE66D + 0xB) & (2**48 - 1)
        return self.state >> (48 - n)

    def integer(self, n):
        if n & (n - 1) == 0:
            return (n * self.bits(31)) >> 31
        while True:
            drawn = self.bits(31)
            if drawn - drawn % n + n - 1 < 2**31:
                return drawn % n

    def boolean(self):
        return self.bits(1) != 0

    def double(self):
        return ((self.bits(26) << 27) + self.bits(27)) / 2**53

    def gaussian(self):
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        while True:
            x, y = 2 * self.double() - 1, 2 * self.double() - 1
            s = x * x + y * y
            if 0 < s < 1:
                scale = math.sqrt(-2 * math.log(s) / s)
                self.spare = y * scale
                return x * scale


def generated(seed, n):
    r = JavaRandom(seed)
    out = []
    for _ in range(n):
        name, prop, quantity = LETTERS[r.integer(25)], r.boolean(), int(r.gaussian() * 5)
        words = ["".join(LETTERS[r.integer(25)] for _ in range(1 + r.integer(2))) for _ in range(r.integer(4))]
        out.append((int(r.gaussian() * 5) * 1_000_000_000, name, prop, quantity, " ".join(words)))
    return out


def items(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ITEM)


def test_generator():
    assert [(r[1], r[2], r[3], r[4], r[0]) for r in generated(0, 3)] == [("k", True, -6, "t cc", 3_000_000_000), ("y", True, 0, "", 0), ("x", False, -1, "ma", 0)]


def posting_sets(frame):
    """Keys in dictionary order with their posting sets."""
    sets = defaultdict(set)
    for r in frame.postings.collect():
        sets[r.col, r.value_num, r.value_str].add(r.row_id)
    order = [(r.col, r.value_num, r.value_str) for r in frame.dictionary.orderBy("ordinal").collect()]
    assert set(order) == set(sets)
    return order, sets


def checksums(order, sets):
    r = JavaRandom(0)
    n = 1024
    lookups = sum(r.integer(len(order)) for _ in range(n))
    drawn = [(sets[order[r.integer(len(order))]], sets[order[r.integer(len(order))]]) for _ in range(n)]
    co = (sum(len(a) for a, _ in drawn), sum(len(a & b) for a, b in drawn))
    bits = [sets[order[r.integer(len(order))]] for _ in range(n)]
    total = sum(map(len, bits))
    pairs = [(b, bits[r.integer(n)]) for b in bits]
    pair = (sum(len(a) for a, _ in pairs), sum(len(b) for _, b in pairs), sum(len(a & b) for a, b in pairs))
    three = [0, 0]
    for a in bits:
        ab = a & bits[r.integer(n)]
        three[0] += len(ab)
        three[1] += len(ab & bits[r.integer(n)])
    return lookups, co, total, pair, tuple(three)


def test_1024_rows(spark):
    frame = IndexedFrame.create(items(spark, generated(0, 1024)))
    order, sets = posting_sets(frame)
    assert len(order) == 752
    assert (frame.frequency("property", True), frame.frequency("name", "h"), frame.frequency("name", "w")) == (498, 43, 0)
    assert checksums(order, sets) == (389474, (7500, 35), 8983, (8983, 7480, 114), (147, 0))


def test_two_segments(spark):
    parts = [IndexedFrame.create(items(spark, generated(s, 1000))) for s in (0, 1)]
    frame = segments.multi_indexed(parts)
    order, sets = posting_sets(frame)
    assert (frame.n, len(order)) == (2000, 1320)
    assert (len(sets["property", 1, None]), len(sets["name", None, "h"])) == (983, 75)
    assert checksums(order, sets) == (691626, (9898, 28), 9514, (9514, 6987, 24), (79, 0))


def test_sixteen_segments(spark):
    rows = [(s, i, *r) for s in range(16) for i, r in enumerate(generated(s, 1024))]
    frame = spark.createDataFrame(rows, "segment int, " + ITEM)
    placed = segments.place_segments(frame, segments.segment_starts(frame))
    assert placed.agg(F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")).first() == (0, 16383, 16384)


def test_three_literal_rows(spark):
    rows = [(1_000_000_000, "a", True, 3, "some text"), (1, "b", False, 2, "more text"), (324234, "c", True, 4, "even more text")]
    frame = IndexedFrame.create(items(spark, rows), IndexConf().with_analyzer("text", java_split))
    order, sets = posting_sets(frame)
    want = [
        ("bigNumber", 1, {1}), ("bigNumber", 324234, {2}), ("bigNumber", 1_000_000_000, {0}), ("name", "a", {0}), ("name", "b", {1}), ("name", "c", {2}), ("property", 0, {1}), ("property", 1, {0, 2}),
        ("quantity", 2, {1}), ("quantity", 3, {0}), ("quantity", 4, {2}), ("text", "even", {2}), ("text", "more", {1, 2}), ("text", "some", {0}), ("text", "text", {0, 1, 2}),
    ]
    assert [(c, s if n is None else n, sets[c, n, s]) for c, n, s in order] == want
    assert frame.ordinal_of("text", "more") == 12 and frame.ordinal_of("text", "x") == -1
    assert tuple(index.floor_and_ceil(frame.dictionary, "quantity", 3).first()) == (9, 9, 9)
    assert tuple(index.floor_and_ceil(frame.dictionary, "a", "x").first()) == (-1, -1, 0)
    assert tuple(index.floor_and_ceil(frame.dictionary, "z", 1).first()) == (-1, 14, 15)
    assert [r.value_str for r in frame.col_values("name").collect()] == ["a", "b", "c"]
    assert sorted(r.row_id for r in frame.index_at(12).positions.collect()) == [1, 2]


def test_sixteen_tokenized_rows(spark):
    frame = IndexedFrame.create(items(spark, generated(0, 16)), IndexConf().with_analyzer("text", java_split))
    counts = {r.col: r["count"] for r in index.frequencies(frame.postings).groupBy("col").count().collect()}
    assert counts == {"bigNumber": 11, "name": 11, "property": 2, "quantity": 10, "text": 22}
    assert frame.frequency("text", "") > 0


ANIMALS = [(2, "yellow walks", True, False), (4, "moo white walks", False, False), (4, "moo black walks", True, False), (2, "flies white swims", False, False), (2, "flies yellow swims", True, True), (2, "flies yellow swims", False, True)]
ANIMAL = "row_id bigint, legs int, features string, noise boolean, isDuck boolean"
SPLIT = IndexConf().with_analyzer("features", java_split)


def animals(spark):
    return IndexedFrame.create(spark.createDataFrame([(i, *a) for i, a in enumerate(ANIMALS)], ANIMAL), SPLIT)


def neighbours(spark, divided, baseline, query):
    frame = animals(spark)
    weights = knn.key_value_weights(frame, ["legs", "features"], frame.index("isDuck", True), divided=divided)
    asked = index.build_postings(spark.createDataFrame([(0, *query)], "row_id bigint, legs int, features string"), SPLIT)
    return [(r.row_id, r.distance) for r in knn.nearest(knn.distances(frame, weights, knn.base_distances(frame, weights), asked, baseline), 10).collect()]


@pytest.mark.parametrize(("divided", "baseline", "query", "want"), [
    (True, "w2", (4, "flies white swims"), [(3, 1.085729955), (1, 1.568640591), (2, 2.129049878), (4, 2.373035407), (5, 2.373035407), (0, 3.751632396)]),
    (True, "w2", (4, "flies yellow swims"), [(4, 1.085729955), (5, 1.085729955), (3, 1.735305887), (2, 2.045717230), (1, 2.218216523), (0, 2.464326943)]),
    (False, "w1", (4, "flies white swims"), [(3, 0.883023902), (1, 1.609212700), (4, 2.096862059), (5, 2.096862059), (2, 2.164995931), (0, 3.605242415)]),
    (False, "w1", (4, "flies yellow swims"), [(4, 1.350942556), (5, 1.350942556), (3, 2.096862059), (2, 2.623049232), (1, 2.823050857), (0, 2.859322913)]),
])
def test_neighbours(spark, divided, baseline, query, want):
    got = neighbours(spark, divided, baseline, query)
    assert [r for r, _ in got] == [r for r, _ in want]
    assert [d for _, d in got] == pytest.approx([d for _, d in want], abs=2e-9)


ARTICLES = ["lappi ivalo kotimaa", "lappi rovaniemi kotimaa", "lappi rovaniemi urheilu", "ulkomaat trump", "ulkomaat eu"]
HITS = ["TTF", "TTT", "TFT", "FTF", "FFF"]


def test_weights_and_rates(spark):
    shown = [(a, ARTICLES[a], h == "T") for a, hits in enumerate(HITS) for h in hits]
    decisions = IndexedFrame.create(spark.createDataFrame([(i, *r) for i, r in enumerate(shown)], "row_id bigint, articleId int, features string, hit boolean"), SPLIT)
    weights = knn.key_value_weights(decisions, ["features"], decisions.index("hit", True)).cache()
    got = {r.value_str: (round(r.w1, 3), round(r.w2, 3)) for r in weights.collect()}
    assert got == {"urheilu": (0.077, 0.235), "ivalo": (0.077, 0.235), "eu": (0.433, 0.969), "ulkomaat": (0.739, 0.912), "rovaniemi": (0.542, 0.783), "kotimaa": (0.542, 0.783), "lappi": (0.912, 0.739), "trump": (0.174, 0.340)}
    articles = IndexedFrame.create(spark.createDataFrame(list(enumerate(ARTICLES)), "row_id bigint, features string"), SPLIT)
    base = knn.base_distances(articles, weights).cache()
    outcomes = spark.createDataFrame([(i, h.count("T"), 3) for i, h in enumerate(HITS)], "row_id bigint, hits int, n int")
    for text, near, rate in [("lappi ivalo urheilu", {0, 2}, 0.6), ("lappi rovaniemi trump", {2, 1}, 0.7), ("lappi", {0, 2}, 0.6), ("ulkomaat", {3, 4}, 0.3), ("ulkomaat eu", {4, 3}, 0.3)]:
        asked = index.build_postings(spark.createDataFrame([(0, text)], "row_id bigint, features string"), SPLIT)
        found = knn.nearest(knn.distances(articles, weights, base, asked), 2).cache()
        assert {r.row_id for r in found.collect()} == near
        assert knn.predict_rate(found, outcomes).first().rate == pytest.approx(rate)


def test_costats_worked_example(spark):
    n, a, b, ab = (F.lit(x).cast("bigint") for x in (15, 3, 8, 3))
    got = spark.range(1).select(*CoStats(n, a, b, ab).columns()).first().asDict()
    want = {"p_a": 0.263157894737, "p_b": 0.526315789474, "h_a": 0.831474388010, "ps_0": 0.434150076570, "ps_1": 0.064423765211, "ps_2": 0.347271438696, "ps_3": 0.169836956522, "d_0": 1.243874425727, "d_1": 0.516821760916, "d_2": 0.895464209780, "d_3": 1.226222826087, "mi": 0.069991873633}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-11)


def test_masked_weights(spark):
    frame = animals(spark)
    defined = BitSet.of_positions(spark, range(4), 6)
    got = {(r.col, r.value_num, r.value_str) for r in knn.key_value_weights(frame, ["legs", "features"], frame.index("isDuck", True), defined).collect()}
    assert ("legs", 4, None) in got and len(got) == 9


def some_animals(folder, n, words, seed):
    """A table of animals, most of them with four legs, whose words recur and often weigh the same."""
    draw = random.Random(seed)
    rows = [(i, draw.choice((4, 4, 4, 2, None)), " ".join(draw.choice(words)[: draw.choice((1, 2))] for _ in range(draw.randint(0, 5))), True, draw.random() < 0.3) for i in range(n)]
    con = duckdb.connect()
    con.sql("CREATE TABLE animal (row_id BIGINT, legs INTEGER, features VARCHAR, noise BOOLEAN, is_duck BOOLEAN)")
    con.executemany("INSERT INTO animal VALUES (?, ?, ?, ?, ?)", rows)
    con.sql(f"COPY animal TO '{folder}/animal.parquet' (FORMAT parquet)")
    return con


def batch_against_sql(spark, folder, con):
    """Compares knn_batch with its SQL; returns the frame that ran."""
    got = catalogue.QUERIES["knn_batch"](spark, str(folder))
    rows = sorted((r.query_id, r["rank"], r.row_id, round(r.distance, 6)) for r in got.collect())
    assert rows == sorted((r[0], r[3], r[1], round(r[2], 6)) for r in con.sql(catalogue.SQL["knn_batch"]).fetchall())
    return got


def most_rows(plan):
    """The most rows that any step of a plan that ran gave out."""
    kind = plan.getClass().getSimpleName()
    rows = plan.metrics().get("numOutputRows")
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return max([rows.get().value() if rows.isDefined() else 0, *map(most_rows, below)])


def test_batch_makes_no_product(spark, tmp_path):
    con = some_animals(tmp_path, 2000, ["ab", "cd", "ef", "gh"], 1)
    got = batch_against_sql(spark, tmp_path, con)
    assert 500 <= most_rows(got._jdf.queryExecution().executedPlan()) < 2000 * 100 / 8


@pytest.mark.parametrize("seed", range(3))
def test_batch_of_neighbours(spark, tmp_path, seed):
    batch_against_sql(spark, tmp_path, some_animals(tmp_path, 300, [a + b for a in "abcdefgh" for b in "xyz"], seed))


def test_batch_takes_rows_and_queries_that_share_nothing(spark, tmp_path):
    """Animals without any token are as near as their base, 0, and an animal without tokens has neighbours as well."""
    con = duckdb.connect()
    con.sql("""CREATE TABLE animal AS SELECT range AS row_id, CASE WHEN range NOT IN (0, 20, 33) THEN 2 + 2 * (range % 3 // 2) END::INT AS legs,
      CASE WHEN range = 0 THEN 'alone' WHEN range NOT IN (20, 33) THEN 'a' || range % 4 || ' b' || range % 7 END AS features, true AS noise, range % 3 = 0 AS is_duck FROM range(60)""")
    con.sql(f"COPY animal TO '{tmp_path}/animal.parquet' (FORMAT parquet)")
    got = batch_against_sql(spark, tmp_path, con)
    found = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found[r.query_id].append(r.row_id)
    assert sorted(found) == [0, 20, 40] and all(len(x) == 5 for x in found.values())
    assert found[20][:2] == [20, 33]
    frame, weights = catalogue._animal_weights(spark, str(tmp_path))
    base = knn.base_distances(frame, weights)
    for query, near in found.items():
        asked = frame.postings.filter(F.col("col").isin("legs", "features") & (F.col("row_id") == query))
        assert [r.row_id for r in knn.nearest(knn.distances(frame, weights, base, asked), 5).collect()] == near
    assert {20, 33} <= set(found[0])
