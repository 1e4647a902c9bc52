"""Term frequencies, similar pairs, co-occurrence, overlaps and distinctive terms against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftgrid.llm import distinctive, frequency, overlap, pairs, similar, together
from siftgrid.llm.terms import record_sets, split_text
from siftgrid.lineage import cut

TEXTS = "id bigint, features string, term string, n int, record int"


def texts(spark, rows):
    """Rows with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], TEXTS)


def test_split_text():
    assert split_text("A b,c;;d|| e\n") == ["a", "b", "c", "d", "e"]
    assert split_text("ä ä Ä") == ["ä", "ä", "ä"]
    assert split_text(" ,;|\t") == []


DIRTY = [(1, "a b a"), (1, "A, b"), (2, None), (3, ""), (4, " ; "), (None, "a b"), (5, "b"), (6, "b|c"), (6, "b|c"), (7, "x " * 3000 + "b")]


@pytest.mark.parametrize("shards", [1, 3, 32])
def test_term_counters(spark, shards):
    tokens = frequency.text_tokens(texts(spark, DIRTY), "f", "id", "features")
    counters = frequency.term_counters(tokens, shards)
    got = {(r.field, r.term): (r.occurrences, r.records) for r in counters.collect()}
    occurrences, records, all_records = Counter(), defaultdict(set), set()
    for i, t in DIRTY:
        if i is not None and t:
            for term in split_text(t):
                occurrences[term] += 1
                records[term].add(i)
                all_records.add(i)
    want = {("f", t): (n, len(records[t])) for t, n in occurrences.items()}
    assert got == want
    totals = frequency.record_counts(tokens)
    assert [(r.field, r.n) for r in totals.collect()] == [("f", len(all_records))]
    marked = {r.term: r.marks for r in frequency.marked_terms(counters, totals).collect()}
    assert marked == {"a": ["rare", "common"], "b": ["common"], "c": ["rare", "common"], "x": ["rare", "common"]}


def test_term_counters_of_keys_and_nothing(spark):
    rows = [("p", 1, None, 5), ("p", 1, None, 5), ("p", 0, None, 6), ("t", None, "", 5), ("t", None, None, 5), (None, 1, None, 7), ("t", None, "a", None)]
    postings = spark.createDataFrame(rows, "col string, value_num bigint, value_str string, row_id bigint")
    got = {r.term: (r.occurrences, r.records) for r in frequency.term_counters(frequency.key_tokens(postings, "p")).collect()}
    assert got == {"p=1": (2, 1), "p=0": (1, 1), "t=": (1, 1)}
    assert frequency.term_counters(frequency.key_tokens(postings.limit(0), "p")).count() == 0


def brute_similar(sets, num=3, den=4):
    return {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if x != y and den * len(x & y) >= num * len(x | y)}


def classes_of(spark, sets):
    frame = spark.createDataFrame([(i, sorted(s), "c", 0) for i, s in sets.items()], "uid bigint, terms array<string>, cls string, size int")
    return cut(similar.set_classes(frame)[0])


def near_sets(seed, n, words=400):
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        base = set(rng.sample(range(words), rng.randint(4, 14)))
        for _ in range(rng.randint(1, 4)):
            other = set(base)
            for _ in range(rng.randint(0, 3)):
                other.add(rng.randrange(words)) if rng.random() < 0.5 or len(other) < 5 else other.remove(rng.choice(sorted(other)))
            out[len(out)] = frozenset(f"w{x}" for x in other)
    return out


def by_class(sets, got):
    """The pairs of ids between unequal sets that class pairs stand for."""
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if (min(first[sets[a]], first[sets[b]]), max(first[sets[a]], first[sets[b]])) in got}


def test_similar_classes(spark):
    sets = near_sets(1, 900)
    got = {(r.a, r.b) for r in similar.similar_classes(classes_of(spark, sets)).select("a", "b").collect()}
    assert by_class(sets, got) == brute_similar(sets)


@pytest.mark.parametrize(("group", "buffer"), [(2, 65536), (3, 8)])
def test_similar_classes_in_crowded_neighbourhoods(spark, group, buffer):
    """Sets that share most terms crowd every neighbourhood; deepening and the exact join must lose no pair."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(8)]
    sets = {i: frozenset([*rng.sample(common, rng.randint(5, 8)), *(f"u{rng.randrange(60)}" for _ in range(rng.randint(0, 2)))]) for i in range(250)}
    got = {(r.a, r.b) for r in similar.similar_classes(classes_of(spark, sets), group=group, buffer=buffer).select("a", "b").collect()}
    assert by_class(sets, got) == brute_similar(sets)


def test_exact_candidates(spark):
    sets = near_sets(2, 300, words=60)
    classes = classes_of(spark, sets)
    got = {(r.a, r.b) for r in similar.exact_candidates(classes.select("cls"), classes, 3, 4).collect()}
    assert brute_similar(sets) <= by_class(sets, got)


def test_similar_classes_of_nothing_and_of_equal_sets(spark):
    assert similar.similar_classes(classes_of(spark, {1: frozenset("abcd")})).count() == 0
    classes, members = similar.set_classes(spark.createDataFrame([(i, list("abcd")) for i in range(50)], "uid bigint, terms array<string>"))
    assert [(r.cls, len(r.terms)) for r in classes.collect()] == [(0, 4)]
    assert members.count() == 50
    assert similar.similar_classes(cut(classes.limit(0))).count() == 0


@pytest.mark.parametrize("chunk", [2, 5, 64])
def test_pair_counts(spark, chunk):
    rng = random.Random(chunk)
    baskets = {b: [f"i{rng.randrange(30)}" for _ in range(rng.choice([1, 2, 4, 40]))] for b in range(40)}
    rows = [(b, i, "q", 1) for b, items in baskets.items() for i in items] + [(None, "i1", "q", 1), (3, None, "q", 1)] + [(0, "i0", "q", 1)] * 300
    baskets[0] = [*baskets[0], "i0"]
    want = Counter(p for items in baskets.values() for p in itertools.combinations(sorted(set(items)), 2))
    got = pairs.pair_counts(spark.createDataFrame(rows, "basket bigint, item string, a string, chunks int").dropDuplicates(["basket", "item"]), chunk)
    assert {(r.a, r.b): r.f_ab for r in got.collect()} == want


def test_cooccurrence(spark):
    rng = random.Random(9)
    rows = [(b, f"t{x}") for b in range(400) for x in {rng.randrange(40) for _ in range(4)} | ({50, 51} if b % 20 == 0 else set()) | {99}]
    got = together.cooccurrence(spark.createDataFrame(rows, "basket bigint, item string"), 400)
    sets = defaultdict(set)
    for b, i in rows:
        sets[b].add(i)
    f = Counter(i for s in sets.values() for i in s)
    joint = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    want = {p for p, n in joint.items() if n >= 8 and n * 1000 >= 400 and n * 400 >= 4 * f[p[0]] * f[p[1]]}
    assert {(r.item_1, r.item_2) for r in got.collect()} == want
    assert ("t50", "t51") in want


def test_summed_reports(spark):
    schema = "segment int, col_a string, value_a string, col_b string, value_b string, n bigint, f_a bigint, f_b bigint, f_ab bigint, computed_at timestamp_ntz"
    from datetime import datetime

    at = datetime(2020, 1, 1)
    rows = [
        (0, "x", "1", "y", "2", 100, 10, 20, 5, at), (0, "y", "2", "x", "1", 100, 20, 10, 5, at), (1, "y", "2", "x", "1", 50, 6, 4, 3, at),
        (2, "x", "1", "y", "2", None, 1, 1, 1, at), (3, "x", "1", "y", "2", 9, 1, 5, 2, at), (4, "x", "1", "y", "2", 9, 1, 5, None, at), (5, None, "1", "y", "2", 9, 1, 5, 1, at),
    ]
    got = [tuple(r)[:6] for r in together.summed_reports(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("x=1", "y=2", 150, 14, 26, 8)]


def test_overlaps(spark):
    rng = random.Random(3)
    sets = {f"k{k}": {i for i in range(3000) if rng.random() < 0.02 * (k + 1)} for k in range(8)}
    sets["k8"] = set(list(sets["k0"])[:40]) | {1, 2}
    rows = [("c", 0, k, i) for k, s in sets.items() for i in s] + [("c", 0, "k0", next(iter(sets["k0"])))] * 5 + [("c", 1, None, i) for i in range(9)] + [(None, 1, "x", 5), ("c", None, None, 5), ("c", 1, "k0", None)]
    entries, large, n = overlap.large_sets(spark.createDataFrame(rows, "col string, value_num bigint, value_str string, row_id bigint"), 20, 500)
    sets = {f"c={k}": s for k, s in sets.items()}
    assert n == len(set().union(*sets.values(), range(9)))
    assert {r.key: r.f for r in large.collect()} == {k: len(s) for k, s in sets.items() if len(s) >= 20}
    exact = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    whole = overlap.overlap_estimates(entries, large, 1.0).collect()
    assert {(r.key_1, r.key_2): r.estimate for r in whole} == {p: n for p, n in exact.items() if n}
    assert all(r.low == r.estimate == r.high for r in whole)
    sampled = overlap.overlap_estimates(entries, large, 0.4, z=3.5).collect()
    assert all(r.low <= exact[r.key_1, r.key_2] <= r.high for r in sampled)
    item = {r.key: r.item for r in large.collect()}
    pairs_ = spark.createDataFrame([(item[a], item[b], a) for a, b in exact], "item_1 bigint, item_2 bigint, key string")
    name = {i: k for k, i in item.items()}
    assert {(name[r.item_1], name[r.item_2]): r.f_ab for r in overlap.exact_overlaps(entries, pairs_).collect()} == {p: n for p, n in exact.items() if n}
    assert overlap.sampling_rate(1000, 20, 500) == 1.0
    assert overlap.sampling_rate(10**9, 20, 500) == 400 / 2e6


def test_distinctive_terms(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"t{min(rng.randrange(50), rng.randrange(50))}" for _ in range(rng.randint(1, 8)))) for i in range(300)] + [(900, None), (901, ""), (None, "t1")]
    rows += [(i, t + " everywhere") for i, t in rows[:200]]
    records = cut(record_sets(texts(spark, rows), "id", "features"))
    df = cut(distinctive.document_frequencies(records))
    total = df.agg(F.sum("df")).first()[0]
    got = distinctive.distinctive_terms(distinctive.with_frequencies(records, df, total), total).collect()
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None and t:
            sets[i] |= set(split_text(t))
    f = Counter(t for s in sets.values() for t in s)
    assert {(r.id, r.term): r.df for r in got} == {(i, t): f[t] for i, s in sets.items() for t in s}
    assert {(r.id, r.term) for r in got if r.top} == {(i, t) for i, s in sets.items() for t in s if f[t] == min(f[u] for u in s)}
    weights = defaultdict(float)
    for r in got:
        weights[r.id] += r.weight
    assert all(abs(w - 1) < 1e-9 for w in weights.values())
    for r, s in itertools.combinations([r for r in got if r.id == got[0].id], 2):
        assert (r.weight >= s.weight) == (r.df <= s.df) or r.weight == s.weight


def test_distinctive_terms_of_nothing(spark):
    records = record_sets(texts(spark, [(1, None)]), "id", "features")
    df = distinctive.document_frequencies(records)
    assert distinctive.distinctive_terms(distinctive.with_frequencies(records, df, 1), 1).count() == 0


def test_similar_classes_with_a_wanted_set(spark):
    """Pairs of two sets that are not wanted are not made, also in crowded neighbourhoods and by the exact way."""
    sets = near_sets(5, 120)
    frame = spark.createDataFrame([(i, sorted(s), i % 3 == 0) for i, s in sets.items()], "uid bigint, terms array<string>, is_article boolean")
    classes = cut(similar.set_classes(frame, F.bool_or("is_article").alias("wanted"))[0])
    wanted = {r.cls for r in classes.filter("wanted").collect()}
    every = {(r.a, r.b) for r in similar.similar_classes(classes.drop("wanted")).collect()}
    for group in (256, 2):
        assert {(r.a, r.b) for r in similar.similar_classes(classes, group=group).collect()} == {(a, b) for a, b in every if a in wanted or b in wanted}
