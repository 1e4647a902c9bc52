"""Weighted nearest neighbours over an index: weights learned from co-occurrence with a target, distances, prediction.

The distance between a query X and a row E is the sum of w1 over the features only E has and of w2 over those only X
has. Per row, the sum of w1 over all its features is computed once; a query then touches only postings of its own tokens.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrid import schema
from siftgrid.functions.stats import CoStats
from siftgrid.lineage import cut
from siftgrid.operators.bits import BitSet
from siftgrid.operators.index import KEY, IndexedFrame

DIGITS = 9


def key_value_weights(frame: IndexedFrame, columns: Sequence[str], target: BitSet, defined: BitSet | None = None, least: float = 0.0, divided: bool = True) -> DataFrame:
    """(col, value_num, value_str, w1, w2) of the keys of ``columns`` with w1 >= least.

    w1 is the absolute log of how much the target's lift changes without the feature, w2 with it. Rows outside
    ``defined`` do not count as rows with the feature nor to n; the target is counted as it stands.
    """
    f_b = target.count()
    n = frame.n if defined is None else defined.count()
    own = frame.postings.filter(F.col("col").isin(list(columns)))
    if defined is not None:
        # keys without a defined row stay, with frequency 0
        own = own.join(defined.positions.withColumn("__in", F.lit(1)), "row_id", "left")
    else:
        own = own.withColumn("__in", F.lit(1))
    marked = own.join(target.positions.withColumn("__hit", F.lit(1)), "row_id", "left")
    counts = marked.groupBy(*KEY).agg(F.coalesce(F.sum("__in"), F.lit(0)).alias("f_a"), F.count(F.when(F.col("__in").isNotNull() & F.col("__hit").isNotNull(), 1)).alias("f_ab"))
    stats = CoStats(F.lit(n).cast("bigint"), F.col("f_a"), F.lit(f_b).cast("bigint"), F.col("f_ab"), divided=divided)
    w1 = F.abs(F.ln(stats.lift_of(False, True) / stats.lift_of(False, False)))
    w2 = F.abs(F.ln(stats.lift_of(True, True) / stats.lift_of(True, False)))
    return counts.select(*KEY, w1.alias("w1"), w2.alias("w2")).filter(F.col("w1") >= least)


def _on_key(df: DataFrame, weights: DataFrame) -> DataFrame:
    """An equi join on the key, whose unused half is null."""
    return df.withColumn("__n", F.coalesce("value_num", F.lit(0))).withColumn("__s", F.coalesce("value_str", F.lit(""))).join(
        weights.withColumn("__n", F.coalesce("value_num", F.lit(0))).withColumn("__s", F.coalesce("value_str", F.lit(""))).drop("value_num", "value_str"), ["col", "__n", "__s"]
    )


def base_distances(frame: IndexedFrame, weights: DataFrame, select: BitSet | None = None) -> DataFrame:
    """(row_id, base) of each selected row: the sum of w1 over its weighted features, 0 for rows without any."""
    rows = frame.rows.select("row_id").distinct() if select is None else select.positions
    sums = _on_key(frame.postings, weights).groupBy("row_id").agg(F.sum("w1").alias("base"))
    return rows.join(sums, "row_id", "left").select("row_id", F.coalesce("base", F.lit(0.0)).alias("base"))


def distances(frame: IndexedFrame, weights: DataFrame, base: DataFrame, tokens: DataFrame, baseline: str = "w2") -> DataFrame:
    """(row_id, distance) of each row of ``base`` to the query of ``tokens`` (col, value_num, value_str, distinct).

    Only the query's own weights are broadcast, one row a token; distances are rounded, since equal sums may differ in
    the last digit.
    """
    own = _on_key(tokens.select(*KEY), weights).select("col", "__n", "__s", "w1", "w2")
    line = own.agg(F.coalesce(F.sum(baseline), F.lit(0.0)).alias("line"))
    keyed = frame.postings.withColumn("__n", F.coalesce("value_num", F.lit(0))).withColumn("__s", F.coalesce("value_str", F.lit("")))
    shared = keyed.join(F.broadcast(own), ["col", "__n", "__s"]).groupBy("row_id").agg(F.sum(F.col("w1") + F.col("w2")).alias("off"))
    moved = base.join(shared, "row_id", "left").crossJoin(F.broadcast(line))
    return moved.select("row_id", (F.round(F.col("base") + F.col("line") - F.coalesce("off", F.lit(0.0)), DIGITS) + F.lit(0.0)).alias("distance"))


def nearest(found: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """The k nearest rows that meet ``keep``, ties by row_id: one bounded heap a task, merged at the end."""
    return (found if keep is None else found.filter(keep)).orderBy("distance", "row_id").limit(k)


def predict_rate(neighbours: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(rate): the mean over the neighbours of (hits + 1) / (n + 2), outcomes being (row_id, hits, n).

    The neighbours are k rows; they are sent to the outcomes, which are not shuffled."""
    rate = (F.coalesce("hits", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)
    return outcomes.join(F.broadcast(neighbours), "row_id", "right").agg(F.avg(rate).alias("rate"))


def nearest_of_each(frame: IndexedFrame, weights: DataFrame, base: DataFrame, queries: DataFrame, tokens: DataFrame, k: int, baseline: str = "w2") -> DataFrame:
    """(query_id, row_id, distance, rank): the k nearest rows of ``base`` of each of a batch of queries (query_id), whose tokens are
    (query_id, col, value_num, value_str), distinct; ties by row_id. Rows that share nothing and queries without tokens count too.

    No pair is made of each query and each row. Tokens are numbered from the most common on; a row and a
    query are the paths of their tokens in that order. A pair meets at its rarest common token, or at the paths' start, where what both have
    in common lies on the two paths up to there: so rows with one path up to a token count as one, k of them at most
    remain (and those whose rounded distance may tie), and queries with one path are answered once. At a commoner token
    the same pair only gets a longer distance, so the shortest holds. A row of m tokens makes m + 1 paths.
    """
    key = ["col", "__n", "__s"]
    own = cut(_on_key(tokens.select("query_id", *KEY), weights).select("query_id", *key, "w1", "w2"))
    sums = own.groupBy("query_id").agg(F.sum(baseline).alias("line"))
    line = queries.join(sums, "query_id", "left").select("query_id", F.coalesce("line", F.lit(0.0)).alias("line"))
    keyed = frame.postings.withColumn("__n", F.coalesce("value_num", F.lit(0))).withColumn("__s", F.coalesce("value_str", F.lit("")))
    asked = own.select(*key, (F.col("w1") + F.col("w2")).alias("s")).distinct()
    common = keyed.join(asked, key).groupBy(*key, "s").agg((-F.count(F.lit(1))).alias("__f"))
    numbered = schema.dense_positions(common, "__f", *key, name="token").select(*key, "token", "s")
    rows = _paths(base.filter("row_id IS NOT NULL"), keyed, numbered, "row_id")
    asks = cut(_prefixes(_paths(queries, own, numbered, "query_id")).select("query_id", "prefix", "shared"))
    # where two sums of the same weights differ in the last digit, they are the same to DIGITS + 3; equal rounded distances
    # come from bases whose roundings are the same or next to each other
    rows = rows.withColumn("__same", F.round("base", DIGITS + 3)).withColumn("__near", F.round("base", DIGITS))
    kept = _prefixes(rows).withColumn("__i", F.row_number().over(Window.partitionBy("prefix", "__same").orderBy("row_id"))).filter(F.col("__i") <= k)
    kept = kept.withColumn("__i", F.dense_rank().over(Window.partitionBy("prefix").orderBy("__near"))).filter(F.col("__i") <= k + 1)
    nodes = kept.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("base", "row_id"))).alias("e"))
    no = lambda kind, name: F.array().cast(f"array<{kind}>").alias(name)
    sides = asks.dropDuplicates(["prefix"]).select("prefix", F.lit(0).alias("side"), "shared", no("double", "base"), no("bigint", "row_id"))
    sides = sides.unionByName(nodes.select("prefix", F.lit(1).alias("side"), no("double", "shared"), F.col("e.base").alias("base"), F.col("e.row_id").alias("row_id")))
    sides = sides.withColumn("token", F.coalesce(F.try_element_at("prefix", F.lit(-1)), F.lit(-1)))
    spread = int(frame.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work lies in pairs, not in bytes
    found = sides.repartition(spread, "token").sortWithinPartitions("token", "side").mapInArrow(_nearest_paths(k), "prefix array<bigint>, row_id array<bigint>, base array<double>, off array<double>")
    each = asks.select("query_id", "prefix").join(found, "prefix").select("query_id", F.explode(F.arrays_zip("row_id", "base", "off")).alias("e"))
    each = each.groupBy("query_id", F.col("e.row_id").alias("row_id")).agg(F.first("e.base").alias("base"), F.max("e.off").alias("off"))
    moved = each.join(line, "query_id").select("query_id", "row_id", (F.round(F.col("base") + F.col("line") - F.col("off"), DIGITS) + F.lit(0.0)).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "row_id"))
    return moved.withColumn("rank", rank).filter(F.col("rank") <= k)


def _paths(all_of: DataFrame, keyed: DataFrame, numbered: DataFrame, who: str) -> DataFrame:
    """``all_of`` with ``path``: the numbered tokens of each, the most common first, with their weights."""
    met = keyed.join(numbered, ["col", "__n", "__s"]).groupBy(who).agg(F.sort_array(F.collect_list(F.struct("token", "s"))).alias("path"))
    return all_of.join(met, who, "left").withColumn("path", F.coalesce("path", F.array().cast("array<struct<token: bigint, s: double>>")))


def _prefixes(paths: DataFrame) -> DataFrame:
    """A row for each beginning of each path, the empty one too, with its tokens as ``prefix`` and their weights as ``shared``."""
    cuts = paths.withColumn("__part", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n)))).drop("path")
    return cuts.withColumn("prefix", F.col("__part.token")).withColumn("shared", F.col("__part.s")).drop("__part")


def _nearest_paths(k: int, most: int = 1 << 21):
    """From paths sorted by (token, side) to the k nearest rows, and those that may tie with the last, of each query's path.

    Side 0 are queries with the weights of their path, side 1 rows with (base, row_id) in order. Tables of at most
    ``most`` numbers are made at once.
    """
    near = 2 * 10.0**-DIGITS

    def compare(q: tuple, r: tuple, out: list) -> None:
        (prefix, at, shared), (tokens, to, base, ids, entry) = q, r
        n, m = len(at) - 1, len(to) - 1
        known, column = np.unique(prefix, return_inverse=True)
        wide = max(1, len(known))
        asked = np.zeros((n, wide))
        asked[np.repeat(np.arange(n), np.diff(at)), column] = shared
        parts = []
        high = max(1, most // wide)
        for y in range(0, m, high):
            z = min(m, y + high)
            has = np.zeros((z - y, wide))
            own = tokens[to[y] : to[z]]
            if len(known):
                place = np.minimum(np.searchsorted(known, own), wide - 1)
                hit = known[place] == own
                has[np.repeat(np.arange(z - y), np.diff(to[y : z + 1]))[hit], place[hit]] = 1.0
            step = max(1, most // (z - y))
            for x in range(0, n, step):
                off = asked[x : x + step] @ has.T
                far = base[entry[y:z]] - off
                last = min(k, z - y) - 1
                i, j = np.nonzero(far <= np.partition(far, last, axis=1)[:, last : last + 1] + near)
                size = entry[y + j + 1] - entry[y + j]
                e = np.repeat(entry[y + j] - np.cumsum(size) + size, size) + np.arange(size.sum())
                parts.append((np.repeat(i + x, size), np.repeat(off[i, j], size), base[e], ids[e]))
        who, off, b, row = (np.concatenate(p) for p in zip(*parts, strict=True))
        far = np.round(b - off, DIGITS + 3)
        o = np.lexsort((row, far, who))
        o = o[_place((np.diff(who[o]) != 0) | (np.diff(far[o]) != 0)) < k]
        begin = np.flatnonzero(np.diff(who[o], prepend=-1))
        size = np.diff(np.append(begin, len(o)))
        o = o[far[o] <= np.repeat(far[o[begin + np.minimum(size, k) - 1]] + near, size)]
        out.append((prefix, np.diff(at), row[o], b[o], off[o], np.bincount(who[o], minlength=n)))

    def solve(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        token, side = (whole.column(c).to_numpy() for c in ("token", "side"))
        (prefix, to), (shared, weight), (base, entry), (ids, _) = ((whole.column(c).values.to_numpy(), whole.column(c).offsets.to_numpy()) for c in ("prefix", "shared", "base", "row_id"))
        bounds = [0, *(np.flatnonzero(np.diff(token)) + 1).tolist(), len(token)]
        out: list = []
        for x, y in zip(bounds, bounds[1:], strict=False):
            mid = x + int(np.searchsorted(side[x:y], 1))
            if x < mid < y:
                compare((prefix[to[x] : to[mid]], to[x : mid + 1], shared[weight[x] : weight[mid]]), (prefix, to[mid : y + 1], base, ids, entry[mid : y + 1]), out)
        if out:
            prefix, sizes, row, base, off, found = (np.concatenate(p) for p in zip(*out, strict=True))
            lists = [(prefix, sizes), (row, found), (base, found), (off, found)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(v)) for v, n in lists], ["prefix", "row_id", "base", "off"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of the last token, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column("token").to_numpy()
            if kept and kept[-1].column("token")[-1].as_py() != token[0]:
                yield from solve(kept)
                kept = []
            last = int(np.argmax(token == token[-1]))
            if last:
                yield from solve([*kept, batch.slice(0, last)])
                kept = []
            kept.append(batch.slice(last))
        if kept:
            yield from solve(kept)

    return run


def _place(changes: np.ndarray) -> np.ndarray:
    """The place of each element within its run, given where neighbours differ."""
    begin = np.concatenate([[0], np.flatnonzero(changes) + 1])
    n = len(changes) + 1
    return np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
