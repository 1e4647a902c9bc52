"""Problem 2: all similar pairs between set-valued records, by sorted sketch forests.

Each distinct set gets DEPTH minhash values in each of TREES independent trees. Sorted by tree and signature, the
sets that share a prefix of the signature are neighbours. Neighbourhoods are compared at the prefix length BASE;
where one holds more than GROUP sets, it deepens: the prefix grows until the neighbourhoods are small. A pair of
similarity s is met in a tree with probability s ** depth, so each set's expected recall is known from the depths at
which it was compared; sets that stay under the target are joined exactly by size-aware prefixes of their rarest
terms. Candidates are then verified on the terms themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrid.lineage import cut

TREES, BASE, DEPTH, GROUP, TARGET = 32, 4, 8, 256, 0.9999
_BUFFER = 65_536
_NO_COVER = 99


def _signatures(trees: int, seed: int = 7):
    """Arrow function (cls, hashes, wanted) -> (tree, hi, lo, cls, size, mask): 8 minhash values of 16 bits, four in each long; the
    mask has one bit in 64 for each term, by its hash; size is negative for a set that is not wanted."""
    rng = np.random.default_rng(seed)
    mul, add = rng.integers(1, 2**63, trees * DEPTH, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, trees * DEPTH, dtype=np.uint64)

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                lists = batch.column("hashes")
                offsets = np.asarray(lists.offsets)
                starts = offsets[:-1] - offsets[0]
                h = np.asarray(lists.flatten()).view(np.uint64)
                cls = np.asarray(batch.column("cls"))
                n = len(cls)
                size = np.diff(offsets).astype(np.int32)
                size[~batch.column("wanted").to_numpy(zero_copy_only=False).astype(bool)] *= -1
                mask = np.bitwise_or.reduceat(np.uint64(1) << (h & np.uint64(63)), starts).view(np.int64)
                sig = np.empty((trees, 2, n), dtype=np.uint64)
                for t in range(trees):
                    for half in range(2):
                        word = np.zeros(n, dtype=np.uint64)
                        for k in range(4):
                            i = t * DEPTH + half * 4 + k
                            least = np.minimum.reduceat(mix(h * mul[i] + add[i]), starts)
                            word = (word << np.uint64(16)) | (mix(least) & np.uint64(0xFFFF))
                        sig[t, half] = word
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(trees, dtype=np.int32), n)), pa.array(sig[:, 0].reshape(-1).view(np.int64)), pa.array(sig[:, 1].reshape(-1).view(np.int64)), pa.array(np.tile(cls, trees)), pa.array(np.tile(size, trees)), pa.array(np.tile(mask, trees))],
                    ["tree", "hi", "lo", "cls", "size", "mask"],
                )

    return run


def _neighbourhoods(group: int, buffer: int, num: int, den: int):
    """Arrow function over rows sorted by (tree, hi, lo) -> (a, b, depth): candidate pairs (depth null), and for each
    set compared at more than BASE its depth in that tree (b null).

    Pairs whose sizes or masks rule out num / den are not passed on. No such pair can be similar: the smaller size is
    at least num / den of the larger, and at most (den - num) / (den + num) of both sizes together are terms that
    one of the two lacks, each of which accounts for one differing bit at most.
    """

    def compare(cls: np.ndarray, size: np.ndarray, mask: np.ndarray, out: list) -> None:
        i, j = np.triu_indices(len(cls), 1)
        some = (size[i] > 0) | (size[j] > 0)
        i, j, size = i[some], j[some], np.abs(size)
        differ = np.bitwise_count(mask[i] ^ mask[j]).astype(np.int64)
        near = (differ * (den + num) <= (den - num) * (size[i] + size[j])) & (np.minimum(size[i], size[j]) * den >= np.maximum(size[i], size[j]) * num)
        if near.any():
            out.append((cls[i[near]], cls[j[near]], None))

    def resolve(lo: np.ndarray, sets: tuple[np.ndarray, ...], depth: int, out: list) -> None:
        cls = sets[0]
        if len(cls) <= group:
            if depth > BASE:
                out.append((cls, None, np.full(len(cls), depth)))
            if len(cls) > 1:
                compare(*sets, out)
        elif depth == DEPTH:
            out.append((cls, None, np.full(len(cls), _NO_COVER)))
        else:
            prefix = lo >> np.uint64(16 * (DEPTH - depth - 1))
            bounds = [0, *(np.flatnonzero(np.diff(prefix)) + 1).tolist(), len(cls)]
            for x, y in zip(bounds, bounds[1:], strict=False):
                resolve(lo[x:y], tuple(s[x:y] for s in sets), depth + 1, out)

    def deepest(lo: np.ndarray, sets: tuple[np.ndarray, ...], out: list) -> None:
        """A neighbourhood that outgrew the buffer, at full depth."""
        bounds = [0, *(np.flatnonzero(np.diff(lo)) + 1).tolist(), len(lo)]
        for x, y in zip(bounds, bounds[1:], strict=False):
            part = tuple(s[x:y] for s in sets)
            out.append((part[0], None, np.full(y - x, DEPTH if y - x <= group else _NO_COVER)))
            if 1 < y - x <= group:
                compare(*part, out)

    def batch_of(out: list) -> pa.RecordBatch:
        a = np.concatenate([x[0] for x in out])
        b = pa.concat_arrays([pa.nulls(len(x), pa.int64()) if y is None else pa.array(y, pa.int64()) for x, y, _ in out])
        d = pa.concat_arrays([pa.nulls(len(x), pa.int32()) if z is None else pa.array(z, pa.int32()) for x, _, z in out])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, d], ["a", "b", "depth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [np.asarray(batch.column(c)) for c in ("tree", "hi", "lo", "cls", "size", "mask")]
            new[2], new[4], new[5] = new[2].view(np.uint64), new[4].astype(np.int64), new[5].view(np.uint64)
            tree, hi, lo, cls, size, mask = new if kept is None else [np.concatenate(p) for p in zip(kept, new, strict=True)]
            edges = np.flatnonzero((np.diff(tree) != 0) | (np.diff(hi) != 0)) + 1
            out: list = []
            bounds = np.concatenate([[0], edges])
            sizes = np.diff(bounds)
            for k in np.flatnonzero(sizes > 1):  # all but the last group are complete; most hold one set
                x, y = bounds[k], bounds[k + 1]
                resolve(lo[x:y], (cls[x:y], size[x:y], mask[x:y]), BASE, out)
            at = bounds[-1]
            if len(cls) - at > buffer:
                last = at + int(np.argmax(lo[at:] == lo[-1]))  # where the run of the last signature begins
                if last == at:
                    out.append((cls[at:], None, np.full(len(cls) - at, _NO_COVER)))
                    last = len(cls)
                else:
                    deepest(lo[at:last], (cls[at:last], size[at:last], mask[at:last]), out)
                at = last
            kept = [x[at:] for x in (tree, hi, lo, cls, size, mask)]
            if out:
                yield batch_of(out)
        if kept is not None and len(kept[3]) > 1:
            out = []
            resolve(kept[2], tuple(kept[3:]), BASE, out)
            if out:
                yield batch_of(out)

    return run


def set_classes(records: DataFrame, *keep: Column) -> tuple[DataFrame, DataFrame]:
    """Of records (uid BIGINT, terms sorted): the classes (cls, digest, terms, *keep, hashes), one per distinct set, cls being
    its smallest uid and ``keep`` aggregates over its records; and the members (uid, digest). Equal sets are reduced map-side, however many they are."""
    digest = F.md5(F.concat_ws("\u0001", "terms"))
    members = records.withColumn("digest", digest)
    classes = members.groupBy("digest").agg(F.min("uid").alias("cls"), F.first("terms").alias("terms"), *keep)
    return classes.withColumn("hashes", F.transform("terms", lambda t: F.xxhash64(t))), members.select("uid", "digest")


def _near_sizes(size: Column, num: int, den: int) -> Column:
    """The sizes that a set may have to reach similarity num / den with a set of this size."""
    return F.sequence(F.ceil(size * num / den).cast("int"), F.floor(size * den / num).cast("int"))


def exact_candidates(weak: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b: every pair of a class of ``weak`` (cls) and one of ``classes`` that can reach num / den.

    Two sets of sizes s and t reach it only if they share need = ceil(num (s + t) / (num + den)) terms, so, ordered by
    rarity, the first s - need + 1 of one meet the first t - need + 1 of the other; sizes are part of the key.
    """
    tokens = classes.select("cls", F.explode("terms").alias("term"))
    df = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ordered = tokens.join(df, "term").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("by")).withColumn("size", F.size("by"))
    need = lambda s, t: F.ceil((F.col(s) + F.col(t)) * num / (num + den)).cast("int")
    mine = ordered.join(weak, "cls", "left_semi").withColumn("size_b", F.explode(_near_sizes(F.col("size"), num, den)))
    mine = mine.select(F.col("cls").alias("x"), F.col("size").alias("s"), F.col("size_b").alias("t"), F.explode(F.slice("by", F.lit(1), F.col("size") - need("size", "size_b") + 1)).alias("e"))
    theirs = ordered.withColumn("size_a", F.explode(_near_sizes(F.col("size"), num, den)))
    theirs = theirs.select(F.col("cls").alias("y"), F.col("size_a").alias("s"), F.col("size").alias("t"), F.explode(F.slice("by", F.lit(1), F.col("size") - need("size", "size_a") + 1)).alias("e"))
    met = mine.select("x", "s", "t", "e.term").join(theirs.select("y", "s", "t", "e.term"), ["s", "t", "term"]).filter("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_classes(classes: DataFrame, num: int = 3, den: int = 4, trees: int = TREES, group: int = GROUP, target: float = TARGET, buffer: int = _BUFFER) -> DataFrame:
    """(a, b, shared, union), a < b: pairs of different sets of classes (cls, terms, hashes) with shared / union >= num / den.

    ``classes`` is read several times and must be computed already. Sets must not be empty. Expected recall of each
    pair at the threshold is at least ``target``, at higher similarity more; no candidate is dropped. If ``classes`` has a
    column ``wanted``, only pairs with a wanted set are made.
    """
    sided = "wanted" in classes.columns
    classes = classes if sided else classes.withColumn("wanted", F.lit(True))
    rows = classes.select("cls", "hashes", F.coalesce("wanted", F.lit(False)).alias("wanted")).mapInArrow(_signatures(trees), "tree int, hi bigint, lo bigint, cls bigint, size int, mask bigint")
    found = cut(rows.repartition("tree", "hi").sortWithinPartitions("tree", "hi", "lo").mapInArrow(_neighbourhoods(group, buffer, num, den), "a bigint, b bigint, depth int"))
    s = num / den
    gain = F.log(1 - F.lit(s) ** F.col("depth")) - math.log(1 - s**BASE)
    missed = found.filter("b IS NULL").groupBy("a").agg((F.sum(F.when(F.col("depth") == _NO_COVER, F.lit(-math.log(1 - s**BASE))).otherwise(gain)) + trees * math.log(1 - s**BASE)).alias("m"))
    weak = missed.filter(F.col("m") > math.log(1 - target)).select(F.col("a").alias("cls"))
    pairs = found.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if not weak.isEmpty():
        pairs = pairs.unionByName(exact_candidates(weak, classes, num, den)).distinct()
    left, right = classes.select(F.col("cls").alias("a"), F.col("terms").alias("x"), F.col("wanted").alias("p")), classes.select(F.col("cls").alias("b"), F.col("terms").alias("y"), F.col("wanted").alias("q"))
    shared = F.size(F.array_intersect("x", "y"))
    sized = pairs.join(left, "a").join(right, "b").filter("p OR q").select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("union"))
    return sized.filter(F.col("shared") * den >= F.col("union") * num)
