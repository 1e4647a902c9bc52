"""Problem 7: filling fixed-capacity containers, by pattern packing with non-negative least squares.

An item longer than the capacity is cut into full pieces and a remainder; every other item stays whole. What is to be
packed then is dealt into shards of bounded size by the hash of its position, each of which is one packing problem of its
own. Patterns of one to three lengths of the exact histogram that leave the least room are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded so that the sums along the sorted patterns stay, and
what the patterns leave is packed best-fit into the room they left and into new containers.

Where a container takes many items, this is done on two levels: patterns of short items fill compartments of which a whole
number fills a container; patterns of the items that are longer than a compartment then leave room for whole compartments.
A shard ends with one container that may be poorly filled, so the number of shards costs next to nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD, KINDS = 50_000, 1000
#: Patterns that are kept for each length, of those in which it is the longest; rounds of the solver.
PER_LENGTH, ROUNDS = 48, 400
#: A compartment is the largest part of a container that is at most so many median items long.
COMPARTMENT = 3.5
#: What room costs beside the squared misfit of the histogram, a whole container being 1.
ROOM_COST = 8.0
#: A missing item of a pattern may be replaced by one that is shorter by this share of the capacity.
SLACK = 256
#: The share of items whose patterns may be given up because rounding left room in them.
RELEASED = 0.065


def patterns(lengths: np.ndarray, capacity: int, step: int, least: int = 0, per_length: int = PER_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(rows, room): multisets of one to three ascending ``lengths`` (as descending indexes, len(lengths) for none) that fit the
    capacity, and the room each leaves beside whole compartments of ``step``.

    For every longest item, of those above ``least``: alone, with each second, and with each second and the longest third that fits the container
    or the compartment begun; the ``per_length`` of least room are kept.
    """
    n = len(lengths)
    by_rest = np.argsort(lengths % step, kind="stable")
    rest = (lengths % step)[by_rest]
    rows, rooms = [], []
    for i in range(int(np.searchsorted(lengths, least, "right")), n):
        j = np.arange(i + 1)
        two = lengths[i] + lengths[: i + 1]
        j, two = j[two <= capacity], two[two <= capacity]
        first = np.full(len(j), i)
        none = np.full(len(j), n)
        kinds = [np.array([[i, n, n]]), np.stack([first, j, none], 1)]
        totals = [lengths[i : i + 1], two]
        k = np.searchsorted(lengths, capacity - two, "right") - 1
        ok = (k >= 0) & (k <= j)
        k = np.where(k > j, j, k)
        ok = k >= 0
        kinds.append(np.stack([first, j, k], 1)[ok])
        totals.append((two + lengths[np.maximum(k, 0)])[ok])
        if step < capacity:
            k = by_rest[np.maximum(np.searchsorted(rest, (capacity - two) % step, "right") - 1, 0)]
            ok = (k <= j) & (two + lengths[k] <= capacity)
            kinds.append(np.stack([first, j, k], 1)[ok])
            totals.append((two + lengths[k])[ok])
        kind, total = np.concatenate(kinds), np.concatenate(totals)
        room = (capacity - total) % step if step < capacity else capacity - total
        best = np.argsort(room, kind="stable")[:per_length]
        rows.append(kind[best])
        rooms.append(room[best])
    return np.concatenate(rows), np.concatenate(rooms)


def nonnegative_least_squares(rows: np.ndarray, n: int, b: np.ndarray, cost: np.ndarray | float = 0.0, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that minimises |a x - b|² / 2 + cost x, column c of a counting how often each of 0..n-1 stands in rows[c] (n itself is none).

    Projected gradient steps with momentum (accelerated, restarted where they overshoot); a is never written out.
    """
    def product(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, width), n + 1)[:n]

    width, flat = rows.shape[1], rows.ravel()
    # the largest eigenvalue of a' a, by the power method
    v = np.ones(len(rows))
    most = 1.0
    for _ in range(12):
        w = np.append(product(v), 0.0)[rows].sum(1)
        most = float(np.linalg.norm(w)) or 1.0
        v = w / most
    step = 1 / (1.05 * most)
    x = np.zeros(len(rows))
    y, t = x, 1.0
    for _ in range(rounds):
        gradient = np.append(product(y) - b, 0.0)[rows].sum(1) + cost
        new = np.maximum(0.0, y - step * gradient)
        if gradient @ (new - x) > 0:
            y, t = x, 1.0
            gradient = np.append(product(y) - b, 0.0)[rows].sum(1) + cost
            new = np.maximum(0.0, y - step * gradient)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


class _Stacks:
    """Items by length; what is asked for and missing is replaced by the longest that is shorter by ``slack`` at most."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, slack: int):
        order = np.argsort(sizes, kind="stable")
        starts = np.searchsorted(sizes[order], lengths)
        self.stacks = [order[x:y].tolist() for x, y in zip(starts, [*starts[1:], len(order)], strict=True)]
        self.least = np.searchsorted(lengths, lengths - slack).tolist()

    def take(self, i: int) -> int | None:
        return next((self.stacks[at].pop() for at in range(i, self.least[i] - 1, -1) if self.stacks[at]), None)


def _by_patterns(sizes: np.ndarray, capacity: int, step: int) -> tuple[np.ndarray, list[int]]:
    """The container of each item that a pattern holds, -1 for the others, and the room left in each container."""
    box, room = np.full(len(sizes), -1, dtype=np.int64), []
    lengths, counts = np.unique(sizes, return_counts=True)
    counts = counts.astype(float)
    long = lengths > step if step < capacity else lengths > 0
    if not long.all():
        counts[~long] *= min(0.5, counts[long].sum() / counts[~long].sum())  # short items that fill up beside long ones
    rows, left = patterns(lengths, capacity, step, step if step < capacity else 0)
    x = nonnegative_least_squares(rows, len(lengths), counts, ROOM_COST * left / capacity)
    order = np.lexsort((-rows[:, 2], -rows[:, 1], -rows[:, 0]))
    repeats = np.diff(np.floor(np.cumsum(x[order]) + 0.5), prepend=0.0).astype(int)
    stacks = _Stacks(lengths, sizes, max(1, step // SLACK))
    for c, times in zip(order[repeats > 0].tolist(), repeats[repeats > 0].tolist(), strict=True):
        kind = [i for i in rows[c].tolist() if i < len(lengths)]
        for _ in range(times):
            items = [item for i in kind if (item := stacks.take(i)) is not None]
            if items:
                box[items] = len(room)
                room.append(capacity - int(sizes[items].sum()))
    return _kept(box, np.array(room, dtype=np.int64), step)


def _kept(box: np.ndarray, room: np.ndarray, step: int) -> tuple[np.ndarray, list[int]]:
    """Without the containers whose patterns, rounded, leave the most room: with RELEASED of the items at most."""
    held = np.bincount(box[box >= 0], minlength=len(room))
    worst = np.argsort(-(room % step if step else room), kind="stable")
    released = worst[np.cumsum(held[worst]) <= RELEASED * len(box)]
    number = np.full(len(room) + 1, -1, dtype=np.int64)
    kept = np.setdiff1d(np.arange(len(room)), released)
    number[kept] = np.arange(len(kept))
    return number[box], room[kept].tolist()


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, patterned) of each item: the container's number, dense from 0, and whether a pattern holds the item; sizes
    are in 1..capacity."""
    if not len(sizes):
        return np.full(0, -1, dtype=np.int64), np.zeros(0, dtype=bool)
    sizes = sizes.astype(np.int64)
    parts = max(1, -(-capacity // max(1, int(COMPARTMENT * float(np.median(sizes))))))
    step = capacity // parts
    if parts == 1:
        box, room = _by_patterns(sizes, capacity, capacity)
    else:
        box, room = _two_levels(sizes, capacity, step)
    patterned = box >= 0
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    box = _best_fit(sizes, capacity, order, box, room)
    return np.unique(box, return_inverse=True)[1], patterned


def _two_levels(sizes: np.ndarray, capacity: int, step: int) -> tuple[np.ndarray, list[int]]:
    """Compartments of short items, containers of long ones, and as many compartments in each container as it takes."""
    box = np.full(len(sizes), -1, dtype=np.int64)
    room: list[int] = []
    if (sizes > step).any():
        box, room = _by_patterns(sizes, capacity, step)
    short = np.flatnonzero((sizes <= step) & (box < 0))
    if not len(short):
        return box, room
    own, left = _by_patterns(sizes[short], step, step)
    # the fullest compartments first, into the containers that the long items leave with the least room
    fill = [step - x for x in left]
    at = iter(np.argsort([-f for f in fill], kind="stable").tolist())
    place = np.full(len(fill), -1, dtype=np.int64)
    todo = next(at, None)
    for container in np.argsort(room, kind="stable").tolist():
        while todo is not None and room[container] >= fill[todo]:
            place[todo] = container
            room[container] -= fill[todo]
            todo = next(at, None)
    while todo is not None:
        room.append(capacity)
        while todo is not None and room[-1] >= fill[todo]:
            place[todo] = len(room) - 1
            room[-1] -= fill[todo]
            todo = next(at, None)
    inside = own >= 0
    box[short[inside]] = place[own[inside]]
    return box, room


def _best_fit(sizes: np.ndarray, capacity: int, order: np.ndarray, box: np.ndarray, room: list[int]) -> np.ndarray:
    """Each item without a container, longest first, goes into the least room that takes it, else into a new container."""
    open_rooms: list[int] = []
    by_room: dict[int, list[int]] = {}

    def put(container: int, left: int) -> None:
        if left > 0:
            if left in by_room:
                by_room[left].append(container)
            else:
                by_room[left] = [container]
                insort(open_rooms, left)

    for container, left in enumerate(room):
        put(container, left)
    used = len(room)
    rest = order[box[order] < 0]
    for item, size in zip(rest.tolist(), sizes[rest].tolist(), strict=True):
        at = bisect_left(open_rooms, size)
        if at < len(open_rooms):
            left = open_rooms[at]
            container = by_room[left].pop()
            if not by_room[left]:
                del by_room[left], open_rooms[at]
        else:
            container, left, used = used, capacity, used + 1
        box[item] = container
        put(container, left - size)
    return box


def fill_containers(items: DataFrame, kinds: DataFrame, shard: int = SHARD) -> DataFrame:
    """(container_kind, container_id STRING, doc_id, piece BIGINT, tokens BIGINT, patterned BOOLEAN) of items (doc_id, tokens) and kinds
    (container_kind, capacity).

    One row per piece: piece 0.. are the full pieces of an item longer than the capacity, each alone in its container;
    the last is the remainder, or the whole item. Items of 0 tokens, null counts included, take no room and come
    out with a null container. ``patterned`` says whether a pattern holds the piece (full pieces count as patterns of their own
    length). Rows with a null id are packed too. Kinds without a positive capacity are left
    out. ``kinds`` is a setting, the sizes in use, and does not grow with the items: up to KINDS of them are a constant of
    the plan, more raise ValueError. ``items`` is read several times and must be computed already (a table or a
    checkpoint), so that a row that is read again after a failure falls into the same shard; its shard does not depend
    on its id, which many rows may share. Containers of full pieces are named by the row's position, shared ones by shard.
    """
    sizes = kinds.filter("capacity > 0").select("container_kind", F.col("capacity").cast("bigint")).distinct().sort("capacity", "container_kind").head(KINDS + 1)
    if len(sizes) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    items = items.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("size"), F.monotonically_increasing_id().alias("at"))
    shards = max(1, -(-items.count() // shard))
    constant = F.array(*(F.struct(F.lit(k.container_kind).cast("string").alias("container_kind"), F.lit(k.capacity).cast("bigint").alias("capacity")) for k in sizes))
    constant = constant if sizes else F.array().cast("array<struct<container_kind:string,capacity:bigint>>")
    crossed = items.withColumn("k", F.explode(constant)).select("doc_id", "size", "at", "k.container_kind", "k.capacity")
    crossed = crossed.withColumn("full", F.expr("size div capacity")).withColumn("last", F.expr("size % capacity"))
    whole = crossed.filter("full > 0").select("container_kind", "doc_id", "at", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("container_kind", F.concat_ws("-", F.lit("whole"), F.col("at").cast("string"), F.col("piece").cast("string")).alias("container_id"), "doc_id", "piece", F.col("capacity").alias("tokens"), F.lit(True).alias("patterned"))
    empty = crossed.filter("size = 0").select("container_kind", F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).cast("bigint").alias("piece"), F.col("size").alias("tokens"), F.lit(False).alias("patterned"))
    rest = crossed.filter("last > 0").select("container_kind", "capacity", "doc_id", F.col("full").alias("piece"), F.col("last").alias("tokens"), F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int").alias("shard"))
    kind = items.schema["doc_id"].dataType.simpleString()

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"container_kind": pa.array([], pa.string()), "container_id": pa.array([], pa.string()), "doc_id": rows.column("doc_id"), "piece": rows.column("piece"), "tokens": rows.column("tokens"), "patterned": pa.array([], pa.bool_())})
        rows = rows.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        boxes, patterned = pack(rows.column("tokens").to_numpy(), rows.column("capacity")[0].as_py())
        names = pa.array([f"shared-{rows.column('shard')[0].as_py()}-{b}" for b in boxes.tolist()], pa.string())
        return pa.table({"container_kind": rows.column("container_kind"), "container_id": names, "doc_id": rows.column("doc_id"), "piece": rows.column("piece"), "tokens": rows.column("tokens"), "patterned": pa.array(patterned)})

    shared = rest.groupBy("container_kind", "shard").applyInArrow(packed, f"container_kind string, container_id string, doc_id {kind}, piece bigint, tokens bigint, patterned boolean")
    return whole.unionByName(empty).unionByName(shared)


def fill_report(filled: DataFrame, kinds: DataFrame) -> DataFrame:
    """(container_kind, capacity, items, tokens, containers, least, unused, patterned): least is the number of containers that
    the tokens would need if they could be cut anywhere, unused the share of all containers' room that stays empty, patterned the
    share of pieces that patterns hold."""
    containers = filled.filter("container_id IS NOT NULL").groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("patterned"), 1)).alias("held"))
    total = containers.groupBy("container_kind").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum("held").alias("held"), F.count(F.lit(1)).alias("containers"))
    kinds = kinds.select("container_kind", F.col("capacity").cast("bigint").alias("capacity")).distinct()
    room = F.col("containers") * F.col("capacity")
    return total.join(kinds, "container_kind").select("container_kind", "capacity", "items", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), F.round(1 - F.col("tokens") / room, 6).alias("unused"), F.round(F.col("held") / F.col("items"), 6).alias("patterned"))
