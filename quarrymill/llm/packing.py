"""Filling fixed-capacity containers with items (problem 7): a grouping genetic algorithm.

Documents larger than a container are split into full containers and a rest; all
other documents stay whole.  Spark spreads the items over shards by hash; each
shard is packed by several islands, groups of their own that evolve a small
population of packings.  A packing's genes are its containers: crossover injects
whole well-filled containers of one parent into the other, drops the containers
that hold an injected item too, opens a few badly filled ones (the mutation), and
puts the displaced items back, by swaps that fill a container better and then by
best fit.  Between epochs the best packings migrate to the next island, through a
shuffle.  Containers that are full up to SLACK are done; the items of all others
are pooled over the shards and packed again, in fewer shards each round.

A packing is one flat array, the container of each item; the packings of an
island lie behind one another in one array of integers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import checkpointed
from .mixing import token_count

#: Items of a shard, and of a shard of the last round; islands of a shard, epochs between migrations.
SHARD_ITEMS = 768
LAST_SHARD_ITEMS = 3072
ISLANDS = 3
EPOCHS = 3
#: Offspring an island makes in an epoch, packings it keeps, packings that migrate.
OFFSPRING = 20
POPULATION = 6
ELITE = 2
#: Rounds in which containers with more free room than this share are pooled and packed again.
POOL_ROUNDS = 2
SLACK = 0.0005
#: One of how many well-filled containers is injected, and one of how many others is opened.
INJECT = 10
OPEN = 30
#: Displaced items that are tried in pairs, and such swaps at most.
PAIRED = 40
SWAPS = 4

_NO = np.int64(1) << 40


def free_room(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Free room of every container of a packing."""
    return capacity - np.bincount(bins, sizes).astype(np.int64) if len(bins) else np.zeros(0, np.int64)


def value(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean square of the fill: full containers and few of them count most."""
    fill = np.bincount(bins, sizes) / capacity
    return float((fill * fill).mean()) if len(fill) else 0.0


def best_fit(bins: np.ndarray, sizes: np.ndarray, free: np.ndarray, items: np.ndarray, capacity: int) -> np.ndarray:
    """bins with the items added in their order, each to the fullest container that takes it."""
    if not len(items):
        return bins
    some = np.flatnonzero(free >= sizes[items].min())
    room = sorted(zip(free[some].tolist(), some.tolist(), strict=True))
    n = len(free)
    for i, size in zip(items.tolist(), sizes[items].tolist(), strict=True):
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins[i] = n
            insort(room, (capacity - size, n))
            n += 1
        else:
            left, k = room.pop(at)
            bins[i] = k
            insort(room, (left - size, k))
    return bins


def falling(items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The items by falling size."""
    return items[np.argsort(-sizes[items], kind="stable")]


@lru_cache(maxsize=None)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of n numbers; n is at most PAIRED."""
    return np.triu_indices(n, 1)


def put_back(bins: np.ndarray, sizes: np.ndarray, free: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """bins with the displaced items (-1 in bins) back in: first a displaced item, or
    a pair of them, takes the place of a smaller item where that leaves the least
    room, then all go in by best fit."""
    at = np.flatnonzero(bins >= 0)
    at = at[free[bins[at]] > 0]  # a full container gains nothing
    own, held = bins[at], sizes[at]
    most = held + free[own]  # the largest item that fits in the place of each
    left = falling(loose, sizes).tolist()
    for n, (i, size) in enumerate(zip(left, sizes[left].tolist(), strict=True) if len(at) else ()):
        fits = np.where((held < size) & (most >= size), most, _NO)
        j = int(fits.argmin())
        if fits[j] < _NO:
            k = own[j]
            free[k] = fits[j] - size
            bins[i], bins[at[j]], left[n] = k, -1, int(at[j])
            at[j], held[j] = i, size
            same = np.flatnonzero(own == k)
            most[same] = held[same] + free[k]
    loose = np.array(left, np.int64)
    for _ in range(SWAPS):
        if len(loose) < 2 or not len(at):
            break
        room = free[own]
        a, b = _pairs(min(len(loose), PAIRED))
        both = sizes[loose[a]] + sizes[loose[b]]
        order = np.argsort(both, kind="stable")
        both = both[order]
        pair = np.searchsorted(both, held + room, side="right") - 1
        got = np.where(pair >= 0, both[np.maximum(pair, 0)], 0)
        rest = np.where(got > held, held + room - got, _NO)
        j = int(rest.argmin())
        if rest[j] >= _NO:
            break
        x, y = loose[a[order[pair[j]]]], loose[b[order[pair[j]]]]
        out, k = at[j], own[j]
        bins[x] = bins[y] = k
        bins[out], free[k] = -1, rest[j]
        loose = np.append(loose[(loose != x) & (loose != y)], out)
        at[j], held[j] = x, sizes[x]
        at, held, own = np.append(at, y), np.append(held, sizes[y]), np.append(own, k)
    return best_fit(bins, sizes, free, falling(loose, sizes), capacity)


def crossover(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of one with some of the best-filled containers of the other."""
    room = free_room(other, sizes, capacity)
    well = np.argsort(room + rng.random(len(room)), kind="stable")[: max(1, len(room) // 2)]
    picked = np.sort(rng.choice(well, max(1, len(well) // INJECT), replace=False))
    chosen = np.zeros(len(room), bool)
    chosen[picked] = True
    injected = chosen[other]
    opened = np.zeros(one.max() + 1, bool)
    opened[one[injected]] = True
    kept = np.flatnonzero(~opened)
    if len(kept):  # mutation: the least filled and some of the others are opened too
        least = np.argsort(-free_room(one, sizes, capacity)[kept], kind="stable")[: max(1, len(kept) // OPEN)]
        opened[kept[least]] = True
        opened[rng.choice(kept, min(2, len(kept)), replace=False)] = True
    loose = opened[one] & ~injected
    child = one.copy()
    child[injected] = len(opened) + np.searchsorted(picked, other[injected])
    child[loose] = -1
    inside = ~loose
    used = np.zeros(len(opened) + len(picked), bool)
    used[child[inside]] = True
    child[inside] = (np.cumsum(used) - 1)[child[inside]]
    return put_back(child, sizes, free_room(child[inside], sizes[inside], capacity), np.flatnonzero(loose), capacity)


def start(sizes: np.ndarray, capacity: int, rng: np.random.Generator, population: int = POPULATION) -> list[np.ndarray]:
    """Best fit of the items by falling size, exact and perturbed."""
    none, empty = np.full(len(sizes), -1, np.int64), np.zeros(0, np.int64)
    orders = [np.argsort(-sizes * (rng.uniform(0.75, 1.0, len(sizes)) if k else 1.0), kind="stable") for k in range(population)]
    return [best_fit(none.copy(), sizes, empty, order, capacity) for order in orders]


def evolve(sizes: np.ndarray, capacity: int, population: list[np.ndarray], rng: np.random.Generator, offspring: int = OFFSPRING) -> list[np.ndarray]:
    """The population after an epoch, best first."""
    ranked = sorted(((value(p, sizes, capacity), p) for p in population), key=lambda x: -x[0])[:POPULATION]
    if len(sizes) < 2:
        return [p for _, p in ranked]
    for _ in range(offspring):
        a, b = (ranked[int(rng.integers(len(ranked), size=2).min())][1] for _ in "ab")  # tournaments of two
        child = crossover(a, b, sizes, capacity, rng)
        got = value(child, sizes, capacity)
        if (len(ranked) < POPULATION or got > ranked[-1][0]) and all(abs(got - v) > 1e-12 for v, _ in ranked):
            ranked = sorted([*ranked, (got, child)], key=lambda x: -x[0])[:POPULATION]
    return [p for _, p in ranked]


def _epoch(epoch: int, offspring: int):  # noqa: ANN202
    def run(group: pa.Table) -> pa.Table:
        row = group.slice(0, 1)
        name, capacity, shard, island = (row.column(c)[0].as_py() for c in ("limit_name", "capacity", "shard", "island"))
        sizes = row.column("sizes")[0].values.to_numpy(zero_copy_only=False).astype(np.int64)
        rng = np.random.default_rng(crc32(f"{name}-{shard}-{island}-{epoch}".encode()))
        flat = [np.asarray(p.values.to_numpy(zero_copy_only=False), np.int64) for p in group.column("packings")]
        population = [p for f in flat for p in f.reshape(-1, len(sizes))] or start(sizes, capacity, rng)
        population = evolve(sizes, capacity, population, rng, offspring)
        row = row.set_column(row.schema.get_field_index("packings"), "packings", pa.array([np.concatenate(population)], pa.list_(pa.int32())))
        return row.set_column(row.schema.get_field_index("best"), "best", pa.array([value(population[0], sizes, capacity)], pa.float64()))

    return run


_ITEM = ("doc_id", "part", "n_parts", "tokens")


def _pack(items: DataFrame, islands: int, epochs: int, groups: int, offspring: int) -> DataFrame:
    """(limit_name, capacity, shard, bin, doc_id, part, n_parts, tokens, unused): each
    shard's best packing, unused the free room of the item's container.

    items: limit_name, capacity, shard, doc_id, part, n_parts, tokens; shards are of
    bounded size.  The rows are few and small but their work is long, so they are
    spread over a set number of partitions, which is not cut down by their size in bytes."""
    keys = ["limit_name", "capacity", "shard", "island"]
    spread = max(1, min(groups * islands, 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    state = items.groupBy("limit_name", "capacity", "shard").agg(F.array_sort(F.collect_list(F.struct("tokens", "doc_id", "part", "n_parts"))).alias("i"))
    state = state.select(
        "limit_name", "capacity", "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("i.doc_id").alias("ids"), F.col("i.part").alias("parts"),
        F.col("i.n_parts").alias("of"), F.col("i.tokens").alias("sizes"), F.expr("cast(array() as array<int>)").alias("packings"), F.lit(0.0).alias("best"),
    )
    for epoch in range(epochs):
        evolved = checkpointed(state.repartition(spread, *keys).groupBy(*keys).applyInArrow(_epoch(epoch, offspring), state.schema))
        # the best of each island also go to the next one
        moved = evolved.withColumn("island", ((F.col("island") + 1) % islands).cast("int")).withColumn("packings", F.slice("packings", F.lit(1), ELITE * F.size("sizes")))
        state = evolved.unionByName(moved) if epoch < epochs - 1 and islands > 1 else evolved
    best = state.groupBy("limit_name", "capacity", "shard").agg(F.max_by(F.struct("ids", "parts", "of", "sizes", F.slice("packings", F.lit(1), F.size("sizes")).alias("bins")), F.struct("best", "island")).alias("p"))
    best = best.select("limit_name", "capacity", "shard", "p.*")
    fields = {f.name: f for f in items.schema}
    names = ["limit_name", "capacity", "shard", "bin", *_ITEM, "unused"]
    schema = T.StructType([*(fields[c] for c in names[:3]), T.StructField("bin", T.IntegerType()), *(fields[c] for c in _ITEM), T.StructField("unused", T.LongType())])

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, parts, of, sizes, bins = (batch.column(c)[r].values for c in ("ids", "parts", "of", "sizes", "bins"))
                at, size = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (bins, sizes))
                owner = pa.array(np.full(len(at), r))
                unused = free_room(at, size, batch.column("capacity")[r].as_py())[at]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owner) for c in names[:3]), bins, ids, parts, of, sizes, pa.array(unused)], names)

    return best.mapInArrow(unfold, schema)


def containers(
    documents: DataFrame, limits: DataFrame, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, pool_rounds: int = POOL_ROUNDS,
    offspring: int = OFFSPRING, last_shard_items: int = LAST_SHARD_ITEMS,
) -> DataFrame:
    """(limit_name, capacity, container_id, doc_id, part, n_parts, tokens): every
    document assigned to containers of each capacity in limits.

    Only documents over the capacity have several parts, all but the last of
    which fill a container.  Null text counts one token, null doc_ids are left
    out, repeated doc_ids count once; no documents give no rows; limits with a
    null or non-positive size are left out; ties between packings go to the island
    of the larger number."""
    caps = limits.where(F.col("max_size") > 0).select("limit_name", F.col("max_size").cast("int").alias("capacity"))
    sized = documents.where(F.col("doc_id").isNotNull()).select("doc_id", token_count(F.col("text")).alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    sized = checkpointed(sized)
    shards = max(1, -(-sized.count() // shard_items))
    both = sized.join(F.broadcast(caps), how="cross")  # caps: the rows of a fixed table of limits
    n_parts = F.ceil(F.col("size") / F.col("capacity")).cast("int")
    parts = both.withColumn("n_parts", n_parts).select("*", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
    tokens = F.least(F.col("size") - F.col("part").cast("bigint") * F.col("capacity"), F.col("capacity").cast("bigint")).cast("int")
    items = parts.withColumn("tokens", tokens)
    columns = ["limit_name", "capacity", *_ITEM]
    out = items.where("tokens = capacity").select(F.concat_ws("-", "limit_name", F.lit("full"), "doc_id", "part").alias("container_id"), *columns)
    left = items.where("tokens < capacity").select(*columns)
    for r in range(pool_rounds + 1):
        placed = left.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", F.lit(r)), F.lit(shards)))
        packed = checkpointed(_pack(placed, islands, epochs, 2 * shards, offspring))
        done = F.lit(True) if r == pool_rounds else F.col("unused") <= SLACK * F.col("capacity")
        named = F.concat_ws("-", "limit_name", F.lit(r), "shard", "bin").alias("container_id")
        out = out.unionByName(packed.where(done).select(named, *columns))
        if r < pool_rounds:
            left = packed.where(~done).select(*columns)
            most = left.groupBy("limit_name").count().agg(F.max("count")).first()[0] or 0
            shards = max(1, -(-most // (shard_items if r < pool_rounds - 1 else last_shard_items)))
    return out.select("limit_name", "capacity", "container_id", "doc_id", "part", "n_parts", "tokens")


def report(packed: DataFrame) -> DataFrame:
    """(limit_name, capacity, n_containers, n_documents, tokens, unused_tokens, unused_share, fewest_possible)."""
    out = packed.groupBy("limit_name", "capacity").agg(F.countDistinct("container_id").alias("n_containers"), F.countDistinct("doc_id").alias("n_documents"), F.sum("tokens").alias("tokens"))
    room = F.col("n_containers") * F.col("capacity")
    return out.select("*", (room - F.col("tokens")).alias("unused_tokens"), F.round((room - F.col("tokens")) / room, 6).alias("unused_share"), F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest_possible"))
