"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised and cut into pieces of the sequence length at most. Full pieces are sequences already; the
others are dealt by a hash into blocks of bounded size, and each block to several islands. An island evolves whole
packings: crossover injects a run of the other parent's well-filled bins, removes the bins that hold the same
documents again, and best-fits what was displaced. Between epochs each island's elite moves to the next island of
its block. A block's best packing wins; its poorly filled bins are pooled over the blocks and packed once more. Islands start from
random next-fit groupings, so the packing is the algorithm's own and not a seed's.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import wordcache
from quire.llm.common import cut_lineage

CAPACITY = 2048
#: Pieces in a block, on average. A block is what one task holds.
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 12
POPULATION = 4
#: A bin is well filled from this share on: crossover passes such bins on and mutation opens the others.
FULL = 0.995
#: Bins filled less than this are pooled and packed again.
POOLED = 0.97


def pieces(docs: DataFrame, tokenizer: str, separator: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and a final separator id.

    A null or empty text is the separator alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wordcache.chunk_table(tokenizer)
        end = np.array([separator], dtype="<u4").tobytes()
        for whole in batches:
            # an Arrow batch is 64 MB at most; a text that is longer comes alone
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rows, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(table.encode(b.column(1))):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        rows.append(i)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                # workers live on and serve later stages: give back what Arrow keeps for reuse
                pa.default_memory_pool().release_unused()

    src = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """bin_of each item; loads of the bins, numbered from 0 without gaps."""

    def __init__(self, bin_of: np.ndarray, sizes: np.ndarray):
        self.bin_of = np.unique(bin_of, return_inverse=True)[1] if len(bin_of) else bin_of
        self.loads = np.bincount(self.bin_of, weights=sizes).astype(np.int64) if len(bin_of) else np.zeros(0, np.int64)

    def key(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return len(self.loads), -float(((self.loads / capacity) ** 2).sum())


def best_fit(sizes: np.ndarray, capacity: int, items: np.ndarray, bin_of: np.ndarray, loads: dict[int, int], next_bin: int) -> None:
    """Puts ``items``, largest first, into the fullest bin that has room; ties go to the lowest bin. Changes bin_of."""
    room = sorted((capacity - load, b) for b, load in loads.items() if load < capacity)
    for i in items[np.lexsort((items, -sizes[items]))]:
        need = int(sizes[i])
        at = bisect_left(room, (need, -1))
        if at == len(room):
            left, b = capacity, next_bin
            next_bin += 1
        else:
            left, b = room.pop(at)
        bin_of[i] = b
        if left > need:
            insort(room, (left - need, b))


def next_fit(sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Documents in random order, each into the bin of the one before if it fits: cheap, and no two alike."""
    bin_of, order = np.zeros(len(sizes), np.int64), rng.permutation(len(sizes))
    at = load = 0
    for i, need in zip(order.tolist(), sizes[order].tolist()):
        load += need
        if load > capacity:
            at, load = at + 1, need
        bin_of[i] = at
    return Packing(bin_of, sizes)


def offspring(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """``a`` with some of b's well-filled bins injected, duplicates removed and the displaced best-fitted."""
    good = np.flatnonzero(b.loads >= FULL * capacity)
    if not len(good):
        good = np.argsort(-b.loads, kind="stable")[:1]
    injected = rng.choice(good, max(1, int(len(good) * rng.uniform(0.3, 0.7))), replace=False)
    from_b = np.isin(b.bin_of, injected)
    hit = np.zeros(len(a.loads), bool)
    hit[np.unique(a.bin_of[from_b])] = True
    # mutation: poorly filled bins and a few others are opened too
    hit |= a.loads < FULL * capacity
    hit[rng.integers(0, len(a.loads), 1 + len(a.loads) // 50)] = True
    bin_of = np.where(from_b, len(a.loads) + b.bin_of, a.bin_of)
    displaced = np.flatnonzero(hit[a.bin_of] & ~from_b)
    loads = {int(k): int(a.loads[k]) for k in np.flatnonzero(~hit)}
    loads.update((len(a.loads) + int(k), int(b.loads[k])) for k in injected)
    best_fit(sizes, capacity, displaced, bin_of, loads, len(a.loads) + len(b.loads))
    return Packing(bin_of, sizes)


def floor(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins."""
    return -(-int(sizes.sum()) // capacity)


def evolve(sizes: np.ndarray, capacity: int, seeds: list[Packing], rng: np.random.Generator, generations: int) -> Packing:
    """The best packing after some generations; stops at the lower bound.

    The population starts from ``seeds`` and random next-fit groupings, so whatever is good comes from crossover.
    Two parents are drawn, the better one first more often; their children replace the two worst.
    """
    population = [*seeds, *(next_fit(sizes, capacity, rng) for _ in range(POPULATION - len(seeds)))]
    least = floor(sizes, capacity)
    for _ in range(generations):
        population.sort(key=lambda p: p.key(capacity))
        if len(population[0].loads) <= least:
            break
        i, j = sorted(rng.choice(len(population), 2, replace=False))
        a, b = population[i], population[j]
        population = population[: max(1, POPULATION - 2)] + [offspring(a, b, sizes, capacity, rng), offspring(b, a, sizes, capacity, rng)]
    return min(population, key=lambda p: p.key(capacity))


_STATE = "block long, island int, source int, key long, length long, bin long"


def _island(capacity: int, generations: int, epoch: int):
    def run(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["key"].to_numpy(), group["source"].to_numpy()))
        group = group.take(pa.array(order))
        block, island = group["block"][0].as_py(), group["island"][0].as_py()
        source = group["source"].to_numpy()
        own = source == source[0]
        key, sizes = group["key"].to_numpy()[own], group["length"].to_numpy()[own]
        bins = group["bin"].to_numpy()
        seeds = [Packing(bins[source == s], sizes) for s in np.unique(source)] if epoch else []
        rng = np.random.default_rng([block & 0xFFFFFFFF, island, epoch])
        best = evolve(sizes, capacity, seeds, rng, generations)
        n = len(key)
        return pa.table({
            "block": pa.array(np.full(n, block)), "island": pa.array(np.full(n, island, np.int32)),
            "source": pa.array(np.full(n, island, np.int32)), "key": pa.array(key), "length": pa.array(sizes),
            "bin": pa.array(best.bin_of.astype(np.int64)),
        })

    return run


def _pack_round(items: DataFrame, capacity: int, block_items: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """(key, length, bin) of items (key, length); bin numbers are unique over the blocks."""
    blocks = max(1, -(-items.count() // block_items))
    dealt = items.select(
        F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.lit(0).alias("source"), "key", "length", F.lit(0).cast("long").alias("bin"),
    )
    state = cut_lineage(dealt.groupBy("block", "island").applyInArrow(_island(capacity, generations, 0), _STATE))
    done = None
    for epoch in range(1, epochs + 1):
        best = cut_lineage(_best(state, capacity))
        won = state.join(best.where("at_floor" if epoch < epochs else "true"), ["block", "island"], "left_semi")
        done = won if done is None else done.unionByName(won)
        open_blocks = best.where("NOT at_floor").select("block")
        if epoch == epochs or open_blocks.isEmpty():
            break
        # blocks at the bound are done; of the others, each island's elite also goes to the next island
        state = state.join(open_blocks, "block", "left_semi")
        arrived = state.withColumn("island", F.expr(f"cast((island + 1) % {islands} AS int)"))
        both = state.unionByName(arrived) if islands > 1 else state
        state = cut_lineage(both.groupBy("block", "island").applyInArrow(_island(capacity, generations, epoch), _STATE))
    return done.select("key", "length", (F.col("block") * (1 << 24) + F.col("bin")).alias("bin"))


def _best(state: DataFrame, capacity: int) -> DataFrame:
    """(block, island, at_floor): each block's best island, and whether no packing has fewer bins."""
    bins = state.groupBy("block", "island").agg((F.max("bin") + 1).alias("n"), F.sum("length").alias("tokens"))
    best = bins.groupBy("block").agg(F.min_by("island", F.struct("n", "island")).alias("island"), F.min("n").alias("n"), F.max("tokens").alias("tokens"))
    return best.select("block", "island", (F.col("n") <= F.ceil(F.col("tokens") / capacity)).alias("at_floor"))


def pack(
    docs: DataFrame, tokenizer: str, separator: int = 0, capacity: int = CAPACITY, block_items: int = BLOCK,
    islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Offsets fill each sequence from 0 without gaps. Null texts count as empty and take one token; null ids stay null.
    Repeated rows are packed each, ties among equal lengths included. A very long text is cut into full pieces and a
    rest. An empty table gives an empty result; other columns are ignored. Results depend on the rows'
    order in the checkpoint only through which equal packing is found, never in what is packed.
    """
    cut = cut_lineage(pieces(docs, tokenizer, separator, capacity)).withColumn("key", F.monotonically_increasing_id())
    items = cut.where(F.col("length") < capacity).select("key", "length")
    settings = (capacity, block_items, islands, epochs, generations)
    first = cut_lineage(_pack_round(items, *settings))
    loads = first.groupBy("bin").agg(F.sum("length").alias("load")).where(F.col("load") < POOLED * capacity).select(F.col("bin").alias("b"))
    loads = cut_lineage(loads)
    pooled = cut_lineage(first.join(loads, F.col("bin") == F.col("b"), "left_semi"))
    second = cut_lineage(_pack_round(pooled.select("key", "length"), *settings))
    # never worse than before: bins of the pool are counted
    if second.select("bin").distinct().count() >= loads.count():
        second = pooled
    kept = first.join(loads, F.col("bin") == F.col("b"), "left_anti")
    bins = kept.select("key", "length", (F.col("bin") * 4).alias("bin")).unionByName(second.select("key", "length", (F.col("bin") * 4 + 1).alias("bin")))
    # a bin holds at most ``capacity`` pieces, as each has a token at least
    earlier = Window.partitionBy("bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.select(
        F.col("bin").alias("sequence_id"), F.col("key").alias("k"), F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset")
    )
    full = cut.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("key") * 4 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return full.unionByName(
        cut.where(F.col("length") < capacity).join(placed, F.col("key") == F.col("k"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    )
