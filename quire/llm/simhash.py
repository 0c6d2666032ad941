"""SimHash near-dedup over deletion-variant signatures.

Fingerprints that differ in at most three bits differ in at most one bit in one of their two 32-bit halves.
So each half is indexed under its 32 one-wildcard variants, variants are joined by equality, and pairs are
verified on all 64 bits. A variant that too many fingerprints share is not joined: its members are cut again
(two 16-bit pieces of the other half, then two 8-bit pieces of what is left) by the same rule. After two cuts
only 11 bits are free, so no group holds more than 2,048 fingerprints, however the data are spread.

Work is done on distinct fingerprints; within a group only a spanning forest of the links is emitted, which
keeps the components and avoids all pairs. Components come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ASCII_LOWER, cut_lineage

SEED = 42
#: Members above which a variant is cut again. At least 2,048, so the last cut always suffices.
MAX_GROUP = 2048
#: Fingerprints whose keys one task makes.
EXPANDED_TOGETHER = 50_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    ones, n = np.zeros(64, dtype=np.int64), 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype=">u8")
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) for each row; fp is the 64-bit fingerprint as a signed long. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t.as_py(), width)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["_id", "fp"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, fp long")


def forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps`` (uint64, distinct): at most one link fewer than members."""
    links, rest = [], np.sort(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= most
            for other in rest[near]:
                links.append((at, other))
                queue.append(other)
            rest = rest[~near]
    return links


def _pieces(level: int) -> list[list[tuple[int, int]]]:
    """For each key of a level, the bits it fixes: a piece less one wildcard bit. (shift, width) of the pieces."""
    return [[(0, 32), (32, 32)], [(0, 16), (16, 16)], [(0, 8), (8, 8)]][level]


def _expand(level: int):
    """Rows (key, free, base, fp) to rows of the next level's keys.

    ``free`` is the lowest bit of the span still free, ``key`` hashes all that is fixed so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            low = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            fps = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            out_k, out_l, out_f = [], [], []
            pieces = _pieces(level)
            for i, (shift, width) in enumerate(pieces):
                other = pieces[1 - i][0]
                mask = np.uint64((1 << width) - 1)
                value = (fps >> (low + np.uint64(shift))) & mask
                for bit in range(width):
                    kept = value & (mask ^ np.uint64(1 << bit))
                    # mixes what was fixed before, the piece, the wildcard and the rest of the piece's bits
                    tag = np.uint64((level * 2 + i) * 64 + bit)
                    out_k.append(_mix(_mix(keys + tag) ^ kept))
                    out_l.append(low + np.uint64(other))
                    out_f.append(fps)
            for k, lo, f in zip(out_k, out_l, out_f):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(f.view(np.int64))], ["key", "free", "fp"]
                )

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; two keys that clash only cost a check, as every pair is verified."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEYS = "key long, free int, fp long"


def links(fps: DataFrame, max_bits: int = 3, max_group: int = MAX_GROUP) -> DataFrame:
    """(a, b) links among distinct fingerprints (column fp) that keep the components of "differ in <= max_bits".

    max_bits is at most 3, which two pieces with one wildcard cover.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = [], []
            col = b.column(0)
            values = col.values.to_numpy(zero_copy_only=False).view(np.uint64)
            ends = col.offsets.to_numpy()
            sizes = np.diff(ends)
            two = ends[:-1][sizes == 2]
            x, y = values[two], values[two + 1]
            near = np.bitwise_count(x ^ y) <= max_bits
            a.append(x[near])
            z.append(y[near])
            for i in np.flatnonzero(sizes > 2):
                found = forest(values[ends[i] : ends[i + 1]], max_bits)
                if found:
                    pair = np.array(found, dtype=np.uint64)
                    a.append(pair[:, 0])
                    z.append(pair[:, 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(z).view(np.int64))], ["a", "b"]
            )

    found = None
    todo = fps.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("free"), "fp")
    for level in range(3):
        keys = todo.mapInArrow(_expand(level), _KEYS)
        hot = None
        if level < 2:
            # A variant over the bound takes its members from two values of its piece, so one of those alone is over half of it.
            hot = _hot_keys(todo, level, max_group)
            hot = cut_lineage(hot)
            if hot.isEmpty():
                hot = None
        cold = keys if hot is None else keys.join(hot, "key", "left_anti")
        pairs = (
            cold.groupBy("key")
            .agg(F.collect_list("fp").alias("fps"))
            .where(F.size("fps") > 1)
            .select("fps")
            .mapInArrow(verify, "a long, b long")
        )
        found = pairs if found is None else found.unionByName(pairs)
        if hot is None:
            break
        todo = keys.join(hot, "key", "left_semi")
    return found.distinct()


def _hot_keys(todo: DataFrame, level: int, max_group: int) -> DataFrame:
    """Variants that may have over ``max_group`` members, from counts of whole pieces (2 rows a fingerprint, not 64)."""
    pieces = _pieces(level)
    whole = []
    for i, (shift, width) in enumerate(pieces):
        moved = F.expr(f"shiftrightunsigned(fp, free + {shift})").bitwiseAND(F.lit((1 << width) - 1))
        whole.append(F.struct(F.lit(i).alias("i"), moved.alias("value")))
    counts = (
        todo.select("key", F.explode(F.array(*whole)).alias("p"))
        .groupBy("key", "p.i", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") * 2 > max_group)
    )

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            which = b.column(1).to_numpy(zero_copy_only=False)
            value = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (_, width) in enumerate(pieces):
                k, v = keys[which == i], value[which == i]
                mask = np.uint64((1 << width) - 1)
                for bit in range(width):
                    tag = np.uint64((level * 2 + i) * 64 + bit)
                    out = _mix(_mix(k + tag) ^ (v & (mask ^ np.uint64(1 << bit))))
                    yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["key"])

    return counts.select("key", "i", "value").mapInArrow(variants, "key long").distinct()


def _apart(key: str) -> Column:
    """The key in another form: a join on it shuffles both sides, even one just aggregated by the key, so that a hot key can be split."""
    return F.bitwise_not(F.col(key))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b: longs).

    Large-star and small-star rounds until nothing changes; each round's result is checkpointed. Minima are
    partial aggregates and joins are plain equi-joins, so a hub never has to fit one task.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: every larger neighbour of a node moves to the node's least neighbour
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(_apart("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, _apart("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour of a node, and the node, move to the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m")).select(_apart("a").alias("w"), "m")
        moved = (
            large.join(small, _apart("a") == F.col("w"))
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        e = cut_lineage(moved)
        after = tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if after == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3, max_group: int = MAX_GROUP
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest id reachable over links of ``max_bits`` differing bits or fewer. A text without
    words, null or empty, has fingerprint zero and is linked like any other. Repeated rows get a row each; null
    ids take part and are never the smallest unless alone. A very long text is read whole, its shingles' bits in slices.
    An empty table gives an empty result; other columns are ignored.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, width))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("_id").alias("least")))
    # few bytes, but 64 keys each: a task for every so many fingerprints, whatever their size
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // EXPANDED_TOGETHER))
    roots = components(links(distinct.select("fp").repartition(parts, "fp"), max_bits, max_group))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id")).select(_apart("root").alias("r"), "component_id")
    by_fp = cut_lineage(placed.join(smallest, _apart("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"))
    return marked.join(by_fp, F.col("fp") == F.col("f")).select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
