"""Groups of documents with similar packed min-hash signatures.

Equal signatures are one node.  Candidates share a band; inside each band's
bucket signatures are compared by bit counts and a spanning forest of the
similar pairs is kept.  The forest connects what all the similar pairs of the
bucket connect, so a bucket of thousands gives thousands of edges rather than
millions, and loses none.  Copies never meet in a bucket: of a batch's rows of
one node only the first brings its bands, and the rows are joined with their
group by the node's hash, so no task holds their list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import table
from .components import components
from .packed import pack, steps, unpack

_LANES = {1: 0xFFFFFFFFFFFFFFFF, 2: 0x5555555555555555, 4: 0x1111111111111111, 8: 0x0101010101010101}
#: Band keys that a task deals to the parts at a time.
DEALT = 1_000_000


def matches(one: np.ndarray, many: np.ndarray, bits: int) -> np.ndarray:
    """How many of the b-bit lanes agree, by bit counts of the differences."""
    x = one ^ many
    shift = 1
    while shift < bits:
        x = x | (x >> np.uint64(shift))
        shift *= 2
    differ = np.bitwise_count(x & np.uint64(_LANES[bits])).sum(axis=-1, dtype=np.int64)
    return many.shape[-1] * (64 // bits) - differ


def similarity(equal: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Jaccard similarity from the share of equal lanes, corrected for the
    2**-bits of unequal minima whose low bits agree by accident."""
    c = 2.0**-bits
    return (equal / k - c) / (1 - c)


def _forest(sigs: np.ndarray, least: float, k: int, bits: int) -> Iterator[tuple[int, int, float]]:
    """Edges of a spanning forest of the pairs of rows at least so similar."""
    left = np.arange(len(sigs))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            sim = similarity(matches(sigs[at], sigs[left], bits), k, bits)
            near = sim >= least
            for j, s in zip(left[near], sim[near]):
                yield int(at), int(j), float(s)
            queue += list(left[near])
            left = left[~near]


def _edges(least: float, k: int, bits: int):
    width = k * bits // 64
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def of(keys: np.ndarray, ids: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        sim = similarity(matches(sigs[two], sigs[two + 1], bits), k, bits)
        near = sim >= least
        a, b, s = [ids[two][near]], [ids[two + 1][near]], [sim[near]]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            found = list(_forest(sigs[at : at + n], least, k, bits))
            if found:
                i, j, v = map(np.array, zip(*found))
                a.append(ids[at + i])
                b.append(ids[at + j])
                s.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = b"".join(batch.column("sig").to_pylist())
            held.append((batch.column("key").to_numpy(), batch.column("id").to_numpy(), np.frombuffer(raw, np.uint64).reshape(-1, width)))
            first, last = held[0][0][0], held[-1][0][-1]
            if first == last:
                continue  # one bucket that may go on
            keys, ids, sigs = (np.concatenate(x) for x in zip(*held))
            cut_at = np.searchsorted(keys, last)  # keys are sorted
            yield of(keys[:cut_at], ids[:cut_at], sigs[:cut_at])
            held = [(keys[cut_at:], ids[cut_at:], sigs[cut_at:])]
        if held:
            yield of(*(np.concatenate(x) for x in zip(*held)))

    return run


def columns(mins: np.ndarray, empty: np.ndarray, rows: int, bits: int) -> dict[str, pa.Array]:
    """sig and bands of texts with these minima, bands only at a signature's first text; null and none where empty."""
    packed, keys = textvec.pack_low_bits(mins, bits), textvec.bands(mins, rows)
    sigs = [None if e else p.tobytes() for e, p in zip(empty, packed)]
    seen: set[bytes] = set()
    fresh = [s is not None and not (s in seen or seen.add(s)) for s in sigs]
    return {"sig": pa.array(sigs, pa.binary()), "bands": pa.array([x if f else [] for f, x in zip(fresh, keys)], pa.list_(pa.int64()))}


def shared_keys(sigs: DataFrame) -> DataFrame:
    """(node, bands) -> (key, node) of the keys that several nodes have.

    Keys go to their parts packed, sorted and by difference, which takes a quarter
    of their bytes off a shuffle whatever the number of parts."""
    parts = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            key, node = np.concatenate(keys), np.concatenate(nodes)
            part = (key.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            by = np.lexsort((key.view(np.uint64), part))
            key, node, part = key[by], node[by], part[by]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            blobs = [pack(steps(k), n) for k, n in zip(np.split(key, starts[1:]), np.split(node, starts[1:]))]
            for i in range(0, len(blobs), 50):
                yield pa.RecordBatch.from_pydict({"part": pa.array(part[starts[i : i + 50]], pa.int32()), "blob": pa.array(blobs[i : i + 50], pa.binary())})

        for batch in batches:
            bands = batch.column("bands")
            keys.append(bands.flatten().to_numpy(zero_copy_only=False))
            nodes.append(np.repeat(batch.column("node").to_numpy(), np.diff(bands.offsets.to_numpy())))
            held += len(keys[-1])
            if held > DEALT:
                yield from emit()
                keys, nodes, held = [], [], 0
        if held:
            yield from emit()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpack(raw) for batch in batches for raw in batch.column("blob").to_pylist()]
        if not found:
            return
        key, node = np.concatenate([np.cumsum(k) for k, _ in found]), np.concatenate([n for _, n in found])
        by = np.lexsort((node, key))
        key, node = key[by], node[by]
        first = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[first], node[first]
        same = key[1:] == key[:-1]
        several = np.r_[False, same] | np.r_[same, False]
        key, node = key[several], node[several]
        for i in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[i : i + 100_000]), "node": pa.array(node[i : i + 100_000])})

    dealt = sigs.select("node", "bands").mapInArrow(deal, "part int, blob binary")
    return dealt.repartitionById(parts, F.col("part")).mapInArrow(find, "key bigint, node bigint")


def similar_edges(sigs: DataFrame, least: float, k: int, bits: int) -> DataFrame:
    """(node, sig, bands), rows of a node being equal -> edges (a, b, similarity)
    of nodes that connect what the similar pairs among the candidates connect."""
    each = sigs.groupBy("node").agg(F.first("sig").alias("sig"))
    ready = shared_keys(sigs).join(each, "node").select("key", F.col("node").alias("id"), "sig")
    ready = ready.repartition("key").sortWithinPartitions("key")
    return ready.mapInArrow(_edges(least, k, bits), "a bigint, b bigint, similarity double")


def similar_groups(sigs: DataFrame, least: float, k: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, sig, bands, any other columns) -> the rows, stored, with their node (null without
    signature), and (node, root, links) of nodes that are linked with others."""
    stored = table(sigs.withColumn("node", F.when(F.col("sig").isNotNull(), F.xxhash64("sig"))))
    near = similar_edges(stored.where("node is not null").select("node", "sig", "bands"), least, k, bits)
    near = table(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = near.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    roots = components(near).withColumnRenamed("id", "node")
    return stored.drop("sig", "bands"), roots.join(links, "node")


def with_groups(stored: DataFrame, roots: DataFrame) -> DataFrame:
    """Each stored row with root, the least node of its group, group_id, the group's least id, group_size, the number
    of its different ids, and links: how many other nodes its own was found similar to."""
    rows = stored.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rows.where("root is not null").select("root", "id").distinct().groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    return rows.join(sizes, "root", "left")
