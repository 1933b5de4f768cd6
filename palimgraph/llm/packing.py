"""Best-fit packing by exact-complement hashing.

Documents are lengths in tokens.  Full pieces of the capacity are sequences of
their own; the plan is made on how many remainders have each length, so its
cost depends on the capacity and not on the number of documents.  Sums of one,
two and three lengths are indexed; each length, the longest first, consumes
combinations that fill its gap exactly, as often as the counts allow.
What is left is packed best-fit decreasing.  Documents then take the slots of
their length in a fixed order: by a hash, or in the order in which their files
have them, so that the first documents of a mix are in the first sequences that
take their length.

Defined cases: a text without tokens (null, empty) is in no sequence; repeated
rows are packed each; equal documents are ordered arbitrarily among equals.
A text longer than the capacity fills whole sequences and leaves a remainder; a
null doc_id is packed as null; an empty table gives no sequence; other columns
are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import by_place, n_tokens, pick, place, prefix, table

CAPACITY = 2048


class _Index:
    """Sums of one, two or three of the lengths: a length is its own sum, pairs are kept by their sum,
    and a triple is a length beside a pair of its complement.  counts says what is still available."""

    def __init__(self, counts: np.ndarray):
        self.left = counts
        capacity = len(counts) - 1
        lengths = np.flatnonzero(counts)
        i, j = np.tril_indices(len(lengths))
        a, b = lengths[i], lengths[j]  # a >= b
        fit = a + b < capacity
        a, b = a[fit], b[fit]
        by = np.lexsort((-a, a + b))
        self.a, self.b = a[by].astype(np.int32), b[by].astype(np.int32)
        self.start = np.searchsorted(self.a + self.b, np.arange(capacity + 1))

    def _can(self, *lengths: int) -> int:
        """How often this combination can be taken."""
        return min(self.left[n] // m for n, m in Counter(lengths).items())

    def _pairs(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        """Available pairs of that sum, of lengths up to most, the longest first."""
        at = slice(self.start[total], self.start[total + 1])
        a, b = self.a[at], self.b[at]
        good = (a <= most) & (self.left[a] > 0) & (self.left[b] > 0)
        yield from zip(a[good].tolist(), b[good].tolist())

    def fillings(self, gap: int) -> Iterator[tuple[int, ...]]:
        if self.left[gap] > 0:
            yield (gap,)
        yield from self._pairs(gap, gap)
        for a in np.flatnonzero(self.left[: gap - 1])[::-1].tolist():  # a >= b >= c
            if 3 * a >= gap:
                for b, c in self._pairs(gap - a, a):
                    yield a, b, c


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how many sequences have each."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    index, out = _Index(left), []
    for length in range(capacity - 1, 0, -1):
        if not left[length]:
            continue
        for rest in index.fillings(capacity - length):
            if (times := index._can(length, *rest)) > 0:
                for n in (length, *rest):
                    left[n] -= times
                out.append(((length, *rest), int(times)))
            if not left[length]:
                break
    return out + _best_fit({int(n): int(left[n]) for n in np.flatnonzero(left)}, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal items go on filling the tightest sequence, which stays the tightest."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(gaps, length)
            gap = gaps[at] if at < len(gaps) else capacity
            held, times = open_[gap].pop() if at < len(gaps) else ((), left)
            if at < len(gaps) and not open_[gap]:
                del gaps[at]
            each = min(left, gap // length)
            used = min(times, left // each)
            if at < len(gaps) or held:
                if times > used:
                    if not open_[gap]:
                        insort(gaps, gap)
                    open_[gap].append((held, times - used))
            after = gap - each * length
            if not open_[after]:
                insort(gaps, after)
            open_[after].append((held + (length,) * each, used))
            left -= each * used
    return [x for g in sorted(open_) for x in open_[g]]


def _slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length of each combination: the ranks of documents of that length that it takes, and its sequences."""
    taken: Counter[int] = Counter()
    rows, base = [], 0
    for lengths, times in planned:
        slot = 0
        for n, m in sorted(Counter(lengths).items(), reverse=True):
            rows.append((n, taken[n], base, m, slot))
            taken[n] += m * times
            slot += m
        base += times
    rows.sort()
    names = ("length", "rank", "base", "per", "slot")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T))


def _in_order(docs: DataFrame) -> DataFrame | None:
    """doc_id, text and position, which rises along the rows of files written by Spark; None if docs are no files' rows."""
    try:
        file = docs.metadataColumn("_metadata")
        part = F.regexp_extract(file["file_name"], r"part-(\d+)", 1).try_cast("bigint")
        rows = by_place(docs.select("*", F.shiftleft(F.coalesce(part, F.lit(0)), 40) + file["row_index"]))
        rows.schema  # noqa: B018
    except AnalysisException:
        return None
    return rows.select(*(F.col(f"_{place(docs, c)}").alias(c) for c in ("doc_id", "text")), F.col(f"_{len(docs.columns)}").alias("position"))


def pack(docs: DataFrame, *, capacity: int = CAPACITY, in_order: bool = False) -> DataFrame:
    """One row for each sequence: pack_id, doc_ids, pieces (doc_id, start and
    number of tokens), n_tokens, gap.

    in_order: documents take slots in the order in which their files have them, and each sequence has the position of its
    first document in it (null where docs are no files' rows: these are ordered by a hash)."""
    ordered = _in_order(docs) if in_order else None
    given = (pick(docs, "doc_id", "text") if ordered is None else ordered).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    at = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))) if ordered is None else F.col("position")
    lengths = given.select("doc_id", n_tokens(F.col("text")).alias("n"), at.alias("place"))
    lengths = table(lengths.where("n > 0").withColumn("length", F.col("n") % capacity))
    # Ranks within a length are counted in buckets of places (or files), so that a frequent length is no task of its own.
    lengths = lengths.withColumn("bucket", F.substring("place", 1, prefix(lengths.count(), 200_000)) if ordered is None else F.shiftright("place", 40))
    counts = {r["length"]: r["count"] for r in lengths.where("length > 0").groupBy("length").count().collect()}  # capacity - 1 rows at most
    slots = docs.sparkSession.sparkContext.broadcast(_slots(plan(counts, capacity)))  # bounded by the capacity, as the plan is

    kept = ["doc_id", "n", "length", *["place"] * in_order]

    def slot_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        far = np.int64(1) << 40
        keys = s["length"] * far + s["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * far + rank, side="right") - 1
            nth = rank - s["rank"][at]
            pack_id, slot = s["base"][at] + nth // s["per"][at], s["slot"][at] + nth % s["per"][at]
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in kept}, "pack": pa.array(pack_id), "slot": pa.array(slot)})

    starts = lengths.groupBy("length", "bucket").agg(F.count("*").alias("here"))
    starts = starts.select("length", "bucket", (F.sum("here").over(W.partitionBy("length").orderBy("bucket")) - F.col("here")).alias("first"))
    nth = F.row_number().over(W.partitionBy("length", "bucket").orderBy("place", "n")).cast("bigint") - 1
    ranked = lengths.withColumn("nth", nth).join(starts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("nth"))
    if in_order and ordered is None:
        ranked = ranked.withColumn("place", F.lit(None).cast("bigint"))
    parts = ranked.where("length > 0").select(*kept, "rank").mapInArrow(slot_of, "".join(f"{c} bigint, " for c in kept) + "pack bigint, slot bigint")
    piece = F.struct("slot", "doc_id", (F.col("n") - F.col("length")).alias("start"), F.col("length").alias("n_tokens"))
    first = [F.min("place").alias("position")] * in_order
    packed = parts.groupBy("pack").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.sum("length").alias("n_tokens"), *first)
    position = ["position"] * in_order
    packed = packed.select(F.concat(F.lit("rest-"), "pack").alias("pack_id"), F.expr("transform(p, x -> struct(x.doc_id, x.start, x.n_tokens))").alias("pieces"), "n_tokens", *position)
    full = ranked.where(F.col("n") >= capacity).select("doc_id", "length", "rank", *[F.col("place").alias("position")] * in_order, F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"n div {capacity} - 1"))).alias("i"))
    size = F.lit(capacity).cast("bigint")
    full = full.select(F.concat_ws("-", F.lit("full"), "length", "rank", "i").alias("pack_id"), F.array(F.struct("doc_id", (F.col("i") * capacity).alias("start"), size.alias("n_tokens"))).alias("pieces"), size.alias("n_tokens"), *position)
    both = packed.unionByName(full)
    return both.select("pack_id", F.array_distinct(F.col("pieces.doc_id")).alias("doc_ids"), "pieces", "n_tokens", (size - F.col("n_tokens")).alias("gap"), *position)
