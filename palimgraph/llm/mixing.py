"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's documents, in a seeded order, form a stream of tokens that is
divided into equal blocks; a document belongs to the block in which it starts.
Blocks go to the sources by highest quotients weight / (2 i + 1), as seats do,
and none is repeated.  A source that has run out keeps its stock as its quota,
and seats go on to the others until a budget of tokens is dealt: mix() deals
all by default, so that a small source takes nothing from the large ones.  The
shards have the target weights for as long as no source has run out.  Without
a budget dealing ends at the first seat that a source has no block left for:
the mixture has exactly the target weights, and the scarcest source sets its
size.  Shards take consecutive seats, so their integer quotas add up to the
apportionment of the whole; a seeded permutation of each source's blocks says
which ones fill the quotas.

Defined cases: a null source is a source of its own, named ''; a source of
weight 0, null or without tokens gets no block; documents without tokens go
where their place in the stream is; rows equal in doc_id and text are ordered
arbitrarily, sources of equal quotients by name.
Texts of any length count whole; an empty table gives no rows and no blocks;
columns of other names, also those used inside, are carried along untouched.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import by_place, cut, n_tokens, place, prefix

BLOCK_TOKENS, SHARDS, SEED = 2048, 8, 17


def seats_before(weights: dict[str, float], limit: float, name: str) -> dict[str, int]:
    """How many seats of each source have a quotient above the limit, or equal to it and a lesser name."""
    out = {}
    for s, w in weights.items():
        before = lambda i: (q := w / (2 * i + 1)) > limit or (q == limit and s < name)  # noqa: B023, E731
        n = max(0, int((w / limit - 1) / 2))
        while n > 0 and not before(n - 1):
            n -= 1
        while before(n):
            n += 1
        out[s] = n
    return out


def apportion(weights: dict[str, float], seats: int) -> dict[str, int]:
    """Sainte-Laguë quotas: closed form just short of the total, the rest by highest quotient, ties by name."""
    if not weights:
        return {}
    total = sum(weights.values())
    quotas = {s: max(0, math.floor(seats * w / total) - 1) for s, w in weights.items()}
    # Each seat of these has a higher quotient than the last seat given: no quota is under its share less one.
    heap = [(-w / (2 * quotas[s] + 1), s) for s, w in weights.items()]
    heapq.heapify(heap)
    for _ in range(seats - sum(quotas.values())):
        _, s = heapq.heappop(heap)
        quotas[s] += 1
        heapq.heappush(heap, (-weights[s] / (2 * quotas[s] + 1), s))
    while True:  # a quota that began too high gives its last seat to a higher quotient
        low, s = max((-weights[s] / (2 * q - 1), s) for s, q in quotas.items() if q) if any(quotas.values()) else (0, "")
        if not seats or heap[0] >= (low, s):
            return quotas
        quotas[s] -= 1
        _, t = heapq.heappop(heap)
        quotas[t] += 1
        heap = [(-w / (2 * quotas[x] + 1), x) for x, w in weights.items()]
        heapq.heapify(heap)


def apportion_stock(weights: dict[str, float], stock: dict[str, int], seats: int) -> dict[str, int]:
    """Quotas where no source gets more seats than its stock: those it can't fill go on to the others."""
    full: dict[str, int] = {}
    while True:
        # A source over its stock here stays so when seats of other full sources are added to the rest.
        quotas = apportion({s: w for s, w in weights.items() if s not in full}, seats - sum(full.values()))
        over = {s: stock[s] for s, q in quotas.items() if q > stock[s]}
        if not over:
            return full | quotas
        full |= over


def shard_quotas(weights: dict[str, float], stock: dict[str, int], shards: int, most: float | None = None) -> dict[str, list[int]]:
    """Cumulative quotas of each source after each shard, of so many blocks at most; None: up to the first missing block."""
    weights = {s: float(w) for s, w in weights.items() if w and w > 0 and stock.get(s, 0) > 0}
    if not weights:
        return {}
    if most is not None:
        seats = int(min(most, sum(stock[s] for s in weights)))
        steps = [apportion_stock(weights, stock, seats * (j + 1) // shards) for j in range(shards)]
        return {s: [q[s] for q in steps] for s in weights}
    limit = max(w / (2 * stock[s] + 1) for s, w in weights.items())
    name = min(s for s, w in weights.items() if w / (2 * stock[s] + 1) == limit)
    seats = sum(seats_before(weights, limit, name).values())
    steps = [apportion(weights, seats * (j + 1) // shards) for j in range(shards)]
    return {s: [q[s] for q in steps] for s in weights}


def _permutation(n: int, seed: int) -> tuple[int, int]:
    """a, b: block i is at place (a * i + b) mod n."""
    a = n * 5 // 8 + 1
    while math.gcd(a, n) != 1:
        a += 1
    return a, seed % n


def _streams(docs: DataFrame, seed: int) -> DataFrame:
    """row, source, place (a seeded hash of doc_id and text, so that rows without id are spread as well) and n_tokens."""
    plain = by_place(docs)
    doc_id, source, text = (F.col(f"_{place(docs, c)}") for c in ("doc_id", "source", "text"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    row = F.struct(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
    return plain.select(row.alias("row"), F.coalesce(source, F.lit("")).alias("source"), order.alias("place"), n_tokens(text).alias("n_tokens"))


def assign_blocks(docs: DataFrame, weights: dict[str, float] | None = None, *, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, seed: int = SEED, budget: float | None = None) -> DataFrame:
    """The chosen documents: row (the document's columns), source, n_tokens, block, shard.

    weights: target share of each source; by default the square root of its tokens.
    budget: tokens to deal, in whole blocks, going on past sources that have run out; math.inf for all.
    None ends at the first missing block."""
    return _assigned(docs, weights, block_tokens, shards, seed, budget).drop("place")


def _assigned(docs: DataFrame, weights: dict[str, float] | None, block_tokens: int, shards: int, seed: int, budget: float | None) -> DataFrame:
    spark = docs.sparkSession
    streams = _streams(docs, seed)
    streams = streams.withColumn("bucket", F.substring("place", 1, prefix(docs.count())))
    sums = cut(streams.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")))
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    stock = {s: -(-n // block_tokens) for s, n in totals.items()}
    if weights is None:
        weights = {s: math.sqrt(n) for s, n in totals.items()}
    quotas = shard_quotas({k or "": w for k, w in weights.items()}, stock, shards, budget if budget in (None, math.inf) else budget // block_tokens)
    rows = [(s, stock[s], *_permutation(stock[s], seed), q) for s, q in sorted(quotas.items())]
    plan = spark.createDataFrame(rows, "source string, blocks bigint, a bigint, b bigint, quotas array<bigint>")
    starts = sums.withColumn("start", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).join(plan, "source").drop("n")
    before = F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("place").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = streams.withColumn("before", before).join(starts, ["source", "bucket"])
    block = F.least(F.floor((F.col("start") + F.col("before")) / block_tokens), F.col("blocks") - 1)
    placed = placed.withColumn("block", block.cast("bigint"))
    seat = F.expr("cast((cast(a as decimal(38,0)) * block + b) % blocks as bigint)")
    placed = placed.withColumn("seat", seat).where(F.col("seat") < F.element_at("quotas", -1))
    shard = F.size(F.filter("quotas", lambda q: q <= F.col("seat"))).cast("bigint")
    return placed.select("row", "source", "n_tokens", "block", shard.alias("shard"), "place")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, budget: float | None = math.inf, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The chosen documents, with their own columns, in the order of the mix: shard after shard, in each the blocks of all
    sources in a seeded order.  The order is that of the rows, and of files that are written from them."""
    chosen = _assigned(docs, weights, block_tokens, shards, seed, budget)
    return chosen.orderBy("shard", F.xxhash64(F.lit(seed), "source", "block"), "source", "block", "place").select("row.*")
