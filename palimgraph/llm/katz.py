"""Language-model scoring with a Katz backoff model of word bigrams.

Tokens are runs of ASCII letters, digits and bytes of other characters, each
other character that is not white space, and an end mark.  A token is known by
a 31-bit hash, so the vocabulary is closed (2**31) without being trained or
sent anywhere; words of equal hash count as one.  Counts are of all documents,
and what is gathered grows with the corpus, as its words and bigrams do.

Good-Turing discounts apply to counts up to 5, at both orders; backoff weights
make each context's probabilities sum to one exactly.  The model is a table of
token counts, and tables of bigram counts and context weights partitioned by
context.  A token's probability is that of its bigram if that was counted, else
the context's weight times the token's own, which backs off to 1 / 2**31.

There is one plan for all sizes, without sending a table to the executors.
Documents are taken in batches; a batch sends each bigram once to the bigram's
part, with the documents that hold it, and the part sends back sums.  Parts are
as many as the corpus' tokens ask for.  A context of over a quarter of a part's
tokens is hot: its bigrams are dealt by both tokens, and only its sums (for at
most 4 contexts a part) are brought together.

Defined cases: a text without tokens (null, empty, white space) is not counted
and has a null score; repeated rows count as often as they occur, and each has
a row; where counts of counts give no discount between 0 and 1, (r - 1/2) / r
is used; a context whose counts are all above 5 leaves 1 / (its count + 1) for
unseen tokens.  Texts of any length are counted and scored whole; the model of
an empty table is empty, and under it a token has 1 / 2**31; an empty table
has no scores; other columns are not looked at.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import pick, table
from .packed import pack, steps, unpack

CUT, BITS = 5, 31
TOKENS, BEGIN, END = 1 << BITS, 0, 1
#: Characters of a batch, tokens of a part.
BATCH, PART = 16_000_000, 2_000_000
_LOW = np.int64(TOKENS - 1)
_CLASS = np.ones(256, np.uint8)  # 0: white space, 1: a token by itself, 2: of a run
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and how many each text has."""
    found = [_tokens(texts[a:b]) for a, b in textvec.chunks(texts)]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    kind = _CLASS[data]
    run = kind == 2
    edge = run[1:] & run[:-1]
    first = kind > 0
    last = first.copy()
    first[1:] &= ~edge
    last[:-1] &= ~edge
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = (textvec.run_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.where(hashes <= END, hashes + 2, hashes), np.diff(np.searchsorted(starts, at))


def _lean() -> None:
    """A batch's arrays go back to the system when they are freed; those of a chunk's size are used again.  By default glibc
    comes to keep all of up to 32 MB for itself."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 12 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):
        pass  # another C library


def bigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(context << 31 | token) for each token and the end of each text with tokens; how many each text has."""
    found = [_bigrams(texts[a:b]) for a, b in textvec.chunks(texts)]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _bigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    found, n = _tokens(texts)
    sizes = np.where(n > 0, n + 1, 0)
    stops = np.cumsum(sizes)[n > 0]
    word = np.full(int(sizes.sum()), END, np.int64)
    inner = np.ones(len(word), bool)
    inner[stops - 1] = False
    word[inner] = found
    context = np.r_[BEGIN, word[:-1]][: len(word)]
    context[np.r_[0, stops[:-1]][: len(stops)]] = BEGIN
    return context << np.int64(BITS) | word, sizes


def _tally(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(values, kind="stable")
    values, times = values[by], times[by]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    return values[starts], np.add.reduceat(times, starts) if len(starts) else times


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of about so many characters."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = min(len(sizes), int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most)) + 1)
        yield at, to
        at = to


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, ascending, and how often each occurs; the values are sorted in place."""
    values.sort()
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    return values[starts], np.diff(np.r_[starts, len(values)])


def _batches(given: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Rows, some BATCH characters at a time (a longer text is a batch's last)."""
    _lean()
    ids, texts, held = [], [], 0
    for batch in given:
        column = batch.column("text")
        sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
        for a, b in _runs(sizes, BATCH // 8):
            ids.append(batch.column("doc_id").slice(a, b - a))
            texts += column.slice(a, b - a).to_pylist()
            held += int(sizes[a:b].sum())
            if held >= BATCH:
                yield pa.concat_arrays(ids), texts
                ids, texts, held = [], [], 0
    if texts:
        yield pa.concat_arrays(ids), texts


def discounts(counts_of_counts: dict[int, int], cut: int = CUT) -> list[float]:
    """Factors for counts 1 to cut, by Good-Turing in Katz's form.

    Counts of counts by which a token seen more often would count for less (as when much of a corpus occurs just twice)
    are smoothed by a straight line through their logarithms, as in simple Good-Turing."""
    n = [0.0, *(float(counts_of_counts.get(r, 0)) for r in range(1, cut + 2))]
    out = _good_turing(n, cut)
    seen = [r for r in range(1, cut + 2) if n[r]]
    if len(seen) > 1 and any(d is None or r * d >= (r + 1) * e for r, (d, e) in enumerate(zip(out, [x or 0.0 for x in out[1:]] + [1.0]), 1)):
        slope, level = np.polyfit(np.log(seen), np.log([n[r] for r in seen]), 1)
        out = _good_turing([0.0, *np.exp(level + slope * np.log(np.arange(1, cut + 2)))], cut)
    return [(r - 0.5) / r if d is None else float(d) for r, d in enumerate(out, 1)]


def _good_turing(n: list[float], cut: int) -> list[float | None]:
    common = (cut + 1) * n[cut + 1] / n[1] if n[1] else 1.0
    found = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0 for r in range(1, cut + 1)]
    return [d if 0 < d < 1 else None for d in found]


def _mass(n: np.ndarray, factors: list[float]) -> np.ndarray:
    """Discounted counts."""
    return n * np.array([1.0, *factors, 1.0])[np.minimum(n, CUT + 1)]


def _weights(total, kept, covered, least) -> tuple[np.ndarray, np.ndarray]:
    """The share of a context's mass that its seen tokens get, over their discounted counts; the log weight of the others."""
    left = np.where(least > CUT, 1.0 / (total + 1.0), (total - kept) / total)
    return (1 - left) / kept, np.log(left) - np.log1p(-covered)


@dataclass
class Unigrams:
    """The numbers that turn a token's count into its probability."""

    factors: list[float]
    scale: float = 0.0
    rest: float = 0.0  # log weight of unseen tokens

    def log_probability(self, n: np.ndarray) -> np.ndarray:
        """n: the tokens' counts, 0 of unseen ones."""
        with np.errstate(divide="ignore"):
            return np.where(n > 0, np.log(_mass(n, self.factors) * self.scale), self.rest - np.log(TOKENS))


@dataclass
class Model:
    """words: (token, n); counts: (part, blob of bigrams and counts); contexts: (part, blob of contexts, scales and weights);
    hot: contexts that are dealt to several parts, to how many, their scales and weights; at most 4 for each part."""

    words: DataFrame
    counts: DataFrame
    contexts: DataFrame
    parts: int
    unigrams: Unigrams
    factors: list[float]
    hot: dict[str, np.ndarray] = field(default_factory=dict)


def _part(code: np.ndarray, parts: int, hot: dict[str, np.ndarray]) -> np.ndarray:
    """A context's part; of a hot context the next ones too, as many as its tokens ask for."""
    context = code >> np.int64(BITS)
    h = textvec.mix64(context.astype(np.uint64)) >> np.uint64(20)
    at, is_hot = _at(hot["context"], context)
    h[is_hot] += (textvec.mix64(code[is_hot].astype(np.uint64)) >> np.uint64(20)) % hot["spread"][at[is_hot]].astype(np.uint64)
    return (h % np.uint64(parts)).astype(np.int64)


def _dealt(code: np.ndarray, parts: int, hot: dict[str, np.ndarray]) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Each part with where its codes are in the order that is given too; codes keep their order within a part."""
    part = _part(code, parts, hot)
    by = np.argsort(part, kind="stable")
    stops = np.cumsum(np.bincount(part, minlength=parts))
    for p in np.flatnonzero(np.diff(np.r_[0, stops])):
        yield int(p), slice(int(stops[p - 1]) if p else 0, int(stops[p])), by


def _slim(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def fit(docs: DataFrame, *, part_tokens: int = PART) -> Model:
    """The model of all documents, its tables in the shared folder."""
    spark, given = docs.sparkSession, _slim(docs)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _batches(batches):
            token, n = _counted(bigrams(texts)[0] & _LOW)
            yield pa.RecordBatch.from_pydict({"token": pa.array(token, pa.int64()), "n": pa.array(n, pa.int64())})

    known = table(given.mapInArrow(words, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")))
    of = [F.count_if(F.col("n") == r).alias(f"r{r}") for r in range(1, CUT + 2)]
    s = known.agg(F.sum("n").alias("total"), F.count("*").alias("seen"), F.min("n").alias("least"), F.sum(F.when(F.col("n") > CUT, F.col("n"))).alias("many"), *of).first()
    total = s["total"] or 0
    unigrams = Unigrams(discounts({r: s[f"r{r}"] for r in range(1, CUT + 2)}))
    if total:
        kept = (s["many"] or 0) + sum(_mass(np.array([r]), unigrams.factors)[0] * s[f"r{r}"] for r in range(1, CUT + 1))
        scale, rest = _weights(np.float64(total), np.float64(kept), np.float64(s["seen"] / TOKENS), s["least"])
        unigrams.scale, unigrams.rest = float(scale), float(rest)
    parts = max(1, -(-total // part_tokens))
    # Their counts add up to the total at most, so there are at most 4 a part, and they are dealt to 8 times as many parts as there are
    # at most, each time counted.  The begin mark is as frequent as the end mark, which is no context.
    often = known.where(F.col("n") * 4 > part_tokens).collect() if parts > 1 else []
    often = sorted((BEGIN if r["token"] == END else r["token"], min(parts, -(-4 * r["n"] // part_tokens))) for r in often)
    hot = {"context": np.array([c for c, _ in often], np.int64), "spread": np.array([n for _, n in often], np.int64)}
    sent = spark.sparkContext.broadcast(hot)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _batches(batches):
            code, n = _counted(bigrams(texts)[0])
            yield from _rows((p, 0, 0, pack(steps(code[by[at]]), n[by[at]])) for p, at, by in _dealt(code, parts, sent.value))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, part = 0, 0
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
                step, n = unpack(raw)
                held.append((np.cumsum(step), n))
                rows += len(n)
                if rows > 4 * part_tokens:
                    held = [_tally(*(np.concatenate(x) for x in zip(*held)))]
                    rows = len(held[0][0])
        if held:
            code, n = _tally(*(np.concatenate(x) for x in zip(*held)))
            yield from _rows([(part, 0, 0, pack(steps(code), n))])

    counts = table(given.mapInArrow(encode, _ROW).repartitionById(parts, F.col("part")).mapInArrow(merge, _ROW))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("blob").to_pylist():
                n = np.bincount(np.minimum(unpack(raw)[1], CUT + 2), minlength=CUT + 3)
                yield pa.RecordBatch.from_pydict({"r": pa.array(range(CUT + 3), pa.int64()), "times": pa.array(n, pa.int64())})

    factors = discounts({r["r"]: r["times"] for r in counts.mapInArrow(frequencies, "r bigint, times bigint").groupBy("r").agg(F.sum("times").alias("times")).collect()})

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
                token = np.unique(np.cumsum(unpack(raw)[0]) & _LOW)
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(token), part), pa.int32()), "token": pa.array(token)})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of the part's contexts, and rows of its sums of hot contexts."""
        _lean()
        blob, part, keys, values = None, 0, [], []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            for i in np.flatnonzero(kind == 0):
                blob, part = batch.column("blob")[int(i)].as_py(), batch.column("part")[int(i)].as_py()
            keys.append(batch.column("batch").to_numpy()[kind == 1])
            values.append(batch.column("n").to_numpy(zero_copy_only=False)[kind == 1])
        if blob is None:
            return
        token, times = np.concatenate(keys), np.concatenate(values)
        by = np.argsort(token)
        token, below = token[by], np.exp(unigrams.log_probability(times[by].astype(np.int64)))
        step, n = unpack(blob)
        code = np.cumsum(step)
        below = below[np.searchsorted(token, code & _LOW)]
        context = code >> np.int64(BITS)
        starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        context = context[starts]
        total, least = np.add.reduceat(n, starts), np.minimum.reduceat(n, starts)
        kept, covered = np.add.reduceat(_mass(n, factors), starts), np.add.reduceat(below, starts)
        apart = np.isin(context, sent.value["context"])
        own = ~apart
        scale, weight = _weights(total[own].astype(float), kept[own], covered[own], least[own])
        yield from _rows([(part, 0, 0, pack(steps(context[own]), scale, weight))])
        yield from _rows((part, 1, int(c), pack(np.array([t, m], np.int64), np.array([k, x]))) for c, t, m, k, x in zip(context[apart], total[apart], least[apart], kept[apart], covered[apart]))

    wanted = counts.mapInArrow(asked, "part int, token bigint").join(known, "token")
    both = counts.select("part", "kind", "batch", "blob", F.lit(0).cast("bigint").alias("n")).unionByName(wanted.select("part", F.lit(1).alias("kind"), F.col("token").alias("batch"), F.lit(None).cast("binary").alias("blob"), "n"))
    weighed = table(both.repartitionById(parts, F.col("part")).mapInArrow(weigh, _ROW))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*ints, *floats.view(np.float64)) for ints, floats in map(unpack, batch.column("blob").to_pylist())]
            names = ("total", "least", "kept", "covered")
            yield pa.RecordBatch.from_pydict({"context": batch.column("batch"), **{c: pa.array([float(r[j]) for r in rows]) for j, c in enumerate(names)}})

    sums = weighed.where("kind = 1").mapInArrow(apart, "context bigint, total double, least double, kept double, covered double")
    sums = sums.groupBy("context").agg(F.sum("total").alias("total"), F.min("least").alias("least"), F.sum("kept").alias("kept"), F.sum("covered").alias("covered"))
    found = {r["context"]: r for r in sums.collect()}  # hot contexts
    total, least, kept, covered = (np.array([found[c][x] for c in hot["context"].tolist()], float) for x in ("total", "least", "kept", "covered"))
    scale, weight = _weights(total, kept, covered, least)
    return Model(known, counts, weighed.where("kind = 0"), parts, unigrams, factors, hot | {"scale": scale, "weight": weight})


_ROW = "part int, kind int, batch bigint, blob binary"


def _rows(rows) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the rows (part, kind, batch, blob), some MB each."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3] or b"")
        if size > 8_000_000 or len(held) == 5000:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, batch, blob = zip(*rows)
    return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "kind": pa.array(kind, pa.int32()), "batch": pa.array(batch, pa.int64()), "blob": pa.array(blob, pa.binary())})


class Part:
    """Bigrams and contexts of a part, in memory."""

    def __init__(self, counts: bytes | None, contexts: bytes | None, factors: list[float], hot: dict[str, np.ndarray]):
        step, self.n = unpack(counts) if counts else (np.zeros(0, np.int64),) * 2
        self.code = np.cumsum(step)
        step, scale, weight = unpack(contexts) if contexts else (np.zeros(0, np.int64),) * 3
        context = np.r_[np.cumsum(step), hot["context"]]
        by = np.argsort(context)
        self.context = context[by]
        self.scale, self.weight = np.r_[scale.view(np.float64), hot["scale"]][by], np.r_[weight.view(np.float64), hot["weight"]][by]
        self.factors = factors

    def look_up(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each bigram was counted, and its log-probability if it was, else its context's log weight (0 of an unseen context)."""
        context = code >> np.int64(BITS)
        at, known = _at(self.context, context)
        scale, weight = (np.where(known, x[at] if len(x) else 0.0, 0.0) for x in (self.scale, self.weight))
        where, found = _at(self.code, code)
        value = weight
        value[found] = np.log(_mass(self.n[where[found]], self.factors) * scale[found])
        return found, value


def _at(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row: doc_id, n_tokens, log_prob (natural), bits_per_token."""
    parts, unigrams, factors = model.parts, model.unigrams, model.factors
    sent = docs.sparkSession.sparkContext.broadcast(model.hot)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch: a row of its documents (kind 3), and for each part one of bigrams and which documents hold them how often (kind 2)."""
        task = TaskContext.get().partitionId()
        for i, (ids, texts) in enumerate(_batches(batches)):
            name = task << 32 | i  # the same if the task runs again
            code, sizes = bigrams(texts)
            doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
            by = np.argsort(code, kind="stable")
            code, doc = code[by], doc[by]  # by code, then document
            del by
            starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])][: len(code)])
            times = np.diff(np.r_[starts, len(code)])
            code, doc = code[starts], doc[starts]
            dealt = _dealt(code, parts, sent.value)

            def one(at: slice, by: np.ndarray) -> bytes:
                c = code[by[at]]
                first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                return pack(steps(c[first]), np.diff(np.r_[first, len(c)]), doc[by[at]], times[by[at]])

            null = np.array(ids.is_null())
            yield from _rows([(name % parts, 3, name, pack(ids.fill_null(0).to_numpy().view(np.uint64), null, sizes))])
            yield from _rows((p, 2, name, one(at, by)) for p, at, by in dealt)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each document's log-probabilities (kind 2), and what its unseen bigrams leave to single tokens."""
        _lean()
        blobs: list[bytes | None] = [None, None]
        part = None
        for batch in batches:
            for kind, name, raw in zip(*(batch.column(c).to_pylist() for c in ("kind", "batch", "blob"))):
                if kind < 2:
                    blobs[kind] = raw
                    continue
                if kind == 3:
                    yield _sums(name, 3, raw)
                    continue
                part = part or Part(*blobs, factors, sent.value)
                step, per, doc, times = unpack(raw)
                code = np.cumsum(step)
                found, value = part.look_up(code)
                docs, at = np.unique(doc, return_inverse=True)
                yield _sums(name, 2, pack(steps(docs), np.bincount(at, np.repeat(value, per) * times, len(docs))))
                unseen = np.flatnonzero(np.repeat(~found, per))
                for a in range(0, len(unseen), 100_000):
                    u = unseen[a : a + 100_000]
                    yield _sums(name, 4, None, doc[u], np.repeat(code & _LOW, per)[u], times[u])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come batch by batch, a batch's documents first."""
        at, ids, null, sizes, sums = None, None, None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "n_tokens": pa.array(sizes), "log_prob": pa.array(sums, pa.float64(), mask=sizes == 0)})

        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            for i, (kind, name, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "batch", "blob")))):
                if kind == 3:
                    if at is not None:
                        yield out()
                    at, (ids, null, sizes) = name, unpack(raw)
                    sums = np.zeros(len(sizes))
                elif kind == 2:
                    step, values = unpack(raw)
                    sums[np.cumsum(step)] += values.view(np.float64)
                else:
                    sums[int(doc[i])] += n[i]
        if at is not None:
            yield out()

    mine = lambda df, kind: df.select("part", F.lit(kind).alias("kind"), "batch", "blob")
    rows = mine(model.counts, 0).unionByName(mine(model.contexts, 1)).unionByName(_slim(docs).mapInArrow(encode, _ROW))
    placed = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("kind")
    looked = table(placed.mapInArrow(look_up, "batch bigint, kind int, blob binary, doc bigint, token bigint, n double"))
    # A token by itself: its count gives its probability, without a table of probabilities.
    asked = looked.where("kind = 4").join(model.words.withColumnRenamed("n", "times"), "token", "left")
    n = F.coalesce(F.col("times"), F.lit(0))
    factor = F.lit(1.0)
    for r, d in enumerate(unigrams.factors, 1):
        factor = F.when(n == r, d).otherwise(factor)
    mass = n * factor
    single = F.when(n > 0, F.log(mass * F.lit(unigrams.scale))).otherwise(F.lit(unigrams.rest - float(np.log(TOKENS))))
    backed = asked.groupBy("batch", "doc").agg(F.sum(F.col("n") * single).alias("n"))
    sums = looked.where("kind < 4").select("batch", F.when(F.col("kind") == 3, 0).otherwise(1).alias("order"), "kind", "blob", "doc", "n")
    sums = sums.unionByName(backed.select("batch", F.lit(2).alias("order"), F.lit(4).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc", "n"))
    whole = sums.repartition("batch").sortWithinPartitions("batch", "order").mapInArrow(gather, "doc_id bigint, n_tokens bigint, log_prob double")
    return whole.withColumn("bits_per_token", -F.col("log_prob") / F.col("n_tokens") / F.lit(float(np.log(2))))


def _sums(name: int, kind: int, blob: bytes | None, doc=None, token=None, n=None) -> pa.RecordBatch:
    rows = 1 if doc is None else len(doc)
    given = lambda x, t: pa.nulls(rows, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_pydict({
        "batch": pa.array(np.full(rows, name), pa.int64()), "kind": pa.array(np.full(rows, kind), pa.int32()), "blob": pa.array([blob] * rows, pa.binary()),
        "doc": given(doc, pa.int64()), "token": given(token, pa.int64()), "n": given(None if n is None else n.astype(float), pa.float64()),
    })


def save(model: Model, folder: str) -> None:
    """The model's tables, partitioned, and its numbers, in a folder."""
    spark = model.words.sparkSession
    model.words.write.parquet(f"{folder}/words")
    model.counts.repartitionById(model.parts, F.col("part")).write.partitionBy("part").parquet(f"{folder}/counts")
    model.contexts.repartitionById(model.parts, F.col("part")).write.partitionBy("part").parquet(f"{folder}/contexts")
    u, hot = model.unigrams, model.hot
    row = (model.parts, u.factors, u.scale, u.rest, model.factors, *(hot[x].tolist() for x in ("context", "spread", "scale", "weight")))
    schema = "parts bigint, unigram_factors array<double>, scale double, rest double, factors array<double>, context array<bigint>, spread array<bigint>, hot_scale array<double>, hot_weight array<double>"
    spark.createDataFrame([row], schema).write.parquet(f"{folder}/numbers")


def load(spark: SparkSession, folder: str) -> Model:
    r = spark.read.parquet(f"{folder}/numbers").first()
    rows = lambda name: spark.read.schema(_ROW).parquet(f"{folder}/{name}").select("part", "kind", "batch", "blob")
    hot = {"context": np.array(r["context"], np.int64), "spread": np.array(r["spread"], np.int64), "scale": np.array(r["hot_scale"], float), "weight": np.array(r["hot_weight"], float)}
    return Model(spark.read.parquet(f"{folder}/words"), rows("counts"), rows("contexts"), r["parts"], Unigrams(list(r["unigram_factors"]), r["scale"], r["rest"]), list(r["factors"]), hot)


def fit_and_score(docs: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, **options))
