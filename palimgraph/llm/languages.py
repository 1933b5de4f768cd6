"""Language identification of multilingual documents (after Lui, Lau and
Baldwin, "Automatic Detection and Language Identification of Multilingual
Documents", 2014): a document is a mixture of languages; expectation
maximisation estimates the proportions from n-gram likelihoods of its words,
and languages are dropped while the penalised likelihood gains by it.

A word's likelihood in a language is that of its character trigrams, between
word marks, interpolated with bigrams and single characters.  Beside the
languages there is 'und', under which any character is as likely; a document
of which it has the largest share has no known language.

The models are fitted on a bounded sample: the `sample` labelled documents of
each language with the least hashes of doc_id and text; repeated rows count as
one.  EM goes on for each document until no share changes by more than TOLERANCE.

Defined cases: a document without letters (null, empty, digits) has language
'und' and no proportions; a null lang is not trained on; without any labelled
document all are 'und'; every row gives one row; of equal shares the language
that is first by name leads ('und' is last), and of equal losses is dropped first.
Texts of any length are read whole; an empty table gives none; other columns are
not looked at, and the filter carries them along.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import by_place, pick, place
from .textvec import chunks

SAMPLE, PENALTY, TOLERANCE = 200, 3.0, 2e-3
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the words with a mark before each and one at the end, and where each word's end."""
    text = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return text, np.flatnonzero(text == 32)[1:]


class Model:
    """Character trigrams of some languages, interpolated with bigrams and
    single characters; a character in 21 bits of an n-gram's code."""

    def __init__(self, texts: dict[str, list[str]], weight: float = 4.0):
        self.languages = sorted(texts)
        self.n, self.weight = len(self.languages), weight
        seen: list[dict[int, np.ndarray]] = [{} for _ in range(3)]
        for j, lang in enumerate(self.languages):
            words = Counter(w for t in texts[lang] for w in _WORD.findall(t.lower()))
            one, two, three, ends = self._grams(list(words))
            times = np.repeat(np.array(list(words.values()), float), np.diff(np.r_[0, ends]))
            for k, g in enumerate((one, two, three)):
                values, inverse = np.unique(g, return_inverse=True)
                for v, c in zip(values.tolist(), np.bincount(inverse, times)):
                    seen[k].setdefault(v, np.zeros(self.n))[j] += c
        tables = [(np.array(sorted(t), np.int64), np.array([t[v] for v in sorted(t)]).reshape(-1, self.n)) for t in seen]
        (g1, c1), (g2, c2), (g3, c3) = tables
        symbols, total = len(g1) + 1, c1.sum(axis=0)
        self.floor = -math.log(2.0 * symbols)  # of a character under 'und'
        self.unseen = np.ones((1, self.n)) / (total + symbols)
        self.one = g1, (c1 + 1) / (total + symbols)
        self.starts = self._starts(g2 >> 21, c2), self._starts(g3 >> 21, c3)
        self.two = g2, (c2 + weight * self._p1(g2 & _CHAR)) / (self._find(self.starts[0], g2 >> 21, 0.0) + weight)
        self.three = g3, (c3 + weight * self._p2(g3 & _PAIR)) / (self._find(self.starts[1], g3 >> 21, 0.0) + weight)

    @staticmethod
    def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        text, ends = _padded(words)
        one = text[1:]
        two = text[:-1] << 21 | one
        before = np.r_[32, text[:-2]]
        before[ends[:-1]] = 32  # nothing of the word before
        return one, two, before << 42 | two, ends

    @staticmethod
    def _starts(context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(context, return_index=True)
        return values, np.add.reduceat(counts, at, axis=0) if len(at) else counts

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], code: np.ndarray, other) -> np.ndarray:
        known, values = table
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return np.where((known[at] == code)[:, None], values[at], other)

    def _p1(self, code: np.ndarray) -> np.ndarray:
        return self._find(self.one, code, self.unseen)

    def _p2(self, code: np.ndarray) -> np.ndarray:
        rest = self.weight * self._p1(code & _CHAR) / (self._find(self.starts[0], code >> 21, 0.0) + self.weight)
        return self._find(self.two, code, rest)

    def words(self, words: list[str]) -> np.ndarray:
        """Relative likelihoods of each word in each language, and under 'und' last: the largest is 1."""
        _, _, grams, ends = self._grams(words)
        used, inverse = np.unique(grams, return_inverse=True)
        rest = self.weight * self._p2(used & _PAIR) / (self._find(self.starts[1], used >> 21, 0.0) + self.weight)
        logs = np.log(self._find(self.three, used, rest))[inverse]
        starts = np.r_[0, ends[:-1]]
        out = np.c_[np.add.reduceat(logs, starts, axis=0), self.floor * np.diff(np.r_[0, ends])]
        return np.exp(np.maximum(out - out.max(axis=1, keepdims=True), -80)).astype(np.float32)


_CHAR, _PAIR = (1 << 21) - 1, (1 << 42) - 1


def _expect(p: np.ndarray, times: np.ndarray, share: np.ndarray, sizes: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """EM from these shares of each document (languages x documents), until none changes by more than the tolerance; log-likelihoods.

    p: of different words (languages x words), which occur so many times; sizes: different words of each document."""
    share, likelihood = share.astype(np.float32), np.zeros(len(sizes))
    docs = np.arange(len(sizes))  # not yet converged; their words are p, times, doc
    while True:
        doc, starts = np.repeat(np.arange(len(docs)), sizes), np.r_[0, np.cumsum(sizes)[:-1]]
        total = np.add.reduceat(times, starts)
        moving = np.ones(len(docs), bool)
        used = [j for j in range(len(p)) if share[j, docs].any()]
        while moving.mean() > 0.6:
            mixed = np.full(p.shape[1], 1e-38, np.float32)
            for j in used:
                mixed += p[j] * share[j, docs][doc]
            likelihood[docs[moving]] = np.add.reduceat(times * np.log(mixed), starts)[moving]
            weight = times / mixed
            change = np.zeros(len(docs), np.float32)
            for j in used:
                after = share[j, docs] * np.add.reduceat(p[j] * weight, starts) / total
                change = np.maximum(change, np.abs(after - share[j, docs]))
                share[j, docs[moving]] = after[moving]
            moving &= change > tolerance
        if not moving.any():
            return share, likelihood
        words = moving[doc]
        docs, sizes, p, times = docs[moving], sizes[moving], p[:, words], times[words]


def infer(p: np.ndarray, times: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY, tolerance: float = TOLERANCE) -> np.ndarray:
    """Shares of the languages in each document (documents x languages), 0 where not selected; arguments as in _expect.

    Languages are dropped, each time the one that is missed least, while that loses less likelihood than the penalty of a language."""
    n, (starts, docs) = len(p), (np.r_[0, np.cumsum(sizes)[:-1]], np.arange(len(sizes)))
    share, best = _expect(p, times, np.full((n, len(sizes)), 1 / n), sizes, tolerance)
    gain = penalty * 0.5 * np.log(np.add.reduceat(times, starts) + 1.0)
    top = share.argmax(axis=0)
    alone = np.add.reduceat(times * np.log(np.maximum(p[np.repeat(top, sizes), np.arange(p.shape[1])], 1e-38)), starts)
    # If all the others together lose less than one penalty, no order of dropping them stops.
    single = alone + gain >= best
    share[:, single] = 0
    share[top[single], docs[single]] = 1
    active = docs[~single]
    while len(active):  # of each document's languages the one goes whose loss is least, if it is under a penalty
        most, after = np.full(len(active), -np.inf), share[:, active].copy()
        for j in range(n):
            with_j = np.flatnonzero(share[j, active] > 0)
            trial = share[:, active[with_j]].copy()
            trial[j] = 0
            left = trial.sum(axis=0) > 0
            with_j, trial = with_j[left], trial[:, left]
            if not len(with_j):
                continue
            d = active[with_j]
            words = np.concatenate([np.arange(starts[x], starts[x] + sizes[x]) for x in d])
            trial, ll = _expect(p[:, words], times[words], trial / trial.sum(axis=0), sizes[d], tolerance)
            better = ll > most[with_j]
            most[with_j[better]], after[:, with_j[better]] = ll[better], trial[:, better]
        gone = most + gain[active] >= best[active]
        active, after, most = active[gone], after[:, gone], most[gone]
        share[:, active], best[active] = after, most
        active = active[(after > 0).sum(axis=0) > 1]
    return share.T.astype(np.float64)


def fit(docs: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """Models of the languages in lang, from a bounded sample; None without labelled rows."""
    named = pick(docs, "doc_id", "lang", "text").where("lang is not null and text is not null")
    named = named.select("lang", "text", F.struct(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.xxhash64("text").alias("t")).alias("at"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("at"))
    limits = named.select("lang", "at").withColumn("n", nth).where(F.col("n") <= sample).groupBy("lang").agg(F.max("at").alias("most"))
    # A row for each language; rows of equal hashes are repeats of one, so no more than the sample comes to the driver.
    chosen = named.join(F.broadcast(limits), "lang").where("at <= most").groupBy("lang", "at").agg(F.min("text").alias("text"))
    texts: dict[str, list[str]] = defaultdict(list)
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["at"])):
        texts[r["lang"]].append(r["text"])
    return Model(texts) if texts else None


def identify(docs: DataFrame, model: Model | None = None, *, sample: int = SAMPLE, penalty: float = PENALTY) -> DataFrame:
    """One row for each row: doc_id, language (the largest share), languages
    and proportions (largest first), n_words, known (language is not 'und')."""
    return _identify(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model or fit(docs, sample=sample), penalty, ["doc_id"])


def keep_known(docs: DataFrame, *, sample: int = SAMPLE, penalty: float = PENALTY) -> DataFrame:
    """The rows whose language is known, with their own columns."""
    return _filter(docs, fit(docs, sample=sample), penalty)


def _shares(texts: list[str | None], model: Model, memo: dict[str, int], known: list[np.ndarray], penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages in each text, and how many words it has.  memo: where a word's likelihoods are in known[0]."""
    index, times, sizes, totals, new = [], [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        bag = Counter(_WORD.findall((t or "").lower()))
        sizes[i], totals[i] = len(bag), bag.total()
        for w in bag:
            at = memo.get(w)
            if at is None:
                at = memo[w] = len(memo)
                new.append(w)
            index.append(at)
        times += bag.values()
    if new:
        fresh = len(memo)
        if fresh > len(known[0]):
            known[0] = np.r_[known[0], np.empty((max(fresh, len(known[0])), model.n + 1), np.float32)]
        known[0][fresh - len(new) : fresh] = model.words(new)
    shares, full = np.zeros((len(texts), model.n + 1)), sizes > 0
    if full.any():
        p = np.ascontiguousarray(known[0][np.array(index)].T)
        shares[full] = infer(p, np.array(times, np.float32), sizes[full], penalty)
    return shares, totals


def _over(model: Model | None, penalty: float):
    """A function from texts to shares and word counts, with a memory of words that is emptied at a bound."""
    memo: dict[str, int] = {}
    known = [np.zeros((0, model.n + 1 if model else 1), np.float32)]

    def run(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if model is None:
            return np.ones((len(texts), 1)), np.array([len(_WORD.findall((t or "").lower())) for t in texts])
        if len(memo) > 500_000:
            memo.clear()
        return _shares(texts, model, memo, known, penalty)

    return run


def _identify(docs: DataFrame, model: Model | None, penalty: float, keys: list[str]) -> DataFrame:
    names = np.array([*(model.languages if model else []), UNKNOWN], dtype=object)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = _over(held.value, penalty)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                shares, sizes = over(texts[a:b])
                order = np.argsort(-shares, axis=1, kind="stable")
                langs, parts, top = [], [], []
                for s, o, n in zip(shares, order, sizes):
                    chosen = [j for j in o if s[j] > 0] if n else []
                    langs.append([names[j] for j in chosen])
                    parts.append([float(s[j]) for j in chosen])
                    top.append(names[chosen[0]] if chosen else UNKNOWN)
                yield pa.RecordBatch.from_pydict({
                    **{k: batch.column(k).slice(a, b - a) for k in keys},
                    "language": pa.array(top, pa.string()), "languages": pa.array(langs, pa.list_(pa.string())),
                    "proportions": pa.array(parts, pa.list_(pa.float64())), "n_words": pa.array(sizes, pa.int64()),
                    "known": pa.array([t != UNKNOWN for t in top], pa.bool_()),
                })

    return docs.mapInArrow(run, ", ".join(f"{k} bigint" for k in keys) + ", language string, languages array<string>, proportions array<double>, n_words bigint, known boolean")


def _filter(docs: DataFrame, model: Model | None, penalty: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = place(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = _over(held.value, penalty)
        for batch in batches:
            texts, known = batch.column(at).to_pylist(), []
            for a, b in chunks(texts):
                shares, sizes = over(texts[a:b])
                known += list((sizes > 0) & (shares.argmax(axis=1) < shares.shape[1] - 1))
            yield batch.filter(pa.array(known, pa.bool_()))

    plain = by_place(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
