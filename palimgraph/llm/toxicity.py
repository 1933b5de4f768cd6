"""Toxicity: a logistic classifier with counterfactual regularisation.

Features are words and word beginnings that occur at least once, twice, three or
five times in a text; those that go with the toxic label are selected by their
log-odds.  In labelled sentences that hold an identity term the term is
swapped for others (where no sentence holds one, terms are added to each text),
and the squared change of the score is penalised, so that a neutral mention of
a group doesn't raise it however often toxic texts mention that group.

The classifier is fitted on a bounded sample: the `sample` labelled documents
with the least hash of doc_id, and all swaps in all their sentences.  It has
the `features` features that go most with the label, which regularises it.
Scoring reads every text whole.

Defined cases: a null or empty text is not toxic (its score is the
intercept's); a label that is null or of an absent document is not used;
repeated labels of a document count once, toxic if any is; of different texts
with one doc_id the least is learnt from; without both labels nothing is
toxic; every row gives one row; features of equal log-odds are taken by name.
Texts of any length are scored whole; a null doc_id stays null; an empty table
gives no rows; other columns are carried along by the filter.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, pick, place

SAMPLE, FEATURES, LEAST_Z, LEVELS, PREFIXES = 6000, 1024, 3.5, (1, 2, 3, 5), (4, 5, 6, 7, 8)
RIDGE, SWAP_WEIGHT, THRESHOLD = 0.1, 10.0, 0.3
IDENTITY_TERMS = tuple(
    "women men woman man black white asian african european american muslim christian jewish hindu buddhist atheist gay lesbian bisexual transgender straight disabled blind deaf elderly young immigrant refugee".split()
    + "frauen männer muslime christen juden schwule einwanderer femmes hommes musulmans chrétiens juifs immigrés mujeres hombres musulmanes cristianos judíos inmigrantes".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def _grams(word: str) -> Iterator[str]:
    yield "=" + word
    for n in PREFIXES:
        if len(word) >= n:
            yield "^" + word[:n]


class Classifier:
    """Weights of (feature, level) pairs.  Swaps of one identity term for another leave the score nearly unchanged."""

    def __init__(self, weights: dict[tuple[str, int], float], bias: float):
        self.bias = bias
        self.names = sorted({g for g, _ in weights})
        at = {g: i for i, g in enumerate(self.names)}
        self.steps: list[list[tuple[int, float]]] = [[] for _ in self.names]
        for (g, level), w in weights.items():
            self.steps[at[g]].append((level, w))
        self._at, self._memo = at, {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}

    def __setstate__(self, state):
        self.__dict__ = state | {"_memo": {}}

    def _hits(self, word: str) -> tuple[int, ...]:
        return tuple(self._at[g] for g in _grams(word) if g in self._at)

    def score(self, text: str | None) -> float:
        memo = self._memo
        if len(memo) > 500_000:
            memo.clear()
        counts: dict[int, int] = {}
        for w in _WORD.findall((text or "").lower()):
            hits = memo.get(w)
            if hits is None:
                hits = memo[w] = self._hits(w)
            for h in hits:
                counts[h] = counts.get(h, 0) + 1
        z = self.bias
        for h, c in counts.items():
            for level, weight in self.steps[h]:
                if c >= level:
                    z += weight
        return float(1 / (1 + np.exp(-max(-500.0, min(500.0, z)))))


def _bags(texts: Iterable[str | None], known: dict[str, int]) -> list[dict[int, int]]:
    """How often each known word or beginning occurs in each text."""
    memo: dict[str, tuple[int, ...]] = {}
    out = []
    for text in texts:
        bag: dict[int, int] = {}
        for w, n in Counter(_WORD.findall((text or "").lower())).items():
            hits = memo.get(w)
            if hits is None:
                hits = memo[w] = tuple(known[g] for g in _grams(w) if g in known)
            for h in hits:
                bag[h] = bag.get(h, 0) + n
        out.append(bag)
    return out


def _select(texts: list[str | None], toxic: np.ndarray, terms: Iterable[str], most: int) -> list[tuple[str, int]]:
    """Features whose presence goes with the label; of features in just the
    same documents the most specific stays; identity terms are always in."""
    often: Counter = Counter()  # only what several toxic documents hold can be selected
    for t, y in zip(texts, toxic):
        if y:
            often.update({g for w in set(_WORD.findall((t or "").lower())) for g in _grams(w)})
    grams = [g for g, n in often.items() if n >= 4]
    docs: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, bag in enumerate(_bags(texts, {g: j for j, g in enumerate(grams)})):
        for j, n in bag.items():
            for level in LEVELS:
                if n >= level:
                    docs[j, level].append(i)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    best: dict[bytes, tuple] = {}
    for (j, level), at in docs.items():
        a = toxic[at].sum()
        b = len(at) - a
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))
        if z >= LEAST_Z:
            key, rank = np.array(at).tobytes(), (grams[j][0] == "=", len(grams[j]), -level)
            if key not in best or rank > best[key][1]:
                best[key] = (float(z), rank, (grams[j], level))
    chosen = [f for _, _, f in sorted(best.values(), key=lambda x: (-x[0], x[2]))[:most]]
    held = set(chosen)
    return chosen + [("=" + t, 1) for t in terms if ("=" + t, 1) not in held]


def swaps(texts: Iterable[str | None], terms: tuple[str, ...]) -> Iterator[tuple[Counter, list[str], list[str]]]:
    """Each swap: the words of a sentence, those that it loses and those that it gets instead.

    Where no sentence has a term, each text gets one, and one of two; the terms take turns."""
    known, made = {t: i for i, t in enumerate(terms)}, 0
    texts = list(texts)
    for text in texts:
        for sentence in _SENTENCE.findall((text or "").lower()):
            words = _WORD.findall(sentence)
            spots = [w for w in words if w in known]
            bag = Counter(words) if spots else None
            for w in spots:
                for step in (1, 5, 11):
                    made += 1
                    yield bag, [w], [terms[(known[w] + step) % len(terms)]]
    if terms and not made:
        for i, text in enumerate(texts):
            bag = Counter(_WORD.findall((text or "").lower()))
            a, b = terms[i % len(terms)], terms[(i * 7 + 3) % len(terms)]
            yield bag, [], [a]
            yield bag + Counter([a]), [a], [b]


def _changes(found: Iterable[tuple[Counter, list[str], list[str]]], names: dict[str, int], column: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The different changes of the features (rows of +1, 0 and -1), how many swaps make each, and how many swaps there are.

    Only features of the words swapped can change, so a swap costs as much as these, whatever the sentence."""
    of: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for f, (j, level) in enumerate(zip(column.tolist(), least.tolist())):
        of[j].append((f, level))
    hits = lambda w: [names[g] for g in _grams(w) if g in names]
    times: Counter = Counter()
    total, bag_of, held = 0, None, Counter()
    for bag, lost, got in found:
        total += 1
        if bag is not bag_of:
            bag_of, held = bag, Counter()
            for w, n in bag.items():
                for j in hits(w):
                    held[j] += n
        move: Counter = Counter()
        for ws, sign in ((lost, -1), (got, 1)):
            for w in ws:
                for j in hits(w):
                    move[j] += sign
        change = tuple((f, int(held[j] + m >= level) - int(held[j] >= level)) for j, m in sorted(move.items()) if m for f, level in of[j] if (held[j] + m >= level) != (held[j] >= level))
        times[change] += 1
    times.pop((), None)
    rows = np.zeros((len(times), len(column)), np.float32)
    for i, change in enumerate(times):
        for f, v in change:
            rows[i, f] = v
    return rows, np.array(list(times.values()), np.float32), total


def objective(w: np.ndarray, x: np.ndarray, toxic: np.ndarray, extra: np.ndarray) -> float:
    """What the weights minimise: the logistic loss, the ridge and the swaps' squared changes (in extra)."""
    z = x @ w
    return float(np.sum(np.logaddexp(0, z) - toxic * z) + 0.5 * w @ extra @ w)


def _design(texts: list[str | None], labels: list[int], terms: tuple[str, ...], swap_weight: float, most: int) -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray, np.ndarray]:
    """Features, their matrix with a column for the intercept, labels, and the quadratic penalty."""
    toxic = np.array(labels, np.float64)
    features = _select(texts, toxic, terms, most)
    names = {g: j for j, g in enumerate(sorted({g for g, _ in features}))}
    column, least = np.array([names[g] for g, _ in features]), np.array([level for _, level in features])
    counts = np.zeros((len(texts), len(names)), np.int32)
    for i, bag in enumerate(_bags(texts, names)):
        for j, n in bag.items():
            counts[i, j] = n
    x = np.c_[(counts[:, column] >= least).astype(np.float32), np.ones(len(texts), np.float32)]
    extra = np.diag(np.r_[np.full(len(features), RIDGE), 1e-3]).astype(np.float64)
    rows, times, total = _changes(swaps(texts, terms), names, column, least)
    if total and swap_weight:
        extra[:-1, :-1] += swap_weight * len(texts) / total * ((rows.T * times) @ rows)
    return features, x, toxic, extra


def train(texts: list[str | None], labels: list[int], *, terms: tuple[str, ...] = IDENTITY_TERMS, swap_weight: float = SWAP_WEIGHT, features: int = FEATURES) -> Classifier | None:
    """None unless both labels occur."""
    if not len(labels) or min(labels) == max(labels):
        return None
    names, x, toxic, extra = _design(texts, labels, terms, swap_weight, features)
    w = np.zeros(len(names) + 1)
    now = objective(w, x, toxic, extra)
    while True:  # Newton, halving steps that don't lower the objective
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - toxic) + extra @ w
        step = np.linalg.solve(((x.T * (p * (1 - p)).astype(np.float32)) @ x).astype(np.float64) + extra, gradient)
        while (after := objective(w - step, x, toxic, extra)) > now and np.abs(step).max() > 1e-6:
            step /= 2
        if not after < now - 1e-9 * abs(now):
            break
        w, now = w - step, after
    return Classifier({f: float(v) for f, v in zip(names, w[:-1]) if v}, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, **options) -> Classifier | None:
    """The classifier of the labelled documents in the sample."""
    order = F.md5(F.col("doc_id").cast("string"))
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(order, "doc_id").limit(sample)  # ids and labels only: the sample's bound is the broadcast's
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])  # the classifier doesn't depend on the order that rows come in
    return train([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows], **options)


def scores(docs: DataFrame, classifier: Classifier | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row: doc_id, score, toxic."""
    held = docs.sparkSession.sparkContext.broadcast(classifier)  # as many weights as features, which are bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            s = np.array([c.score(t) if c else 0.0 for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(s, pa.float64()), "toxic": pa.array(s >= threshold, pa.bool_())})

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, toxic boolean")


def toxic_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents found toxic: doc_id, score, toxic."""
    return scores(docs, fit(docs, labels, **options), threshold=threshold).where("toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows not found toxic, with their own columns."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    at = place(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            keep = [not c or c.score(t) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    plain = by_place(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
