"""The operators against plain versions of themselves."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import fixtures as fx
import numpy as np
import pytest

from palimgraph.llm import fingerprints, hnsw, katz, languages, licences, mixing, near_dups, packed, packing, queries, reply_trees, setjoin, textvec, toxicity
from palimgraph.llm.common import read


# -- 1 mixing


def seats_one_by_one(weights, seats):
    given = dict.fromkeys(weights, 0)
    for _ in range(seats):
        s = min(weights, key=lambda s: (-Fraction(weights[s]) / (2 * given[s] + 1), s))
        given[s] += 1
    return given


def test_apportionment_gives_seats_by_highest_quotient():
    rng = random.Random(1)
    for _ in range(60):
        weights = {f"s{i}": float(rng.choice([1, 2, 3, 7, 50, 1000])) for i in range(rng.randint(1, 7))}
        seats = rng.randint(0, 80)
        assert mixing.apportion(weights, seats) == seats_one_by_one(weights, seats)


def test_mixture_has_target_weights(spark):
    rows = [(i, "w " * 50, "en", "abc"[i % 3 if i % 2 else 0], 100) for i in range(3000)]
    got = mixing.assign_blocks(fx.docs(spark, rows), {"a": 3, "b": 2, "c": 1}, block_tokens=500, shards=4).collect()
    blocks = defaultdict(set)
    for r in got:
        blocks[r.source].add(r.block)
    counts = {s: len(b) for s, b in blocks.items()}
    total = sum(counts.values())
    assert counts == seats_one_by_one({"a": 3.0, "b": 2.0, "c": 1.0}, total)
    per_shard = [Counter(s for s, b in {(r.source, r.block) for r in got if r.shard == j}) for j in range(4)]
    assert max(sum(c.values()) for c in per_shard) - min(sum(c.values()) for c in per_shard) <= 1
    assert len({(r.row.doc_id) for r in got}) == len(got)


def stocked_seats_one_by_one(weights, stock, seats):
    given = dict.fromkeys(weights, 0)
    for _ in range(seats):
        s = min((s for s in weights if given[s] < stock[s]), key=lambda s: (-Fraction(weights[s]) / (2 * given[s] + 1), s))
        given[s] += 1
    return given


def test_sources_that_run_out_leave_seats_to_the_others():
    rng = random.Random(11)
    for _ in range(60):
        weights = {f"s{i}": float(rng.choice([1, 2, 3, 7, 50])) for i in range(rng.randint(1, 6))}
        stock = {s: rng.choice([1, 2, 9, 40]) for s in weights}
        most, total = rng.randint(1, 150), sum(stock.values())
        got = mixing.shard_quotas(weights, stock, 4, most)
        for j in range(4):
            assert {s: q[j] for s, q in got.items()} == stocked_seats_one_by_one(weights, stock, min(most, total) * (j + 1) // 4)
        assert {s: q[-1] for s, q in mixing.shard_quotas(weights, stock, 4, math.inf).items()} == stock


def test_a_tiny_source_takes_nothing_from_large_ones(spark):
    rows = [(i, "w " * 50, "en", "ab"[i % 2], 100) for i in range(2000)] + [(2000, "w " * 50, "en", None, 100)]
    d = fx.docs(spark, rows)
    assert mixing.mix(d, block_tokens=500).count() == 2001
    some = mixing.assign_blocks(d, {"a": 2, "b": 1, "": 5}, block_tokens=500, budget=60 * 500).collect()
    blocks = Counter(s for s, _ in {(r.source, r.block) for r in some})
    assert blocks == stocked_seats_one_by_one({"a": 2.0, "b": 1.0, "": 5.0}, {"a": 100, "b": 100, "": 1}, 60)
    assert mixing.mix(d, {"a": 1.0}, block_tokens=500).count() == 1000


# -- 2 languages


def slow_shares(p, times, start, tolerance):
    """Plain EM on one document, and its log-likelihood."""
    share = np.array(start, float)
    while True:
        post = share[:, None] * p
        after = (post / post.sum(axis=0) * times).sum(axis=1) / times.sum()
        done = np.abs(after - share).max() <= tolerance
        share = after
        if done:
            return share, float((times * np.log(share @ p)).sum())


def some_words(n_docs, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 40, n_docs)
    p = rng.random((4, sizes.sum())).astype(np.float32) ** rng.choice([1, 6], sizes.sum())
    times = rng.integers(1, 5, sizes.sum()).astype(np.float32)
    return p.astype(np.float32), times, sizes, np.r_[0, np.cumsum(sizes)]


def test_em_equals_a_plain_loop():
    p, times, sizes, at = some_words(50, 2)
    share, likelihood = languages._expect(p, times, np.full((4, 50), 0.25), sizes, 1e-3)
    for d in range(50):
        want, ll = slow_shares(p[:, at[d] : at[d + 1]].astype(float), times[at[d] : at[d + 1]], np.full(4, 0.25), 1e-3)
        assert np.allclose(share[:, d], want, atol=5e-3) and abs(likelihood[d] - ll) < 0.01 * abs(ll) + 0.05


def test_languages_are_selected_by_penalised_likelihood():
    """Against all subsets of the languages of a small model, each fitted by plain EM."""
    p, times, sizes, at = some_words(60, 3)
    shares = languages.infer(p, times, sizes, 3.0, 1e-4)
    best = 0
    for d in range(60):
        q, t = p[:, at[d] : at[d + 1]].astype(float) + 1e-12, times[at[d] : at[d + 1]]
        price = 1.5 * math.log(t.sum() + 1)
        value = {}
        for k in range(1, 5):
            for chosen in itertools.combinations(range(4), k):
                _, ll = slow_shares(q[list(chosen)], t, np.full(k, 1 / k), 1e-5)
                value[chosen] = ll - k * price
        mine = tuple(np.flatnonzero(shares[d] > 0).tolist())
        assert value[mine] >= max(value[s] for s in value if set(s) < set(mine) and len(s) == len(mine) - 1 or s == mine) - 0.2 * price
        best += value[mine] >= max(value.values()) - 0.2 * price
    assert best >= 54  # dropping one language at a time finds the best subset nearly always


def test_language_sample_is_bounded(spark):
    rows = [(None, f"wort nummer {i}", "de", "a", 0) for i in range(300)] + [(7, "the same", "en", "a", 0)] * 300
    seen = {}
    original = languages.Model
    try:
        languages.Model = lambda texts: seen.update(texts)
        languages.fit(fx.docs(spark, rows), sample=20)
    finally:
        languages.Model = original
    assert len(seen["de"]) == 20 and seen["en"] == ["the same"]


def test_held_out_languages(spark):
    docs = read(spark, fx.SF, "documents")
    model = languages.fit(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1 and n_chars > 60")
    found = {r.doc_id: r for r in languages.identify(rest, model).collect()}
    truth = {r.doc_id: r.lang for r in rest.select("doc_id", "lang").collect()}
    right = [found[i].language == lang for i, lang in truth.items() if found[i].known]
    assert np.mean(right) > 0.95 and len(right) > 0.85 * len(truth)


def test_mixed_document_has_both_languages(spark):
    docs = read(spark, fx.SF, "documents").where("n_chars > 1500")
    one = {r.lang: r.text for r in docs.collect()}
    text = one["de"][:1200] + "\n" + one["fr"][:1200]
    got = languages.identify(fx.docs(spark, [(1, text, None, None, 0), (2, one["en"], None, None, 0)]), languages.fit(read(spark, fx.SF, "documents"))).collect()
    mixed, plain = sorted(got, key=lambda r: r.doc_id)
    assert {"de", "fr"} <= set(mixed.languages) and abs(mixed.proportions[0] - 0.5) < 0.2
    assert plain.language == "en" and plain.proportions[0] > 0.8


# -- 3 packing


def test_no_exact_combination_is_left():
    rng = random.Random(3)
    for _ in range(40):
        capacity = rng.randint(8, 24)
        counts = {n: rng.randint(0, 4) for n in range(1, capacity)}
        planned = packing.plan(dict(counts), capacity)
        used = Counter()
        for lengths, times in planned:
            assert sum(lengths) <= capacity
            for n in lengths:
                used[n] += times
        assert used == Counter({n: c for n, c in counts.items() if c})
        loose = Counter()
        for lengths, times in planned:
            if sum(lengths) < capacity:
                for n in lengths:
                    loose[n] += times
        for k in (2, 3, 4):
            for combination in itertools.combinations_with_replacement(sorted(loose), k):
                if sum(combination) == capacity:
                    assert any(loose[n] < m for n, m in Counter(combination).items())


def plain_best_fit(lengths, capacity):
    """Best-fit decreasing, item by item; how many sequences have each filling."""
    open_ = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in open_ if capacity - sum(b) >= n]
        if fits:
            max(fits, key=sum).append(n)
        else:
            open_.append([n])
    return Counter(sum(b) for b in open_)


def test_residuals_equal_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.randint(6, 40)
        counts = {n: rng.randint(0, 5) for n in rng.sample(range(1, capacity), min(capacity - 1, 7))}
        got = Counter()
        for lengths, times in packing._best_fit({n: c for n, c in counts.items() if c}, capacity):
            got[sum(lengths)] += times
        assert got == plain_best_fit([n for n, c in counts.items() for _ in range(c)], capacity)


def test_index_has_all_sums():
    rng = random.Random(5)
    for _ in range(30):
        capacity = rng.randint(5, 30)
        counts = np.array([0] + [rng.randint(0, 2) for _ in range(capacity - 1)] + [0])
        index = packing._Index(counts)
        have = np.flatnonzero(counts).tolist()
        for gap in range(1, capacity):
            want = {tuple(sorted(c, reverse=True)) for k in (1, 2, 3) for c in itertools.combinations_with_replacement(have, k) if sum(c) == gap}
            assert set(index.fillings(gap)) == want


def test_each_slot_is_taken_once():
    rng = random.Random(6)
    for _ in range(40):
        capacity = rng.randint(6, 30)
        counts = {n: rng.randint(0, 6) for n in range(1, capacity)}
        planned = packing.plan(dict(counts), capacity)
        s, filled = packing._slots(planned), defaultdict(list)
        keys = list(zip(s["length"].tolist(), s["rank"].tolist()))
        for length, c in counts.items():
            for rank in range(c):
                at = max(i for i, k in enumerate(keys) if k <= (length, rank))
                nth = rank - s["rank"][at]
                filled[int(s["base"][at] + nth // s["per"][at])].append((int(s["slot"][at] + nth % s["per"][at]), length))
        assert Counter(tuple(sorted((n for _, n in x), reverse=True)) for x in filled.values()) == sum((Counter({tuple(sorted(ls, reverse=True)): t}) for ls, t in planned), Counter())
        assert all(len({slot for slot, _ in x}) == len(x) for x in filled.values())


def test_packing_is_near_the_least_number(spark):
    docs = read(spark, fx.SF, "documents")
    got = packing.pack(docs).collect()
    tokens = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    covered = Counter()
    for r in got:
        for p in r.pieces:
            covered[p.doc_id] += p.n_tokens
    assert covered == Counter(tokens)
    assert len(got) <= math.ceil(sum(tokens.values()) / packing.CAPACITY) * 1.05 + 1


# -- 4 embeddings


def near_rows(spark, folder=None):
    """The embeddings of the smallest tables, with planted neighbours, a hot cluster and copies; the pairs that groups connect."""
    rng = np.random.default_rng(4)
    base = np.array([r.embedding for r in read(spark, fx.SF, "embeddings").orderBy("vec_id").limit(700).collect()], np.float64)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:200] + 0.03 * rng.normal(size=(200, base.shape[1]))
    v = np.concatenate([base, near, np.repeat(base[:1], 40, axis=0) + 0.01 * rng.normal(size=(40, base.shape[1])), base[:3]])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= hnsw.LEAST, 1))
    truth = fx.pairs_of(_groups(fx.united(zip(a.tolist(), b.tolist()))))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>"), truth


def pairs_in(rows, name):
    groups = defaultdict(list)
    for r in rows:
        groups[r.group_id].append(r[name])
    assert all(r.group_id == min(groups[r.group_id]) and r.group_size == len(groups[r.group_id]) for r in rows)
    return fx.pairs_of(groups.values())


def test_near_vectors_against_all_pairs(spark):
    e, truth = near_rows(spark)
    for options in ({}, {"shards": 3}, {"shards": 4, "shard_rows": 100}):
        found = pairs_in(hnsw.near_vector_groups(e, **options).collect(), "vec_id")
        assert found <= truth and len(found & truth) >= 0.95 * len(truth) > 100


def test_audits_fail_a_search_that_finds_only_the_query_itself():
    rng = np.random.default_rng(5)
    v = hnsw._unit(rng.normal(size=(600, 24)))
    v = np.concatenate([v, hnsw._unit(v[:50] + 0.02 * rng.normal(size=(50, 24)))])

    class Blind(hnsw.Graph):
        def search(self, queries, beam):
            ids = np.full((len(queries), beam), -1)
            sims = np.full((len(queries), beam), -np.inf, np.float32)
            same = queries @ self.vectors.T > 1 - 1e-6
            found = same.any(axis=1)
            ids[found, 0], sims[found, 0] = same[found].argmax(axis=1), 1.0
            return ids, sims

    blind = Blind(v)
    assert hnsw._recall(blind, v[:64], hnsw.LEAST, 32, np.arange(64)) < 0.1
    assert hnsw.audited(blind, hnsw.LEAST).beam >= len(v)
    blind.beam = 32
    assert len(hnsw.near_pairs(blind, v, hnsw.LEAST, own=np.arange(len(v)))[0]) == 100  # the second audit alone brings it to brute force
    assert hnsw.audited(hnsw.Graph(v), hnsw.LEAST).beam < len(v)


def _groups(labels):
    out = defaultdict(list)
    for x, r in labels.items():
        out[r].append(x)
    return out.values()


def test_op4_on_a_table_with_planted_pairs(spark, tmp_path):
    e, truth = near_rows(spark)
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = pairs_in(queries.op4_embedding_near_dups(spark, str(tmp_path)).collect(), "vec_id")
    assert found <= truth and len(found) >= 0.95 * len(truth) > 100


# -- 5 fingerprints, 10 near duplicates


def phrases(text):
    known, at, out = set(), (), set()
    for word in (text or "").split():
        for symbol in [word] if len(word) <= fingerprints.LONG_WORD else word:
            at += (symbol,)
            if at not in known:
                known.add(at)
                out.add(at)
                at = ()
    return out


def test_phrases_equal_a_plain_parse():
    texts = ["", None, "a a a a a a a", "ab ab c ab ab c ab", "the  cat\nthe cat sat the cat sat", "x" * 50 + " x x", *fx.pieces(5, 1, 200)]
    hashes, offsets = fingerprints.phrase_hashes(texts)
    named = {}
    for i, t in enumerate(texts):
        own = hashes[offsets[i] : offsets[i + 1]].tolist()
        assert len(own) == len(set(own)) == len(phrases(t))
        named[i] = set(own)
    for i, j in itertools.combinations(named, 2):  # equal phrases, and only these, have equal hashes
        assert len(named[i] & named[j]) == len(phrases(texts[i]) & phrases(texts[j]))


def near_texts(words=120):
    texts = {}
    for i, t in enumerate(fx.pieces(60, 5, words)):
        texts[10 * i] = t
        texts[10 * i + 1] = fx.edited(t, 0.03, i)
    return texts


def test_fingerprint_recall(spark):
    texts = {i: t * 6 if i % 10 == 0 else t for i, t in near_texts(300).items()}
    texts |= {10 * i + 2: texts[10 * i][:-40] for i in range(30)}
    truth = fx.similar_pairs({i: phrases(t) for i, t in texts.items()}, 0.6)
    got = fingerprints.fingerprint_groups(fx.docs(spark, [(i, t, "en", "a", 0) for i, t in texts.items()])).collect()
    root = {r.doc_id: r.group_id for r in got}
    assert truth and np.mean([root[a] == root[b] for a, b in truth]) >= 0.95


def test_fingerprint_recall_over_all_pairs_of_a_larger_table(spark):
    """At least 0.95 of the pairs of similarity 0.6 and more among 5,000 documents are in one group, and no group has documents that are unlike all others."""
    rows = read(spark, "/root/testdata/sf0.1", "documents").orderBy("doc_id").limit(5000).select("doc_id", "text").collect()
    ids = [r.doc_id for r in rows]
    numbers, holders = {}, defaultdict(list)
    sets = [{numbers.setdefault(p, len(numbers)) for p in phrases(r.text)} for r in rows]
    for i, s in enumerate(sets):
        for p in s:
            holders[p].append(i)
    similar = defaultdict(dict)
    for i, s in enumerate(sets):
        common = Counter(itertools.chain.from_iterable(h for p in s if len(h := holders[p]) > 1))
        for j, n in common.items():
            if j > i and n >= 0.4 * (len(s) + len(sets[j]) - n):
                similar[i][j] = similar[j][i] = n / (len(s) + len(sets[j]) - n)
    root = {r.doc_id: (r.group_id, r.group_size) for r in fingerprints.fingerprint_groups(fx.docs(spark, [(r.doc_id, r.text, None, None, 0) for r in rows])).collect()}
    pairs = [(i, j) for i in similar for j, s in similar[i].items() if i < j and s >= 0.6]
    assert len(pairs) > 100 and np.mean([root[ids[i]][0] == root[ids[j]][0] for i, j in pairs]) >= 0.95
    assert all(similar[i] for i in range(len(ids)) if root[ids[i]][1] > 1)


def shingles(text, n=3):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_near_duplicate_recall_and_precision(spark):
    texts = near_texts()
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {r.doc_id: r.group_id for r in near_dups.near_duplicate_groups(fx.docs(spark, [(i, t, "en", "a", 0) for i, t in texts.items()])).collect()}
    same = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if root.get(a, -a - 1) == root.get(b, -b - 1)}
    truth = fx.similar_pairs(sets, 0.55)
    assert len(truth & same) >= 0.9 * len(truth) > 30
    assert same <= fx.similar_pairs(sets, 0.35)


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(6)
    for share in (0.0, 0.5, 0.9):
        n = int(400 * share)
        both = rng.integers(0, 1 << 62, n).astype(np.uint64)
        a, b = (np.r_[both, rng.integers(0, 1 << 62, 400 - n).astype(np.uint64)] for _ in range(2))
        mins = textvec.minima(np.r_[a, b], np.array([0, 400, 800]), 1920, 7)
        packed = textvec.pack_low_bits(mins, 4).view(np.uint64)
        from palimgraph.llm.neargroups import matches, similarity

        assert abs(similarity(matches(packed[0], packed[1:2], 4), 1920, 4)[0] - n / (800 - n)) < 0.05


def test_op5_and_op10_on_their_table(spark):
    docs = {r.doc_id: r.text for r in read(spark, fx.SF, "documents").collect()}
    truth = fx.similar_pairs({i: shingles(t) for i, t in docs.items()}, 0.6)
    found = pairs_in(queries.op10_minhash_near_dups(spark, fx.SF).collect(), "doc_id")
    assert len(truth & found) >= 0.9 * len(truth) > 0
    lz = fx.similar_pairs({i: phrases(t) for i, t in docs.items()}, 0.6)
    root = {r.doc_id: r.group_id for r in queries.op5_fingerprints(spark, fx.SF).collect()}
    assert np.mean([root[a] == root[b] for a, b in lz]) >= 0.9


# -- 6 language model


WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\t\n\v\f\r ]")


class PlainKatz:
    """Counts in dictionaries, recursion as in the textbook."""

    def __init__(self, texts):
        self.counts = [Counter(), Counter(), Counter()]
        for t in texts:
            for pair in self.pairs(t):
                self.counts[1][pair[1:]] += 1
                self.counts[2][pair] += 1
        self.d = [None, *(katz.discounts(Counter(c.values())) for c in self.counts[1:])]

    @staticmethod
    def pairs(text):
        data = [None, *WORD.findall((text or "").encode()), "end"]
        return list(zip(data, data[1:])) if len(data) > 2 else []

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / katz.TOKENS
        seen = {g: n for g, n in self.counts[k].items() if g[:-1] == gram[:-1]}
        if not seen:
            return self.p(gram[1:])
        total = sum(seen.values())
        mass = {g: n * (self.d[k][n - 1] if n <= katz.CUT else 1) for g, n in seen.items()}
        left = 1 / (total + 1) if min(seen.values()) > katz.CUT else 1 - sum(mass.values()) / total
        if gram in seen:
            return mass[gram] * (1 - left) / sum(mass.values())
        return left * self.p(gram[1:]) / (1 - sum(self.p(g[1:]) for g in seen))

    def score(self, text):
        pairs = self.pairs(text)
        return len(pairs), sum(math.log(self.p(g)) for g in pairs) if pairs else None


def sentences():
    rng = random.Random(6)
    words = ["the", "cat", "sat", "on", "a", "mat,", "and", "(so", "did)", "Wörter", "\U0001f600", "x1-2", "dog."]
    return [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(1, 25))) for _ in range(60)] + ["", " \n", None, "once only"]


ASKED = ["the cat sat on a mat", "mat a on sat cat the", "quite unseen ß words", "the the the", "\n", None, "the cat sat on a mat"]


@pytest.mark.parametrize("part_tokens", [katz.PART, 300, 60])  # one part; several; several with hot contexts
def test_katz_equals_recursion(spark, tmp_path, part_tokens):
    texts = sentences()
    d = fx.docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    model = katz.fit(d, part_tokens=part_tokens)
    assert (model.parts > 1) == (part_tokens < katz.PART) == (len(model.hot["context"]) > 0)
    plain = PlainKatz(texts)
    given = [*texts, *ASKED]
    asked = fx.docs(spark, [(i, t, None, None, 0) for i, t in enumerate(given)] + [(None, texts[0], None, None, 0)])
    katz.save(model, str(tmp_path / "model"))
    for m in (model, katz.load(spark, str(tmp_path / "model"))):
        rows = katz.score(asked, m).collect()
        assert len(rows) == len(given) + 1
        for r in rows:
            n, want = plain.score(texts[0] if r.doc_id is None else given[r.doc_id])
            assert r.n_tokens == n and (r.log_prob is None) == (want is None)
            assert want is None or abs(r.log_prob - want) < 1e-9 * abs(want)


def test_katz_sums_to_one(spark):
    model = katz.fit(fx.docs(spark, [(i, t, None, None, 0) for i, t in enumerate(sentences())]))
    part = katz.Part(model.counts.first().blob, model.contexts.first().blob, model.factors, model.hot)
    words = {r.token: r.n for r in model.words.collect()}
    single = np.exp(model.unigrams.log_probability(np.array([*words.values(), 0])))
    rest = katz.TOKENS - len(words)
    assert abs(single[:-1].sum() + rest * single[-1] - 1) < 1e-9
    for context in [katz.BEGIN, *part.context.tolist()[1:8], 77]:
        found, value = part.look_up(np.array([context << katz.BITS | w for w in [*words, 99]]))
        p = np.where(found, np.exp(value), np.exp(value) * single)
        assert abs(p[:-1].sum() + rest * p[-1] - 1) < 1e-9


def test_katz_joins_batches_and_sees_the_order_of_words(spark, monkeypatch):
    texts = fx.pieces(40, 12) + [fx.pieces(1, 13, 4000)[0]]
    d = fx.docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    whole = {r.doc_id: r.log_prob for r in katz.fit_and_score(d).collect()}
    monkeypatch.setattr(katz, "BATCH", 800)
    parts = {r.doc_id: r.log_prob for r in katz.fit_and_score(d.repartition(3), part_tokens=400).collect()}
    assert all(abs(parts[i] - x) < 1e-6 * abs(x) for i, x in whole.items()) and len(parts) == len(whole)
    model = katz.fit(d)
    turned = {r.doc_id: r.log_prob for r in katz.score(fx.docs(spark, [(i, " ".join(t.split()[::-1]), None, None, 0) for i, t in enumerate(texts)]), model).collect()}
    assert all(turned[i] < x for i, x in whole.items())


def test_discounts():
    plain = {1: 1000, 2: 400, 3: 220, 4: 140, 5: 100, 6: 70}
    common = 6 * 70 / 1000
    assert np.allclose(katz.discounts(plain), [((r + 1) * plain[r + 1] / (r * plain[r]) - common) / (1 - common) for r in range(1, 6)])
    for odd in ({1: 9000, 2: 3000, 3: 40, 4: 20, 5: 15, 6: 2}, {1: 10, 2: 500, 3: 1, 4: 1, 5: 1, 6: 1}, {1: 5}, {}):
        d = katz.discounts(odd)
        assert all(0 < x < 1 for x in d) and all(r * x < (r + 1) * y for r, (x, y) in enumerate(zip(d, d[1:]), 1))


def test_twice_is_likelier_than_once(spark):
    texts = fx.pieces(300, 14)
    d = fx.docs(spark, [(i, t, None, None, 0) for i, t in enumerate([*texts, *texts[:30]])])
    bits = {r.doc_id: r.bits_per_token for r in katz.fit_and_score(d).collect()}
    once = [bits[i] for i in range(30, 300)]
    assert np.mean([bits[i] < min(once) for i in range(30)]) > 0.9


def test_op6_counts_across_words(spark):
    docs = read(spark, fx.SF, "documents")
    texts = [r.text for r in docs.collect()]
    model = katz.fit(docs)
    got = sum(len(packed.unpack(r.blob)[1]) for r in model.counts.collect())
    want = len({p for t in texts for p in PlainKatz.pairs(t)})
    assert 0.999 * want <= got <= want
    scored = queries.op6_lm_scoring(spark, fx.SF).collect()
    assert len(scored) == len(texts) and sum(r.n_tokens for r in scored) == sum(len(PlainKatz.pairs(t)) for t in texts)


# -- 7 licences


@pytest.mark.parametrize(
    "expression, kind",
    [
        ("MIT", "permissive"), ("MIT OR GPL-3.0-only", "permissive"), ("MIT AND GPL-3.0-only", "copyleft"), ("GPL-2.0-only WITH Classpath-exception-2.0", "weak-copyleft"),
        ("MIT AND (GPL-2.0+ OR Apache-2.0)", "permissive"), ("MIT OR GPL-2.0 AND AGPL-3.0", "permissive"), ("(MIT OR GPL-2.0) AND AGPL-3.0", "network-copyleft"),
        ("MIT OR", "unknown"), ("(MIT", "unknown"), ("MIT GPL-2.0", "unknown"), ("", "unknown"), ("Nobody-1.0", "unknown"), ("gpl-3.0-or-later", "copyleft"),
    ],
)
def test_licence_expressions(expression, kind):
    assert licences.evaluate(expression)[0] == kind


def test_automaton_equals_search(spark):
    docs = read(spark, fx.SF, "documents").collect()
    found = {r.doc_id: set(r.licences) for r in queries.op7_licences(spark, fx.SF).collect()}
    for r in docs:
        flat = " ".join(r.text.split()).lower()
        want = {name for phrase, name in licences.PHRASES.items() if phrase in flat}
        assert want <= found[r.doc_id], r.doc_id
        assert want == found[r.doc_id] or "spdx-license-identifier:" in flat or any(f in flat for f in licences.FAMILIES)
    got = licences.scan(fx.docs(spark, [(1, "x\n// SPDX-License-Identifier: MIT OR GPL-2.0-only */\nReleased under\nthe MIT  License", None, None, 0)])).collect()[0]
    assert got.licences == ["GPL-2.0", "MIT"] and got.expressions == ["MIT OR GPL-2.0-only"] and got["class"] == "permissive" and got.allowed


#: Written apart from the operator's phrases: (notice, class, allowed).
NOTICES = [
    ("All rights reserved.", "proprietary", False), ("ALL RIGHTS\nRESERVED", "proprietary", False), ("Alle Rechte vorbehalten.", "proprietary", False),
    ("Tous droits réservés.", "proprietary", False), ("Todos los derechos reservados.", "proprietary", False), ("Copyright 2019 Example Press", "proprietary", False),
    ("Copyright (c) Example Press", "proprietary", False), ("© 2021 Example Press", "proprietary", False), ("(C) 1998 Example Press", "proprietary", False),
    ("Copyright (c) 2020 A. Writer. All rights reserved. Redistribution and use in source and binary forms, with or without modification", "permissive", True),
    ("Copyright 2020 A. Writer. Released under the MIT License.", "permissive", True), ("Copyright 2020 A. Writer\nSPDX-License-Identifier: GPL-3.0-only", "copyleft", False),
    ("All rights reserved. Licensed under CC BY-NC 4.0.", "non-commercial", False), ("Licensed under the Apache License 2.0", "permissive", True),
    ("under the Apache License Version 2.0", "permissive", True), ("Licensed under CC BY 3.0", "permissive", True), ("Licensed under CC BY-SA 3.0.", "copyleft", False),
    ("Creative Commons Attribution 3.0 Unported", "permissive", True), ("Creative Commons Attribution-NonCommercial-ShareAlike 3.0", "non-commercial", False),
    ("it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "copyleft", False),
    ("Licensed under the Eclipse Public License 2.0", "weak-copyleft", False), ("A history of the GNU General Public License", "none", True), ("PackageLicenseDeclared: NONE", "none", True),
    ("License-Expression: BlueOak-1.0.0", "permissive", True), ("Creative Commons Attribution-NoDerivatives 4.0 International", "non-commercial", False), ("The copyright of 20 pages was discussed (c).", "none", True), ("Some rights reserved", "none", True),
]


def test_versions_after_families():
    automaton = licences._automaton(licences.PHRASES)
    for notice, name in [
        ("GNU General Public License as published by the Free Software Foundation, either version 3", "GPL-3.0"), ("licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
        ("distributed under the GNU GPL v2", "GPL-2.0"), ("under the terms of the GNU Affero General Public License, Version 3", "AGPL-3.0"), ("subject to the terms of the Mozilla Public License, v. 1.1", "MPL-1.1"),
        ("released under the GNU\n General Public\tLicense", "GPL-2.0"), ("licensed under the Artistic License 2.0", "Artistic-2.0"), ("licensed under the GNU GPL version 9", "GPL-2.0"),
    ]:
        assert licences.scan_text(f"x {notice}.", automaton)[0] == [name], notice


def test_notices_and_their_verdicts(spark):
    rows = [(i, f"Some prose before it.\n{notice}\nand after it", "en", "a", 0) for i, (notice, _, _) in enumerate(NOTICES)]
    got = {r.doc_id: r for r in licences.scan(fx.docs(spark, rows)).collect()}
    assert [(n, got[i]["class"], got[i].allowed) for i, (n, _, _) in enumerate(NOTICES)] == NOTICES


# -- 8 reply trees


def test_trees_against_walks(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(6):
        for i in range(25):
            parent = rng.randrange(i) if i and rng.random() < 0.9 else None
            rows.append((conv, i, parent, "user", f"t{i}", float(rng.randint(0, 3))))
    rows += [(9, 1, 2, "user", "a", 1.0), (9, 2, 1, "user", "b", 1.0), (9, 3, 2, "user", "c", 1.0), (9, 4, 99, "user", "d", None)]
    m = spark.createDataFrame(rows, "conv_id bigint, msg_id bigint, parent_id bigint, role string, text string, score double")
    got = {(r.conv_id, r.leaf_id): (r.branch, list(r.path), r.score) for r in reply_trees.format_trees(m).collect()}
    up = {(c, i): (p, s) for c, i, p, _, _, s in rows}
    want = {}
    for c, i in up:
        if any(cc == c and p == i for (cc, _), (p, _) in up.items()):
            continue
        path, at = [], i
        while at is not None and (c, at) in up and at not in path:
            path.insert(0, at)
            at = up[c, at][0]
        if at is None or (c, at) not in up:
            want[c, i] = path, sum(up[c, x][1] or 0 for x in path) / len(path)
    assert {k: v[1] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    for c in {c for c, _ in want}:
        ranked = sorted((k for k in want if k[0] == c), key=lambda k: (-want[k][1], k[1]))
        assert [got[k][0] for k in ranked] == list(range(1, len(ranked) + 1))


# -- 9 toxicity


def test_held_out_toxicity(spark):
    d, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(d, labels.where("doc_id % 2 = 0"))
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 1").collect()}
    found = {r.doc_id: r.toxic for r in toxicity.scores(d, model).collect() if r.doc_id in truth}
    toxic = [found[i] for i, y in truth.items() if y and i in found]
    clean = [found[i] for i, y in truth.items() if not y and i in found]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01


def labelled(n=400):
    rng = random.Random(9)
    out = []
    for i, f in enumerate(fx.pieces(n, 9, 12)):
        term = rng.choice(["muslim", "women", "christian", ""])
        out.append((f"{f} {term} {'vilehate scum' if i % 3 == 0 else 'nice'}. {f[:30]} {term}", int(i % 3 == 0)))
    return out


def test_all_swaps_count_and_give_the_plain_changes():
    terms = toxicity.IDENTITY_TERMS
    texts = [t for t, _ in labelled()]
    found = list(toxicity.swaps(texts, terms))
    with_term = sum(w in terms for t in texts for w in re.findall(r"[^\W\d_]+", t.lower()))
    assert len(found) == 3 * with_term
    assert len(list(toxicity.swaps(["The women left. " * 3000], terms))) == 9000  # beyond 4,000 too
    features = [("=women", 1), ("=women", 2), ("^musl", 1), ("=nice", 1), ("^wome", 1), ("=christian", 1)]
    names = {g: j for j, g in enumerate(sorted({g for g, _ in features}))}
    column, least = np.array([names[g] for g, _ in features]), np.array([n for _, n in features])
    rows, times, total = toxicity._changes(iter(found), names, column, least)

    def active(bag):
        counts = Counter(g for w, n in bag.items() for g in toxicity._grams(w) for _ in range(n))
        return np.array([counts[g] >= n for g, n in features], float)

    want = Counter()
    for bag, lost, got in found:
        after = bag.copy()
        after.subtract(lost)
        after.update(got)
        want[tuple(active(after) - active(bag))] += 1
    want.pop((0.0,) * len(features), None)
    assert total == len(found) and {tuple(r): t for r, t in zip(rows.astype(float), times)} == dict(want)


def test_fit_minimises_the_penalised_loss():
    texts, labels = zip(*labelled())
    model = toxicity.train(list(texts), list(labels), features=40)
    names, x, y, extra = toxicity._design(list(texts), list(labels), toxicity.IDENTITY_TERMS, toxicity.SWAP_WEIGHT, 40)
    w, rate = np.zeros(len(names) + 1), 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + np.linalg.norm(extra, 2))
    last, t = w, 1.0
    for _ in range(4000):  # accelerated gradient descent
        at = w + (t - 1) / (t + 2) * (w - last)
        last, t = w, t + 1
        w = at - rate * (x.T @ (1 / (1 + np.exp(-(x @ at))) - y) + extra @ at)
    mine = np.array([dict(model.steps[model._at[g]]).get(n, 0.0) if g in model._at else 0.0 for g, n in names] + [model.bias])
    assert toxicity.objective(mine, x, y, extra) <= toxicity.objective(w, x, y, extra) + 1e-3


def test_held_out_accuracy_with_more_features(spark):
    """The bound on features regularises: with four times as many, held-out documents aren't told apart better."""
    d, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 1").collect()}
    right = []
    for features in (toxicity.FEATURES, 4 * toxicity.FEATURES):
        model = toxicity.fit(d, labels.where("doc_id % 2 = 0"), features=features)
        found = {r.doc_id: r.toxic for r in toxicity.scores(d.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id"), model).collect()}
        right.append(np.mean([found[i] == bool(y) for i, y in truth.items() if i in found]))
    assert right[0] >= right[1] - 0.005


def test_order_of_rows_and_texts_of_one_id(spark):
    rows = [(i, t, "en", "a", 0) for i, (t, _) in enumerate(labelled(90))] + [(0, "zzz", "en", "a", 0)] * 50
    labels = spark.createDataFrame([(i, 0, y) for i, (_, y) in enumerate(labelled(90))], "doc_id bigint, quality int, toxic int")
    one, two = (toxicity.fit(fx.docs(spark, r).repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert one.steps == two.steps and one.bias == two.bias


def test_swapped_terms_change_the_score_little():
    rng = random.Random(9)
    filler = fx.pieces(400, 9, 12)
    texts, labels = [], []
    for i, f in enumerate(filler):
        toxic = i % 3 == 0
        term = "muslim" if toxic and rng.random() < 0.7 else rng.choice(["christian", "women", "muslim"]) if rng.random() < 0.3 else "people"
        texts.append(f"{f} {term} {'vilehate scum' if toxic else 'nice'}")
        labels.append(int(toxic))
    fair, plain = toxicity.train(texts, labels), toxicity.train(texts, labels, swap_weight=0.0)
    gap = lambda c: abs(c.score("the muslim family went home") - c.score("the christian family went home"))
    assert gap(fair) < 0.5 * gap(plain) and gap(fair) < 0.05
    assert fair.score("the muslim family went home") < toxicity.THRESHOLD < fair.score("such vilehate scum")


# -- 5 fingerprints: no link is left out


def test_fingerprint_links_equal_all_pairs(spark, monkeypatch):
    """Every text's number of links, also just at the bound, of texts of all sizes; copies and spaces don't count twice."""
    texts = dict(enumerate(fx.pieces(12, 21, 30) + fx.pieces(12, 22, 400) + fx.pieces(4, 23, 2500)))
    for i in list(texts):
        for j, share in enumerate((0.1, 0.25, 0.3, 0.35, 0.4)):
            texts[100 * (j + 1) + i] = fx.edited(texts[i], share, 10 * i + j)
    texts |= {1000: "a b c", 1001: "a b d", 1002: "a  b c", 1003: "a b c", 1004: "a b", 1005: ""}
    sets = {i: phrases(t) for i, t in texts.items()}
    near = fx.similar_pairs(sets, 0.5)
    others = defaultdict(set)
    for a, b in near:
        if texts[a] != texts[b]:
            others[a].add(texts[b])
            others[b].add(texts[a])
    root = fx.united(near)
    assert sum(0.5 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.6 for a, b in near) >= 10
    for block in (setjoin.BLOCK, 500):
        monkeypatch.setattr(setjoin, "BLOCK", block)
        got = {r.doc_id: r for r in fingerprints.fingerprint_groups(fx.docs(spark, [(i, t, None, None, 0) for i, t in texts.items()])).collect()}
        assert {i: r.links for i, r in got.items()} == {i: len(others[i]) for i in texts}
        assert {i: r.group_id for i, r in got.items()} == {i: root.get(i, i) for i in texts}


def test_many_texts_all_alike_give_few_edges(spark):
    """200 texts, all alike, are 19,900 pairs; what goes on from the cells is a few edges a text, and yet each link is counted."""
    text = fx.pieces(1, 41, 300)[0]
    texts = {i: fx.edited(text, 0.03, i) for i in range(200)} | {1000 + i: t for i, t in enumerate(fx.pieces(20, 42, 300))}
    docs = fx.docs(spark, [(i, t, None, None, 0) for i, t in texts.items()])
    near = fx.similar_pairs({i: phrases(t) for i, t in texts.items()}, 0.5)
    assert len(near) > 15_000
    assert fingerprints.fingerprints(docs)[1].count() <= 20 * len(texts)
    assert {r.doc_id: r.links for r in fingerprints.fingerprint_groups(docs).collect()} == {i: sum(i in p for p in near) for i in texts}


def test_cells_connect_all_that_may_be_similar(monkeypatch):
    """Every two sets of one cell whose elements are similar enough are connected, also of one element, in small steps and blocks; whole sets are compared exactly."""
    rng = np.random.default_rng(43)
    whole = [rng.choice(400, rng.integers(1, 40), replace=False) for _ in range(60)] + [np.array([e]) for e in range(30)] + [np.array([e, e + 1]) for e in range(30)]
    sets = [*whole, *(np.unique(np.r_[s[rng.random(len(s)) < 0.9], rng.integers(0, 400, 2)]) for s in whole * 2)]
    sets = [np.unique(s) * 40_503 % (1 << setjoin.ELEMENT) for s in sets]
    nodes, counts = np.arange(len(sets)) * 7 + 5, np.array([len(s) for s in sets])
    pairs = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in itertools.combinations(range(len(sets)), 2)}
    for least in (0.25, 0.5, 0.7):
        near = {p for p, n in pairs.items() if n * (1 + least) >= least * (counts[p[0]] + counts[p[1]]) - 1e-9}
        assert len(near) > 20
        assert {(x, y) for x, ys in setjoin.similar(sets, least) for y in ys.tolist()} == near
        for size, block in ((setjoin.PAIRS, setjoin.BLOCK), (50, 700)):
            monkeypatch.setattr(setjoin, "PAIRS", size)
            monkeypatch.setattr(setjoin, "BLOCK", block)
            a, b = setjoin.near_in_cell(nodes, counts, np.concatenate(sets), least)
            root = fx.united(set(zip(a.tolist(), b.tolist())))
            assert all(root.get(nodes[i], nodes[i]) == root.get(nodes[j], nodes[j]) for i, j in near)
            monkeypatch.undo()


# -- 6 language model: memory


def test_op6_batches_hold_little_besides_their_bigrams():
    """Bigrams of a batch of many chunks are made chunk by chunk: less than three arrays of all of them at a time."""
    import tracemalloc

    texts = fx.pieces(1, 31, 20_000) * 320
    tracemalloc.start()
    code, sizes = katz.bigrams(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(code) == sizes.sum() == 320 * 20_001
    assert peak < 3 * code.nbytes + 10_000_000
