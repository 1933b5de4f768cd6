"""run() against a plain version of each stage."""

import itertools
import math
import re
from collections import Counter, defaultdict

import fixtures as fx
import numpy as np

import corpus_pipeline
from palimgraph.llm import languages, mixing, near_dups, packing, toxicity
from palimgraph.llm.common import read
from palimgraph.llm.neargroups import matches, similarity

LETTERS = re.compile(r"[^\W\d_]+")


def plain_score(model, text):
    """The classifier's score from its weights, word by word."""
    counts = Counter()
    for w in LETTERS.findall((text or "").lower()):
        for name in ["=" + w, *("^" + w[:n] for n in toxicity.PREFIXES if len(w) >= n)]:
            counts[name] += 1
    z = model.bias + sum(weight for name, steps in zip(model.names, model.steps) for level, weight in steps if counts[name] >= level)
    return 1 / (1 + math.exp(-z))


def plain_language(model, text):
    """Of all sets of languages the one of most penalised likelihood, by plain EM; the largest share's language, None without words."""
    bag = Counter(LETTERS.findall((text or "").lower()))
    if not bag:
        return None
    p, times = model.words(list(bag)).T.astype(float), np.array(list(bag.values()), float)
    best = None
    for k in (1, 2, 3):  # none of these documents has more
        for chosen in itertools.combinations(range(len(p)), k):
            q, share = np.maximum(p[list(chosen)], 1e-38), np.full(k, 1 / k)
            for _ in range(60 if k > 1 else 0):
                post = share[:, None] * q
                share = (post / post.sum(axis=0) * times).sum(axis=1) / times.sum()
            value = (times * np.log(share @ q)).sum() - k * languages.PENALTY / 2 * math.log(times.sum() + 1)
            if best is None or value > best[0]:
                best = value, chosen[int(share.argmax())]
    return [*model.languages, languages.UNKNOWN][best[1]]


def test_pipeline_equals_plain_stages(spark):
    docs = read(spark, fx.SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    # toxicity: each text by itself
    model = toxicity.fit(docs, read(spark, fx.SF, "labels"))
    kept = {i: r for i, r in rows.items() if model is None or plain_score(model, r.text) < toxicity.THRESHOLD}
    as_df = lambda k: docs.where(docs.doc_id.isin(list(k)))
    # languages: each text by itself, with the model of what the first stage kept
    langs = languages.fit(as_df(kept))
    for i in list(kept):
        if plain_language(langs, kept[i].text) in (None, languages.UNKNOWN):
            del kept[i]
    # near duplicates: all pairs of signatures
    sigs = {r.id: np.frombuffer(r.sig, np.uint64) for r in near_dups.signatures(as_df(kept)).collect() if r.sig}
    ids = sorted(sigs)
    table = np.stack([sigs[i] for i in ids])
    pairs = []
    for at, i in enumerate(ids):
        near = similarity(matches(table[at], table[at + 1 :], near_dups.BITS), near_dups.K, near_dups.BITS) >= near_dups.LEAST
        pairs += [(i, ids[at + 1 + j]) for j in np.flatnonzero(near)]
    for i, root in fx.united(pairs).items():
        if i != root:
            kept.pop(i)
    # mixing: with all tokens dealt, each source that has tokens keeps all its documents
    tokens = {i: len(r.text.split()) for i, r in kept.items()}
    assert all(sum(tokens[i] for i, x in kept.items() if x.source == r.source) for r in kept.values())
    # packing: full sequences, and remainders as planned from their counts
    rest = Counter(n % packing.CAPACITY for n in tokens.values() if n % packing.CAPACITY)
    want = Counter()
    for lengths, times in packing.plan(dict(rest), packing.CAPACITY):
        want[tuple(sorted(lengths))] += times
    want[(packing.CAPACITY,)] += sum(n // packing.CAPACITY for n in tokens.values())
    got, pieces = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, fx.SF).collect():
        assert r.n_tokens == sum(p.n_tokens for p in r.pieces) and r.n_tokens + r.gap == packing.CAPACITY
        got[tuple(sorted(p.n_tokens for p in r.pieces))] += 1
        for p in r.pieces:
            pieces[p.doc_id].append((p.start, p.n_tokens))
    assert got == +want
    assert set(pieces) == {i for i, n in tokens.items() if n}
    for i, ps in pieces.items():
        at = 0
        for start, n in sorted(ps):
            assert start == at
            at += n
        assert at == tokens[i]


def test_the_mix_decides_which_documents_share_sequences(spark, tmp_path):
    """Rows come shard after shard, and packing follows them: of one length, earlier documents are in earlier sequences."""
    texts = [" ".join(f"w{i}x{j}" for j in range(1024)) for i in range(64)]
    given = fx.docs(spark, [(i, t, "en", "ab"[i % 4 == 0], len(t)) for i, t in enumerate(texts)])
    shard = {r.row.doc_id: r.shard for r in mixing.assign_blocks(given, budget=math.inf).collect()}
    corpus_pipeline.mix_sources(spark, given, "").write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    order = [r.doc_id for r in mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert sorted(order) == list(range(64)) and [shard[i] for i in order] == sorted(shard.values()) and len(set(shard.values())) > 4
    packs = corpus_pipeline.pack(spark, mixed, "").orderBy("position").collect()
    assert [i for p in packs for i in sorted(p.doc_ids, key=order.index)] == order
    given.coalesce(1).write.parquet(str(tmp_path / "plain"))
    plain = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "plain")), "").collect()
    assert {frozenset(p.doc_ids) for p in plain} != {frozenset(p.doc_ids) for p in packs}
