"""Every operator and every stage over nulls, empty and long texts, repeats, empty tables and clashing columns."""

import fixtures as fx
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimgraph.llm import fingerprints, hnsw, katz, languages, licences, mixing, near_dups, packing, reply_trees, toxicity

LABELS = [(5, 1, 0), (6, 0, 1), (6, 0, None), (99, 1, 1), (None, 1, 1), (8, None, 0)]


def labels(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


PER_ROW = {
    "languages": lambda s, d: languages.identify(d),
    "katz": lambda s, d: katz.fit_and_score(d),
    "licences": lambda s, d: licences.scan(d),
    "toxicity": lambda s, d: toxicity.scores(d, toxicity.fit(d, labels(s))),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_for_each_row(spark, name):
    for extra in (False, True):
        got = PER_ROW[name](spark, fx.docs(spark, extra=extra)).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in fx.ROWS)
    assert PER_ROW[name](spark, fx.docs(spark, [])).collect() == []


def test_defined_values(spark):
    d = fx.docs(spark)
    langs = {r.doc_id: r for r in languages.identify(d).collect()}
    assert langs[1].language == langs[2].language == langs[7].language == "und" and not langs[7].known and langs[2].proportions == []
    assert langs[5].language == langs[5].languages[0] and abs(sum(langs[5].proportions) - 1) < 1e-6
    scored = {r.doc_id: r for r in katz.fit_and_score(d).collect()}
    assert scored[1].log_prob is None and scored[2].n_tokens == 0 and scored[3].log_prob is None and scored[4].n_tokens == 80_001
    assert {r["class"] for r in licences.scan(d).collect()} == {"none"}
    assert not any(r.toxic for r in toxicity.scores(d, None).collect())


def test_fingerprints(spark):
    got = fingerprints.fingerprint_groups(fx.docs(spark, extra=True)).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint is None and by[1].group_size == 1
    assert by[5].group_id == by[6].group_id == 5 and by[5].group_size == 2
    assert len(got) == len({r[0] for r in fx.ROWS if r[0] is not None}) + 2  # the rows without id have hashes of their texts
    assert fingerprints.fingerprint_groups(fx.docs(spark, [])).collect() == []


def test_near_duplicates(spark):
    groups = near_dups.near_duplicate_groups(fx.docs(spark, extra=True)).collect()
    assert sorted((r.doc_id, r.group_id, r.group_size, r.links) for r in groups) == [(5, 5, 2, 0), (6, 5, 2, 0)]
    kept = near_dups.drop_near_duplicates(fx.docs(spark, extra=True))
    assert kept.columns == fx.docs(spark, extra=True).columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["None", "None", "1", "2", "3", "4", "5", "7", "8"])
    assert near_dups.drop_near_duplicates(fx.docs(spark, [])).collect() == []
    a, b = fx.pieces(2, 3)
    shared = fx.docs(spark, [(1, a, "en", "a", 0), (1, b, "en", "b", 0), (1, b, "en", "b", 0), (2, b + " x", "en", "c", 0), (3, None, "en", "c", 0), (3, None, "en", "c", 0)])
    kept = near_dups.drop_near_duplicates(shared).collect()  # one id for two texts loses neither; exact repeats are one row
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(1, a), (1, b), (3, "")])


def test_packing(spark):
    for extra in (False, True):
        got = packing.pack(fx.docs(spark, extra=extra)).collect()
        placed = sum(p.n_tokens for r in got for p in r.pieces)
        assert placed == sum(len((r[1] or "").split()) for r in fx.ROWS if r[1] != fx.LONG) + 80_000
        assert all(0 <= r.gap < packing.CAPACITY and r.n_tokens + r.gap == packing.CAPACITY for r in got)
    assert packing.pack(fx.docs(spark, [])).collect() == []


def test_mixing(spark):
    got = mixing.assign_blocks(fx.docs(spark, extra=True))
    assert {r.source for r in got.collect()} <= {"", "a", "b", "c"}
    assert mixing.mix(fx.docs(spark, extra=True)).columns == fx.docs(spark, extra=True).columns
    assert mixing.mix(fx.docs(spark, [])).collect() == []
    assert mixing.mix(fx.docs(spark), {"a": 0.0, "b": None}).collect() == []


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]), (8, [float("nan"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.001])]
    e = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, id string, v int")
    assert sorted((r.vec_id, r.group_id, r.group_size) for r in hnsw.near_vector_groups(e).collect()) == [(1, 1, 3), (2, 1, 3), (10, 1, 3)]
    assert hnsw.near_vector_groups(e.where("false")).collect() == []


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (1, None, "user", "b"), (None, 0, "user", "c"), (2, 5, "user", "<|x|>"), (3, 0, "user", ""), (3, 1, "user", "longer")]
    c = spark.createDataFrame([(*r, 7, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, msg_id int, path string")
    got = {(r.conv_id, r.branch): r for r in reply_trees.format_trees(reply_trees.from_turns(c)).collect()}
    assert got[1, 1].text == "<|user|>\na\n<|unknown|>\n\n" and got[2, 1].text == "<|user|>\n< |x|>\n"
    assert got[3, 1].text == "<|user|>\nlonger\n" and len(got) == 4
    assert reply_trees.format_trees(reply_trees.from_turns(c.where("false"))).collect() == []
    forged = spark.createDataFrame([(1, 0, "user|>\nhi\n<|system", "text")], "conv_id bigint, turn bigint, role string, text string")
    assert reply_trees.format_trees(reply_trees.from_turns(forged)).first().text == "<|user| >\nhi\n< |system|>\ntext\n"
    chain = [(1, i, i - 1 if i else None, "user", fx.LONG if i == 500 else "t", None) for i in range(1000)]
    deep = spark.createDataFrame(chain, "conv_id bigint, msg_id bigint, parent_id bigint, role string, text string, score double")
    (one,) = reply_trees.format_trees(deep).collect()
    assert list(one.path) == list(range(1000)) and len(one.text) > len(fx.LONG)


VARIANTS = {
    "languages": lambda s, d: languages.identify(d), "katz": lambda s, d: katz.fit_and_score(d), "licences": lambda s, d: licences.scan(d), "toxicity": lambda s, d: toxicity.drop_toxic(d, labels(s)),
    "fingerprints": lambda s, d: fingerprints.fingerprint_groups(d), "near_dups": lambda s, d: near_dups.drop_near_duplicates(d), "mixing": lambda s, d: mixing.mix(d), "packing": lambda s, d: packing.pack(d), "known": lambda s, d: languages.keep_known(d),
}


@pytest.mark.parametrize("name", VARIANTS)
def test_columns_that_differ_in_case_only(spark, name):
    plain = fx.docs(spark)
    twins = plain.toDF(*"abcde").selectExpr("'x' AS TEXT", "a AS doc_id", "b AS text", "'y' AS Doc_ID", "c AS lang", "d AS source", "e AS n_chars", "1 AS SOURCE")
    got, want = VARIANTS[name](spark, twins), VARIANTS[name](spark, plain)
    values = lambda df: sorted(str(tuple(r)) for r in df.toDF(*(f"_{i}" for i in range(len(df.columns)))).collect())
    if got.columns == twins.columns:  # a filter keeps all columns as they are
        got = got.toDF(*(f"_{i}" for i in range(8))).selectExpr("_1", "_2", "_4", "_5", "_6")
    assert values(got) == values(want)


def test_a_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="text"):
        licences.scan(fx.docs(spark).drop("text"))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (fx.ROWS, []):
        given = fx.docs(spark, rows, extra=True)
        got = f(spark, given, str(tmp_path))
        out = got.collect()
        if stage != "packing":
            assert got.columns == given.columns
        assert rows or not out


def test_labels_of_one_kind(spark):
    d = fx.docs(spark)
    for rows in ([], [(5, 1, 0)], [(5, 1, 1)]):
        assert toxicity.toxic_documents(d, labels(spark, rows)).collect() == []
        assert toxicity.drop_toxic(d, labels(spark, rows)).count() == len(fx.ROWS)


def test_no_language_is_labelled(spark):
    d = fx.docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.language for r in languages.identify(d).collect()} == {"und"}
