"""Small tables of awkward rows, and brute-force helpers."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; a table may have columns of these names.
CLASHING = ["id", "key", "row", "n", "h", "sig", "bands", "root", "place", "tie", "bucket", "block", "shard", "n_tokens", "length", "rank", "pack", "score", "toxic", "language", "known", "nth", "code", "seat", "value"]
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))
ROWS = [
    (None, None, None, None, None),
    (None, "a text without an id, of some words that are there", "en", "a", 5),
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, "   \n\t ", None, "b", 6),
    (4, LONG, "en", "a", len(LONG)),
    (5, "the same short row again and again and again", "en", "b", 10),
    (5, "the same short row again and again and again", "en", "b", 10),
    (6, "the same short row again and again and again", "fr", "b", 10),
    (7, "?!?!", "de", "c", 4),
    (8, "één überlanges Wort\x00 mit \U0001f600 Zeichen", "de", "c", 9),
]


def docs(spark: SparkSession, rows=ROWS, extra: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    return df


def pieces(n: int, seed: int, words: int = 60) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 8))) for _ in range(900)]
    return [" ".join(rng.choices(vocabulary, k=words)) for _ in range(n)]


def edited(text: str, share: float, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"x{rng.randint(0, 999)}" for w in text.split())


def united(pairs) -> dict:
    """Least member of each connected group."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def similar_pairs(sets: dict, least: float) -> set:
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= least * len(x | y):
            out.add((a, b))
    return out


def pairs_of(groups) -> set:
    return {p for g in groups for p in itertools.combinations(sorted(g), 2)}
