"""Levels and edge rows against brute force."""

import random

from lodegrid.llm import substring_dedup as S

from .test_queries import WORDS, brute_dedup


def made(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, passages = {}, [[rng.choice(vocabulary) for _ in range(rng.choice([12, 13, 14, 26, 60, 120]))] for _ in range(8)]
    for d in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        texts[d] = rng.choice([" ", "\n", " \t "]).join(words)
    texts[n] = texts[0]
    return texts


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = made(seed)
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        for width in (13, 4):
            want = brute_dedup(texts, width)
            assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in S.deduplicate(docs, width).collect()} == want


def test_longest(spark):
    texts = made(3)
    words = {d: WORDS.findall(t) for d, t in texts.items()}
    want, width, left = {}, 13, True
    while left:
        where = {}
        for d, w in words.items():
            for i in range(len(w) - width + 1):
                where.setdefault(tuple(w[i : i + width]), set()).add(d)
        left = {d for ds in where.values() if len(ds) > 1 for d in ds}
        want |= dict.fromkeys(left, width)
        width *= 2
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    assert {r["doc_id"]: r["longest"] for r in S.longest_repeats(docs).collect()} == want


def test_edge_rows(spark):
    long = " ".join(f"x{i}" for i in range(13))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (5, long + " tail"), (None, long), (6, "é " * 12 + "é"), (7, "é " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in S.deduplicate(docs).collect())
    assert out == [(0, 13, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 13, 0), (4, 13, 0), (5, 14, 13), (6, 13, 0), (7, 30, 30)]
    assert S.deduplicate(docs.where("doc_id > 99")).count() == 0
