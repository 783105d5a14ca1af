"""Every language is learned, however many there are and however long its documents are."""

from lodegrid.llm import language_id as L


def test_many_languages_and_long_texts(spark):
    rows = [(10 * k + i, f"text {k} of {i}", f"l{k:03}") for k in range(70) for i in range(1 + (k < 69))]
    rows.append((9999, "long words " * 5000, "long"))
    got = L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang"] for r in got} == {r[2] for r in rows} and len(got) == len(rows)
    assert max(len(r["text"]) for r in got) == L.LONGEST // 4


def test_scores_of_many_languages(spark):
    """Every language's code length and the scores that follow from them, against plain loops, over families of tables."""
    from .test_edges import brute_bits

    letters = [chr(97 + k % 26) + chr(0x430 + k % 32) + "xyz "[k % 4] for k in range(70)]
    rows = [(100 * k + i, " ".join(letters[(k * j + i) % 70] for j in range(9)), f"l{k:03}") for k in range(70) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in L.predict(docs, L.fit(docs)).collect()}
    train = {}
    for _, text, lang in rows:
        train.setdefault(lang, []).append(text)
    for doc, text, _ in rows[::41]:
        bits = brute_bits(train, text, L.ORDER)
        best = min(bits, key=lambda k: (round(bits[k], 3), k))
        assert abs(bits[out[doc]["lang_pred"]] - bits[best]) < 1e-2
        assert abs(out[doc]["score"] - 1 / sum(2 ** min(0, -(b - bits[best])) for b in bits.values())) < 1e-3


def test_tables_stay_small():
    """16 languages of 250 byte values: the tables take less than 300 MB while they are built."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    parts = []
    for k in range(16):
        p = (np.minimum(rng.zipf(1.3, (4, 60000)), 250) + 3 * k) % 250 + 1
        parts.append(np.unique(((p[0] * 257 + p[1]) * 257 + p[2]) * 257 + p[3]))
    langs, counts = np.repeat([f"l{k:02}" for k in range(16)], [len(p) for p in parts]).astype(object), np.concatenate(parts)
    tracemalloc.start()
    L.build(langs, counts, np.ones(len(counts), np.int64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300e6
