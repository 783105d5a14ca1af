"""Cases in which an operator once did less than its whole job."""

import numpy as np

from lodegrid.llm import simhash_dedup as S


def test_repeated_lines_make_no_copies(spark):
    rng = np.random.default_rng(11)
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    line = own(20)
    body = own(500)
    rows = [(1, f"{own(500)} {' '.join([line] * 50)}"), (2, f"{own(500)} {' '.join([line] * 50)}")]  # a set similarity near 0.02
    rows += [(3, f"{body} {' '.join([line] * 5)}"), (4, f"{body} {' '.join([line] * 90)}")]  # equal sets
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.deduplicated(docs).collect()) == [1, 2, 3]


def test_a_long_list_of_keys_takes_time_in_proportion():
    import random
    import time

    from lodegrid.llm import secrets

    rng = random.Random(4)
    line = lambda: f"key_{rng.randrange(1 << 30)}: password={rng.randrange(1 << 60):x} {rng.randrange(1 << 120):x} Zx9{rng.randrange(1 << 90):x}Qw/{rng.randrange(99)}\n"
    text = "".join(line() for _ in range(50_000))
    assert len(text) > 5_000_000
    began = time.perf_counter()
    found = secrets.candidates(text)
    assert len(found) > 100_000 and time.perf_counter() - began < 60
    # Against all pairs, for a part of it.
    part = text[:20_000]
    base = [(k, m.start(), m.end()) for k, p, g, n in secrets.BASE for m in p.finditer(part) if len(m[g]) >= n]
    tokens = [("token", m.start(), m.end()) for m in secrets.TOKEN.finditer(part) if sum(map(str.isdigit, m[0])) >= secrets.DIGITS and secrets.entropy(m[0]) >= secrets.BITS and not any(a < m.end() and m.start() < b for _, a, b in base)]
    assert sorted(base + tokens) == sorted(x[:3] for x in secrets.candidates(part)) and tokens


def test_a_long_word_with_a_character_outside_the_vocabulary():
    import time

    import public_tokenizers
    import sentencepiece

    from lodegrid.llm import pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = pieces.Pieces(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(6)
    letters = [c for c in sorted(own.chars) if c > "　"] + list("abcdefghij")
    text = "".join(rng.choice(letters, 500_000)) + "\U0001fae8" + "".join(rng.choice(letters, 500_000)) + "\U0001fae8\U0001fae8 \U0001fae8 x"
    merged = []
    plain, own.merge = own.merge, lambda t: merged.append(len(t)) or plain(t)
    began = time.perf_counter()
    ids = own.encode(text)
    assert time.perf_counter() - began < 60
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
    assert max(merged) < 200  # pairs of tokens and single characters only
