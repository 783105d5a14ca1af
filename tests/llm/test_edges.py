"""Null, empty, repeated and very long rows, empty tables and clashing columns, for each operator; small brute-force models."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodegrid.llm import chat, fingerprints, language_id, mixing, pieces, secrets, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, None), (2, "", "a", "s", 0), (3, " \n\t", "a", "s", 3), (4, "x", "b", None, 1), (4, "x", "b", None, 1), (None, "null id", "a", "t", 7), (5, "é漢😀 " * 40000, "b", "t", 160000), (6, "12 34", None, "s", 5)]
    return spark.createDataFrame(rows, SCHEMA)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.ORG/es/1?x#y", "a://b://c/d", "x://example.org.evil.com/de/", "s://sub.com?q=/fr/", "http://é.com/fr/a"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    weights, bias = url_filter.train(url_filter.rule_labels(pages), 64, steps=2)
    out = {r["page_id"]: r for r in url_filter.judge(pages, weights, bias).collect()}
    assert len(out) == len(urls)
    assert (out[0]["host"], out[0]["path"], out[0]["rule"]) == ("", "", None)
    assert (out[4]["host"], out[4]["path"], out[4]["rule"], out[4]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (out[5]["host"], out[5]["path"]) == ("b:", "//c/d")
    assert out[6]["rule"] == "com/de/" and out[7]["rule"] is None and out[7]["host"] == "sub.com" and out[8]["rule"] == "com/fr/"
    none = url_filter.train(spark.createDataFrame([], "url string, label int"), 64)
    assert none == ([0.0] * 64, 0.0) and url_filter.judge(pages.limit(0), *none).count() == 0


def test_regression_learns(spark):
    rows = [(f"http://{'good' if i % 2 else 'bad'}{i}.net/p/{i}", i % 2) for i in range(200)]
    model = url_filter.train(spark.createDataFrame(rows[:150], "url string, label int"), 512)
    pages = spark.createDataFrame(rows[150:], "url string, label int")
    out = url_filter.judge(pages, *model, rules=()).collect()
    assert sum((r["verdict"] == "allow") == r["label"] for r in out) >= 48
    # The score by hand: mean-root sum of the weights of the distinct buckets.
    grams = pages.select(url_filter.features(*url_filter.split_url(F.col("url")), 512).alias("g"), "url").collect()
    by_hand = {r["url"]: 1 / (1 + math.exp(-(model[1] + sum(model[0][g] for g in r["g"]) / math.sqrt(len(r["g"]))))) for r in grams}
    assert all(abs(by_hand[r["url"]] - r["score"]) < 1e-9 for r in out)


def brute_bits(texts_by_lang, text, order):
    """Code length of text under PPM, method C with exclusion, by plain loops."""
    counts = {lang: defaultdict(Counter) for lang in texts_by_lang}
    for lang, texts in texts_by_lang.items():
        for t in texts:
            b = [0] * order + [x + 1 for x in t.encode()]
            for i in range(order, len(b)):
                for k in range(order + 1):
                    counts[lang][tuple(b[i - k : i])][b[i]] += 1
    out = {}
    for lang, table in counts.items():
        b, bits = [0] * order + [x + 1 for x in text.encode()], 0.0
        for i in range(order, len(b)):
            out_of = set()
            for k in range(order, -1, -1):
                c = table.get(tuple(b[i - k : i]))
                if not c:
                    continue
                left = {s: n for s, n in c.items() if s not in out_of}
                total, kinds = sum(left.values()), len(left)
                if b[i] in left:
                    bits += math.log2((total + kinds) / left[b[i]])
                    break
                if kinds:
                    bits += math.log2((total + kinds) / kinds)
                out_of |= set(c)
            else:
                bits += math.log2(max(256 - len(out_of), 1))
        out[lang] = bits
    return out


def test_code_lengths(spark):
    train = {"a": ["abracadabra abba", "cab bad", "dead beef"], "b": ["hello world", "yellow low mellow", "über"]}
    rows = [(t, lang) for lang, ts in train.items() for t in ts]
    for order in (1, 2, 3):
        c = language_id.gram_counts(spark.createDataFrame(rows, "text string, lang string"), order).toPandas()
        model = language_id.build(c["lang"].to_numpy(object), c["gram"].to_numpy(), c["n"].to_numpy(), order)
        for text in ("abba", "zebra über x", "", "mellow cab\n", "日"):
            data = np.frombuffer(text.encode(), np.uint8)
            for step in (1 << 20, 3):
                got = language_id.code_lengths(model, data, np.array([0, len(data)]), step)[0]
                want = brute_bits(train, text, order)
                assert np.allclose(got, [want["a"], want["b"]], rtol=1e-5)


def test_language_rows(spark, odd):
    model = language_id.fit(odd)
    out = language_id.predict(odd.withColumn("score", F.lit("clash")), model).collect()
    assert len(out) == 8 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (1, 2, 3, 6))
    assert all(r["lang_pred"] in ("a", "b") for r in out if r["doc_id"] in (4, 5))
    none = language_id.fit(odd.where("lang = 'z'"))
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.predict(odd.limit(0), model).count() == 0


def test_fingerprint_rows(spark):
    rows = [(i * 3, f"doc {i} " + " ".join(f"w{(i * j) % 17}" for j in range(i % 9))) for i in range(60)] + [(None, "last one"), (30, None), (30, "doc 10"), (30, "doc 10")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit(1))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    want = sorted((a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1]))
    for least in (1000, 7):
        got = sorted((r["text"], r["next_text"]) for r in fingerprints.followed(docs, least=least).where("end = 0").collect())
        assert got == want
    prints = fingerprints.pair_prints(docs).collect()
    assert len(prints) == len(rows) and all(p["fp"] is not None and p["next_fp"] is not None for p in prints)
    assert fingerprints.pair_prints(docs.limit(0)).count() == 0
    one = fingerprints.pair_prints(docs.where("doc_id = 3")).first()
    assert one["fp"] == one["next_fp"]


def test_blocks_have_equally_many_rows(spark):
    """One far id, an id of thousands of rows and null ids: no block is much larger than the others."""
    docs = spark.range(20000).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    same = docs.limit(10000).select(F.lit(77).cast("long").alias("id"), F.concat("text", F.lit(" again")).alias("text"))
    rows = docs.union(same).union(docs.limit(3000).select(F.lit(None).cast("long"), "text")).union(spark.createDataFrame([(1 << 50, "far")], "id long, text string")).withColumnRenamed("id", "doc_id")
    got = fingerprints.followed(rows, least=500)
    assert got.where("end = 0").count() == rows.count() and got.where("end = 0 AND next_text IS NULL").count() == 0
    sizes = [r["count"] for r in got.groupBy("block").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 1500


def test_fingerprints_by_brute_force(spark):
    """Words, runs of three, weights and votes again from the text, as op3 has them."""

    def spark_hash(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else p.to_bytes(8, "little"), h)
        return h

    def plain(text):
        w = [spark_hash(x.encode()) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
        if 0 < len(w) < 3:
            h = 0
            for x in w:
                h = spark_hash(h, x)
            t = [h]
        else:
            t = [spark_hash(spark_hash(a, b), c) for a, b, c in zip(w, w[1:], w[2:])]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in t) > len(t))

    rng = random.Random(8)
    texts = ["", "one", "one two", "a b c", " x\ty \n"] + [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(80))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprints.pair_prints(docs).collect():
        text = texts[r["doc_id"]]
        after = texts[r["doc_id"] - 1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert [r[c] & (1 << 64) - 1 for c in ("fp", "edited_fp", "next_fp")] == [plain(text), plain(edited), plain(after)]


def test_votes_by_hand(spark):
    rng = random.Random(1)
    terms = [(k, rng.getrandbits(64) - (1 << 63)) for k in range(4) for _ in range(k * 7)] + [(9, None)]
    got = {r["k"]: r["fp"] for r in fingerprints.voted(spark.createDataFrame(terms, "k long, h long"), ["k"], "h").collect()}
    for k in (1, 2, 3):
        own = [h for j, h in terms if j == k]
        want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in own) > len(own))
        assert got[k] & (1 << 64) - 1 == want
    assert got[9] == 0


def test_radius_search(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = base + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for x in base for _ in range(5)]
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    q = df.limit(20).select(F.col("fp").alias("query_fp"))
    asked = {r[0] for r in q.collect()}
    for radius, blocks in ((3, 6), (2, 4), (0, 1)):
        got = sorted((r["query_fp"], r["fp"], r["distance"]) for r in fingerprints.near(df, q, radius, blocks).collect())
        want = sorted((a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a in asked for b in set(signed) if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius)
        assert got == want


def test_mix_rows(spark, odd):
    out = mixing.mix(odd.withColumn("target", F.lit("clash"))).collect()
    assert len(out) == 8 and {r["size"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert len({r["copies"] for r in out if r["doc_id"] == 4}) == 1
    assert mixing.mix(odd.limit(0)).count() == 0
    for sizes in ({"a": 10, "b": 1000, "c": 5, "d": 300, None: 77}, {"a": 0}, {"x": 5}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        want, total, full = {}, 1.5 * sum(sizes.values()), set()
        while True:  # the repeated way
            left = [s for s in names if s not in full]
            rest = total - sum(2 * sizes[s] for s in full)
            want = {s: 2 * sizes[s] if s in full else rest * weight[s] / sum(weight[t] for t in left) for s in names}
            over = {s for s in left if want[s] > 2 * sizes[s]}
            if not over:
                break
            full |= over
        assert all(abs(got[s] - want[s]) < 1e-6 for s in names)


def test_pieces_rows(spark, odd):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode_column(odd.withColumn("ids", F.lit("clash")), path).collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == library.decode(ids)


def test_pieces_like_the_library():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = pieces.Pieces(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    rng, letters, chars = random.Random(3), "abcthe ing  \n\t▁eéß漢字😀<0x0A>s/</s>0129.,;-_\x00 ", sorted(own.chars)
    for k in range(4000):
        s = "".join(rng.choice(letters if k % 3 else chars) for _ in range(rng.randint(0, 60)))
        ids = library.encode(s)
        assert np.frombuffer(own.encode(s), "<u4").tolist() == ids and own.decode(ids) == library.decode(ids)
        made = [rng.randrange(3, 700 if k % 2 else 32000) for _ in range(rng.randint(0, 8))]
        assert own.decode(made) == library.decode(made)
    long = " " * 3000 + "a" * 3000 + "ab" * 1500
    assert np.frombuffer(own.encode(long), "<u4").tolist() == library.encode(long)


def test_secret_rows(spark, odd):
    key, shared = "AKIA" + "B2C3D4E5F6G7H8J9", "token=abcdef123456"
    bare = "Zx9Qw8Er7Ty6Ui5Op4As3"
    rows = [(100 + i, f"{shared} and {key if i == 0 else ''} {bare if i < 2 else ''}", "en", f"s{i}", 1) for i in range(4)]
    docs = odd.unionByName(spark.createDataFrame(rows, SCHEMA))
    out = {}
    for r in secrets.secrets(docs.withColumn("spans", F.lit(1)), F.col("source"), F.col("doc_id")).collect():
        out.setdefault(r["doc_id"], []).append([(s["kind"], s["start"], s["stop"], s["live"]) for s in r["spans"]])
    assert sum(map(len, out.values())) == 12 and out[4] == [[], []] and out[1] == [[]]
    assert out[100] == [[("assign", 0, 18, False), ("access", 23, 43, True), ("token", 44, 65, True)]]
    assert out[102] == [[("assign", 0, 18, False)]]
    masked = {r["doc_id"]: r["text"] for r in secrets.mask(docs, F.col("source"), F.col("doc_id")).collect()}
    assert masked[100] == f"{shared} and [secret] [secret]" and masked[103].startswith(shared) and masked[1] is None
    assert secrets.secrets(docs.limit(0), F.col("source"), F.col("doc_id")).count() == 0


def test_masks_that_meet(spark):
    rows = [(1, 'x token = "0123456789abcdef0123456789abcdef"-tail y', "s"), (2, "password=0123456789abcdef0123456789abcdefzz q", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in secrets.mask(docs, F.col("source"), F.col("doc_id")).collect()}
    assert got == {1: 'x [secret]"-tail y', 2: "[secret] q"}


def test_chat_texts():
    rng = random.Random(5)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "<", "[", "\\", "a", "\n", "é", "]", ">", "/"]
    for _ in range(3000):
        turns = [("".join(rng.choices(parts, k=rng.randint(0, 3))), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for _ in range(rng.randint(0, 4))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]
        assert not any(re.search(r"</?s>|\[/?INST\]", chat.escape(t)) for _, t in turns)


def test_loss_spans_by_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        cuts = sorted(rng.sample(range(60), 12))
        tokens = np.array(sorted((a, b) for a, b in zip(cuts, cuts[1:])))
        ends = sorted(rng.sample(range(60), 6))
        turns = np.array([(ends[i], ends[i + 1]) for i in (0, 2, 4)])
        for (a, b), (lo, hi) in zip(tokens, chat.loss_spans(tokens, turns)):
            parts = [(max(a, x), min(b, y)) for x, y in turns if max(a, x) < min(b, y)]
            assert (lo, hi) == ((parts[0][0], parts[-1][1]) if parts else (0, 0))


def test_chat_rows(spark):
    import public_tokenizers

    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, 0, "assistant", "é漢 </s>"), (2, None, "assistant", "b"), (2, 0, "assistant", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = {r["conv_id"]: r for r in chat.format_chats(table, path).collect()}
    assert chat.parse(made[1]["formatted"]) == [("user", ""), ("", "x"), ("assistant", ""), ("assistant", "")]
    assert chat.parse(made[None]["formatted"]) == [("assistant", "é漢 </s>")] and chat.parse(made[2]["formatted"]) == [("assistant", "b"), ("assistant", "a")]
    for r in made.values():
        spans = np.array(list(zip(r["loss_from"], r["loss_to"]))).reshape(-1, 2)
        assert chat.masked_text(r["formatted"], spans) == "".join(t for role, t in chat.parse(r["formatted"]) if role == "assistant")
    assert chat.format_chats(table.limit(0), path).count() == 0


def test_tokenizer_files_are_not_in_the_repository():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    assert not [p for p in root.rglob("*") if p.suffix in (".model", ".tiktoken")]
