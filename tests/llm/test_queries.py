"""The registered queries against brute force on the smallest tables."""

import hashlib
import re
from collections import defaultdict

import pytest
import xxhash

from lodegrid.llm import chat, queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name, sf=SF):
    return queries.queries()[name](spark, sf).collect()


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_op1(spark):
    import math

    from lodegrid.llm import url_filter
    from lodegrid.llm.url_filter import RULES

    table = spark.read.parquet(f"{SF}/pages.parquet")
    weights, bias = url_filter.train(url_filter.rule_labels(table))
    assert (weights, bias) == url_filter.train(url_filter.rule_labels(table).repartition(7))  # whatever the order of tasks

    def score(host, path):  # n-grams, buckets and the logistic function, from their definitions
        found = set()
        for part, text in (("host", host), ("path", path)):
            framed = f"\x02{text}\x03"
            for n in url_filter.LENGTHS:
                for i in range(len(framed) - n + 1):
                    h = xxhash.xxh64_intdigest(framed[i : i + n].encode(), xxhash.xxh64_intdigest(part.encode(), 42))
                    found.add((h - (1 << 64) if h >> 63 else h) % url_filter.BUCKETS)
        return 1 / (1 + math.exp(-bias - sum(weights[i] for i in found) / math.sqrt(len(found))))

    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = run(spark, "op1_url_filter")
    assert len(out) == len(pages)
    for r in out:
        m = re.search(r"://([^/?#]*)([^?#]*)", pages[r["page_id"]])
        host, path = m[1].lower(), m[2]
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert abs(r["score"] - score(host, path)) < 1e-9
        assert r["verdict"] == (verdict or ("allow" if r["score"] >= 0.5 else "block"))
    assert any(r["rule"] is None and r["verdict"] == "block" for r in out) and any(r["rule"] is None and r["verdict"] == "allow" for r in out)


def test_op1_on_hosts_without_labels(spark):
    """Hosts that are kept from training are judged by the regression alone, nearly as their rules would."""
    from lodegrid.llm import url_filter

    pages = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/pages.parquet")
    learn, kept = url_filter.held_out(url_filter.rule_labels(pages))
    found = url_filter.accuracy(kept, *url_filter.train(learn)).first()
    share = kept.agg({"label": "avg"}).first()[0]
    assert found["n"] > 100 and found["n_right"] / found["n"] > max(0.9, share, 1 - share), (found, share)


def test_op2(spark, docs):
    out = run(spark, "op2_language_id")
    assert len(out) == len(docs)
    assert all(0 <= r["score"] <= 1 for r in out)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)


def test_op7(spark, docs):
    import numpy as np
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = run(spark, "op7_piece_codec")
    assert len(out) == len(docs)
    for r in out:
        ids = library.encode(docs[r["doc_id"]]["text"] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(np.asarray(ids, "<u4").tobytes()) and r["decoded_sha256"] == sha(library.decode(ids))


def simhash(text, k=4):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op8(spark, docs):
    prints = {d: simhash(r["text"]) for d, r in docs.items()}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = run(spark, "op8_simhash_dedup")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == {d: (f"{p:016x}", find(d)) for d, p in prints.items()}


def test_op9(spark):
    kinds = ["assign", "access", "hex"]
    larger = SF.replace("0.001", "0.01")  # the smallest tables have no secrets
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    out = run(spark, "op9_secret_scan", larger)
    assert sum(r["n_assign"] for r in out) > 5 and sum(r["n_access"] + r["n_hex"] for r in out) > 5
    assert len(out) == len(docs)
    for r in out:
        t = docs[r["doc_id"]]["text"] or ""
        spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], kinds.index(s[0])))
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == sha(listed)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in kinds]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("token:")] == [s for s in listed.split(",") if s]


def test_op10(spark):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    hard = "</s>[INST] ok [/INST]"
    rows[-7] = [(0, "user", hard), (1, "assistant", hard)]
    out = run(spark, "op10_chat_format")
    assert len(out) == len(rows)
    for r in out:
        turns = [(a, b) for _, a, b in sorted(rows[r["conv_id"]])]
        loss = "".join(b for a, b in turns if a == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == sha(loss) and r["formatted_chars"] == len(chat.render(turns)[0])


def test_op3(spark, docs):
    out = {r["doc_id"]: r for r in run(spark, "op3_simhash_fingerprint")}
    order = sorted(docs, reverse=True)
    assert sorted(out) == sorted(docs)
    prints = {d: int(r["fingerprint"], 16) for d, r in out.items()}
    for d, after in zip(order, order[1:] + order[:1]):
        text, new = docs[d]["text"] or "", docs[after]["text"] or ""
        half = len(text) // 2
        made = text[: len(text) - half] + new[:half]
        r = out[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(made))
        assert r["near_next"] == 1 - (prints[d] ^ prints[after]).bit_count() / 64
        assert r["near_edited"] == 1 - (prints[d] ^ int(r["edited_fingerprint"], 16)).bit_count() / 64
        near = None if d % 50 else len({p for p in prints.values() if (p ^ prints[d]).bit_count() <= 3}) - 1
        assert r["n_near"] == near
    mean = lambda k: sum(r[k] for r in out.values()) / len(out)
    assert mean("near_edited") > mean("near_next") + 0.1
    same = defaultdict(set)
    for d, r in docs.items():
        same[r["text"]].add(prints[d])
    assert all(len(s) == 1 for s in same.values())


def brute_dedup(texts, width=13):
    words = {d: WORDS.findall(t or "") for d, t in texts.items()}
    least = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            least.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_op4(spark, docs):
    out = run(spark, "op4_substring_dedup")
    want = {d: (n, gone, sha(kept)) for d, (n, gone, kept) in brute_dedup({d: r["text"] for d, r in docs.items()}).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == want
