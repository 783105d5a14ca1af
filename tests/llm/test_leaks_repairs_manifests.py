"""Decontamination, repair and manifest: brute force, hand-made cases, and nulls, ties, long rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodegrid.llm import decontaminate as D
from lodegrid.llm import manifest as M
from lodegrid.llm import queries
from lodegrid.llm import repair as R

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_conversation_repair", "op13_merkle_manifest"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF)
    told = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(told.columns)
    rows = sorted(map(tuple, found.select(*told.columns).collect()), key=repr)
    assert rows == sorted(told.fetchall(), key=repr)


# Decontamination


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_leaks(docs, items, width):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                of = windows.get(tuple(w[i : i + k]))
                if of:
                    hit |= set(range(i, i + k))
                    found |= of
        out.append((doc, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1 << 20, 256])
def test_leaks(spark, most):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["a", "B", "c3", "é", "漢字", "d"]) for _ in range(n))
    items = [(1, say(14)), (1, say(6)), (2, say(3)), (3, "?! ..."), (4, None), (5, ""), (None, say(5)), (6, "one"), (7, say(40)), (10, say(5)), (9, "x y_z")]
    shared = items[8][1]
    docs = [(i, say(rng.randrange(60))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "--- !"), (103, "ONE"), (103, "ONE"), (None, f"{say(4)}, {shared}!"), (104, f"({shared.upper()}) tail, {items[0][1]}. {say(30000)}"), (105, "X y z"), (106, "x\x00y z\U0001f600")]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"items": F.lit("clash"), "doc": F.lit(1), "n_hit": F.lit(2), "hit": F.lit(3)})
    items_df = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))
    for width in (5, 10):
        found = D.scan(docs_df, items_df, width, most)
        got = sorted(((r["doc"]["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect()), key=repr)
        assert got == brute_leaks(docs, items, width)


def test_leaks_cut_out(spark):
    items = spark.createDataFrame([(1, "The quick, brown fox"), (2, "lazy dog")], "item_id int, text string")
    docs = spark.createDataFrame([("é: the QUICK brown-fox; and a lazy dog!", 7), ("clean text", 8), (None, 9), ("lazy dog lazy\tdog", 10)], "text string, kept int")
    out = {r["kept"]: r["text"] for r in D.without_spans(docs, items, 4).collect()}
    assert out == {7: "é: ; and a !", 8: "clean text", 9: None, 10: ""}
    assert sorted(r["kept"] for r in D.without_documents(docs, items, 4).collect()) == [8, 9]
    assert {r["kept"]: r["text"] for r in D.without_documents(docs, items, 4, 0.8).collect()}[7].endswith("lazy dog!")
    assert D.without_spans(docs, items.limit(0), 4).collect() == docs.collect()
    assert D.without_spans(docs.limit(0), items, 4).count() == 0


def test_segments_meet(spark):
    """Windows over the cut between two segments are there, and only once an item."""
    text = " ".join(f"w{i}" for i in range(3 * D.SEGMENT))
    items = spark.createDataFrame([(1, text)], "item_id int, text string")
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(k, k + 10))) for k in range(D.SEGMENT - 12, D.SEGMENT + 12)] + [(-1, text)], "doc_id long, text string")
    assert all(r["n_hit"] == r["n_words"] and r["items"] == ["1"] for r in D.scan(docs, items, clean=False).collect())


# Repair


def brute_repair(rows, costs=R.COSTS):
    """rows: (turn, role, text) in order. By all ways to edit, for short conversations."""
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
        seen.add((role, text))
    best = None

    def go(i, state, cost, audit, out):
        nonlocal best
        if cost > 2 * len(rows):  # what it costs to delete all
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if audit[-3:] != "III":
            for role in ("user", "assistant"):
                go(i, state, cost + costs["I"], audit + "I", [*out, (role, "")])
        if i < len(rows):
            _, role, text = rows[i]
            go(i + 1, state, cost + costs["D"], audit + "D", out)
            if faults[i] in (0, 3):
                more = costs["truncated"] * (faults[i] == 3)
                go(i + 1, state, cost + costs["K"] + more, audit + "K", [*out, (role, text)])
                for new in {"user", "assistant"} - {role}:
                    go(i + 1, state, cost + costs["R"] + more, audit + "R", [*out, (new, text)])

    go(0, 0, 0, "", [])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return (gaps, *[faults.count(k) for k in (1, 2, 3)], illegal, best[0], best[1], sha("\n".join(f"{r}:{t}" for r, t in best[2])))


def test_repairs(spark):
    rng = random.Random(3)
    roles, texts = ["system", "user", "assistant", "tool", "", "sage", "User"], ["Yes.", "no", "  \t", "Why?", "", "Ok!\n", "é漢."]
    chats = {k: [(t, rng.choices(roles, [1, 3, 3, 1, 1, 1, 1])[0], rng.choice(texts)) for t in sorted(rng.sample(range(9), rng.randrange(1, 5)))] for k in range(120)}
    chats[None] = [(None, "user", "Null id."), (3, "assistant", "Yes.")]
    chats[500] = [(2**62, "user", "Far."), (2**62, "user", "Far."), (2**62 + 5, "assistant", "Gone.")]
    rows = [(c, t, r, x) for c, said in chats.items() for t, r, x in said]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"late": F.lit(1), "h1": F.lit("clash"), "cost": F.lit(0.5)})
    out = R.repaired(frame.repartition(3)).collect()
    assert len(out) == len(chats)
    assert {r[0]: tuple(r)[1:] for r in out} == {c: brute_repair(said) for c, said in chats.items()}
    turns = defaultdict(list)
    for r in R.repaired(frame, summary=False).collect():
        turns[r["conv_id"]].append((r["position"], r["role"], r["text"], r["edit"]))
    for r in out:
        told = sorted(turns[r["conv_id"]])
        assert [t[0] for t in told] == list(range(len(told)))
        assert sha("\n".join(f"{a}:{b}" for _, a, b, _ in told)) == r["repaired_sha256"] and "".join(t[3] for t in told) == r["audit"].replace("D", "")


def test_repair_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, None, None), (1, 2, "user", "Hi."), (1, 3, None, "Null role."), (2, None, "user", None)]
    out = {r["conv_id"]: r for r in R.repaired(spark.createDataFrame(rows, schema)).collect()}
    assert (out[1]["blank"], out[1]["illegal"], out[1]["cost"], out[1]["audit"], out[1]["gaps"]) == (1, 2, 3, "DKR", 0)
    assert (out[2]["blank"], out[2]["cost"], out[2]["audit"], out[2]["repaired_sha256"]) == (1, 2, "D", sha(""))
    assert R.repaired(spark.createDataFrame([], schema)).count() == 0
    gone = R.damaged(spark.createDataFrame(rows, schema), F.lit(0))
    assert {tuple(r)[1:] for r in R.repaired(gone).collect()} == {(0, 0, 0, 0, 0, 0, "", sha(""))}
    twice = R.damaged(spark.createDataFrame(rows[1:2], schema), F.lit(3))
    assert [r["duplicate"] for r in R.repaired(twice).collect()] == [1]


def test_repair_of_a_long_conversation(spark):
    """40,000 rows, a third of them copies of one, and a text of 4 MB; weights against plain dynamic programming."""
    rng = random.Random(8)
    said = [("user", "Same.") if k % 3 == 0 else (rng.choice(["user", "assistant", "system"]), f"Text {k}" + rng.choice([".", ""])) for k in range(40000)]
    said[100] = ("user", "long " * 800000 + ".")
    frame = spark.createDataFrame([(1, k, *x) for k, x in enumerate(said)], "conv_id long, turn long, role string, text string")
    row = R.repaired(frame).first()
    cost = {"": 0, "s": 1 << 60, "u": 1 << 60, "a": 1 << 60}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    seen = set()
    for role, text in said:
        fault = 2 if (role, text) in seen else 0 if text[-1] == "." else 3
        seen.add((role, text))
        for _ in range(2):
            for q, to in after.items():
                cost[to] = min(cost[to], cost[q] + 5)
        new = {q: c + 2 for q, c in cost.items()}
        if fault != 2:
            for q, c in cost.items():
                if role[0] == after[q] or (role[0] == "s" and q == ""):
                    new[role[0]] = min(new[role[0]], c + (fault == 3) * 5)
                new[after[q]] = min(new[after[q]], c + 1 + (fault == 3) * 5)
        cost = new
    cost["a"] = min(cost["a"], cost["u"] + 5)
    assert row["cost"] == min(cost[""], cost["a"]) and row["duplicate"] == sum(k % 3 == 0 for k in range(40000)) - 1 - (100 % 3 == 0)


# Manifest


def brute_tree(digests):
    """The root, and for each leaf its steps: (place, siblings)."""
    under, nodes, steps = [[i] for i in range(len(digests))], list(digests), [[] for _ in digests]
    while len(nodes) > 1:
        runs = [range(a, min(a + 16, len(nodes))) for a in range(0, len(nodes), 16)]
        for run in runs:
            for k in run:
                for leaf in under[k]:
                    steps[leaf].append((k - run[0], "".join(nodes[j] for j in run if j != k)))
        nodes, under = [sha("".join(nodes[k] for k in run)) for run in runs], [[x for k in run for x in under[k]] for run in runs]
    return nodes[0], steps


@pytest.mark.parametrize("sizes", [(1,), (16, 17), (0, 1, 255, 257, 300), (1,) * 40])
def test_appending(sizes):
    for n in filter(None, sizes):
        digests = [sha(str(k)) for k in range(n)]
        tree = M.Append()
        for d in digests:
            tree.append(d)
        assert (tree.close(), tree.witness) == brute_tree(digests)


def test_manifest(spark):
    """Groups below, at and above a block, one of them in several rounds; repeated leaves; a null group."""
    rng = random.Random(2)
    sizes = {None: 3, "": 1, "a": M.BLOCK, "b": 2 * M.BLOCK + 1, "é": 17, **{f"s{k}": 1 for k in range(30)}}
    rows = [(g, k // 2 if g == "b" else k, sha(f"{g}{k // 4}")) for g, n in sizes.items() for k in range(n)] + [("é", None, sha("null"))]
    rng.shuffle(rows)
    leaves = spark.createDataFrame(rows, "grp string, key long, digest string").withColumn("root", F.lit("more"))
    out = M.manifest(leaves, ["root"]).withColumn("again", M.folded(F.col("digest"), F.col("steps"))).collect()
    assert len(out) == len(rows) and all(r["root"] == "more" and r["again"] == r["top"] for r in out)
    by = defaultdict(list)
    for g, k, d in rows:
        by[g].append((k is not None, k or 0, d))
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([d for *_, d in sorted(by[g])]) for g in order}
    top, upper = brute_tree([trees[g][0] for g in order])
    for r in out:
        own = trees[r["grp"]]
        assert r["sub"] == own[0] and r["top"] == top
        assert [tuple(s) for s in r["steps"]] == own[1][r["idx"]] + upper[order.index(r["grp"])]


def test_manifest_of_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (5, "ABC é", "x", "s", 5), (5, "ABC é", "x", "s", 5), (7, "", "", "", 0), (8, "A" * 3_000_000, "x", "s", -1), *[(k, f"Text {k}", "x", "t", k) for k in range(60)]]
    spark.createDataFrame(rows, schema).withColumn("digest", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    out = M.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(part(x) for x in (r[0], r[3], r[2], r[4], r[1])))
    assert sorted(r["leaf"] for r in out) == sorted(map(leaf, rows))
    changes = {leaf(r) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] != r[1].lower()}
    assert changes and all(r["verified"] == (r["leaf"] not in changes) for r in out)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert M.op13_merkle_manifest(spark, f"{tmp_path}/none").count() == 0


def test_proofs_are_right_at_any_partitioning(spark):
    rows = [("g", k, sha(str(k))) for k in range(5000)]
    leaves = spark.createDataFrame(rows, "grp string, key long, digest string")
    one, many = ({tuple(r["digest"]): (r["steps"], r["top"]) for r in M.manifest(leaves.repartition(n)).collect()} for n in (1, 7))
    assert one == many and len({t for _, t in one.values()}) == 1


def test_all_edits_by_hand():
    cases = {("ua", (0, 0)): (0, "KK"), ("", ()): (0, ""), ("s", (0,)): (2, "D"), ("uu", (0, 0)): (1, "KR"), ("au", (0, 0)): (2, "RR"), ("u", (3,)): (2, "D"), ("sua", (0, 0, 0)): (0, "KKK"), ("ss", (0, 0)): (2, "RR"), ("uau", (0, 0, 0)): (2, "KKD"), ("u", (0,)): (2, "D"), ("suau", (0,) * 4): (2, "KKKD")}
    for (roles, faults), told in cases.items():
        by_all = min((sum(c), "".join(a)) for a, c in _edits(roles, faults))
        assert R.lightest(roles, bytes(faults)) == by_all == told, (roles, faults)


def _edits(roles, faults, inserts=2):
    """All edits without more than a few inserts."""
    n = len(roles)
    for gaps in itertools.product(range(inserts + 1), repeat=n + 1):
        for own in itertools.product("DKR", repeat=n):
            for new in itertools.product("ua", repeat=sum(gaps) + own.count("R")):
                left, out, audit, cost = list(new), "", [], []
                for k in range(n + 1):
                    for _ in range(gaps[k]):
                        out, audit, cost = out + left.pop(0), [*audit, "I"], [*cost, 5]
                    if k < n:
                        e = own[k]
                        out += "" if e == "D" else roles[k] if e == "K" else left.pop(0)
                        audit, cost = [*audit, e], [*cost, {"D": 2, "K": 0, "R": 1}[e] + 5 * (e != "D" and faults[k] == 3)]
                if re.fullmatch("(s?(ua)+)?", out):
                    yield audit, cost
