"""Linking and components against brute force, also where fingerprints are dense or differ in the highest bit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegrid.llm import simhash_dedup as S


def brute(prints, radius):
    ids = list(range(len(prints)))
    root = ids[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


@pytest.mark.parametrize("radius,block", [(4, 1 << 14), (9, 1 << 14), (4, 50)])
def test_components(spark, radius, block):
    rng = random.Random(radius + block)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):  # drifting copies; flips in any bit, the highest included
        x = rng.choice(prints)
        for _ in range(rng.randint(0, radius + 2)):
            x ^= 1 << rng.choice([63, 0, rng.randrange(64)])
        prints.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    rows = spark.createDataFrame([(i, x, x) for i, x in enumerate(signed)], "doc_id long, fp long, node long")
    nodes = S.with_vertices(rows, F.min("fp").alias("fp"))
    links = S.components(S.stars(S.dealt(nodes, S.plan(nodes, radius)), radius, block=block))
    root = {r["node"]["node"]: r["root"]["least"] for r in links.collect()}
    assert [root.get(x, signed.index(x)) for x in signed] == brute(prints, radius)


def test_large_groups_by_breadth():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.concatenate([fp, *[fp ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(70)]])
    label = S.compare(np.zeros(len(fp), np.int64), np.zeros(len(fp), bool), fp, None, 4, 0)
    assert label.tolist() == brute([int(x) for x in fp], 4)


def test_thresholds_add_up():
    groups = [list(range(16 * k, 16 * k + 16)) for k in range(4)]
    both = np.full((64, 64), 25) + np.eye(64, dtype=int) * 25
    _, t = S.thresholds(100, both, groups, [5.0, 1.0, 1.0, 9.0], 4)
    assert sum(t) == 4 - 4 + 1 and all(x >= -1 for x in t)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \t"), (4, "one two"), (5, "ONE  two\n"), (6, "one two three four five"), (None, "one two"), (None, None), (4, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("mine")).withColumn("node", F.lit(1))
    out = S.near_duplicates(docs.drop("node")).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in out if r["doc_id"]}
    assert got[1] == got[2] == got[3] == (0, 1) and got[4] == got[5] and got[4][1] == 4 and got[6][1] == 6
    kept = S.deduplicated(docs).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [1, 4, 6]
    assert S.deduplicated(docs).columns == docs.columns
    assert S.near_duplicates(docs.where("doc_id > 99").drop("node")).count() == 0


def sets_of(text):
    w = [x.lower() for x in text.split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_exact_links_by_brute_force(spark):
    """Dense groups, chains and sets that stay apart; also where a component is dealt out in blocks."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(4)]
    for _ in range(120):
        words = rng.choice(texts).split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(60)] = f"w{rng.randrange(300)}"
        texts.append(" ".join(words))
    texts = sorted(set(texts)) + ["A b", "a  B", "a c", ""]
    sets = [sets_of(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                    root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "key string, doc_id long, text string")
    prints = S.set_fingerprints(docs, 2, 4, 5)
    nodes = S.with_vertices(prints, F.first("size").alias("size"), F.min(F.struct("doc_id", "key")).alias("f")).withColumn("key", F.col("f.key"))
    members = nodes.where("size > 0").withColumn("root", F.struct(F.lit(False).alias("late"), F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("node")))
    node = {r["doc_id"]: r["node"] for r in prints.collect()}
    for most in (1 << 20, 1500):
        out = S.rooted(nodes.select(*S.VERTEX), S.exact_links(members, docs.select("key", "text"), most=most)).collect()
        got = {r["node"]: r["root"]["least"] for r in out}
        assert [got[node[i]] for i in range(len(texts))] == root


def test_similar_texts_are_found(spark):
    """Pairs of a similarity of 0.8 and more: few are lost, and none below hang together alone."""
    rng = random.Random(9)
    rows, likeness = [], {}
    for k in range(300):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([60, 150, 400]))]
        other = list(words)
        if k % 2:  # one passage
            at = rng.randrange(len(words) - len(words) // 8)
            other[at : at + rng.randint(0, len(words) // 9)] = [f"v{rng.randrange(2000)}" for _ in range(rng.randint(0, len(words) // 9))]
        else:
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                other[rng.randrange(len(words))] = f"v{rng.randrange(2000)}"
        a, b = " ".join(words), " ".join(other)
        rows += [(2 * k, a), (2 * k + 1, b)]
        likeness[2 * k] = len(sets_of(a) & sets_of(b)) / len(sets_of(a) | sets_of(b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints, nodes = S.similar_nodes(docs.withColumn("key", F.col("doc_id").cast("string")))
    found = prints.join(nodes, "node").collect()
    root = {r["doc_id"]: r["root"]["least"] for r in found}
    near = [k for k, j in likeness.items() if j >= 0.8]
    assert sum(root[k] == root[k + 1] for k in near) >= 0.95 * len(near) > 100
    assert not any(root[k] == root[k + 1] for k, j in likeness.items() if j < 0.8)
