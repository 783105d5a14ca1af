"""Copies are found, other pictures aren't; corners and votes by brute force."""

import numpy as np
from pyspark.sql import functions as F

from lodegrid.llm import media, queries

SF = "/root/testdata/sf0.001"


def test_op5(spark):
    out = queries.queries()["op5_image_copies"](spark, SF).collect()
    vectors = {r["vec_id"]: tuple(r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert len(out) == len(vectors)
    first = {}
    for i in sorted(vectors):
        first.setdefault(vectors[i], i)
    assert all(r["class_id"] == first[vectors[r["vec_id"]]] for r in out)
    asked = [r for r in out if r["vec_id"] % 50 == 0]
    assert all(r["n_found"] is None for r in out if r["vec_id"] % 50)
    assert sum(r["votes"] >= media.VOTES for r in asked) >= 0.9 * len(asked)  # recall
    assert sum(set(r["found"]) <= {r["class_id"]} for r in asked) >= 0.9 * len(asked)


def test_matches_by_brute_force(spark):
    rng = np.random.default_rng(5)
    pics = media.drawn(rng.normal(0, 0.125, (6, 64)))
    rows = [(i, *p.shape, bytearray(p.tobytes())) for i, p in enumerate(pics)]
    rows += [(90, 3, 3, bytearray(9)), (91, None, 4, bytearray(4)), (92, 4, 4, None), (93, 2, 2, bytearray(3))]
    codes = media.descriptors(spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary")).collect()
    assert {r["image_id"] for r in codes} == set(range(6))
    bare = media.descriptors(spark.createDataFrame([(None, *pics[0].shape, bytearray(pics[0].tobytes()))], "image_id long, height int, width int, pixels binary")).collect()
    assert sorted(map(tuple, ([r["x"], r["y"], r["code"][0]] for r in bare))) == sorted((r["x"], r["y"], r["code"][0]) for r in codes if r["image_id"] == 0)
    made = spark.createDataFrame(codes, "image_id long, x double, y double, scale double, angle int, code array<long>")
    got = {(r["q"]["image_id"], r["q"]["x"], r["q"]["y"], r["q"]["scale"], r["d"]["image_id"], r["d"]["x"], r["d"]["y"], r["d"]["scale"]) for r in media.matches(made, made).collect()}
    want = set()
    for a in codes:
        for b in codes:
            words = [(x ^ y) & (1 << 64) - 1 for x, y in zip(a["code"], b["code"])]
            if sum(w.bit_count() for w in words) <= media.RADIUS:
                want.add((a["image_id"], a["x"], a["y"], a["scale"], b["image_id"], b["x"], b["y"], b["scale"]))
    assert got == want


def test_no_vectors(spark):
    empty = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert media.descriptors(media.pictures(empty)).count() == 0
    assert media.pictures(empty.where(F.lit(False))).count() == 0


def test_every_pair_within_the_radius(spark):
    """Codes at 0 to 15 tests from a query, spread evenly, in one group or at random: matches are exactly those within."""
    rng = np.random.default_rng(7)
    q = rng.integers(0, 1 << 62, 4)
    rows = []
    for k in range(400):
        n = k % 16
        at = [rng.choice(256, n, replace=False), np.arange(n) * 32 % 256 + np.arange(n) // 8, rng.integers(0, 8) * 32 + np.arange(n)][k % 3]
        code = [int(x) for x in q]
        for b in at.tolist():
            code[b // 64] ^= 1 << b % 64
        rows.append((k, 0.0, 0.0, 1.0, 0, [c - (1 << 64) if c >> 63 else c for c in code], n))
    schema = "image_id long, x double, y double, scale double, angle int, code array<long>"
    one = spark.createDataFrame([(-1, 0.0, 0.0, 1.0, 0, [int(x) for x in q])], schema)
    many = spark.createDataFrame(rows, schema + ", n int")
    for radius in (8, 12, 15):
        got = [r["d"]["image_id"] for r in media.matches(one, many.drop("n"), radius).collect()]
        assert sorted(got) == [r[0] for r in rows if r[-1] <= radius]


def test_consensus_by_hand(spark):
    """Three matches of one motion are a copy; three of different motions aren't."""
    corner = "struct<image_id:long,x:double,y:double,scale:double,angle:int,code:array<long>>"
    at = lambda i, x, y: (i, float(x), float(y), 1.0, 0, [0, 0, 0, 0])
    same = [(at(1, x, y), at(2, x + 10, y - 3)) for x, y in ((5, 5), (30, 9), (18, 40))]
    other = [(at(1, x, y), at(3, x + 9 * k, y - 11 * k)) for k, (x, y) in enumerate(((5, 5), (30, 9), (18, 40)))]
    got = media.consensus(spark.createDataFrame(same + other, f"q {corner}, d {corner}")).collect()
    assert [(r["query_id"], r["image_id"], r["votes"]) for r in got] == [(1, 2, 3)]


def test_larger_images_have_more_corners():
    pic = media.drawn(np.random.default_rng(2).normal(0, 0.125, (1, 64)), 144)
    assert len(media.scales_of(144, 144)) > len(media.scales_of(72, 72)) and media.scales_of(20, 20) == [1.0]
    assert len(media.described(pic)["row"]) > 1.5 * len(media.described(pic[:, :72, :72])["row"])
