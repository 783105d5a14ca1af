"""Queries without SQL take every row; none runs over a subset."""

from collections import defaultdict

from lodegrid.operators import merge
from lodegrid.plans import catalogue as C

SF = "/root/testdata/sf0.001"


def test_every_row_is_a_box(spark):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    boxes = [r.asDict() for r in C.row_boxes(spark, SF).collect()]
    assert len({(b["frame_id"], b["box_idx"]) for b in boxes}) == len(boxes) == n
    assert C.QUERIES["tracks"](spark, SF).count() == C.QUERIES["wall_memory"](spark, SF).count() == n
    frames, named = defaultdict(list), defaultdict(set)
    for b in boxes:
        frames[b["frame_id"]].append(b)
    merged = [(f, b["box_idx"], b["cx"], b["sx"]) for f, part in frames.items() for b in merge.merge_peers(part, 2.0)]
    assert sorted((r["frame_id"], r["box_idx"], r["cx"], r["sx"]) for r in C.QUERIES["merged_boxes"](spark, SF).collect()) == sorted(merged)

    def shared(a, b):
        v = [max(0.0, min(a[f"c{c}"] + a[f"s{c}"] / 2, b[f"c{c}"] + b[f"s{c}"] / 2) - max(a[f"c{c}"] - a[f"s{c}"] / 2, b[f"c{c}"] - b[f"s{c}"] / 2)) for c in "xyz"]
        return v[0] * v[1] * v[2] / min(a["sx"] * a["sy"] * a["sz"], b["sx"] * b["sy"] * b["sz"])

    pairs = {(f, a["box_idx"], b["box_idx"]) for f, part in frames.items() for a in part for b in part if a["box_idx"] < b["box_idx"] and shared(a, b) > 0}
    assert {(r["frame_id"], r["i"], r["j"]) for r in C.QUERIES["overlap_pairs_all"](spark, SF).collect()} == pairs
    for f, part in frames.items():
        for b in sorted(part, key=lambda b: (-(b["sx"] * b["sy"] * b["sz"]), b["box_idx"])):
            if all(shared(k, b) <= 0.5 for k in part if k["box_idx"] in named[f]):
                named[f].add(b["box_idx"])
    assert {(r["frame_id"], r["box_idx"]) for r in C.QUERIES["suppressed_boxes"](spark, SF).collect()} == {(f, i) for f, ids in named.items() for i in ids}


def test_every_frame(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    n, frames = lines.count(), {(r[0] // 3000, r[0] // 300 % 10) for r in lines.select("l_orderkey").distinct().collect()}
    per = C.QUERIES["rejection"](spark, SF).collect()
    assert {(r["seq_id"], r["frame_id"]) for r in per} == frames and len(per) == len(frames) and sum(r["n"] for r in per) == n
    assert C.QUERIES["voxel_adjacency_all"](spark, SF).select("frame_id").distinct().count() == 50
    assert C.QUERIES["ply_map"](spark, SF).where("part = 1").count() == n
