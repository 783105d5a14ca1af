"""A Merkle manifest of a dataset, with a witness for every row.

Leaves are appended in order. A tree has an open run of nodes on each level; a run that is full (16 nodes) becomes their
hash, which is appended on the level above. A leaf gets its siblings of the lowest level when its run closes, and what
its subtree's root gets on closing a run higher up extends the witnesses of all leaves below, which share that part.

Rows are sorted by a range exchange, so that a group may be larger than any task. Aligned blocks of 16 ** 3 leaves are
appended by one task each; the blocks' roots are the leaves of the next round, until one node is left for each group.
Going back, what a block's root was given is joined to the block, a row for a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, checkpointed, read

#: Nodes of a run, levels of a block.
ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
#: A step of a witness: how many siblings stand before the node, and all its siblings' digests in a row (64 digits each).
STEP = "struct<place:int,others:string>"


def joined(*parts: Column) -> Column:
    """sha256 of the parts: each `-` if null, else its UTF-8 byte count, a colon, and itself."""
    said = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*said), 256)


class Append:
    """A tree that grows by whole nodes from the left. witness[i]: the steps of leaf i so far."""

    def __init__(self, height: int | None = None):
        self.height = height
        #: By level, the open run: digests and the first leaf under each; no run of `height` is open.
        self.runs: list[tuple[list[str], list[int]]] = []
        self.witness: list[list[tuple[int, str]]] = []

    def append(self, digest: str) -> None:
        self.witness.append([])
        self._put(0, digest, len(self.witness) - 1)

    def _put(self, level: int, digest: str, first: int) -> None:
        while len(self.runs) <= level:
            self.runs.append(([], []))
        digests, firsts = self.runs[level]
        digests.append(digest)
        firsts.append(first)
        if len(digests) == ARITY and (self.height is None or level < self.height):
            self._close(level)

    def _close(self, level: int) -> None:
        """Makes the open run one node of the level above; all leaves under it learn their siblings."""
        digests, firsts = self.runs[level]
        self.runs[level] = ([], [])
        ends = [*firsts[1:], len(self.witness)]
        for place, (a, b) in enumerate(zip(firsts, ends)):
            step = (place, "".join(digests[:place] + digests[place + 1 :]))
            for leaf in self.witness[a:b]:
                leaf.append(step)
        self._put(level + 1, hashlib.sha256("".join(digests).encode()).hexdigest(), firsts[0])

    def close(self) -> str:
        """The root: open runs close from below, up to `height` or until one node is left."""
        level = 0
        while True:
            alone = len(self.runs[level][0]) == 1 and level == len(self.runs) - 1
            if level == self.height or (self.height is None and alone):
                return self.runs[level][0][0]
            if self.runs[level][0]:
                self._close(level)
            level += 1


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx, the place of each in its group by the order (nulls first), from 0, and n, the group's size.

    A range exchange deals out whole ranges, equal rows included; places are counts before a range, and within it."""
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())  # equal rows may part; which is which doesn't matter
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    dealt = checkpointed(spread.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(group)
    before = F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(by).alias("n"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*keys[1:])) - 1
    placed = dealt.withColumn("_within", within)
    out = placed.join(counts, placed[group].eqNullSafe(counts["_g"]) & (placed["_part"] == counts["_p"]))
    return out.withColumn("idx", F.col("_before") + F.col("_within")).drop("_tie", "_part", "_g", "_p", "_before", "_within")


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (grp, block) after another, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(batch.column("grp").to_pylist(), batch.column("block").to_pylist()))
        at = 0
        for k, key in enumerate(keys):
            if key != last:
                if k > at:
                    held.append(batch.slice(at, k - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, last = [], k, key
        if len(keys) > at:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def grown(digests: list[str], n: int) -> tuple[Append, str]:
    """The tree of a block, of a group of n nodes (of full height if the group has other blocks), and its root."""
    tree = Append(LEVELS if n > BLOCK else None)
    for digest in digests:
        tree.append(digest)
    return tree, tree.close()


def dealt(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, idx, ...) by aligned blocks of BLOCK, which one task reads in order; block is added where it isn't there."""
    keyed = nodes if "block" in nodes.columns else nodes.withColumn("block", F.expr(f"idx div {BLOCK}"))
    return keyed.repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")


def roots(nodes: DataFrame) -> DataFrame:
    """grp, idx, n, digest: the root of each block, as a node of the next round."""
    kind = nodes.schema["grp"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blocks(batches):
            n = rows.column("n")[0].as_py()
            digest = grown(rows.column("digest").to_pylist(), n)[1]
            yield pa.record_batch({"grp": rows.column("grp").slice(0, 1).combine_chunks(), "idx": rows.column("block").slice(0, 1).combine_chunks(), "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": pa.array([digest], pa.string())})

    return dealt(nodes.select("grp", "idx", "n", "digest")).mapInArrow(work, f"grp {kind}, idx long, n long, digest string")


def extended(nodes: DataFrame, known: DataFrame, more: list[str]) -> DataFrame:
    """grp, idx, digest, more, steps, sub, top: for each node, its siblings up to the top.

    known: grp, idx, steps, sub, top: what the root of block idx was given higher up; it comes first in the block's rows."""
    kind = nodes.schema["grp"].dataType.simpleString()
    types = {c: nodes.schema[c].dataType.simpleString() for c in more}
    kept = nodes.select("grp", "idx", "n", "digest", *more, F.expr(f"idx div {BLOCK}").alias("block"))
    above = known.select("grp", F.lit(-1).cast("long").alias("idx"), F.col("idx").alias("block"), "steps", "sub", "top")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blocks(batches):
            head, rows = rows.slice(0, 1).to_pylist()[0], rows.slice(1).combine_chunks()
            tree, _ = grown(rows.column("digest").to_pylist(), rows.column("n")[0].as_py())
            later = [(s["place"], s["others"]) for s in head["steps"]]
            for a in range(0, rows.num_rows, 512):
                part = rows.slice(a, 512)
                steps = [[{"place": p, "others": o} for p, o in [*own, *later]] for own in tree.witness[a : a + 512]]
                out = {c: part.column(c).combine_chunks() for c in ("grp", "idx", "digest", *more)}
                out |= {"steps": pa.array(steps, pa.list_(pa.struct({"place": pa.int32(), "others": pa.string()})))}
                out |= {c: pa.array([head[c]] * part.num_rows, pa.string()) for c in ("sub", "top")}
                yield pa.record_batch(out)

    columns = ["grp kind", "idx long", "digest string", *[f"`{c}` {t}" for c, t in types.items()], f"steps array<{STEP}>", "sub string", "top string"]
    return dealt(kept.unionByName(above, allowMissingColumns=True)).mapInArrow(work, ", ".join(columns).replace("grp kind", f"grp {kind}"))


def climbed(nodes: DataFrame, more: list[str], then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """grp, idx, digest, more, steps, sub, top of nodes (grp, idx, n, digest, more).

    then: from the groups' roots (grp, digest, round) to what is above them (grp, round, steps, sub, top)."""
    rounds, done = [nodes], []
    while True:
        up = checkpointed(roots(rounds[-1]))
        done.append(up.where("n = 1").select("grp", "digest", F.lit(len(rounds)).alias("round")))
        rest = up.where("n > 1")
        if rest.isEmpty():
            break
        rounds.append(rest)
    above = checkpointed(then(reduce(DataFrame.unionByName, done)))
    given = lambda k: above.where(F.col("round") == k).select("grp", F.lit(0).cast("long").alias("idx"), "steps", "sub", "top")
    known = given(len(rounds))
    for k in range(len(rounds) - 1, 0, -1):
        known = extended(rounds[k], known, []).select("grp", "idx", "steps", "sub", "top").unionByName(given(k))
    return extended(nodes, known, more)


def above_groups(found: DataFrame) -> DataFrame:
    """The tree over the groups' roots, by group: what climbed asks for."""
    rows = checkpointed(ranked(found.select(F.lit(0).alias("all"), F.col("grp").alias("of"), "digest", "round"), "all", ["of"]))
    nodes = rows.select(F.col("all").alias("grp"), "idx", "n", "digest", "of", "round")
    none = F.array().cast(f"array<{STEP}>")
    out = climbed(nodes, ["of", "round"], lambda top: top.select("grp", "round", none.alias("steps"), F.col("digest").alias("sub"), F.col("digest").alias("top")))
    return out.select(F.col("of").alias("grp"), "round", "steps", F.col("digest").alias("sub"), "top")


def manifest(leaves: DataFrame, more: list[str] | None = None) -> DataFrame:
    """idx, digest, grp, more, steps (the witness: siblings level by level, up to the root), sub, top (root) of every leaf.

    leaves: grp (a string; null is a group, the first), key (a number; null first), digest (64 digits), more. A group's leaves
    go by key, then digest. While a group has more than one node, every ARITY in a row (the last run: fewer, even one) become
    one; the groups' roots, by the groups' names, do the same."""
    more = more or []
    placed = checkpointed(ranked(leaves, "grp", ["key", "digest"]))
    return climbed(placed, ["key", *more], above_groups)


def folded(digest: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give."""

    def step(acc: Column, s: Column) -> Column:
        cut = s["place"] * 64
        return F.sha2(F.concat(F.substring(s["others"], F.lit(1), cut), acc, F.substring(s["others"], cut + 1, F.length(s["others"]))), 256)

    return F.aggregate(witness, digest, step)


def tampered(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what becomes of the proofs of those that are tampered with."""
    docs = read(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    row = lambda text: joined(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    leaves = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("key"), row(F.col("text")).alias("digest"), F.when(hit, row(tampered(F.col("text")))).alias("now"))
    found = manifest(leaves, ["now"])
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: s["others"]), ""), 256)
    out = found.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), F.col("sub").alias("subroot"), F.col("top").alias("root"), proof.alias("proof_sha256"), folded(F.coalesce("now", "digest"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    """DuckDB's SQL for the checksum of a string of ASCII characters; it reads steps of the one row of crc, from CRC_SQL."""
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, steps[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"


CRC_SQL = "crc AS (SELECT list(list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, v) ORDER BY v) AS steps FROM range(256) t(v))"


def _sql() -> str:
    """Trees of up to 5 levels, level by level: n nodes of each group, their siblings before and after, what a leaf has become."""
    said = lambda *c: "sha256(" + " || ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')" for x in c) + ")"
    lower = f"translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}')"
    columns = ("doc_id", "source", "lang", "n_chars")
    out = [CRC_SQL, f"""a AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {said(*columns, 'text')} AS leaf,
  CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN {said(*columns, lower)} ELSE {said(*columns, 'text')} END AS now FROM documents, crc)""",
           "f0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, '' AS proof FROM a)",
           "s0 AS (SELECT g, idx, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM f0)"]

    def level(f: str, s: str, k: int, group: str, at: str) -> list[str]:
        order = f"OVER (PARTITION BY {group}, idx // 16 ORDER BY idx ROWS BETWEEN"
        return [f"{s}w{k} AS (SELECT {group}, idx, n, coalesce(string_agg(digest, '') {order} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo, coalesce(string_agg(digest, '') {order} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM {s}{k})",
                f"{f}{k + 1} AS (SELECT f.* REPLACE (CASE WHEN n > 1 THEN sha256(lo || now || hi) ELSE now END AS now, CASE WHEN n > 1 THEN proof || lo || hi ELSE proof END AS proof) FROM {f}{k} f JOIN {s}w{k} w ON f.{group} = w.{group} AND f.{at} // {16 ** k} = w.idx)",
                f"{s}{k + 1} AS (SELECT {group}, idx // 16 AS idx, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE min(digest) END AS digest, (n + 15) // 16 AS n FROM {s}{k} GROUP BY {group}, idx // 16, n)"]

    for k in range(5):
        out += level("f", "s", k, "g", "idx")
    out += ["t0 AS (SELECT 0 AS o, g AS idx, digest, count(*) OVER () AS n FROM s5)", "h0 AS (SELECT f5.*, 0 AS o, digest AS subroot FROM f5 JOIN s5 USING (g))"]
    for k in range(5):
        out += level("h", "t", k, "o", "g")
    return "WITH " + ",\n".join(out).replace("s5 USING", "(SELECT g, digest FROM s5) USING") + "\nSELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = digest AS verified FROM h5, t5"


OP13_SQL = _sql()
