"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link within a Hamming radius. Their bits are grouped into partitions, correlated bits together,
and each partition gets a threshold of its own, such that the thresholds add up to radius - partitions + 1: then two
fingerprints within the radius are within its threshold in at least one partition. Dynamic programming picks the
thresholds that make the fewest estimated candidates and probes. Each fingerprint is dealt to its own value in every
partition and to the values within the threshold; fingerprints that meet are verified against the whole radius.

Copies are one fingerprint. Of fingerprints that meet and link, only a star per connected part is passed on, never all
pairs; where very many meet in one value, blocks of them are compared pair by pair of blocks, in tasks of their own.
A value of n fingerprints is so dealt out n / BLOCK times: the thresholds keep values small, and only a group of more than
BLOCK different fingerprints that agree in a whole partition makes this grow.
Connected components then follow from the stars by alternating large and small stars.

Deduplication deals two fingerprints of sets of word pairs out in this way, with four to verify them, and then holds what
hangs together against the exact similarity of sets of five-word shingles, each document's set once for each block of
its component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, pieces_of, read, row_key, text_bytes, word_limits
from .substring_dedup import mixed, window_hashes, windows, word_hashes

SEED, RADIUS, SHINGLE = 42, 4, 4
#: Seconds that a dealt row (some 100 bytes, written, sorted and read) and a compared pair take about, as measured; partitions tried; rows of one value that are compared in one task.
ROW_COST, PAIR_COST, PARTITIONS, BLOCK = 1e-5, 1e-8, range(2, 13), 1 << 14
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_ONLY = _LOWER.copy()
_LOWER[[*range(0x09, 0x0E)]] = 0x20


def shingle_hashes(data: np.ndarray, at: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each shingle, its XXH64) in runs, for all rows: words of A-Z lower-cased text, joined by single spaces.

    A row of fewer words has its whole sequence as its only shingle, a row without words none."""
    starts, ends, first = word_limits(data, at)
    if not len(starts):
        return
    inside = np.zeros(int(at[-1] - at[0]) + 1, np.int8)
    np.add.at(inside, starts - at[0], 1)
    np.add.at(inside, ends - at[0], -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the white space right after a word
    place = np.cumsum(keep) - 1
    text = _LOWER[data[at[0] : at[-1]][keep]].tobytes()
    lo, hi = place[starts - at[0]], place[ends - 1 - at[0]] + 1
    n = np.diff(first)
    per = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    row = np.repeat(np.arange(len(n)), per)
    begin = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    last = np.minimum(begin + words, first[1:][row]) - 1
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(row), 1 << 17):
        b, e = lo[begin[i : i + (1 << 17)]].tolist(), hi[last[i : i + (1 << 17)]].tolist()
        yield row[i : i + (1 << 17)], np.fromiter((digest(text[x:y], SEED) for x, y in zip(b, e)), np.uint64, len(b))


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits for each hash (k = 0: the hash itself)."""
    if not k:
        return h
    h = h ^ np.uint64((k * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def word_sets(data: np.ndarray, at: np.ndarray, widths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each width, (row, hash) of the distinct shingles of so many words of A-Z lower-cased text, sorted by both.

    A row of fewer words has its whole sequence as its only shingle, a row without words none. The hashes are of 64 bits
    and not XXH64. Takes some 40 bytes of memory a byte of text."""
    data, at = _LOWER_ONLY[data[at[0] : at[-1]]], at - at[0]
    starts, ends, first = word_limits(data, at)
    h = word_hashes(data, starts, ends)
    out = []
    for width in widths:
        _, row, hashes = windows(h, first, width)
        rows, found = [row], [hashes]
        for n in range(1, width):
            short = np.flatnonzero(np.diff(first) == n)
            rows.append(short)
            found.append(mixed(window_hashes(h, n)[first[short]] + np.uint64(n)))
        row, hashes = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        out.append((row[new], hashes[new]))
    return out


#: Eight counters of eight bits, one for each bit of a byte.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def add_bits(ones: np.ndarray, row: np.ndarray, h: np.ndarray) -> None:
    """Adds to ones (rows, 64) how often each bit is set in the hashes of each row; rows are sorted."""
    head = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(head, np.diff(head, append=len(row)))
    cut = np.flatnonzero(place % 255 == 0)  # so many fit into eight bits
    sums = np.add.reduceat(_LANES[h.view(np.uint8).reshape(-1, 8)], cut, axis=0).view(np.uint8).reshape(-1, 64)
    again = np.flatnonzero(np.diff(row[cut], prepend=-1))
    ones[row[cut[again]]] += np.add.reduceat(sums, again, axis=0, dtype=np.int64)


def majority(n: int, runs: Iterator[tuple[np.ndarray, np.ndarray]], count: int = 1) -> np.ndarray:
    """(n, count) of 64 bits: a bit is set if it is in over half of the row's hashes (mixed anew for each count)."""
    ones, total = np.zeros((count, n, 64), np.int64), np.zeros(n, np.int64)
    for row, h in runs:
        if len(row):
            total += np.bincount(row, minlength=n)
            for k in range(count):
                add_bits(ones[k], row, remixed(h, k))
    return np.packbits(2 * ones > total[:, None], axis=2, bitorder="little").view(np.uint64)[:, :, 0].T


def fingerprint_rows(data: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """64 bits for each row, from all its shingles, repeats included."""
    return majority(len(at) - 1, shingle_hashes(data, at, words))[:, 0]


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """docs without text, with fp (long). Null and empty texts have fingerprints of zero; a column fp of docs is replaced."""
    plain = docs.drop("text", "fp")
    names = plain.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 20):
                fp = fingerprint_rows(*text_bytes(part.column("text")), words)
                yield pa.record_batch({k: part.column(k) for k in names} | {"fp": pa.array(fp.view(np.int64))})

    return docs.select(*names, "text").mapInArrow(work, T.StructType([*plain.schema, *T.StructType.fromDDL("fp long")]))


def set_fingerprints(docs: DataFrame, words: int, count: int, set_words: int) -> DataFrame:
    """docs without text, with check (array of `count` longs, from the set of shingles of `words`), node (64 bits that equal
    sets of shingles of `set_words` share) and size (of that set). Columns of docs so called are replaced."""
    plain = docs.drop("text", "check", "node", "size")
    names = plain.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 20):
                n = part.num_rows
                few, many = word_sets(*text_bytes(part.column("text")), (words, set_words))
                check = np.ascontiguousarray(majority(n, iter([few]), count)).view(np.int64)
                size, node = np.bincount(many[0], minlength=n), np.zeros(n, np.uint64)
                head = np.flatnonzero(np.diff(many[0], prepend=-1))
                if len(head):
                    node[many[0][head]] = np.add.reduceat(remixed(many[1], 1), head)
                node = mixed(node + size.astype(np.uint64)).view(np.int64)
                yield pa.record_batch({k: part.column(k) for k in names} | {"check": pa.FixedSizeListArray.from_arrays(pa.array(check.ravel()), count).cast(pa.list_(pa.int64())), "node": pa.array(node), "size": pa.array(size, pa.int64())})

    return docs.select(*names, "text").mapInArrow(work, T.StructType([*plain.schema, *T.StructType.fromDDL("check array<long>, node long, size long")]))


def bit_moments(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set; 4,096 sums from each task, added up in Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64), np.int64)
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(bits)
            both += (bits.T @ bits).astype(np.int64)
        yield pa.record_batch({"i": pa.array(np.arange(4097)), "n": pa.array(np.append(both.ravel(), n))})

    sums = nodes.select("fp").mapInArrow(work, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(4097, np.int64)
    out[sums["i"]] = sums["n"]
    return int(out[-1]), out[:-1].reshape(64, 64)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` partitions of equal widths (one more or less): each starts with the bit least like those
    taken, and takes the bits most correlated with its own."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    like = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, out = list(range(64)), []
    for k in range(parts):
        taken = [b for g in out for b in g]
        group = [min(left, key=lambda b: (like[b, taken].sum(), b))]
        left.remove(group[0])
        while len(group) < 64 // parts + (k < 64 % parts):
            group.append(max(left, key=lambda b: (like[b, group].sum(), -b)))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def value_pairs(nodes: DataFrame, plans: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """For each partition of each plan, how many pairs of all fingerprints agree in it."""
    parts = [(m, i, bits) for m, groups in plans.items() for i, bits in enumerate(groups)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k, (_, _, bits) in enumerate(parts):
                v, n = np.unique(project(fp, bits), return_counts=True)
                yield pa.record_batch({"k": pa.array(np.full(len(v), k)), "v": pa.array(v), "n": pa.array(n)})

    per = nodes.select("fp").mapInArrow(work, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n").cast("double").alias("n"))
    sums = {r["k"]: r["s"] for r in per.groupBy("k").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("s")).collect()}
    return {(m, i): sums.get(k, 0.0) for k, (m, i, _) in enumerate(parts)}


def project(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint as one number."""
    out = np.zeros(len(fp), np.int64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def thresholds(n: int, both: np.ndarray, groups: list[list[int]], agreeing: list[float], radius: int) -> tuple[float, list[int]]:
    """The cheapest thresholds that add up to radius - partitions + 1, and their cost; -1 leaves a partition out."""
    p = np.diag(both) / max(n, 1)
    options = []
    for bits, same in zip(groups, agreeing):
        law = np.ones(1)  # of the distance in this partition, bits apart
        for b in bits:
            q = min(max(2 * p[b] * (1 - p[b]), 1e-3), 0.5)
            law = np.append(law * (1 - q), 0) + np.append(0, law * q)
        within = np.cumsum(law) / law[0]
        own = [(0.0, -1)]
        for t in range(min(radius, len(bits)) + 1):
            rows = 1 + sum(comb(len(bits), d) for d in range(1, t + 1)) / 2
            own.append((rows * n * ROW_COST + same * within[t] * PAIR_COST, t))
        options.append(own)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in options:
        more: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for c, t in own:
                if total + t not in more or cost + c < more[total + t][0]:
                    more[total + t] = (cost + c, [*chosen, t])
        best = more
    return best[radius - len(groups) + 1]


def plan(nodes: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """Partitions (bits, threshold), from the statistics of all fingerprints."""
    n, both = bit_moments(nodes)
    plans = {m: grouped_bits(n, both, m) for m in PARTITIONS if m <= radius + 2}
    same = value_pairs(nodes, plans)
    done = [(*thresholds(n, both, groups, [same[m, i] for i in range(m)], radius), groups) for m, groups in plans.items()]
    _, chosen, groups = min(done, key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(groups, chosen) if t >= 0]


def dealt(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """nodes with key, once for its own value in each partition (probe false) and once for each larger value within the
    threshold (probe true; of two values that differ, one is the larger)."""

    names = nodes.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k, (bits, t) in enumerate(parts):
                own = project(fp, bits)
                flips = [sum(1 << j for j in c) for d in range(1, t + 1) for c in combinations(range(len(bits)), d)]
                for flip in [0, *flips]:
                    value = own ^ flip
                    use = np.flatnonzero(value > own) if flip else np.arange(len(own))
                    part = batch.take(pa.array(use))
                    cols = {c: part.column(c) for c in names}
                    yield pa.record_batch(cols | {"key": pa.array(value[use] | k << 56), "probe": pa.array(np.full(len(use), bool(flip)))})

    return nodes.mapInArrow(work, T.StructType([*nodes.schema, *T.StructType.fromDDL("key long, probe boolean")]))


def parts_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n indices reaches over the links a, b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(fp: np.ndarray, check: np.ndarray | None, i: np.ndarray, j: np.ndarray, radius: int, check_radius: int) -> np.ndarray:
    near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    if check is not None:
        hit = np.flatnonzero(near)
        near[hit] = np.bitwise_count(check[i[hit]] ^ check[j[hit]]).sum(1) <= check_radius
    return near


def compare(group: np.ndarray, probe: np.ndarray, fp: np.ndarray, check: np.ndarray | None, radius: int, check_radius: int) -> np.ndarray:
    """The least row that each row reaches over links between rows of its group; rows are sorted by group, then probe."""
    n = len(group)
    label = np.arange(n)
    begin = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if n else np.zeros(0, np.int64)
    size = np.diff(begin, append=n)
    end_of = np.repeat(begin + size, size)
    large = np.repeat(size > 2048, size)
    # Small groups: every row that isn't a probe against all after it.
    rows = np.flatnonzero(~probe & ~large)
    many = end_of[rows] - rows - 1
    cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + 1, 1 << 19)) if len(rows) else np.zeros(0, np.int64)
    pairs_a, pairs_b = [], []
    for lo, hi in zip(cuts, [*cuts[1:], len(rows)]):
        r, m = rows[lo:hi], many[lo:hi]
        a = np.repeat(r, m)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
        near = linked(fp, check, a, b, radius, check_radius)
        pairs_a.append(a[near]), pairs_b.append(b[near])
    if pairs_a:
        label = parts_of(np.concatenate(pairs_a), np.concatenate(pairs_b), n)
    # Large ones: breadth first; what has been reached isn't compared again, so a dense group takes about one pass.
    for lo, hi in zip(begin[size > 2048], (begin + size)[size > 2048]):
        left = np.arange(lo, hi)
        while len(left):
            seed, left = left[0], left[1:]
            front = [seed]
            while front and len(left):
                x = front.pop()
                near = linked(fp, check, np.full(len(left), x), left, radius, check_radius)
                reached = left[near]
                label[reached] = seed
                front += reached.tolist()
                left = left[~near]
    return label


#: What orders and names a vertex, and the flat form of an edge that tasks return.
VERTEX = ("late", "least", "node")
EDGE = "a_late boolean, a_least long, a_node long, b_late boolean, b_least long, b_node long"


def edges_of(cols: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges between rows a and b of columns of vertices, without loops, each once."""
    some = np.flatnonzero(cols["node"][a] != cols["node"][b])
    a, b = a[some], b[some]
    _, once = np.unique(np.stack([cols["node"][a], cols["node"][b]], 1), axis=0, return_index=True)
    return pa.record_batch({f"{side}_{c}": pa.array(cols[c][i[once]]) for side, i in (("a", a), ("b", b)) for c in VERTEX})


def linked_vertices(flat: DataFrame) -> DataFrame:
    a, b = (F.struct(*[F.col(f"{side}_{c}").alias(c) for c in VERTEX]) for side in "ab")
    return flat.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def stars(deals: DataFrame, radius: int, check_radius: int = 0, block: int = BLOCK) -> DataFrame:
    """Distinct links (a, b) of vertices, b < a, that connect what the nodes that meet in a key connect.

    A vertex is (late, least, node): its order is that of the smallest doc_id, and null ids, which are late, come last."""
    many = deals.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    deals = deals.join(many, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pair = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long")), lambda c: F.greatest(c, own) * (1 << 20) + F.least(c, own))
    )
    deals = deals.withColumn("pair", F.explode(pair)).drop("blocks")
    checked = "check" in deals.columns
    dealt_out = deals.repartition("key", "pair").sortWithinPartitions("key", "pair", "probe")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> pa.RecordBatch:
            col = lambda c: rows.column(c).to_numpy()
            key, pair, node = col("key"), col("pair"), col("node")
            group = np.cumsum(np.append(True, (np.diff(key) != 0) | (np.diff(pair) != 0)))
            check = None
            if checked:
                values = rows.column("check").combine_chunks()
                check = values.flatten().to_numpy().view(np.uint64).reshape(len(key), -1)
            label = compare(group, col("probe"), col("fp").view(np.uint64), check, radius, check_radius)
            return edges_of({c: col(c) for c in VERTEX}, np.arange(len(label)), label)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 17:  # whole groups of it; the last, perhaps unfinished one waits
                rows = pa.Table.from_batches(held)
                key, pair = rows.column("key").to_numpy(), rows.column("pair").to_numpy()
                cut = int(np.flatnonzero((key != key[-1]) | (pair != pair[-1]))[-1]) + 1 if (key[0], pair[0]) != (key[-1], pair[-1]) else 0
                if cut:
                    yield done(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    n -= cut
        if n:
            yield done(pa.Table.from_batches(held))

    return linked_vertices(dealt_out.mapInArrow(work, EDGE))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least vertex that each vertex of the edges (a, b) reaches.

    Each round hangs larger neighbours, then smaller ones, on the least; hot nodes are only ever reduced to a minimum
    or joined, both of which Spark splits. The rounds end when no edge changes."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = checkpointed(small.where("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state


def with_vertices(prints: DataFrame, *more: Column) -> DataFrame:
    """One row for each node of prints: late, least (smallest doc_id; 0 where all are null), node and more."""
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least"), *more)
    return nodes.withColumns({"late": F.col("least").isNull(), "least": F.coalesce("least", F.lit(0).cast("long"))})


def rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with root, the least vertex that each reaches; itself without an edge. No join is by root, which may be hot."""
    root = components(edges).select(F.col("node.node").alias("of"), "root")
    return nodes.join(root, nodes["node"] == root["of"], "left").drop("of").withColumn("root", F.coalesce("root", F.struct(*VERTEX)))


def component_id() -> Column:
    """Of a root: its doc_id; null where no row of the component has one."""
    return F.when(~F.col("root.late"), F.col("root.least"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs without text, with fp and component_id; every row is returned, repeated ones and null texts too. Ids that are
    null don't count, and a component of nothing but these has a null id."""
    prints = checkpointed(fingerprints(docs, words).withColumn("node", F.col("fp")))
    nodes = checkpointed(with_vertices(prints).withColumn("fp", F.col("node")))
    found = rooted(nodes.select(*VERTEX), stars(dealt(nodes, plan(nodes, radius)), radius))
    return prints.join(found.select("node", component_id().alias("component_id")), "node").drop("node")


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Component of every document of documents."""
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of the deduplication: words in a shingle, and the least similarity of two sets of shingles.
SET_WORDS, SIMILAR = 5, 0.8
#: Its candidates: PRINTS fingerprints from sets of word pairs, of which the first DEALT are dealt out within NEAR bits;
#: what meets is a candidate if all of them together differ in SPREAD bits at most. Texts whose sets of five-word shingles
#: have a similarity of 0.8 by scattered changes differ in 6 of 64 and 24 of 256 bits on average, by one passage in 10 and 39.
WORD_PAIR, PRINTS, DEALT, NEAR, SPREAD = 2, 4, 2, 9, 56
#: Shingles of a component that are held against each other in one task.
SHINGLES = 1 << 20


def reached(sets: list[np.ndarray], similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Links i, j that connect all sets which links of at least so much similarity connect; breadth first, what has been
    reached isn't compared again, so a dense group takes about one pass. Two empty sets are alike."""
    size = np.asarray([len(x) for x in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True) if size.sum() else (np.zeros(0), np.zeros(0, np.int64))
    at = np.append(0, np.cumsum(size))
    mark = np.zeros(len(values) + 1, np.uint8)
    left, held = np.arange(len(sets)), code
    links_i, links_j, front = [], [], []
    while len(left):
        if front:
            x = front.pop()
        else:
            x, left, held = left[0], left[1:], held[size[left[0]] :]
        own = code[at[x] : at[x + 1]]
        mark[own] = 1
        cut = np.append(0, np.cumsum(size[left]))
        both = np.diff(np.append(0, np.cumsum(mark[held], dtype=np.int64))[cut])
        mark[own] = 0
        near = both >= similar * (len(own) + size[left] - both) - 1e-9
        if near.any():
            hit = left[near]
            links_i.append(np.full(len(hit), x))
            links_j.append(hit)
            front += hit.tolist()
            held = held[np.repeat(~near, size[left])]
            left = left[~near]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(links_i), np.concatenate(links_j)) if links_i else (empty, empty)


def exact_links(members: DataFrame, texts: DataFrame, words: int = SET_WORDS, similar: float = SIMILAR, most: int = SHINGLES) -> DataFrame:
    """Distinct links (a, b) of vertices that connect what pairs of similar sets of shingles connect in each root's members.

    members: late, least, node, size, root, key; texts: key, text. Sets of a root are dealt out by node in blocks of about
    `most` shingles, and each pair of blocks is one group of one task."""
    blocks = members.groupBy("root").agg(F.sum("size").alias("n")).where(F.col("n") > most).select("root", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    dealt_in = members.join(blocks, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    zero = F.lit(0).cast("long")
    pair = F.when(F.col("blocks") == 1, F.array(zero)).otherwise(F.transform(F.sequence(zero, F.col("blocks") - F.lit(1).cast("long")), lambda c: F.greatest(c, own) * (1 << 20) + F.least(c, own)))
    rows = texts.join(dealt_in.select("key", *VERTEX, F.col("root.node").alias("of"), pair.alias("pairs")), "key")
    names = [*VERTEX, "of", "pair"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 20):
                row, h = word_sets(*text_bytes(part.column("text")), (words,))[0]
                cut = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
                blobs = pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
                yield pa.record_batch({c: part.column(c) for c in (*VERTEX, "of", "pairs")} | {"hashes": blobs})

    schema = "late boolean, least long, node long, of long, pairs array<long>, hashes binary"
    each = rows.select(*VERTEX, "of", "pairs", "text").mapInArrow(sets, schema).select(*VERTEX, "of", F.explode("pairs").alias("pair"), "hashes")
    dealt_out = each.repartition("of", "pair").sortWithinPartitions("of", "pair", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(group)
            if rows.num_rows > 1:
                i, j = reached([np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()], similar)
                yield edges_of({c: rows.column(c).to_numpy() for c in VERTEX}, i, j)

        group: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            of, pair = batch.column("of").to_numpy(), batch.column("pair").to_numpy()
            cut = [0, *(np.flatnonzero((np.diff(of) != 0) | (np.diff(pair) != 0)) + 1).tolist(), len(of)]
            for lo, hi in zip(cut, cut[1:]):
                if group and (of[lo], pair[lo]) != last:
                    yield from done(group)
                    group = []
                last = (of[lo], pair[lo])
                group.append(batch.slice(lo, hi - lo))
        if group:
            yield from done(group)

    return linked_vertices(dealt_out.select(*names, "hashes").mapInArrow(work, EDGE))


def similar_nodes(docs: DataFrame, radius: int = NEAR, spread: int = SPREAD, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """prints: key, doc_id, node of every row; nodes: node, first (of its rows: whether the id is null, doc_id, key), root.

    docs has key, which names a row, doc_id and text. Nodes of one root hang together by pairs of at least so much
    similarity of their sets of five-word shingles; equal sets are one node, and so are all texts without words."""
    prints = checkpointed(set_fingerprints(docs.select("key", "doc_id", "text"), WORD_PAIR, PRINTS, SET_WORDS))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("first")
    nodes = checkpointed(with_vertices(prints, F.min("check").alias("check"), F.first("size").alias("size"), first))
    edges = None
    for k in range(DEALT):
        rows = nodes.select(*VERTEX, "check", F.col("check")[k].alias("fp"))
        found = stars(dealt(rows, plan(rows, radius)), radius, spread)
        edges = found if edges is None else edges.union(found)
    linked = components(edges).select(F.col("node.node").alias("node"), "root")
    members = nodes.where(F.col("size") > 0).select(*VERTEX, "size", F.col("first.key").alias("key")).join(linked, "node")
    sure = exact_links(checkpointed(members), docs.select("key", "text"), SET_WORDS, similar)
    return prints.select("key", "doc_id", "node"), rooted(nodes.select(*VERTEX, "first"), sure).select("node", "first", "root")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """docs without near-duplicates: of each group, the row of the smallest doc_id stays (one of equal rows; null ids only
    where a group has no other, and then one of them). All columns stay. Nothing is joined by a group or a node, which
    many rows may share: what a group keeps is an aggregate."""
    key = row_key("doc_id", "text")
    _, nodes = similar_nodes(docs.select(key.alias("key"), "doc_id", "text"), **how)
    kept = nodes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("kept_key"))
    staying = docs.withColumn("kept_key", key).join(kept, "kept_key")
    again = docs.groupBy(key.alias("kept_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kept_key", F.lit(True).alias("again"))
    staying = staying.join(again, "kept_key", "left")
    once = staying.where(F.col("again").isNull()).select(*docs.columns)
    return once.unionByName(staying.where(F.col("again")).dropDuplicates(["kept_key"]).select(*docs.columns))
