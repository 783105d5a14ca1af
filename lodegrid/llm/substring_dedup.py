"""Substring deduplication by level-wise doubling.

The first level holds the anchors: of every window of `width` words, the run of half as many words whose hash is least.
Equal windows have equal anchors, so a window can only repeat if its anchor repeats in another document. Windows whose
anchor does are extended to the full width, twice that of an anchor, and hashed; those that repeat are extended to
twice their width and so on, as far as is asked for or until no candidates survive.

What a level sends over the network is a hash and an id for each candidate, never text: each task first settles what
its own documents settle, so that a passage which a third of all documents share arrives once from each batch of
documents. Where the hashes meet, rows are sorted and read as a stream, whatever the size of a group. Texts are dealt
out by document once (Spark reuses that exchange), and every level joins what it has found to them.

Hashes have 64 bits; two different windows are taken for equal with a chance of about n * n / 2 ** 65 over n windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, pieces_of, read, text_bytes, word_limits

WIDTH = 13
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Odd base of the polynomial over a word's bytes, its inverse, and a random number for each byte.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(13).integers(1, 1 << 63, 256, np.uint64)
#: Rows that a reading task gathers before it compares them.
HELD = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _P2
    return (h ^ (h >> np.uint64(27))) * _P1


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word, from differences of one running sum over all bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo = int(starts[0])
    data, starts, ends = data[lo : int(ends[-1])], starts - lo, ends - lo
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data))[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each place on (fewer places at the end), by doubling: a window of n words is two of
    n / 2; an odd one has a word more."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    if width == 1:
        return mixed(h)
    half = window_hashes(h, width // 2)
    n = len(h) - width + 1
    out = mixed(half[: len(h) - width // 2 * 2 + 1] * _P1 + half[width // 2 :])
    return mixed(out[:n] * _P1 + h[width - 1 :]) if width % 2 else out


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, row and hash of each window that is inside one row. first: number of each row's first word, and the end."""
    hashes = window_hashes(h, width)
    place = np.arange(len(hashes))
    row = np.searchsorted(first, place, "right") - 1
    ok = place + width <= first[row + 1] if len(place) else np.zeros(0, bool)
    return place[ok], row[ok], hashes[ok]


def anchor_hashes(h: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Of each window, the least hash of the runs of half its words (rounded up) in it."""
    short = (width + 1) // 2
    gram = window_hashes(h, short)
    least = gram[place]
    for k in range(1, width - short + 1):
        least = np.minimum(least, gram[place + k])
    return least


def known(rows: np.ndarray, hashes: np.ndarray, found: pa.ListArray) -> np.ndarray:
    """Which of the hashes are in the list of their row (null: an empty list)."""
    lengths = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(found)), lengths).astype(np.uint64)
    values = found.flatten().to_numpy().view(np.uint64)
    return np.isin(mixed(hashes + rows.astype(np.uint64) * _P1), mixed(values + of * _P1))


def by_document(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    order = np.argsort(ids, kind="stable")
    ids, hashes = ids[order], hashes[order]
    cut = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)) if len(ids) else np.zeros(0, np.int64)
    return ids[cut], [x.tobytes() for x in np.split(hashes, cut[1:])] if len(cut) else []


#: hash, doc_id: a candidate; shared: it is in other documents, too, which know so. With at, hashes that are found for a document.
SENT = pa.schema({"hash": pa.int64(), "doc_id": pa.int64(), "shared": pa.bool_(), "at": pa.binary()})


def found_rows(ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    ids, blobs = by_document(ids, hashes)
    spread = mixed(ids.astype(np.uint64)).view(np.int64)
    return pa.record_batch([pa.array(spread), pa.array(ids), pa.array(np.zeros(len(ids), bool)), pa.array(blobs, pa.binary())], SENT)


def settled(hashes: np.ndarray, ids: np.ndarray, smaller: bool) -> Iterator[pa.RecordBatch]:
    """What a batch of documents sends: what it can tell by itself is found, and one row for each hash (the least id's)."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    new = (np.diff(hashes, prepend=~hashes[:1]) != 0) | (np.diff(ids, prepend=ids[:1]) != 0) if len(ids) else np.zeros(0, bool)
    hashes, ids = hashes[new], ids[new]
    head = np.diff(hashes, prepend=~hashes[:1]) != 0 if len(ids) else new
    shared = ~head | np.append(~head[1:], np.zeros(min(len(head), 1), bool))
    tell = ~head if smaller else shared
    yield found_rows(ids[tell], hashes[tell])
    n = int(head.sum())
    yield pa.record_batch([pa.array(hashes[head].view(np.int64)), pa.array(ids[head]), pa.array(shared[head] & (not smaller)), pa.nulls(n, pa.binary())], SENT)


def met(rows: pa.Table, smaller: bool) -> pa.RecordBatch:
    """doc_id, hash: of whole groups of rows, sorted by hash and id, those whose hash is in another document (of a smaller
    id), and what is already found."""
    given = rows.column("at").is_valid().to_numpy()
    plain = rows.filter(pa.array(given))
    at = plain.column("at").to_pylist()
    out_ids, out = [np.repeat(plain.column("doc_id").to_numpy(), [len(x) // 8 for x in at])], [np.frombuffer(b"".join(at), np.int64)]
    hashes, ids, shared = (rows.column(c).to_numpy()[~given] for c in ("hash", "doc_id", "shared"))
    if len(ids):
        head = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]) != 0)
        size = np.diff(head, append=len(ids))
        hit = ids != np.repeat(ids[head], size)
        if not smaller:
            hit = np.repeat(np.maximum.reduceat(hit | shared, head), size) & ~shared
        out_ids.append(ids[hit])
        out.append(hashes[hit])
    return pa.record_batch({"doc_id": pa.array(np.concatenate(out_ids)), "hash": pa.array(np.concatenate(out))})


def level(texts: DataFrame, width: int, kind: str, smaller: bool) -> DataFrame:
    """doc_id, found: the hashes that repeat, for each document with any.

    texts: doc_id, text and, but for anchors, found: what the level before has found. kind: anchor; window (whose
    anchors were found); double (whose two halves were found)."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                data, at = text_bytes(part.column("text"))
                starts, ends, first = word_limits(data, at)
                h = word_hashes(data, starts, ends)
                place, row, hashes = windows(h, first, width)
                ids = part.column("doc_id").to_numpy()
                if kind == "anchor":
                    hashes = anchor_hashes(h, place, width)
                elif len(place):
                    found = part.column("found")
                    if kind == "window":
                        ok = known(row, anchor_hashes(h, place, width), found)
                    else:
                        half = window_hashes(h, width // 2)
                        ok = known(row, half[place], found) & known(row, half[place + width // 2], found)
                    row, hashes = row[ok], hashes[ok]
                yield from settled(hashes, ids[row], smaller)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                rows = pa.Table.from_batches(held)
                hashes = rows.column("hash").to_numpy()
                cut = int(np.searchsorted(hashes, hashes[-1]))
                if cut:
                    yield met(rows.slice(0, cut), smaller)
                    held, n = rows.slice(cut).to_batches(), n - cut
        if n:
            yield met(pa.Table.from_batches(held), smaller)

    sent = texts.mapInArrow(candidates, "hash long, doc_id long, shared boolean, at binary")
    dealt = sent.repartition("hash").sortWithinPartitions("hash", "doc_id")
    return dealt.mapInArrow(meet, "doc_id long, hash long").groupBy("doc_id").agg(F.collect_list("hash").alias("found"))


def dealt_texts(docs: DataFrame) -> DataFrame:
    """Texts by id, without null ids: the same plan below each join, so that one exchange serves them all."""
    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).repartition("doc_id")


def repeated(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, found: hashes of the windows of `width` words that also start in a document of a smaller id."""
    anchors = level(texts, width, "anchor", False)
    return level(texts.join(anchors, "doc_id"), width, "window", True)


def longest_repeats(docs: DataFrame, width: int = WIDTH, most: int | None = None) -> DataFrame:
    """doc_id, longest: the largest of width, 2 * width, 4 * width, ... (up to most) at which a window of the document
    repeats in another document; documents without any aren't returned. Ends when no candidates survive."""
    texts = dealt_texts(docs)
    found = checkpointed(level(texts.join(level(texts, width, "anchor", False), "doc_id"), width, "window", False))
    out = found.select("doc_id", F.lit(width).alias("longest"))
    while not found.isEmpty() and (most is None or 2 * width <= most):
        width *= 2
        found = checkpointed(level(texts.join(found, "doc_id"), width, "double", False))
        out = out.unionByName(found.select("doc_id", F.lit(width).alias("longest")))
    return out.groupBy("doc_id").agg(F.max("longest").alias("longest"))


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces) of every row of docs.

    A word goes if a window of `width` words that also starts in a document of a smaller id covers it. Null texts have no
    words; rows of a null id stay whole and remove nothing; rows that share an id are one document and don't remove from
    each other."""
    texts = dealt_texts(docs)
    found = repeated(texts, width).withColumnRenamed("doc_id", "of")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                data, at = text_bytes(part.column("text"))
                starts, ends, first = word_limits(data, at)
                place, row, hashes = windows(word_hashes(data, starts, ends), first, width)
                gone = np.zeros(len(starts) + 1, np.int64)
                hit = place[known(row, hashes, part.column("found"))]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + width, -1)
                stays = np.cumsum(gone[:-1]) == 0
                # Bytes of the words that stay, and one white space after each but where a row ends.
                base, end = int(at[0]), int(at[-1])
                put = np.zeros(end - base + 1, np.int8)
                put[starts[stays] - base] += 1
                np.add.at(put, ends[stays] - base, -1)
                inside = np.cumsum(put[:-1]).astype(bool)
                after = ends[stays] - base
                after = after[after < end - base]
                space = np.zeros_like(inside)
                space[after] = True
                space[at[:-1][at[:-1] < end] - base] = False
                text = data[base:end].copy()
                text[space & ~inside] = 0x20
                use = inside | space
                cut = np.append(0, np.cumsum(use))[at - base]
                text = text[use].tobytes()
                kept = [text[a:b].rstrip(b" ").decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                total = np.diff(first)
                left = np.add.reduceat(np.append(stays, False).astype(np.int64), first[:-1]) * (total > 0) if len(total) else total
                out = {"doc_id": part.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(total - left, pa.int64()), "kept": pa.array(kept, pa.string())}
                yield pa.record_batch(out)

    joined = texts.join(found, texts["doc_id"] == found["of"], "left").drop("of")
    whole = docs.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("found"))
    return joined.unionByName(whole).mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Removes repeated passages of 13 words or more from every whole text of documents."""
    done = deduplicate(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
