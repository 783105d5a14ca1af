"""Benchmark decontamination by a broadcast set of test n-grams.

The words of the test items are cut into segments that overlap by a window less one word, so that no row is larger than
a segment whatever the item. Segments are dealt to parts of at most PART_BYTES. Each task holds one part at a time: a
sorted table of the hashes of its windows, and the segments' words to verify hits with. Texts are scanned in numpy, every
window of every length that the part has; a hit counts once its words are equal, so hashes decide nothing alone.

One part is one pass without any shuffle. A larger benchmark takes one more pass for each further part; between passes
the texts and what was found so far are checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, pieces_of, read, text_bytes, word_limits
from .substring_dedup import window_hashes, windows, word_hashes

WIDTH = 10
#: Words of a segment, bytes of segments that one broadcast holds, and bits of the table that is asked first.
SEGMENT, PART_BYTES, FILTER_BITS = 4096, 64 << 20, 22

#: A-Z to a-z; all but 0-9, a-z and bytes of other scripts to a blank.
_NORMAL = np.full(256, 0x20, np.uint8)
_NORMAL[0x30:0x3A] = np.arange(0x30, 0x3A)
_NORMAL[0x61:0x7B] = _NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)
_NORMAL[0x80:] = np.arange(0x80, 256)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, first and end byte of every word, and the number of each row's first word (and the end)."""
    data, at = text_bytes(column)
    data = _NORMAL[data]
    return data, *word_limits(data, at)


def segments(items: DataFrame, width: int) -> DataFrame:
    """item_id (a string), words (joined by blanks), whole: the item's words are fewer than a window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                data, starts, ends, first = words_of(part.column("text"))
                ids, words, whole = [], [], []
                for row, item in enumerate(part.column("item_id").to_pylist()):
                    a, b = int(first[row]), int(first[row + 1])
                    for k in range(a, max(a + 1, b - width + 1) if b > a else a, SEGMENT - width + 1):
                        end = min(b, k + SEGMENT)
                        ids.append(item)
                        words.append(b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(k, end)).decode())
                        whole.append(b - a < width)
                yield pa.record_batch({"item_id": pa.array(ids, pa.string()), "words": pa.array(words, pa.string()), "whole": pa.array(whole, pa.bool_())})

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut, "item_id string, words string, whole boolean").distinct()


class Grams:
    """The windows of segments: a sorted table of hashes for each length, and the words to verify with."""

    def __init__(self, segments: pa.Table, width: int):
        self.data, at = text_bytes(segments.column("words"))
        self.starts, self.ends, first = word_limits(self.data, at)
        h = hashed(self.data, self.starts, self.ends)
        self.items = segments.column("item_id").to_pylist()
        self.tables = {}
        count = np.diff(first)
        short = segments.column("whole").to_numpy(zero_copy_only=False)
        for w in sorted({width} | set(count[short].tolist())):
            place, row, hashes = windows(h, first, w)
            ok = short[row] & (count[row] == w) if w < width else ~short[row]
            place, row, hashes = place[ok], row[ok], hashes[ok]
            if len(hashes):
                order = np.argsort(hashes, kind="stable")
                bits = np.zeros(1 << FILTER_BITS, bool)
                bits[hashes >> np.uint64(64 - FILTER_BITS)] = True
                self.tables[w] = bits, hashes[order], place[order], row[order]

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[set]]:
        """Which words are in an occurrence of a window, and the items with one in each row."""
        h = hashed(data, starts, ends)
        cover = np.zeros(len(starts) + 1, np.int64)
        items: list[set] = [set() for _ in range(len(first) - 1)]
        for w, (bits, hashes, places, rows) in self.tables.items():
            own = window_hashes(h, w)
            at = np.flatnonzero(bits[own >> np.uint64(64 - FILTER_BITS)])
            row = np.searchsorted(first, at, "right") - 1
            inside = at + w <= first[row + 1]
            at, row = at[inside], row[inside]
            lo, hi = np.searchsorted(hashes, own[at]), np.searchsorted(hashes, own[at], "right")
            text: dict = {}
            for k, r, a, b in zip(at[hi > lo].tolist(), row[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                said = [data[starts[k + i] : ends[k + i]].tobytes() for i in range(w)]
                found = text.get(a)
                if found is None:
                    found = text[a] = {}
                    for j in range(a, b):
                        p = int(places[j])
                        words = tuple(self.data[self.starts[p + i] : self.ends[p + i]].tobytes() for i in range(w))
                        found.setdefault(words, set()).add(self.items[rows[j]])
                of = found.get(tuple(said))
                if of is not None:
                    cover[k] += 1
                    cover[k + w] -= 1
                    items[r] |= of
        return np.cumsum(cover[:-1]) > 0, items


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """word_hashes, for a bounded number of words at a time."""
    return np.concatenate([word_hashes(data, starts[k : k + most], ends[k : k + most]) for k in range(0, max(1, len(starts)), most)])


def spans(hit: np.ndarray) -> np.ndarray:
    """First and end of each run of true values."""
    return np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)


def cut_out(text: str, hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without its runs of hit words; starts and ends: bytes of its words."""
    body, kept, at = text.encode(), [], 0
    for a, b in spans(hit).tolist():
        kept.append(body[at : int(starts[a])])
        at = int(ends[b - 1])
    return b"".join([*kept, body[at:]]).decode()


def marked(rows: DataFrame, parts: list[pa.Table], width: int, clean: bool) -> DataFrame:
    """rows (doc, text) with n_words, n_hit, hit (a bit for each word), items; after the last part, clean in place of text
    and hit."""
    context = rows.sparkSession.sparkContext
    out = rows.withColumns({"hit": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")})
    doc = f"doc {rows.schema['doc'].dataType.simpleString()}"
    for number, part in enumerate(parts):
        shared, last = context.broadcast(part), number == len(parts) - 1

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            known = Grams(shared.value, width)
            for batch in batches:
                for piece in pieces_of(batch, "text"):
                    _, at = text_bytes(piece.column("text"))
                    data, starts, ends, first = words_of(piece.column("text"))
                    hit, items = known.hits(data, starts, ends, first)
                    of = [hit[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                    for r, old in enumerate(piece.column("hit")):
                        if old.is_valid:
                            of[r] = of[r] | np.unpackbits(np.frombuffer(old.as_buffer(), np.uint8), count=len(of[r])).astype(bool)
                    listed = [sorted({x for x in new if x is not None} | set(old or ())) for new, old in zip(items, piece.column("items").to_pylist())]
                    found = {"doc": piece.column("doc"), "items": pa.array(listed, pa.list_(pa.string()))}
                    if last:
                        n_hit = np.array([int(x.sum()) for x in of], np.int64)
                        found |= {"n_words": pa.array(np.diff(first), pa.int64()), "n_hit": pa.array(n_hit)}
                        if clean:
                            texts = piece.column("text").to_pylist()
                            for r in np.flatnonzero(n_hit).tolist():
                                words = slice(int(first[r]), int(first[r + 1]))
                                texts[r] = cut_out(texts[r], of[r], starts[words] - at[r], ends[words] - at[r])
                            found["clean"] = pa.array(texts, pa.string())
                    else:
                        found |= {"text": piece.column("text"), "hit": pa.array([np.packbits(x).tobytes() for x in of], pa.binary())}
                    yield pa.record_batch(found)

        if number:
            out = checkpointed(out)
        out = out.mapInArrow(scan, f"{doc}, items array<string>, " + ("n_words long, n_hit long" + ", clean string" * clean if last else "text string, hit binary"))
    return out


def parts_of(items: DataFrame, width: int, most: int = PART_BYTES) -> list[pa.Table]:
    """The segments in parts of at most `most` bytes (one segment, if that is longer): each is collected by itself, and is
    what the driver and a task hold. Without any segment there is one empty part."""
    cut = checkpointed(segments(items, width))
    total = cut.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0
    n = max(1, -(-2 * total // most))
    while n > 1:
        part = F.pmod(F.xxhash64("item_id", "words"), F.lit(n))
        largest = cut.groupBy(part.alias("part")).agg(F.sum(F.octet_length("words") + 64).alias("n"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).agg(F.max("n")).first()[0]
        if largest is None or largest <= most:
            break
        n *= 2
    return [cut.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k).toArrow() for k in range(n)]


def scan(docs: DataFrame, items: DataFrame, width: int = WIDTH, most: int = PART_BYTES, clean: bool = True) -> DataFrame:
    """doc (the columns of docs but text, as a struct), n_words, n_hit, items (ids as strings, sorted) and, if asked, clean:
    the text without its hit words, of every row of docs.

    A text's words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; a window is `width` words in
    a row of an item's, or all of them if they are fewer. A null text has no words and stays null, an item without
    words hits nothing; items that share an id are one, and those without an id hit but aren't listed. Equal rows, also
    of docs, are judged alike. Each run of hit words goes from its first word to its last one's end; the rest stays."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(others or [F.lit(0).alias("_")])).alias("doc"), F.col("text"))
    return marked(rows, parts_of(items, width, most), width, clean)


def without_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, with the hit words cut out of each text; other columns as they are."""
    return scan(docs, items, width).select(*[F.col("clean").alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def without_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = 0.0) -> DataFrame:
    """docs of which at most `share` of the words are hit; those without words stay."""
    whole = docs.withColumn("_text", F.col("text"))  # carried along, as scan returns the text only without the hits
    return scan(whole, items, width, clean=False).where(F.col("n_hit") <= F.lit(share) * F.col("n_words")).select(*[F.col("doc._text" if c == "text" else f"doc.`{c}`").alias(c) for c in docs.columns])


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents against every item of benchmark."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, read(spark, sf_dir, "benchmark"), clean=False)
    digest: Column = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM win),
gram AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM d, lengths, unnest(range(1, len(w) - k + 2)) t(i)),
occ AS (SELECT r, i, k, item_id FROM gram JOIN win USING (k, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, k FROM occ) o, unnest(range(i, i + k)) t(p) GROUP BY r),
item AS (SELECT r, count(item_id) AS n_items, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR), '') AS items FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)"""
