"""SentencePiece encoding and decoding, exactly, for merge-type (BPE) models.

A word is encoded without replaying merges: Aho-Corasick finds the vocabulary's matches, the longest one at a place is
tried first, and it stands if it is compatible with the token before it, that is, if merging the two tokens' text
anew gives just these two. Otherwise the next shorter match is tried, and if none is left, the place is marked as
failed in a bitfield and the token before is shortened. Runs of spaces (whose pieces share one score, so that the
order of merges isn't given by the pieces alone) and characters outside the vocabulary are merged directly.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces_of, read

SPACE = "▁"
#: Words and pairs of tokens that a worker remembers at most; longest word that it remembers.
REMEMBERED, PAIRS, LONGEST = 250_000, 250_000, 48


def model_pieces(content: bytes) -> list[tuple[str, float, int]]:
    """piece, score, type of each id, from the bytes of a model file."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(content)
    spec = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only BPE models that keep the text as it is, with a space put before it, are known here")
    return [(p.piece, p.score, p.type) for p in proto.pieces]


class Words(dict):
    """Encoded words by their text, filled as they are asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        out = np.asarray(self.encode(word), "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out


class Pieces:
    """Encoder and decoder of one model. Types of pieces: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""

    _WORD = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def __init__(self, content: bytes):
        import ahocorasick

        pieces = model_pieces(content)
        if any(kind == 4 for _, _, kind in pieces):
            raise ValueError("models with user-defined pieces aren't known here")
        self.texts = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.rank = {p: -s for p, s, kind in pieces if kind == 1}
        self.size = [len(p) for p in self.texts]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i, (_, _, kind) in enumerate(pieces) if kind == 3}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == 2)
        self.chars = {p for p in self.ids if len(p) == 1}
        self.newline_alone = not any("\n" in p for p in self.ids)
        crossing = [p for p in self.ids if SPACE in p.lstrip(SPACE)]
        if crossing or not self.newline_alone:
            raise ValueError("models with pieces over word limits aren't known here")
        # What a token can stand for: itself, when merging its text gives it.
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merge(p) == [i]:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.words = Words(self.encode_word)

    def merge(self, text: str) -> list[int]:
        """Best pairs first, of equal ones the leftmost, until none is left: the definition."""
        parts = list(text) if len(text) <= 64 else self._merge_long(text)
        rank, none = self.rank, float("inf")
        pairs = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], none)
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode()] if self.bytes else [self.unknown]
        return out

    def _merge_long(self, text: str) -> list[str]:
        """The same by a queue, for runs where looking at all pairs again and again would take the square of their length."""
        part, n = list(text), len(text)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := self.rank.get(joined := part[i] + part[j])) is not None:
                heapq.heappush(queue, (k, i, j, joined))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, j, joined = heapq.heappop(queue)
            if alive[i] and j < n and alive[j] and after[i] == j and part[i] + part[j] == joined:
                part[i], alive[j], after[i] = joined, False, after[j]
                if after[i] < n:
                    before[after[i]] = i
                    offer(i)
                if before[i] >= 0:
                    offer(before[i])
        return [p for p, on in zip(part, alive) if on]

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get(a << 24 | b)  # the caller looks for True first
        if known is None:
            known = self.merge(self.texts[a] + self.texts[b]) == [a, b]
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[a << 24 | b] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """text: of characters that the vocabulary has."""
        n, size, fits = len(text), self.size, self.fits
        at: list[list[int]] = [[] for _ in range(n)]  # matches at each place, shorter ones first
        for last, i in self.automaton.iter(text):
            at[last + 1 - size[i]].append(i)
        failed = bytearray(n + 1)
        out: list[int] = []
        tried: list[tuple[int, int]] = []  # of each token: where it starts, which of the matches there it is
        place, left, before = 0, at[0], -1  # before: the last token, shifted
        choice = len(left)
        while True:
            while choice:
                choice -= 1
                i = left[choice]
                end = place + size[i]
                if not failed[end] and (before < 0 or fits.get(before | i) or self.compatible(before >> 24, i)):
                    break
            else:
                failed[place] = 1
                out.pop()
                place, choice = tried.pop()
                left, before = at[place], out[-1] << 24 if out else -1
                continue
            out.append(i)
            if end == n:
                return out
            tried.append((place, choice))
            place, left, before = end, at[end], i << 24
            choice = len(left)

    def encode_word(self, word: str) -> list[int]:
        """No merge crosses a character that the vocabulary lacks, so a word is cut there. A run of several spaces, whose pieces
        share a score, is merged with what is up to the next cut."""
        if self.chars.issuperset(word):
            return self.merge(word) if word.startswith(SPACE * 2) else self.backtrack(word)
        out: list[int] = []
        for known, run in groupby(word, self.chars.__contains__):
            part = "".join(run)
            if not known:
                for c in part:
                    out += self.merge(c)
            else:
                out += self.merge(part) if part.startswith(SPACE * 2) else self.backtrack(part)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; without begin and end."""
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        return b"".join(map(self.words.__getitem__, self._WORD.findall(text)))

    def decode(self, ids: list[int]) -> str:
        """Control pieces are silent; bytes that aren't UTF-8 give a replacement character each; the space put first goes."""
        texts = self.texts
        if self.byte_of.keys().isdisjoint(ids):
            out = "".join([texts[i] for i in ids if i not in self.silent])
        else:
            parts: list[str] = []
            run = bytearray()
            for i in [*ids, -1]:
                if (b := self.byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(each_byte(bytes(run)))
                    run.clear()
                if i >= 0 and i not in self.silent:
                    parts.append(" ⁇ " if i == self.unknown else texts[i])
            out = "".join(parts)
        return (out[1:] if out.startswith(SPACE) else out).replace(SPACE, " ")


def each_byte(run: bytes) -> str:
    """UTF-8, where every byte that isn't part of a whole character gives a replacement character of its own."""
    out = []
    while run:
        try:
            out.append(run.decode())
            break
        except UnicodeDecodeError as e:
            out.append(run[: e.start].decode() + "�")
            run = run[e.start + 1 :]
    return "".join(out)


_MADE: dict[bytes, Pieces] = {}


def pieces_for(content: bytes) -> Pieces:
    if content not in _MADE:
        _MADE[content] = Pieces(content)
    return _MADE[content]


def encode_column(docs: DataFrame, model: str, begin: int | None = 1, end: int | None = 2) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit integers) and decoded; null texts are encoded like empty ones.

    model: path, on the driver, of the model file; its content (under 1 MB) is broadcast. Columns of docs called like
    the added ones are replaced."""
    docs = docs.drop("ids", "decoded")
    names = docs.columns
    content = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    first, last = (b"" if i is None else np.uint32(i).astype("<u4").tobytes() for i in (begin, end))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_for(content.value)
        for batch in batches:
            for part in pieces_of(batch, "text", 2 << 20):
                ids = [first + pieces.encode(t or "") + last for t in part.column("text").to_pylist()]
                decoded = [pieces.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                own = {k: part.column(k) for k in names}
                yield pa.record_batch(own | {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())})

    return docs.mapInArrow(work, T.StructType([*docs.schema, *T.StructType.fromDDL("ids binary, decoded string")]))


def op7_piece_codec(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of documents."""
    import public_tokenizers

    coded = encode_column(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
