"""Chat formatting with loss masks that are aligned to token offsets.

A conversation is rendered as one string, encoded once with offsets, and the sorted spans of its turns are intersected
with the sorted spans of its tokens by binary search. Strings of the template that occur inside a text or role are
escaped by one backslash after their first character (those that already have some get one more), which can be undone.

A conversation is one training example, so one row holds all its turns; nothing else is gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Fixed strings of the template: a turn is TURN role HEAD text END.
TURN, HEAD, END = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
#: Roles whose texts a model is trained on.
TRAINED = ("assistant",)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and, for each turn, where its (escaped) text is."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{HEAD}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_spans(tokens: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """For each token (start, end; starts and ends ascend), its part in a trained turn; (0, 0) where it has none.

    turns: the sorted, disjoint spans of trained texts. A token that reaches over several has its part from the first to the last."""
    out = np.zeros_like(tokens)
    if len(turns) and len(tokens):
        first = np.searchsorted(turns[:, 1], tokens[:, 0], "right")  # the first turn that ends after the token's start
        last = np.searchsorted(turns[:, 0], tokens[:, 1], "left") - 1  # the last one that starts before its end
        hit = np.flatnonzero(first <= last)
        out[hit, 0] = np.maximum(tokens[hit, 0], turns[first[hit], 0])
        out[hit, 1] = np.minimum(tokens[hit, 1], turns[last[hit], 1])
    return out


def masked_text(formatted: str, spans: np.ndarray) -> str:
    """What is under the mask, each character once (tokens that share a character overlap), unescaped turn by turn."""
    kept: list[list[int]] = []
    for lo, hi in spans[spans[:, 1] > spans[:, 0]].tolist():
        if kept and lo <= kept[-1][1]:
            kept[-1][1] = max(kept[-1][1], hi)
        else:
            kept.append([lo, hi])
    return "".join(unescape(formatted[lo:hi]) for lo, hi in kept)


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns: the rows of a conversation by turn (null turns first; ties by role, then text); null texts and roles are empty."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


_ENCODERS: dict = {}


def encoder(content: str):
    """The byte-level tokenizer of a file's content, with whole offsets and without special tokens."""
    if content not in _ENCODERS:
        from tokenizers import Tokenizer, processors

        made = Tokenizer.from_str(content)
        made.encode_special_tokens = True
        made.post_processor = processors.ByteLevel(trim_offsets=False)
        _ENCODERS[content] = made
    return _ENCODERS[content]


def format_chats(rows: DataFrame, tokenizer: str, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row per conversation: formatted, ids, loss_from, loss_to (each token's part under the loss, in code points).

    rows: conv_id, turn, role, text; other columns are left out. A null conv_id is a conversation like any other.
    tokenizer: path, on the driver, of the tokenizer's file (a few MB); its content is broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                chats = [[(t["role"], t["text"]) for t in turns] for turns in part.column("turns").to_pylist()]
                done = [render(c) for c in chats]
                ids, lo, hi = [], [], []
                for chat, (text, spans), code in zip(chats, done, encode.encode_batch([x for x, _ in done], add_special_tokens=False)):
                    tokens = np.asarray(code.offsets, np.int64).reshape(-1, 2)
                    own = np.asarray([s for s, (role, _) in zip(spans, chat) if role in trained], np.int64).reshape(-1, 2)
                    loss = loss_spans(tokens, own)
                    ids.append(code.ids), lo.append(loss[:, 0]), hi.append(loss[:, 1])
                lists = {"ids": pa.array(ids, pa.list_(pa.int32())), "loss_from": pa.array(lo, pa.list_(pa.int32())), "loss_to": pa.array(hi, pa.list_(pa.int32()))}
                yield pa.record_batch({"conv_id": part.column("conv_id"), "formatted": pa.array([x for x, _ in done], pa.string())} | lists)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return conversations(rows).mapInArrow(work, f"conv_id {kind}, formatted string, ids array<int>, loss_from array<int>, loss_to array<int>")


def digests(chats: DataFrame) -> DataFrame:
    """What the query returns, read back from the formatted strings and masks alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            text = batch.column("formatted").to_pylist()
            turns = [parse(x) for x in text]
            spans = [np.stack([np.asarray(a.values, np.int64), np.asarray(b.values, np.int64)], 1) for a, b in zip(batch.column("loss_from"), batch.column("loss_to"))]
            loss = [masked_text(x, s) for x, s in zip(text, spans)]
            out = {"n_turns": pa.array(map(len, turns), pa.int64()), "turns_sha256": pa.array([sha("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns], pa.string())}
            out |= {"loss_chars": pa.array(map(len, loss), pa.int64()), "loss_sha256": pa.array(map(sha, loss), pa.string())}
            out |= {"formatted_chars": pa.array(map(len, text), pa.int64()), "n_tokens": pa.array(map(len, batch.column("ids")), pa.int64())}
            yield pa.record_batch({"conv_id": batch.column("conv_id")} | out)

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more whose texts are made of the template's strings."""
    import public_tokenizers

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return digests(format_chats(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))
