"""Language identification by prediction by partial matching.

Per language, a byte context tree of bounded order holds symbol counts. A symbol costs minus the binary logarithm of
its probability in the longest context seen before; a context that lacks it costs an escape (method C: as many escape
counts as distinct symbols) and passes on to the context one byte shorter, which no longer considers the symbols that
the longer one has (exclusion). Statistics stay frozen after training, so every cost is a fixed number.

Only what training has seen is stored: for each order, the n-grams of a family of GROUP languages with their costs in
each of these, found by a hash of the n-gram. What no language of the family has seen is reached by the escapes of its
contexts, worked out for the few bytes that need it. The model so grows with the distinct n-grams, about 2 MB a
language, and every language and every context has its place in it.

Training counts n-grams in tasks and adds the counts up in Spark. The training sample is bounded (documents per
language, bytes per document), which bounds what the driver gets and broadcasts for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, read, text_bytes

#: Bytes of context; documents that a language is learned from at most; longest text that is learned whole, in bytes.
ORDER, PER_LANGUAGE, LONGEST = 3, 300, 1 << 15
#: Languages that share the tables of a family.
GROUP = 4
UNKNOWN = "und"


def grams(symbols: np.ndarray, at: np.ndarray, order: int, base: int) -> np.ndarray:
    """For each symbol, the `order` ones before it and itself as one number; symbol 0 stands before a row's start.

    symbols: from 1 to base - 1, of all rows; at: the rows' limits."""
    out = np.zeros(len(symbols), np.int64)
    place = np.arange(len(symbols)) - np.repeat(at[:-1], np.diff(at))
    for back in range(order, -1, -1):
        out *= base
        if back:
            out[back:] += np.where(place[back:] >= back, symbols[:-back], 0)
        else:
            out += symbols
    return out


def sample(learn: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> DataFrame:
    """At most `per_language` rows (text, lang) of each language, by the least hashes of their ids; of texts of more than
    `longest` bytes, the first `longest` / 4 characters.

    A first cut by hash at twice the needed rate leaves the window over a language a bounded number of rows."""
    learn = learn.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64(F.lit(17), "doc_id"))
    rate = learn.groupBy("lang").agg(F.least(F.lit(1.0), 2 * per_language / F.count(F.lit(1))).alias("rate"))
    near = learn.join(F.broadcast(rate), "lang").where(F.col("h") / float(1 << 64) + 0.5 <= F.col("rate"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    text = F.when(F.octet_length("text") <= longest, F.col("text")).otherwise(F.substring("text", 1, longest // 4))
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select(text.alias("text"), "lang")


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each byte follows each context of `order` bytes; bytes count from 1, 0 is a text's edge."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                data, at = text_bytes(part.column("text"))
                langs = np.asarray(part.column("lang").to_pylist(), object)
                all_grams = grams(data[at[0] : at[-1]].astype(np.int64) + 1, at - at[0], order, 257)
                of = np.repeat(np.arange(len(langs)), np.diff(at))
                for lang in sorted(set(langs)):
                    g, n = np.unique(all_grams[langs[of] == lang], return_counts=True)
                    yield pa.record_batch({"lang": pa.array([lang] * len(g), pa.string()), "gram": pa.array(g), "n": pa.array(n)})

    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Lookup:
    """Row of each of some distinct numbers, by a hash table whose collisions lie right behind their place."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(1, 2 * len(keys)).bit_length())
        home = self._home(keys)
        order = np.argsort(home, kind="stable")
        at = np.maximum.accumulate(home[order] - np.arange(len(keys))) + np.arange(len(keys))
        self.most = int((at - home[order]).max()) if len(keys) else 0
        size = (1 << (64 - int(self.shift))) + self.most + 1
        self.keys, self.rows = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        self.keys[at], self.rows[at] = keys[order], order

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Rows; -1 where a number isn't there."""
        at = self._home(keys)
        hit = self.keys[at] == keys
        out = np.where(hit, self.rows[at], -1)
        left = np.flatnonzero(~hit & (self.keys[at] >= 0))
        for step in range(1, self.most + 1):
            if not len(left):
                break
            there = self.keys[at[left] + step]
            hit = there == keys[left]
            out[left[hit]] = self.rows[at[left[hit]] + step]
            left = left[~hit & (there >= 0)]
        return out


@dataclass
class Level:
    """One order of a family. Arrays have a row for each n-gram or context and a column for each language, in bits."""

    grams: Lookup  #: context and symbol
    costs: np.ndarray  #: of the n-gram in its context, or where its escapes lead; that of the shorter one where there is no such context
    own: np.ndarray  #: minus the logarithm of its count; infinite where a language lacks it
    tail: np.ndarray  #: what remains after the escape from its context
    contexts: Lookup
    up: np.ndarray  #: row of each context without its first byte, one order below
    known: np.ndarray  #: whether a language has the context
    escape: np.ndarray  #: from the context, with nothing excluded
    scale: np.ndarray  #: of the context above, without what this one has: logarithm of its total,
    leave: np.ndarray  #: and its escape


@dataclass
class Family:
    levels: list[Level]
    last: np.ndarray  #: a symbol's cost behind the root's escape, for each language
    base: int
    order: int

    def tails(self, k: int, row: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Bits after an escape from context `row` of order k, for n-grams that order k lacks."""
        if k == 0:
            return np.broadcast_to(self.last, (len(row), len(self.last)))
        here, above = self.levels[k], self.levels[k - 1]
        at = above.grams(gram % self.base**k)
        out = here.leave[row].copy()
        hit, miss = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        own = above.own[at[hit]]
        out[hit] = np.where(np.isfinite(own), here.scale[row[hit]] + own, out[hit] + above.tail[at[hit]])
        if len(miss):
            out[miss] += self.tails(k - 1, here.up[row[miss]], gram[miss])
        return out

    def bits(self, gram: np.ndarray, k: int | None = None) -> np.ndarray:
        """Costs of n-grams (of k symbols before, and one) in each language."""
        k = self.order if k is None else k
        level = self.levels[k]
        at = level.grams(gram % self.base ** (k + 1))
        out = level.costs[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            gram = gram[miss]
            row = level.contexts(gram // self.base % self.base**k)
            some = np.flatnonzero(row >= 0)
            part = self.bits(gram, k - 1) if k else np.zeros((len(miss), len(self.last)), np.float32)
            row = row[some]
            part[some] = np.where(level.known[row], level.escape[row] + self.tails(k, row, gram[some]), part[some])
            out[miss] = part
        return out


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  #: of each byte; 0 is a text's edge, the last one any byte that training didn't have
    base: int
    order: int
    families: list[Family]


def family(gram: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: int, base: int, order: int) -> Family:
    """From full-order counts of some languages (shorter contexts' counts are their sums), order by order."""
    log = lambda x: np.log2(np.maximum(x, 1))
    levels: list[Level] = []
    count = None
    for k in range(order + 1):
        grams, of = np.unique(gram % base ** (k + 1), return_inverse=True)
        before, count = count, np.zeros((len(grams), languages), np.float32)
        np.add.at(count, (of, lang), n)
        seen = count > 0
        contexts, ctx = np.unique(grams // base, return_inverse=True)
        if not k and not len(contexts):
            contexts = np.zeros(1, np.int64)
        first = np.searchsorted(ctx, np.arange(len(contexts)))
        per = lambda x: np.add.reduceat(x, first, axis=0, dtype=np.float32) if len(x) else np.zeros((len(contexts), languages), np.float32)  # noqa: E731, B023
        total, kinds = per(count), per(seen)
        with np.errstate(divide="ignore"):
            own = -np.log2(count)
        escape = log(total + kinds) - log(kinds)
        if k:
            above = levels[-1]
            parent = above.grams(grams % base**k)
            up = above.contexts(contexts % base ** (k - 1))
            rest = whole[up] - per(np.where(seen, before[parent], 0))
            left = all_kinds[up] - kinds
            scale = log(rest + left)
            leave = np.where(left > 0, scale - log(left), 0)
            tail = np.where(np.isfinite(above.own[parent]), scale[ctx] + above.own[parent], leave[ctx] + above.tail[parent])
            shorter = above.costs[parent]
        else:
            up, scale, leave, shorter = np.zeros(1, np.int32), np.zeros((1, languages), np.float32), np.zeros((1, languages), np.float32), np.float32(0)
            last = log(256 - kinds[0]).astype(np.float32)
            tail = np.broadcast_to(last, own.shape)
        costs = np.where(seen, log(total + kinds)[ctx] + own, escape[ctx] + tail)
        known = (total > 0) | (k == 0)
        costs = np.where(known[ctx], costs, shorter)
        levels.append(Level(Lookup(grams), *(x.astype(np.float32) for x in (costs, own, tail)), Lookup(contexts), up, known, *(x.astype(np.float32) for x in (escape, scale, leave))))
        whole, all_kinds = total, kinds
    for level in levels[order:]:
        level.own = level.tail = np.zeros((0, languages), np.float32)  # no longer order asks for them
    return Family(levels, last, base, order)


def build(langs: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int = ORDER, group: int = GROUP) -> Model:
    """The model from full-order counts; n-grams are numbers as `grams` gives them, of base 257."""
    names, lang = np.unique(langs.astype(str), return_inverse=True) if len(langs) else (np.zeros(0, str), np.zeros(0, np.int64))
    used = np.unique(gram % 257)
    symbol = np.full(257, len(used) + 1, np.int64)
    symbol[0], symbol[used] = 0, np.arange(1, len(used) + 1)
    base, own = len(used) + 2, np.zeros(len(gram), np.int64)
    for k in range(order, -1, -1):
        own = own * base + symbol[gram // 257**k % 257]
    families = []
    for first in range(0, len(names), group):
        of = (lang >= first) & (lang < first + group)
        families.append(family(own[of], lang[of] - first, n[of], min(group, len(names) - first), base, order))
    return Model(names.tolist(), symbol[1:], base, order, families)


def code_lengths(model: Model, data: np.ndarray, at: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Bits of each row under each language. Works through the bytes in steps, so that memory doesn't grow with a text."""
    out = np.zeros((len(at) - 1, len(model.languages)))
    for lo in range(int(at[0]), int(at[-1]), step):
        hi = min(lo + step, int(at[-1]))
        first, last = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, hi, "left")
        before = max(int(at[first]), lo - model.order)
        cut = np.clip(at[first : last + 1], before, hi) - before
        gram = grams(model.symbol[data[before:hi]], cut, model.order, model.base)[lo - before :]
        cut = np.maximum(cut + before, lo) - lo
        full = np.flatnonzero(np.diff(cut))
        done = 0
        for part in model.families:
            many = len(part.last)
            if len(full):
                out[first + full, done : done + many] += np.add.reduceat(part.bits(gram), cut[full], axis=0, dtype=np.float64)
            done += many
    return out


def fit(learn: DataFrame, order: int = ORDER) -> Model:
    """learn: doc_id, text, lang. Without a row to learn from, the model has no language."""
    counts = gram_counts(sample(learn), order).toPandas()
    return build(counts["lang"].to_numpy(object), counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.int64), order)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (the posterior of the code lengths, equal priors); columns of docs so called are replaced.

    A null text, one without a letter, or a model without languages gives `und` and score 0; of equal code lengths the
    first language by code point wins."""
    docs = docs.drop("lang_pred", "score").withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop("_letter").schema.add("lang_pred", "string").add("score", "double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.asarray([*model.languages, UNKNOWN], object)
        for batch in batches:
            for part in pieces_of(batch, "text"):
                known = part.column("_letter").to_numpy(zero_copy_only=False) & bool(model.languages)
                best, score = np.full(len(known), len(names) - 1), np.zeros(len(known))
                if known.any():
                    bits = code_lengths(model, *text_bytes(part.column("text")))
                    more = bits - bits.min(1, keepdims=True)
                    best[known] = bits.argmin(1)[known]
                    score[known] = (1 / np.exp2(-np.minimum(more, 1000)).sum(1))[known]
                own = {k: part.column(k) for k in part.schema.names if k != "_letter"}
                yield pa.record_batch(own | {"lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score)})

    return docs.mapInArrow(judge, schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod 4 isn't 2, predicts all."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")
