"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every whole text. Hashes of the candidates' values are then aggregated over the corpus by
distinct repositories and owners: a value that several owners share is a copied example; one that a single owner has is
treated as live, in however many of its repositories. The base patterns' spans stay whatever
the frequency says; long mixed tokens that no base pattern covers are added only where the frequency says live.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, pieces_of, read, row_key

#: Base kinds in the order in which equal starts are listed, pattern, group that holds the value, least length of that group.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Added kind: tokens of this pattern with at least DIGITS digits and BITS bits of entropy a character.
ADDED, TOKEN, DIGITS, BITS = "token", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"), 3, 3.0
KINDS = (*(b[0] for b in BASE), ADDED)
#: A value is an example from so many owners on.
OWNERS = 3
#: Rows from which on a value is common, and how many common values there can be.
COMMON, LISTED = 4096, 1 << 16


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, end, value of every candidate of a text, by start, then kind; a token that meets a base span isn't one."""
    found = [(kind, m.start(), m.end(), m[group]) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if len(m[group]) >= least]
    base = sorted((a, b) for _, a, b, _ in found)
    starts, reach = [a for a, _ in base], [0, *accumulate((b for _, b in base), max)]  # reach: furthest end of the first k
    for m in TOKEN.finditer(text):
        value = m[0]
        if sum(map(str.isdigit, value)) >= DIGITS and entropy(value) >= BITS and reach[bisect_left(starts, m.end())] <= m.start():
            found.append((ADDED, m.start(), m.end(), value))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """docs without text, with key (of id and text), owner, repository and found: array of (kind, start, stop, hash of the value).

    Null texts have none. Columns of docs called like the added ones are replaced."""
    docs = docs.drop("key", "owner", "repository", "found").withColumns({"key": row_key("doc_id", "text"), "owner": owner.cast("string"), "repository": repository.cast("string")})
    plain = docs.drop("text").columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                found = [[{"kind": k, "start": a, "stop": b, "value": hashlib.sha256(v.encode()).hexdigest()[:32]} for k, a, b, v in candidates(t or "")] for t in part.column("text").to_pylist()]
                yield pa.record_batch({k: part.column(k) for k in plain} | {"found": pa.array(found, kind)})

    schema = T.StructType([*docs.select(*plain).schema, *T.StructType.fromDDL("found array<struct<kind:string,start:int,stop:int,value:string>>")])
    return docs.select(*plain, "text").mapInArrow(work, schema)


def ownership(found: DataFrame, owners: int = OWNERS) -> DataFrame:
    """value, n_owners, n_repositories, n_rows, live. found: owner, repository, value; null owners or repositories count as one.

    Each step is added up before it is shuffled, so a value that a third of all rows hold is no hot key."""
    pairs = found.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("rows"))
    per_owner = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    per = per_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"), F.sum("rows").alias("n_rows"))
    return per.withColumn("live", F.col("n_owners") < owners)


def judged(each: DataFrame, least: int = COMMON, most: int = LISTED) -> DataFrame:
    """each with live. Values of more than `least` rows, and more than a `most`-th of all, are looked up by broadcast: there
    can't be more than `most` such; no other value is a large part of the join's rows."""
    owned = checkpointed(ownership(each).select("value", "n_rows", "live"))
    total = owned.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    often = F.col("n_rows") > max(least, total // most)
    common = owned.where(often).select(F.col("value").alias("common"), F.col("live").alias("common_live"))
    marked = each.join(F.broadcast(common), each["value"] == F.col("common"), "left")
    rare = marked.where(F.col("common").isNull()).drop("common", "common_live").join(owned.where(~often).select("value", "live"), "value")
    return rare.unionByName(marked.where(F.col("common").isNotNull()).drop("common").withColumnRenamed("common_live", "live"))


def spans_by_key(rows: DataFrame) -> DataFrame:
    """key, spans: array of (start, place of the kind, kind, stop, live), sorted; all base spans, and live tokens.

    rows: what scan returns. Repeated rows share a key and have equal spans, which a set holds once."""
    each = rows.where(F.size("found") > 0).select("key", "owner", "repository", F.explode("found").alias("c")).select("key", "owner", "repository", "c.*")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    kept = judged(each).where((F.col("kind") != ADDED) | F.col("live"))
    return kept.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", place.alias("place"), "kind", "stop", "live"))).alias("spans"))


def secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """docs without text, with spans (see spans_by_key); every row is returned, without a span with an empty array."""
    rows = checkpointed(scan(docs.drop("spans"), owner, repository))  # small: ids and what was found
    empty = F.array().cast("array<struct<start:int,place:int,kind:string,stop:int,live:boolean>>")
    return rows.join(spans_by_key(rows), "key", "left").withColumn("spans", F.coalesce("spans", empty)).drop("key", "found", "owner", "repository")


def mask(docs: DataFrame, owner: Column, repository: Column, put: str = "[secret]") -> DataFrame:
    """docs with the live spans of their texts replaced (those that meet are one); all rows and columns stay."""
    columns = docs.columns
    spans = spans_by_key(checkpointed(scan(docs.select("doc_id", "source", "text"), owner, repository)))
    live = spans.select("key", F.filter("spans", lambda s: s["live"]).alias("live_spans")).where(F.size("live_spans") > 0).withColumnRenamed("key", "live_key")
    keyed = docs.withColumn("live_key", row_key("doc_id", "text")).join(live, "live_key", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put_in(done: Column, span: Column) -> Column:
        more = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, span["start"] - done["at"]), F.lit(put))
        return F.struct(F.when(span["start"] >= done["at"], more).otherwise(done["out"]).alias("out"), F.greatest(done["at"], span["stop"]).alias("at"))

    masked = F.aggregate("live_spans", start, put_in, lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))))
    return keyed.withColumn("text", F.when(F.col("live_spans").isNotNull(), masked).otherwise(F.col("text"))).select(*columns)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents; its source is the owner, the document the repository."""
    found = secrets(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("source"), F.col("doc_id"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    count = lambda holds: F.size(F.filter("spans", holds)).cast("long")
    counts = {f"n_{kind}": count(_is(kind)) for kind, *_ in BASE} | {"n_live": count(lambda s: s["live"])}
    return found.withColumns(counts | {"base_sha256": F.sha2(listed(base), 256), "text_spans": listed(F.col("spans"))}).select(
        "doc_id", *counts, "base_sha256", F.col("text_spans").alias("spans")
    )
