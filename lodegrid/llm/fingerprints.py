"""Document fingerprints: SimHash of weighted terms, and a search by permuted block tables.

DataFrame and SQL functions only. Terms are runs of consecutive words, weighted by how often they occur; each adds its
weight to the counters of the bits that its hash has set, and a bit of the fingerprint is set if over half the weight
has it. Counters are kept two to a long, so that Spark's own sums, in generated code, do the voting.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, read

#: Words in a term; bits; blocks of the search tables; blocks of rows in which neighbours are looked up at most, and their rows at least.
TERM, BITS, TABLE_BLOCKS, ROW_BLOCKS, BLOCK_ROWS = 3, 64, 6, 1 << 12, 1 << 10


def terms(text: Column, words: int = TERM) -> Column:
    """Hashes of the runs of `words` words; a shorter text's only term is all its words, an empty one has none."""
    hashed = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    n = F.size(hashed)
    runs = hashed
    for k in range(1, words):
        rest = F.slice(hashed, F.lit(k + 1), F.greatest(n - k, F.lit(0)))
        runs = F.zip_with(F.slice(runs, F.lit(1), F.greatest(n - k, F.lit(0))), rest, lambda a, b: F.xxhash64(a, b))
    whole = F.when(n > 0, F.array(F.aggregate(hashed, F.lit(0).cast("long"), lambda a, b: F.xxhash64(a, b)))).otherwise(F.array().cast("array<long>"))
    return F.when(n >= words, runs).otherwise(whole)


def lanes(h: Column) -> list[Column]:
    """32 longs of two counters each, one for bit j in the lower half and one for bit j + 32 in the upper."""
    return [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x100000001)) for j in range(BITS // 2)]


def voted(rows: DataFrame, keys: list[str], term: str) -> DataFrame:
    """keys, fp (long): rows has one row per occurrence of a term; null terms only keep their key."""
    total = F.count(term)
    sums = rows.groupBy(*keys).agg(total.alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(f"s{j}") for j, x in enumerate(lanes(F.col(term)))])
    fp = F.lit(0).cast("long")
    for j in range(BITS // 2):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{j}", 32)
        for b, ones in ((j, low), (j + 32, high)):
            fp = fp.bitwiseOR(F.when(2 * ones > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


#: Heads that are gone through at once.
STEP = 64


def place_of(id_: Column, text: Column) -> Column:
    """What orders documents: by descending id, null ids last, of equal ids by a hash of the text."""
    down = F.coalesce(F.bitwise_not(id_), F.lit(0).cast("long"))
    return F.struct(id_.isNull().alias("late"), down.alias("down"), F.xxhash64(text).alias("hash"))


def block_heads(places: DataFrame, blocks: int) -> list[tuple[bool, int, int]]:
    """First places of at most `blocks` blocks of about equally many rows, in order. places: at (a place)."""
    ranged = places.select("at.*").repartitionByRange(blocks, "late", "down", "hash").withColumn("block", F.spark_partition_id())
    return sorted(tuple(r["head"]) for r in ranged.groupBy("block").agg(F.min(F.struct("late", "down", "hash")).alias("head")).collect())


def place_table(heads: list[tuple[bool, int, int]]) -> Column:
    """An array of places that Spark folds to one literal."""
    rows = [dict(zip(("late", "down", "hash"), h)) for h in heads]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<late:boolean,down:bigint,hash:bigint>>")


def followed(docs: DataFrame, blocks: int = ROW_BLOCKS, least: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text, block, end, place, next_text: each document's successor by descending doc_id; after the last comes the first.

    Rows are dealt into at most `blocks` blocks of about equally many (`least` or more), whatever their ids: the blocks'
    first places come from Spark's own range partitioning and are at most `blocks` rows. Within a block, a window looks the
    next row up; the first row of each block is also dealt to the block before it, as its end. Null ids come last, a null
    text is empty, and of equal ids the texts' hashes give the order; only rows of one id and one text can't be parted.
    Rows with end = 1 are those copies; they have no successor.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("at", place_of(F.col("doc_id"), F.col("text")))
    places = docs.select("at")
    heads = block_heads(places, int(max(1, min(blocks, -(-places.count() // least))))) or [(False, 0, 0)]
    table, coarse = place_table(heads), place_table(heads[::STEP])
    upto = lambda some: F.aggregate(some, F.lit(0), lambda n, h: n + F.when(h <= F.col("at"), 1).otherwise(0))
    rough = F.greatest(upto(coarse) - 1, F.lit(0)) * STEP
    block = F.greatest(rough + upto(F.slice(table, rough + 1, F.lit(STEP))) - 1, F.lit(0))
    rows = docs.withColumn("block", block.cast("long"))
    is_head = F.get(table, F.col("block").cast("int")) == F.col("at")
    own = F.struct(F.col("block").alias("block"), F.lit(0).alias("end"))
    back = F.struct(F.when(F.col("block") == 0, F.lit(len(heads) - 1).cast("long")).otherwise(F.col("block") - 1).alias("block"), F.lit(1).alias("end"))
    each = rows.withColumn("to", F.explode(F.when(is_head, F.array(own, back)).otherwise(F.array(own)))).select("doc_id", "text", "at", "to.block", "to.end")
    inside = Window.partitionBy("block").orderBy("end", "at", "text")
    placed = each.withColumns({"place": F.row_number().over(inside), "next_text": F.lead("text").over(inside)})
    return placed.select("doc_id", "text", "block", "end", "place", "next_text")


def edited(docs: DataFrame) -> DataFrame:
    """What followed returns, with n_chars and edited: the last half of the text replaced by the first as many code points of the next."""
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    new = F.concat(F.substring("text", F.lit(1), n.cast("int") - half), F.substring("next_text", F.lit(1), half))
    return followed(docs).withColumns({"n_chars": n, "edited": new})


def pair_prints(docs: DataFrame, words: int = TERM) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp of each document, its edited text and its successor."""
    rows = edited(docs)
    keys = ["block", "end", "place", "doc_id", "n_chars", "sha"]
    kinds = F.array(F.struct(F.lit(0).alias("kind"), terms(F.col("text"), words).alias("terms")), F.struct(F.lit(1).alias("kind"), terms(F.col("edited"), words).alias("terms")))
    rows = rows.withColumn("sha", F.unhex(F.sha2("edited", 256)))
    each = rows.select(*keys, F.explode(F.when(F.col("end") == 0, kinds).otherwise(F.slice(kinds, 1, 1))).alias("e"))
    votes = voted(each.select(*keys, "e.kind", F.explode_outer("e.terms").alias("term")), [*keys, "kind"], "term")
    both = votes.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    after = F.lead("fp").over(Window.partitionBy("block").orderBy("place"))
    both = both.withColumn("next_fp", after).where("end = 0")
    return both.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fp", "edited_fp", "next_fp")


def near(prints: DataFrame, queries: DataFrame, radius: int, blocks: int = TABLE_BLOCKS) -> DataFrame:
    """query_fp, fp, distance: all distinct fingerprints of prints (fp) within radius bits of each of queries (query_fp).

    Of `blocks` blocks of bits, blocks - radius are equal in any such pair. For each choice of so many blocks there is a
    table of fingerprints permuted to lead with these; a query reads those of equal lead and is held against them all.
    A pair that meets in several tables is returned from the first one.
    """
    if not 0 <= radius < blocks:
        raise ValueError("there must be more blocks than bits of radius")
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def table(rows: DataFrame, fp: str) -> DataFrame:
        leads = F.array(*[F.struct(F.lit(k).alias("t"), F.col(fp).bitwiseAND(F.lit(m)).alias("lead")) for k, m in enumerate(signed)])
        return rows.select(fp).distinct().select(fp, F.explode(leads).alias("e")).select(fp, F.col("e.t").alias(f"{fp}_t"), F.col("e.lead").alias(f"{fp}_lead"))

    apart = F.col("query_fp").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, k) for k, m in enumerate(signed)])
    meets = (F.col("query_fp_t") == F.col("fp_t")) & (F.col("query_fp_lead") == F.col("fp_lead"))
    met = table(queries, "query_fp").join(table(prints, "fp"), meets & (F.bit_count(apart) <= radius) & (first == F.col("fp_t")))
    return met.select("query_fp", "fp", F.bit_count(apart).alias("distance"))


#: Bits of radius; every so many-th id is a query of the search.
RADIUS, QUERY_EVERY = 3, 50


def op3_simhash_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited text; n_near: for ids divisible by 50, how many other distinct
    fingerprints of all documents are within 3 bits."""
    prints = checkpointed(pair_prints(read(spark, sf_dir, "documents")))
    is_query = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    found = near(prints, prints.where(is_query).select(F.col("fp").alias("query_fp")), RADIUS)
    counts = found.groupBy("query_fp").agg((F.count(F.lit(1)) - 1).alias("n_near"))  # without itself
    asked = prints.where(is_query).join(counts, F.col("fp") == F.col("query_fp")).drop("query_fp")
    both = asked.unionByName(prints.where(~is_query).withColumn("n_near", F.lit(None).cast("long")))
    as_hex = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_hex("fp").alias("fingerprint"), as_hex("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )
