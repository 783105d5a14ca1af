"""Mixing sources to target weights.

The tokens of each source are added up, the sources' targets follow from weights, and a document is taken
floor(rate) times plus once more with a probability equal to the rate's fraction, decided by a hash of its id.
All of it is DataFrame work: one aggregate by source, one small window over sources, one join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, read

#: Weights that the sources, by code point, get in turn; the share of all tokens that the mix takes; times a source is repeated at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source_size, target.

    Targets are proportional to weight up to `most` times the source's size; what a source can't take goes to the
    others by weight. Sorting by the rate at which a source fills up gives the fixed point without repeating:
    the first source whose filling rate isn't below the rate left over ends the full ones.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    everyone = Window.partitionBy()
    rate = (share * F.sum("source_size").over(everyone) - full) / left
    per = per.withColumn("rate", rate).withColumn("ends", F.col("rate") <= F.col("cap") / F.col("weight"))
    level = F.max(F.when(F.col("ends"), F.col("rate"))).over(everyone)  # of later rows it only falls
    return per.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def uniform(seed: int, doc_id: Column) -> Column:
    """A number from 0 up to 1 that depends on the seed and the id alone: 32 bits of an MD5."""
    word = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8)
    return F.conv(word, 16, 10).cast("long") / F.lit(float(1 << 32))


def mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document).

    Null texts have size 0; null sources are one source, the last; empty sources have rate 0; rows that repeat an id
    share its decision. Columns of docs called like the added ones are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", word_count(F.col("text")))
    targets = source_targets(docs.select("source", "size"), weights, share, most).withColumnRenamed("source", "of_source")
    joined = docs.join(targets, docs["source"].eqNullSafe(targets["of_source"]), "left").drop("of_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    whole = F.floor(rate)
    return joined.withColumn("copies", whole + (uniform(seed, F.col("doc_id")) < rate - whole).cast("long"))


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: DuckDB; the same arithmetic in the same order, so doubles agree.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM p),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
l AS (SELECT max(rate) AS level FROM r WHERE rate <= cap / weight),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM r, l),
c AS (SELECT doc_id, size, source_size, target,
        CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0 END AS rate,
        ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""
