"""Mixing sources to target weights: integer quotas by highest quotients (Sainte-Lague).

Built of DataFrame functions only.

Sources get target word counts by weight, with repeats bounded by ``most_copies``.
Targets become whole blocks of ``block`` words: seat k of a source has quotient
target / (2k - 1), and the highest quotients win. The seats of a source are dealt
to its shards by the same rule over the shards' sizes. A shard lays its documents
in seeded order on a ring of words; its blocks are the ring cut from a seeded
offset on, and the first ``quota`` blocks, turning around as needed, are taken.

A source has about as many shards as a shard has documents, so neither a hot
source nor its table of shards meets in one task: both grow with the square root
of the source's rows.

Defined cases: null and empty texts have size 0 and take 0; a null source is a
source of its own, last in order; repeated rows and ties in the seeded order are
interchangeable; an empty table gives an empty result; columns of the input that
clash with the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableassay.llm.shared import staged

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
OVERSAMPLE = 1.5
MOST_COPIES = 2
BLOCK = 16
SEED = "mix-1"
RESULTS = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, docs, source_size, target: weights by order of the source, the excess
    over ``MOST_COPIES`` times the size dealt again by weight until none is above.

    One row per source; the windows run over sources, not documents."""
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank - 1) % len(WEIGHTS) + 1)
    per = per.withColumn("place", rank).withColumn("weight", weight.cast("long"))
    # Full sources are those first in order of size per weight: with the first j full,
    # the level of the rest is (share - 2 * their sizes) / (weights of the rest).
    every = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = (
        per.withColumn("full_size", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") * OVERSAMPLE - F.col("full_size") * MOST_COPIES) / F.col("open_weight"))
    )
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("source_size") * MOST_COPIES, F.struct("full_size", "place", "level"))).over(whole)["level"]
    cap = (F.col("source_size") * MOST_COPIES).cast("double")
    per = per.withColumn("target", F.least(cap, F.coalesce(level * F.col("weight"), cap)))
    return per.select("source", "place", "docs", "source_size", "target")


def seats(votes: DataFrame, group: list[str], vote: str, total: str, order: str) -> DataFrame:
    """Sainte-Lague: column ``seats``, the share of ``total`` seats that ``vote`` wins in its group.

    With n parties, divisors V/(T-n/2) and V/(T+n/2) bound the result from both sides;
    only the seats between the two bounds, at most 2n, are ranked by their quotients."""
    whole = Window.partitionBy(*group)
    v = F.col(vote)
    votes = votes.withColumn("_n", F.count("*").over(whole)).withColumn("_v", F.sum(v).over(whole))
    low = F.floor(v * (F.col(total) - F.col("_n") / 2) / F.col("_v") + 0.5) - 1
    high = F.floor(v * (F.col(total) + F.col("_n") / 2) / F.col("_v") + 0.5) + 1
    votes = votes.withColumn("_low", F.when(v > 0, F.greatest(low, F.lit(0))).otherwise(F.lit(0)).cast("long"))
    votes = votes.withColumn("_high", F.when(v > 0, F.greatest(high, F.col("_low"))).otherwise(F.lit(0)).cast("long"))
    votes = votes.withColumn("_left", F.col(total) - F.sum("_low").over(whole))
    k = F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))).otherwise(F.array().cast("array<bigint>")))
    open_seats = votes.select(*group, order, "_left", vote, k.alias("_k"))
    best = Window.partitionBy(*group).orderBy((F.col(vote) / (2 * F.col("_k") - 1)).desc(), order, "_k")
    won = open_seats.withColumn("_rank", F.row_number().over(best)).where("_rank <= _left").groupBy(*group, order).agg(F.count("*").alias("_won"))
    keys = [*group, order]
    return (
        votes.join(won, keys, "left")
        .withColumn("seats", F.col("_low") + F.coalesce("_won", F.lit(0)))
        .drop("_n", "_v", "_low", "_high", "_left", "_won")
    )


def mix(docs: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and taken.

    ``taken`` is at most ``MOST_COPIES`` times the size; summed over a source it is the
    target up to half a block, and up to half a block per shard where the target is the bound."""
    sized = docs.select([c for c in docs.columns if c not in RESULTS]).withColumn("size", word_count(F.col("text")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    draw = F.md5(F.concat(F.lit(seed + ":"), name).cast("binary"))
    narrow = staged(sized.select("doc_id", "source", "size", draw.alias("draw"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")), "mix-sizes")

    per = targets(narrow)
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    per = seats(per.withColumn("_all", blocks).withColumn("_one", F.lit(1)), ["_one"], "target", "_all", "place")
    per = staged(per.select("source", "place", "docs", "source_size", "target", F.col("seats").alias("source_seats")), "mix-sources")

    shards = F.ceil(F.sqrt("docs")).cast("long")
    shard = F.conv(F.substring("draw", 20, 12), 16, 10).cast("long") % shards
    # One row per source: grows with sources, so Spark decides how to join it.
    placed = narrow.join(per, narrow["source"].eqNullSafe(per["source"])).drop(per["source"]).withColumn("shard", shard)
    cells = placed.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_seats").alias("source_seats"))
    quota = seats(cells, ["place"], "shard_size", "source_seats", "shard").select("place", "shard", "shard_size", F.col("seats").alias("quota"))

    ring = Window.partitionBy("place", "shard").orderBy("draw", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    words = F.least(F.col("quota") * block, F.col("shard_size") * MOST_COPIES)
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "place", "shard").cast("binary")), 1, 12), 16, 10).cast("long")
    placed = (
        placed.withColumn("begin", F.coalesce(F.sum("size").over(ring), F.lit(0)))
        .join(quota, ["place", "shard"])
        .withColumn("rounds", F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long"))
        .withColumn("rest", (words - F.col("rounds") * F.col("shard_size")).cast("long"))
        .withColumn("offset", F.when(F.col("shard_size") > 0, offset % F.col("shard_size")).otherwise(0))
    )
    begin, end = F.col("begin"), F.col("begin") + F.col("size")

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(end, b) - F.greatest(begin, a))

    turn = F.col("offset") + F.col("rest")
    partly = overlap(F.col("offset"), F.least(turn, F.col("shard_size"))) + overlap(F.lit(0).cast("long"), turn - F.col("shard_size"))
    return placed.select("doc_id", "source", "digest", "size", "source_size", "target", (F.col("rounds") * F.col("size") + partly).cast("long").alias("taken"))
