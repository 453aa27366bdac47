"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets.  Sources share the whole word count by weight; a target stops at ``most_passes`` times the size of its source and the excess is
   shared again by weight until none is above.
2. Quotas.  The whole is cut into blocks of ``block_words`` words.  Blocks go to sources by highest quotients target / (2 n + 1), then each
   source's blocks go to its shards by highest quotients size / (2 n + 1): integer quotas per shard.
3. Selection.  A shard's documents, in an order seeded by md5, form a stream that is read round and round; its quota of blocks is taken from
   the front.  A document so gets whole passes, and one document of a shard may get a part.

Defined results: null text has size 0 and is taken 0 times; null sources are one source, the last; repeated rows are documents of their own;
an empty table gives an empty result; columns beyond doc_id, text and source are carried on, unless one has the name of an output column
(size, source_size, target, taken), which then holds the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD_PATTERN, packed, settled, small, unpacked

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 17
MOST_PASSES = 3
SEED = "mix-1"
BUCKETS = 4_096
OUTPUTS = ("size", "source_size", "target", "taken")


def sainte_lague(votes: DataFrame, group: str, key: str, out: str = "seats", buckets: int = BUCKETS) -> DataFrame:
    """Seats by highest quotients votes / (2 n + 1), ties to the smaller key.  ``votes`` has the group, key, votes and total (seats of the group).

    For q = total * votes / sum and k parties, no party's seats differ from q by more than q k / (2 total) + 1/2, as a divisor within that
    share of the mean fills the house.  So only quotients in that range compete: some four a party, however many seats there are.  They are
    counted in ``buckets`` ranges of their group; all above the range in which the seats run out win, and only those in it are ranked.
    """
    v = votes.where("votes > 0 AND total > 0")
    sums = v.groupBy(group).agg(F.sum("votes").alias("_sum"), F.count("*").alias("_k"))
    n_groups = sums.count()
    v = v.join(small(sums, n_groups), group)
    v = v.withColumn("_q", F.col("total") * F.col("votes") / F.col("_sum")).withColumn("_d", F.col("_q") * F.col("_k") / (2 * F.col("total")) + 1)
    v = settled(v.withColumns({"_lo": F.greatest(F.lit(0).cast("long"), F.floor(F.col("_q") - F.col("_d"))), "_hi": F.ceil(F.col("_q") + F.col("_d"))}), "parties")
    quotients = v.withColumn("_n", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1))).select(group, key, "_n", (F.col("votes") / (2 * F.col("_n") + 1)).alias("_quotient"))
    quotients = settled(quotients, "quotients")
    ends = settled(v.groupBy(group).agg((F.max("total") - F.sum("_lo")).alias("_left")).join(quotients.groupBy(group).agg(F.min("_quotient").alias("_min"), F.max("_quotient").alias("_max")), group), "ends")
    share = F.when(F.col("_max") > F.col("_min"), (F.col("_max") - F.col("_quotient")) / (F.col("_max") - F.col("_min"))).otherwise(0.0)
    dealt = quotients.join(small(ends, n_groups), group).withColumn("_bucket", F.floor(share * buckets))
    # At most ``buckets`` + 1 rows a group are ordered here.
    order = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counted = dealt.groupBy(group, "_bucket", "_left").agg(F.count("*").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(order), F.lit(0)))
    last = settled(counted.where((F.col("_before") <= F.col("_left")) & (F.col("_before") + F.col("_m") > F.col("_left"))).select(F.col(group).alias("_g"), F.col("_bucket").alias("_last"), (F.col("_left") - F.col("_before")).alias("_open")), "last")
    placed = dealt.join(small(last, n_groups), F.col(group) == F.col("_g"), "left")
    sure = placed.where(F.col("_last").isNull() | (F.col("_bucket") < F.col("_last"))).select(group, key)
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("_quotient"), key, "_n"))
    ranked = placed.where(F.col("_bucket") == F.col("_last")).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_open")).select(group, key)
    won = v.select(group, key, F.col("_lo").alias("_seats")).unionByName(sure.unionByName(ranked).withColumn("_seats", F.lit(1).cast("long")))
    return won.groupBy(group, key).agg(F.sum("_seats").alias(out))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """source, source_size, target, idx.  One row per source is all that is ordered here."""
    whole = W.partitionBy(F.lit(0))
    s = by_source.withColumn("idx", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int")).cast("decimal(20,0)"))
    s = s.withColumn("cap", (F.col("source_size") * most_passes).cast("decimal(20,0)"))
    # By rising cap per weight, sources fill up first to last: a source is full if its cap is below its share of what the full ones left.
    order = whole.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), "idx")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("weights_left", F.sum("w").over(after))
    s = s.withColumn("full", (F.col("cap").cast("double") * F.col("weights_left").cast("double") < F.col("w").cast("double") * F.col("rest").cast("double")).cast("int"))
    s = s.withColumn("full", F.min("full").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    open_ = F.col("full") == 0
    total = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(~open_, F.col("cap"))).over(whole), F.lit(0))
    weight = F.sum(F.when(open_, F.col("w"))).over(whole)
    s = s.withColumn("target", F.when(open_, F.col("w").cast("double") * total.cast("double") / weight.cast("double")).otherwise(F.col("cap").cast("double")))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), "target", "idx")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, most_passes: int = MOST_PASSES, seed: str = SEED, keep_text: bool = True) -> DataFrame:
    """Every document with size, source_size, target and taken; without its text unless ``keep_text``."""
    own = [c for c in docs.columns if c not in OUTPUTS and (keep_text or c != "text")]
    sizes = packed(docs.drop(*OUTPUTS), "doc_id", "source", "text").withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long"))
    sizes = settled(sizes if keep_text else sizes.drop("text"), "sizes")
    by_source = settled(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_passes), "sources")
    n = by_source.count()
    per_source = by_source.withColumn("total", F.round(F.sum("source_size").over(W.partitionBy(F.lit(0))) / block_words).cast("long")).withColumn("votes", F.col("target")).withColumn("whole", F.lit(0))
    won = settled(by_source.join(sainte_lague(per_source, "whole", "idx", "quota").drop("whole"), "idx", "left"), "quotas").select(F.col("source").alias("s"), "source_size", "target", "idx", F.coalesce("quota", F.lit(0)).alias("quota"))
    dealt = sizes.join(small(won, n), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    token = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    dealt = dealt.withColumn("token", token).withColumn("shard", F.conv(F.substring("token", 1, 8), 16, 10).cast("long") % shards)
    per_shard = dealt.groupBy("idx", "shard").agg(F.sum("size").alias("votes"), F.max("quota").alias("total"))
    quotas = settled(sainte_lague(per_shard, "idx", "shard"), "shards").toDF("of_idx", "of_shard", "seats")
    shard = W.partitionBy("idx", "shard")
    order = shard.orderBy("token", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.withColumns({"upto": F.sum("size").over(order), "whole": F.sum("size").over(shard)})
    placed = placed.join(quotas, (F.col("idx") == F.col("of_idx")) & (F.col("shard") == F.col("of_shard")), "left")
    want = F.least(F.coalesce("seats", F.lit(0)) * block_words, F.col("whole") * most_passes)
    over = F.col("whole") > 0
    passes = F.when(over, F.floor(want / F.col("whole"))).otherwise(0)
    rest = F.when(over, want % F.col("whole")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("upto"), rest) - (F.col("upto") - F.col("size")))
    out = placed.withColumn("taken", (passes * F.col("size") + part).cast("long"))
    return out.select(*unpacked(own, "doc_id", "source", "text"), *OUTPUTS)
