"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

DataFrame and SQL functions only. Each source's target is its weight's share of the mix, stopped at
max_repeats times its size (the excess is reshared by weight). The mix is cut into blocks of equal
words; the blocks go to sources by the highest quotients target / (k + 1/2), then to the shards of
each source in the same way, and within a shard the blocks that a pass takes are drawn by seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, join_checked, materialize


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_repeats: int) -> DataFrame:
    """(source, source_size) -> adds rn (place by code point, null last) and target.

    Water filling: target = least(cap, level * weight), where the level is what the uncapped sources
    have left per weight. One row a source, so the windows over all of them are small.
    """
    rn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    s = sources.withColumn("rn", rn).withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rn") - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = W.orderBy("ratio", "rn")
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("left", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(W.partitionBy()) * share - F.col("before")) / F.col("left"))
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rn", "level"))).over(W.partitionBy())["level"], F.lit(float("inf")))
    return s.select("source", "source_size", "rn", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def apportion(rows: DataFrame, group: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë: adds out, the seats (of the group's column seats) that each row wins.

    The seats that a row is sure of are given at once and only quotients near the divisor compete,
    about six a row, so the work grows with the rows and not with the seats.
    """
    g = W.partitionBy(*group)
    r = rows.withColumn("_n", F.count("*").over(g)).withColumn("_v", F.sum(F.col(votes).cast("double")).over(g))
    r = r.withColumn("_p", F.when(F.col("_v") > 0, F.col(votes) / F.col("_v")).otherwise(0.0))
    slack = F.ceil(F.col("_n") * F.col("_p")) + 1
    r = r.withColumn("_lo", F.greatest(F.lit(0), F.floor(F.col("_p") * F.col(seats)) - slack).cast("long"))
    r = r.withColumn("_hi", (F.ceil(F.col("_p") * F.col(seats)) + slack).cast("long"))
    r = r.withColumn("_rest", F.col(seats) - F.sum("_lo").over(g))
    q = r.select(*group, key, "_rest", (F.col(votes).cast("double")).alias("_votes"), F.explode(F.sequence("_lo", "_hi")).alias("_k"))
    q = q.withColumn("_rank", F.row_number().over(g.orderBy((F.col("_votes") / (F.col("_k") + 0.5)).desc(), key)))
    won = q.where("_rank <= _rest and _votes > 0").groupBy(*group, key).agg(F.count("*").alias("_won"))
    both = [*group, key]
    return r.join(won, both, "left").withColumn(
        out,
        F.when(F.col("_v") > 0, F.col("_lo") + F.coalesce("_won", F.lit(0))).otherwise(F.lit(0)).cast("long"),
    ).drop("_n", "_v", "_p", "_lo", "_hi", "_rest", "_won")


def _hash(*parts) -> Column:
    """A seeded hash that any SQL engine can compute: the first 8 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_repeats: int = 2,
    block_words: int = 256,
    least_blocks: int = 20_000,
    shard_words: int = 1 << 18,
    most_shards: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """Documents (doc_id, text, source, ...) -> one row each: doc_id, source, size, source_size,
    target, taken, and the source's place rn and the document's shard.

    A text that is null or has no words has size 0 and takes 0. A null source is a source of its own,
    last in order. Rows that repeat, also with the same doc_id, count each on their own. An empty
    table gives no rows. Blocks have block_words words, fewer where the mix would have under
    least_blocks of them. A large source has up to most_shards shards of at least shard_words words, dealt
    by a hash of doc_id, so no source meets in one task.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    src = materialize(targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, share, max_repeats), "targets")
    n_src, total = src.agg(F.count("*"), F.sum("target")).first()
    block = max(1, min(block_words, int((total or 0) // least_blocks)))
    src = src.withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(most_shards), F.ceil(F.col("source_size") / shard_words))))
    src = src.withColumn("seats", F.lit(round((total or 0) / block)).cast("long"))
    src = materialize(apportion(src, [], "rn", "target", "seats", "quota"), "quotas")

    s = sized.withColumnRenamed("source", "_s")
    rows = join_checked(s, src, s["_s"].eqNullSafe(src["source"]), "inner", n_src, 200)
    rows = rows.withColumn("shard", F.pmod(_hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), F.col("shards")))
    spot = W.partitionBy("rn", "shard").orderBy(F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "rn", "shard", (F.sum("size").over(spot) - F.col("size")).alias("a"), F.row_number().over(spot).alias("at"))
    rows = materialize(rows, "spans")

    shards = rows.groupBy("rn", "shard").agg(F.sum("size").alias("words"))
    shards = shards.withColumn("blocks", F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block))).otherwise(0).cast("long"))
    shards = shards.join(src.select("rn", "quota"), "rn")
    shards = apportion(shards, ["rn"], "shard", "blocks", "quota", "won")
    shards = shards.withColumn("won", F.least("won", F.col("blocks") * max_repeats)).where("blocks > 0")
    shards = materialize(shards.select("rn", "shard", "words", "blocks", F.expr("won div blocks").alias("passes"), F.expr("won % blocks").alias("extra")), "shards")

    drawn = shards.where("extra > 0").select("rn", "shard", "extra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    draw = F.row_number().over(W.partitionBy("rn", "shard").orderBy(_hash(F.lit(seed), "rn", "shard", "block"), "block"))
    drawn = drawn.withColumn("_d", draw).where("_d <= extra").select("rn", "shard", "block")

    n_shards = shards.count()
    rows = join_checked(rows, shards, ["rn", "shard"], "left", n_shards, 64)
    first, last = F.expr("((a + 1) * blocks - 1) div words"), F.expr("((a + size) * blocks - 1) div words")
    cut = rows.where("extra > 0 and size > 0").select("rn", "shard", "at", "a", "size", "blocks", "words", F.explode(F.sequence(first, last)).alias("block"))
    part = F.least(F.col("a") + F.col("size"), F.expr("((block + 1) * words) div blocks")) - F.greatest(F.col("a"), F.expr("(block * words) div blocks"))
    part = cut.join(drawn, ["rn", "shard", "block"]).groupBy("rn", "shard", "at").agg(F.sum(part).alias("part"))
    out = rows.join(part, ["rn", "shard", "at"], "left")
    taken = F.coalesce(F.col("passes"), F.lit(0)) * F.col("size") + F.coalesce(F.col("part"), F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "rn", "shard")


def whole(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """Rounds mix()'s rows to whole documents: doc_id, source, size, copies, where copies > 0.

    Each document gets the whole part of taken / size, and one copy more where the running sum of
    the fractions passes a half: in ascending size within a shard, by seed within a size, and
    from each shard on to the source's next. So a source's copies are its fractions' sum to a half,
    and by summation by parts its words differ from taken by no more than each shard's longest
    document. Rows of one doc_id, source and size share their copies. Fractions are 30-bit integers.
    """
    u = mixed.where("size > 0").groupBy("rn", "shard", "source", "doc_id", "size").agg(F.sum("taken").alias("taken"), (F.count("*") * F.col("size")).alias("words"))
    u = u.select("rn", "shard", "source", "doc_id", "size", "words", F.expr("taken div words").alias("sure"), F.expr("shiftleft(taken % words, 30) div words").alias("part"))
    u = materialize(u, "units")
    shards = u.groupBy("rn", "shard").agg(F.sum("part").alias("start"))
    before = W.partitionBy("rn").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = materialize(shards.withColumn("start", F.coalesce(F.sum("start").over(before), F.lit(0)) + (1 << 29)), "starts")
    u = join_checked(u, shards, ["rn", "shard"], "inner", shards.count(), 32)
    upto = W.partitionBy("rn", "shard").orderBy(
        "words",
        _hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))),
        F.col("doc_id").asc_nulls_last(),
        "size",
    ).rowsBetween(W.unboundedPreceding, W.currentRow)
    u = u.withColumn("end", F.col("start") + F.sum("part").over(upto))
    copies = F.col("sure") + F.shiftright("end", 30) - F.shiftright(F.col("end") - F.col("part"), 30)
    return u.select("doc_id", "source", "size", copies.cast("int").alias("copies")).where("copies > 0")
