"""Mixing sources to target weights, with DataFrame functions only.

Tokens are counted once per document and summed per source. Targets follow by water filling: sources share the corpus
total by weight, a source stops at `limit` times its own size, and what it cannot take is shared anew among the others.
A document of a source with rate r is emitted floor(r) times and once more with probability r - floor(r), decided by
a hash of its id and the seed, so reruns agree. The draw is compared with a threshold of its source, near r - floor(r): the
one at which the words of the documents below it come nearest to the words wanted. So a source misses its target by no more than
half of the words that share one draw (in general half a document), where draws of their own would miss it by chance.

Thresholds are found without sorting a source: sizes are summed in DIGITS-wide ranges of the draw, and only the range in which
the words wanted are reached is split further.

Defined cases: a null text has size 0; null is a source of its own, after all others; documents of a source without
words have rate 0; repeated rows are treated alike (the draw depends on the id); a null id draws as the empty string;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.common import settle

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of a draw, and of the ranges of draws in which sizes are summed before the draws themselves are looked at.
HEX, DIGITS = 13, (2, 4)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """13 hex digits that depend on key and seed alone: a number in [0, 1), written in base 16."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `place`, the 0-based rank by code point with null last.

    The rank is taken in ranges: sources are dealt into ranges by their first bytes, ranked inside, and shifted by the
    counts of the ranges before, so that no task sees all sources unless their names share a beginning.
    """
    begin = F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.hex(F.substring(F.col("source").cast("binary"), 1, 2))))
    named = sources.withColumn("_range", begin)
    counts = named.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1
    return named.withColumn("_in", inside).join(before, "_range").withColumn("place", (F.col("_in") + F.col("_shift")).cast("long")).drop("_range", "_in", "_shift")


def water_fill(sources: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """sources (source, place, source_size) with `target`: weights repeat along place; all sums are exact integers.

    Each round is one aggregate of two numbers; it ends when no source is above its limit.
    """
    kinds = F.array(*[F.lit(w) for w in weights])
    weighted = sources.withColumn("weight", F.element_at(kinds, (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    total, share_all = (x or 0 for x in weighted.agg(F.sum("source_size"), F.sum("weight")).first())
    full, left, share, many = F.lit(False), total, share_all, 0
    number = lambda x: x.cast("decimal(19,0)")
    while share:
        stop = F.col("source_size") * limit
        over = number(F.col("weight")) * number(F.lit(left)) > number(stop) * number(F.lit(share))
        took, used, n = weighted.agg(F.sum(F.when(over, stop)), F.sum(F.when(over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == many:
            break
        full, left, share, many = over, total - took, share_all - used, n
    even = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(share or 1))
    return weighted.withColumn("target", F.when(full, (F.col("source_size") * limit).cast("double")).otherwise(even))


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (_source, source_size, target) with rate and `below`: draws up to it take one more copy (null: none does).

    Of a source's draws in ascending order those are in whose middle word is not beyond the words wanted.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = plan.withColumn("rate", rate).withColumn("wanted", F.col("target") - F.floor("rate") * F.col("source_size"))
    open_ = settle(rated.where("rate > floor(rate)").select("_source", F.col("wanted"), F.lit(0).cast("long").alias("_before"), F.lit("").alias("_range")), "mix-open")
    same = F.col("source").eqNullSafe(F.col("_source"))
    for digits in (*DIGITS, HEX):
        # The ranges of `digits` digits inside the open one; the last round has one draw in each.
        inside = sized.select("source", "size", "draw").join(open_, same & F.col("draw").startswith(F.col("_range")))
        sums = inside.groupBy("_source", "wanted", "_before", F.substring("draw", 1, digits).alias("_range")).agg(F.sum("size").alias("_size"))
        ahead = F.coalesce(F.sum("_size").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = sums.withColumn("_before", F.col("_before") + ahead)
        if digits < HEX:
            # The first range that reaches beyond the words wanted; there is one, as they are fewer than the source's.
            reach = placed.where(F.col("_before") + F.col("_size") > F.col("wanted"))
            open_ = settle(reach.groupBy("_source", "wanted").agg(F.min(F.struct("_range", "_before")).alias("r")).select("_source", "wanted", "r._before", "r._range"), "mix-open")
    taken = F.col("_before") + F.col("_size") / 2 <= F.col("wanted")
    # Without a draw of the open range, those before it are in: they come before its first digits, its own after.
    found = placed.groupBy("_source").agg(F.coalesce(F.max(F.when(taken, F.col("_range"))), F.substring(F.min("_range"), 1, max(DIGITS))).alias("below"))
    named = found.withColumnRenamed("_source", "_own")
    return rated.join(named, F.col("_source").eqNullSafe(F.col("_own")), "left").select("_source", "source_size", "target", "rate", "below")


def _sizes(docs: DataFrame, seed: str, text: str, key: str, source: str) -> tuple[DataFrame, Callable[[tuple[int, ...], int], DataFrame]]:
    slim = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), draw(F.col(key), seed).alias("draw"))
    sized = settle(slim, "mix-sizes")

    def plan(weights: tuple[int, ...], limit: int) -> DataFrame:
        sums = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
        filled = water_fill(settle(ranked(sums), "mix-ranked"), weights, limit).select(F.col("source").alias("_source"), "source_size", "target")
        return settle(thresholds(sized, settle(filled, "mix-filled")), "mix-plan")

    return sized, plan


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, draw) with the columns of their source's plan and `copies`."""
    one = F.when(F.col("draw") <= F.col("below"), 1).otherwise(0)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", (F.floor("rate") + one).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: str = "mix", text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    sized, plan = _sizes(docs, seed, text, key, source)
    return _copies(sized, plan(weights, limit)).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: str = "mix", text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with every row repeated as often as the mix takes it; the columns stay as they are."""
    own = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    _, plan = _sizes(docs, seed, text, key, source)
    whole = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.col(source).alias("source"), draw(F.col(key), seed).alias("draw"))
    out = _copies(whole, plan(weights, limit))
    return out.where("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select(*[F.col(n).alias(c) for c, n in own.items()])
