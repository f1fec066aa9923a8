"""Mixing sources to target weights by weighted fair queueing.

Every document of a source stands in the source's queue twice (two epochs), shuffled by a
hash of its id. Its virtual finish time is the cumulative words of the queue up to it,
divided by the source's target. All entries of all sources are sorted by range on their finish
times (then hash, size, epoch), and the mix is the longest prefix whose words the total
budget holds. What ends by time 1 is always in it, and what follows fills up the budget, so a source
misses its target by a document at most. Entries carry no texts: they are sorted as keys, and one
key, that of the last entry in the mix, tells which copies of a document are taken.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share the budget;
none exceeds `epochs` times its source's size, the excess is shared again by weight until none
is above. That is water filling, solved in closed form over the table of sources.

A hot source is dealt out by its hash range to buckets of a bounded share of the rows;
prefix sums run inside the buckets and over the table of buckets.

Defined results: a null or empty text has size 0; a null source is a source of its own; null
ids share one hash; ties are ordered by id and size; repeated rows stand in the queue one
by one; an empty table gives an empty result; other columns are kept by mix() and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, partitions

WEIGHTS = (5, 2, 1)
#: The budget as a ratio of all words, and the most epochs of a source.
BUDGET = (3, 2)
EPOCHS = 2


def _order(seed: str = "mix") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target from source, size. One row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.get(F.array(*map(F.lit, weights)), place).cast("long")).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    per = per.withColumns({"total": F.sum("source_size").over(every) * budget[0] / budget[1], "w_all": F.sum("w").over(every), "cap_sum": F.sum("cap").over(upto), "w_sum": F.sum("w").over(upto)})
    # the level at which this source is full gives out: what is full up to it, and the rest by weight
    full = F.col("cap_sum") + F.col("cap") / F.col("w") * (F.col("w_all") - F.col("w_sum"))
    level = (F.col("total") - (F.col("cap_sum") - F.col("cap"))) / (F.col("w_all") - (F.col("w_sum") - F.col("w")))
    per = per.withColumn("level", F.min(F.when(full >= F.col("total"), F.struct(F.col("cap") / F.col("w"), level.alias("at")))).over(every)["at"])
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def _queues(sizes: DataFrame, **kinds) -> DataFrame:
    """sizes with __order, source_size, target and __end: the words of the source's queue up to
    and with the row, in one epoch."""
    target = max(64, sizes.count() // (2 * partitions(sizes.sparkSession)))
    share = targets(sizes, **kinds).withColumnRenamed("source", "__source")
    rows = sizes.withColumn("__order", _order())
    n_rows = sizes.groupBy(F.col("source").alias("__s")).agg(F.count("*").alias("__n"))
    per = n_rows.withColumn("__buckets", F.ceil(F.col("__n") / target)).join(share, F.col("__s").eqNullSafe(F.col("__source"))).drop("__s")
    # the first 32 bits of the hash are even: their range is dealt out to the buckets
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "__n")
    rows = rows.withColumn("__bucket", F.floor(F.conv(F.substring("__order", 1, 8), 16, 10).cast("double") / 4294967296 * F.col("__buckets")))
    sums = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__source"), F.col("__bucket").alias("__at"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("source", "__bucket").orderBy("__order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__in", F.sum("size").over(inside))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__at")))
    return rows.withColumn("__end", F.col("__before") + F.col("__in")).drop("__source", "__at", "__before", "__in", "__bucket", "__buckets")


def _entry(epoch) -> list[Column]:
    """The place of a row's copy in the mix: its virtual finish time, then what settles ties."""
    finish = (F.lit(epoch) * F.col("source_size") + F.col("__end")) / F.nullif(F.col("target"), F.lit(0.0))
    return [F.coalesce(finish, F.lit(0.0)).alias("finish"), F.col("__order"), F.col("size"), F.lit(epoch).alias("epoch")]


def cut(queues: DataFrame, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS) -> tuple | None:
    """The place of the last entry that the budget holds, None if it holds all, (-1.0, ...) if none. All
    entries are sorted by range; the sizes of the ranges (one row each) tell the one in which the
    budget ends, and only that one is summed row by row. queues: a written table."""
    each = queues.select(F.explode(F.array(*[F.struct(*_entry(k)) for k in range(epochs)])).alias("e")).select("e.*")
    ranked = materialize(each.orderBy("finish", "__order", "size", "epoch").withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sums = sorted(ranked.groupBy(part.alias("p")).agg(F.sum("size").alias("n")).collect())
    left = budget[0] * (sum(n for _, n in sums) // epochs) // budget[1]  # sizes are whole
    for p, n in sums:
        if n > left:
            upto = F.sum("size").over(Window.partitionBy("p").orderBy("__m").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            own = ranked.withColumn("p", part).filter(F.col("p") == p).withColumn("upto", upto).filter(F.col("upto") <= left)
            place = F.struct("finish", "__order", "size", "epoch")
            last = own.agg(F.max_by(place, "__m").alias("x")).first()["x"]
            if last is None:  # the range begins with the entry that is too much
                last = ranked.filter(part < p).agg(F.max_by(place, "__m").alias("x")).first()["x"]
            return tuple(last) if last is not None else (-1.0, "", 0, 0)
        left -= n
    return None


def schedule(sizes: DataFrame, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS, **kinds) -> DataFrame:
    """doc_id, source, size, source_size, target, finish (virtual finish time of the first
    copy), copies (how many the mix takes). sizes must be a written table."""
    rows = materialize(_queues(sizes, budget=budget, epochs=epochs, **kinds))
    last = cut(rows, budget, epochs)
    taken = F.lit(epochs).cast("long")
    if last is not None:
        end = F.struct(*[F.lit(x).cast(t) for x, t in zip(last, ("double", "string", "long", "int"), strict=True)])
        taken = sum((F.struct(*[c.cast(t) for c, t in zip(_entry(k), ("double", "string", "long", "int"), strict=True)]) <= end).cast("long") for k in range(epochs))
    kept = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    return rows.select("doc_id", "source", "size", *kept, "source_size", "target", _entry(0)[0], taken.alias("copies"))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def allot(docs: DataFrame, **kinds) -> DataFrame:
    """schedule() for documents (doc_id, text, source)."""
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"))
    return schedule(materialize(sizes), **kinds)


def mix(docs: DataFrame, ordered: bool = True, **kinds) -> DataFrame:
    """The mix itself: the documents' own columns, a row for each copy, in the order of
    their virtual finish times (or in any, without moving the texts once more). Rows that share a doc_id are given copies as their
    repeats in the queue: the k-th of them, by source and size, those of the k-th entry."""
    names = docs.columns
    key = ["doc_id", "source", "size"]
    rows = docs.withColumn("__size", word_count())
    sizes = materialize(rows.select("doc_id", F.col("source").cast("string").alias("source"), F.col("__size").alias("size")))
    took = schedule(sizes, **kinds)
    here, match = rows.withColumnRenamed("__size", "__words"), F.lit(True)
    if not sizes.groupBy(*key).count().filter("count > 1").isEmpty():  # tell repeated rows apart
        took = took.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy("finish")))
        own = F.xxhash64(*[c for c in names if docs.schema[c].dataType.typeName() != "map"])
        here = here.withColumn("__place", F.row_number().over(Window.partitionBy("doc_id", F.col("source").cast("string"), "__words").orderBy(own)))
        match = F.col("__place") == F.col("__k")
    entries = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("__epoch")
    more = ["__k"] if "__k" in took.columns else []
    copies = took.filter("copies > 0").select(*[F.col(c).alias(f"__{c}") for c in key], *more, F.col("finish").alias("__finish"), F.col("target").alias("__target"), F.col("source_size").alias("__all"), entries)
    at = F.col("__finish") + F.col("__epoch") * F.col("__all") / F.nullif(F.col("__target"), F.lit(0.0))
    joined = here.join(copies, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")) & match)
    return (joined.orderBy(at, "doc_id") if ordered else joined).select(*[F.col(f"`{c}`") for c in names])
