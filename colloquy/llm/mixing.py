"""Mixing sources to target weights, in fixed-length blocks of tokens.

1. Documents of a source are packed end to end, in a pseudorandom order, and cut
   every ``BLOCK`` words; the last block of a source may be shorter.  The order
   comes from two levels of running sums (inside buckets of hashed ids, then over
   bucket totals), so that a hot source is spread over its buckets.
2. Targets: sources, by code point with null last, weigh 5, 2, 1, 5, 2, 1, ... and
   share 150 % of all words; a target stops at twice its source's words and what
   is over is shared out again by weight.  A source's target, rounded to whole words, is a number of slots, the last of which may be cut short.
3. Shards have ``SHARD`` slots.  Each slot of a shard draws its source by the sources' shares of all slots:
   multinomial counts.  A source stops when it has all its slots, and slots drawn for it in vain (some
   square root of all, in the last shards) go to the sources that lack some, so that every target is met.
4. The counts, added up over the shards, number each source's slots.  Slot j of a source is its pass j div n and
   block p(j mod n) for n blocks, with p a pseudorandom permutation of the source and pass over its full blocks; a shorter
   block ends each pass, so that a pass that is not whole has full blocks alone.  Slots and blocks are joined by (source, block).

The permutations are four-round Feistel networks with cycle walking, so neither
an index list nor a sort is ever needed.  Nothing depends on partitioning: reruns
agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import numbered
from . import tokens as T
from .session import cut, if_small, positional

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK, SHARD = 128, 1024
#: Documents of a source in one bucket of the packing order; numbers in one run of a sum.
BUCKET = 4096
#: Slots that a task numbers.
PER_TASK = 1 << 16
#: Ranges that drawn numbers are looked up in.
BUCKETS = 1 << 12
WORD = r"[^\x20\x09-\x0D]+"


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The images of x (numbers below n) under a pseudorandom permutation of 0 .. n - 1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = T.mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = x.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (T.mix(right + k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, source and text, whatever other columns there are."""
    rows, new, _ = positional(docs, "doc_id", "source", "text")
    return rows.select(*[F.col(v).alias(k) for k, v in new.items()])


def sizes(docs: DataFrame) -> DataFrame:
    """docs with ``__key`` (its source as a non-null string), ``__size`` in words and ``__mix`` (place in the packing order)."""
    return docs.withColumns(
        {
            "__key": F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")),
            "__size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
            "__mix": F.xxhash64("doc_id", F.lit(17)),
        }
    )


def _running(df: DataFrame, value: str, name: str, order: str, *by: str) -> DataFrame:
    """df with ``name``, the sum of ``value`` over the rows before in the order of a number, in each group.

    Sums run inside runs of ``BUCKET`` numbers and over the runs' totals, so that one group takes many tasks."""
    rows = df.withColumn("__run", F.floor(F.col(order) / BUCKET))
    totals = rows.groupBy(*by, "__run").agg(F.sum(value).alias("__s"))
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*by, "__run", before("__s", Window.partitionBy(*by).orderBy("__run")).alias("__b"))
    inside = before(value, Window.partitionBy(*by, "__run").orderBy(order))
    return rows.withColumn(name, inside).join(totals, [*by, "__run"]).withColumn(name, F.col(name) + F.col("__b")).drop("__run", "__b")


def targets(sized: DataFrame) -> DataFrame:
    """(__key, i, source_size, n_docs, target, n_blocks, slots, rest): a row for each source, i its place.

    ``slots`` hold the target to the word: its whole passes, and blocks of another one, of which the last is cut to ``rest`` words
    (null if it is whole).  Targets are found as they are defined: share out by
    weight, stop those above, share again; each round is one sum over the sources."""
    by = sized.groupBy("__key").agg(F.sum("__size").alias("source_size"), F.count("*").alias("n_docs"))
    by = numbered(cut(by), F.struct(F.col("__key") == "n", "__key")).drop("__n").withColumnRenamed("__i", "i")
    weight = F.when(F.col("i") % 3 == 0, WEIGHTS[0]).when(F.col("i") % 3 == 1, WEIGHTS[1]).otherwise(WEIGHTS[2]).cast("long")
    by = cut(by.withColumn("w", weight).withColumn("most", F.col("source_size") * int(MOST)))
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("most") <= F.col("w") * F.lit(level)
        x = by.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)).alias("most"), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0)).alias("w")).first()
        if x.n == stopped or not x.w:
            break
        stopped, level = x.n, (SHARE * total - x.most) / x.w
    level = F.lit(0.0 if level is None else level)
    by = by.withColumn("target", F.least(F.col("most").cast("double"), F.col("w") * level) if x.w else F.col("most").cast("double"))
    n = F.ceil(F.col("source_size") / BLOCK).cast("long")
    size = F.greatest("source_size", F.lit(1))
    words = F.least(F.round("target").cast("long"), F.col("source_size") * int(MOST))
    over = words % size
    slots = F.floor(words / size) * n + F.ceil(over / BLOCK)
    rest = F.when(over % BLOCK > 0, over % BLOCK)
    return by.select("__key", "i", "source_size", "n_docs", "target", n.alias("n_blocks"), slots.cast("long").alias("slots"), rest.cast("int").alias("rest"))


def packed(sized: DataFrame, by_source: DataFrame) -> DataFrame:
    """The documents with ``__start``, the number of words of their source before them."""
    rows = sized.join(if_small(by_source.select("__key", "n_docs")), "__key")
    rows = rows.withColumn("__bucket", F.floor((F.shiftrightunsigned("__mix", 32) * F.ceil(F.col("n_docs") / BUCKET)) / F.lit(float(1 << 32))).cast("long")).drop("n_docs")
    before = rows.groupBy("__key", "__bucket").agg(F.sum("__size").alias("s"))
    before = before.select("__key", "__bucket", (F.sum("s").over(Window.partitionBy("__key").orderBy("__bucket")) - F.col("s")).alias("__before"))
    inside = Window.partitionBy("__key", "__bucket").orderBy("__mix", "doc_id", "__size", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__in", F.sum("__size").over(inside) - F.col("__size"))
    return rows.join(before, ["__key", "__bucket"]).withColumn("__start", F.col("__before") + F.col("__in")).drop("__bucket", "__before", "__in")


def draws(by_source: DataFrame, seed: int = 0) -> DataFrame:
    """(__key, shard, n): how many slots of each shard go to each source.

    Every slot draws a source with the probability of its share of all slots, so a shard's counts are a multinomial draw.
    A source that has all its slots gets no more; what later shards drew for it in vain goes to the sources
    that lack slots at the end, in a pseudorandom order."""
    rows = cut(_running(by_source.where("slots > 0"), "slots", "base", "i"))
    total = rows.agg(F.sum("slots")).first()[0] or 0
    spark = by_source.sparkSession
    width = max(1, total // BUCKETS)
    reach = lambda low, n: F.explode(F.sequence(F.floor(low / width), F.floor((low + n - 1) / width)))
    ranges = rows.select("__key", "i", "slots", "base", reach(F.col("base"), F.col("slots")).alias("b"))
    slot = spark.range(-(-total // SHARD)).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.least(F.lit(SHARD), F.lit(total) - F.col("id") * SHARD).cast("int") - 1)).alias("k"))
    drawn = slot.withColumn("u", F.pmod(F.xxhash64("shard", "k", F.lit(seed)), F.lit(max(total, 1)))).withColumn("b", F.floor(F.col("u") / width))
    inside = (F.col("u") >= F.col("base")) & (F.col("u") < F.col("base") + F.col("slots"))
    counts = drawn.join(if_small(cut(ranges)), "b").where(inside).groupBy("__key", "shard", "slots").agg(F.count("*").alias("c"))
    counts = _running(cut(counts), "c", "before", "shard", "__key")
    counts = cut(counts.withColumn("n", F.least("c", F.greatest(F.col("slots") - F.col("before"), F.lit(0)))))
    vain = _running(counts.groupBy("shard").agg(F.sum(F.col("c") - F.col("n")).alias("v")).where("v > 0"), "v", "first", "shard")
    vain = cut(vain.select("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("v") - 1)).alias("x")))
    lack = rows.join(counts.groupBy("__key").agg(F.sum("n").alias("had")), "__key", "left").select("__key", "i", (F.col("slots") - F.coalesce("had", F.lit(0))).alias("lack")).where("lack > 0")
    lack = cut(_running(lack, "lack", "low", "i"))
    n = vain.count()
    step = max(1, n // BUCKETS)
    wanted = lack.select("__key", "low", "lack", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("low") + F.col("lack") - 1) / step))).alias("b"))

    def shuffled(batches):
        for b in batches:
            x = permute(b.column("x").to_numpy(), n, seed ^ 0x5EED)
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(x), pa.array(x // step)], names=["shard", "x", "b"])

    filled = vain.mapInArrow(shuffled, "shard long, x long, b long").join(if_small(cut(wanted)), "b").where("x >= low and x < low + lack").select("__key", "shard", F.lit(1).cast("long").alias("n"))
    return counts.select("__key", "shard", "n").unionByName(filled).groupBy("__key", "shard").agg(F.sum("n").alias("n")).where("n > 0")


def _deal(seed: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                j = np.arange(r["first"], r["first"] + r["n"])
                n, p = r["n_blocks"], j // max(r["n_blocks"], 1)
                full, block = r["source_size"] // BLOCK, j % n
                for one in np.unique(p):
                    at = np.flatnonzero((p == one) & (block < full))
                    block[at] = permute(block[at], full, r["hash"] + 31 * int(one) + seed)
                rest = pa.array(np.full(len(j), r["rest"] or 0, np.int32), mask=(j != r["slots"] - 1) | (r["rest"] is None))
                place = permute(np.arange(r["low"], r["low"] + r["n"]), r["size"], r["shard"] ^ seed)
                yield pa.RecordBatch.from_arrays([pa.array([r["__key"]] * len(j), pa.string()), pa.array(np.full(len(j), r["shard"])), pa.array(place), pa.array(block), rest], names=["__key", "shard", "slot", "block", "rest"])

    return run


def slots(by_source: DataFrame, seed: int = 0) -> DataFrame:
    """(__key, shard, slot, block, rest): which block every slot of the mix takes, and its first ``rest`` words alone where that is not null.

    The drawn counts of a source, added up over the shards, number its slots; numbers go through its permutations."""
    drawn = cut(draws(by_source, seed))
    first = _running(drawn, "n", "first", "shard", "__key")
    order = Window.partitionBy("shard").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    rows = first.withColumns({"low": F.coalesce(F.sum("n").over(order), F.lit(0)), "size": F.sum("n").over(Window.partitionBy("shard"))})
    rows = rows.join(if_small(by_source.select("__key", "n_blocks", "source_size", "slots", "rest")), "__key").withColumn("hash", F.xxhash64("__key"))
    some = drawn.agg(F.sum("n")).first()[0] or 0
    rows = rows.select("__key", "shard", "n", "first", "low", "size", "n_blocks", "hash", "source_size", "slots", "rest").repartition(min(max(some // PER_TASK, 1), 1 << 16), "shard")
    return rows.mapInArrow(_deal(seed), "__key string, shard long, slot long, block long, rest int")


def report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken, a row for each row of docs.

    A null text has no words and is never taken; a null source is a source, a null id an id.  Equal rows are
    packed one after the other, each a row of its own.  An empty table gives no rows; other columns are ignored."""
    docs = _plain(docs)
    sized = cut(sizes(docs.withColumn("__tie", F.lit(0))).select("doc_id", "__key", "__size", "__mix", "__tie"))
    by = cut(targets(sized))
    at = packed(sized, by)
    uses = slots(by, seed).groupBy("__key", "block").agg(F.count_if(F.col("rest").isNull()).alias("uses"), F.max("rest").alias("rest"))
    first, last = F.floor(F.col("__start") / BLOCK), F.floor((F.col("__start") + F.col("__size") - 1) / BLOCK)
    parts = at.where("__size > 0").select("doc_id", "__key", "__size", "__start", F.explode(F.sequence(first, last)).alias("block"))
    upto = lambda words: F.greatest(F.least(F.col("block") * BLOCK + words, F.col("__start") + F.col("__size")) - F.greatest(F.col("block") * BLOCK, "__start"), F.lit(0))
    words = upto(F.lit(BLOCK)) * F.coalesce("uses", F.lit(0)) + F.when(F.col("rest").isNull(), 0).otherwise(upto(F.col("rest")))
    took = parts.join(uses.hint("merge"), ["__key", "block"], "left").groupBy("doc_id", "__key", "__size", "__start").agg(F.sum(words).cast("long").alias("taken"))
    none = at.where("__size = 0").select("doc_id", "__key", "__size", F.lit(0).cast("long").alias("taken"))
    out = took.drop("__start").unionByName(none)
    return out.join(if_small(by.select("__key", "source_size", "target")), "__key").select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: (shard, slot, source, block, doc_ids, n_words, text), a row for each slot.

    ``text`` is the block's words joined by blanks, ``doc_ids`` the documents that they come from, in order; the last slot of a source may have
    the first words of its block alone.
    Nulls, repeated rows and other columns are as in ``report``; a very long text spans many blocks."""
    full = sizes(_plain(docs).withColumn("__tie", F.xxhash64("text")))
    sized = cut(full.select("doc_id", "__key", "__size", "__mix", "__tie"))
    by = cut(targets(sized))
    at = packed(full, by).where("__size > 0")
    first, last = F.floor(F.col("__start") / BLOCK), F.floor((F.col("__start") + F.col("__size") - 1) / BLOCK)
    words = at.select("doc_id", "__key", "__start", first.alias("first"), last.alias("last"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"))
    low = lambda b: F.greatest(b * BLOCK - F.col("__start"), F.lit(0))
    part = lambda b: F.struct(b.alias("block"), F.array_join(F.slice("w", (low(b) + 1).cast("int"), ((b + 1) * BLOCK - F.col("__start") - low(b)).cast("int")), " ").alias("text"))
    parts = words.select("doc_id", "__key", "__start", F.explode(F.transform(F.sequence("first", "last"), part)).alias("p"))
    blocks = parts.groupBy("__key", F.col("p.block").alias("block")).agg(F.array_sort(F.collect_list(F.struct("__start", "doc_id", F.col("p.text").alias("text")))).alias("x"))
    blocks = blocks.select("__key", "block", "x", F.array_join("x.text", " ").alias("text"))
    source = F.when(F.col("__key") == "n", None).otherwise(F.expr("substring(__key, 2)"))
    out = slots(by, seed).hint("merge").join(blocks, ["__key", "block"])
    part = F.when(F.col("rest").isNull(), F.col("text")).otherwise(F.array_join(F.slice(F.split("text", " "), 1, F.coalesce("rest", F.lit(0))), " "))
    inside = F.filter("x", lambda e: F.col("rest").isNull() | (e["__start"] < F.col("block") * BLOCK + F.col("rest")))
    out = out.withColumn("doc_ids", F.transform(inside, lambda e: e["doc_id"])).withColumn("text", part)
    return out.select("shard", "slot", source.alias("source"), "block", "doc_ids", F.regexp_count("text", F.lit(WORD)).alias("n_words"), "text")
