"""Exemplar memory, model-call logs and hooks for callers' functions."""

from __future__ import annotations

import traceback
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import cache_key
from .entities import first_in_order
from .ranges import nodes_above, nodes_before


#: Domains of a set up to which it is found by its parts; larger sets meet by single domains.
PARTS = 8


def _parts(domains: Column) -> Column:
    """All parts of a sorted array of at most ``PARTS`` domains, the empty one too; of a larger one the empty one alone."""
    power = lambda i: F.pow(F.lit(2.0), i).cast("int")
    part = lambda m: F.filter(domains, lambda x, i: F.floor(m / power(i)) % 2 == 1)
    none = F.array(F.array().cast("array<string>"))
    return F.when(F.size(domains) > PARTS, none).otherwise(F.transform(F.sequence(F.lit(0), power(F.least(F.size(domains), F.lit(PARTS))) - 1), part))


def candidates(asked: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """(wants, at, ord, overlap): exemplars heads(ord, has, made) among which are the k that share most domains with each of asked(wants, at) and
    were made before it, of equal ones the earlier.

    Whatever belongs to the best k of a set is among the first k that have all of what they share; so lists of the first k are
    kept for each part of a set of at most ``PARTS`` domains, and a set looks its own parts up: 2 ** n lists of k rows, however popular
    a domain is.  "Made before" is a handful of nodes of a tree over the batches, each with lists of its own.  Larger sets meet
    the others by single domains; the empty part has the first k of all."""
    levels = int(asked.agg(F.max("at")).first()[0] or 0).bit_length()
    key = ["part", "n.level", "n.node"]
    each = heads.select("ord", "has", "made", F.explode(_parts(F.col("has"))).alias("part"))
    each = each.select("part", "ord", "has", F.explode(nodes_above(F.col("made"), levels)).alias("n")).select("ord", "has", *key)
    lists = first_in_order(each, k, "part", "level", "node").drop("rank")
    look = asked.select("wants", "at", F.explode(_parts(F.col("wants"))).alias("part"))
    look = look.select("wants", "at", "part", F.explode(nodes_before(F.col("at"), levels)).alias("n")).select("wants", "at", *key)
    found = look.join(lists, ["part", "level", "node"]).select("wants", "at", "ord", "has")
    large = lambda c: F.size(c) > PARTS
    wide = cut(asked.where(large("wants"))), cut(heads.where(large("has")))
    if not (wide[0].isEmpty() and wide[1].isEmpty()):
        one = lambda df, c: df.select(c).distinct().select(c, F.explode(c).alias("domain"))
        both = [(wide[0], heads), (asked.where(~large("wants")), wide[1])]
        for q, e in both:
            shared = one(q, "wants").join(one(e, "has"), "domain").select("wants", "has").distinct()
            found = found.unionByName(q.join(shared, "wants").join(e, "has").where("made < at").select("wants", "at", "ord", "has"))
    overlap_of = F.size(F.array_intersect("wants", "has")).cast("long")
    return found.dropDuplicates(["wants", "at", "ord", "has"]).select("wants", "at", "ord", overlap_of.alias("overlap"))


def retrieve(queries: DataFrame, exemplars: DataFrame, k: int) -> DataFrame:
    """(query_id, ord, overlap, rank): the k exemplars(ord, domains) that share most domains with each query(query_id,
    domains), of equal ones the earlier; a query that shares none with any gets the first k of all.

    Exemplars of the same set of domains count by their first k only, and queries of the same set are answered
    once: what is compared is sets.  With ``batch_no`` (from 0) on both sides only exemplars of earlier batches count.
    Null domains and null sets count as none."""
    batched = "batch_no" in queries.columns and "batch_no" in exemplars.columns
    as_set = F.array_sort(F.array_distinct(F.filter(F.coalesce("domains", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    at = F.col("batch_no") if batched else F.lit(1)
    q = queries.select("query_id", as_set.alias("wants"), at.alias("at"))
    asked = cut(q.select("wants", "at").distinct())
    heads = exemplars.select("ord", as_set.alias("has"), (at if batched else F.lit(0)).alias("made"))
    heads = cut(first_in_order(heads, k, "has", "made").drop("rank"))
    best = Window.partitionBy("wants", "at").orderBy(F.desc("overlap"), "ord")
    top = F.max("overlap").over(Window.partitionBy("wants", "at"))
    found = candidates(asked, heads, k).withColumns({"rank": F.row_number().over(best), "top": top}).where((F.col("rank") <= k) & ((F.col("overlap") > 0) | (F.col("top") == 0)))
    return q.join(found, ["wants", "at"]).select("query_id", "ord", "overlap", "rank")


def exemplar_text(found: DataFrame, exemplars: DataFrame) -> DataFrame:
    """(query_id, text): the retrieved exemplars as numbered examples; goals cut to 500 characters, trajectories to 2,000."""
    e = exemplars.select("ord", F.left("goal", F.lit(500)).alias("goal"), F.left(F.coalesce("trajectory", F.lit("")), F.lit(2000)).alias("trajectory"))
    block = F.concat(F.lit("### Example "), F.col("rank").cast("string"), F.lit("\nGoal: "), "goal", F.when(F.col("trajectory") == "", "").otherwise(F.concat(F.lit("\n"), "trajectory")))
    by = found.join(e, "ord").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return by.select("query_id", F.array_join("x.b", "\n\n").alias("text"))


def batch_domains(rows: DataFrame, *by: str) -> DataFrame:
    """(by, domains): the different domains but ``general``, sorted."""
    return rows.where("domain <> 'general'").groupBy(*by).agg(F.array_sort(F.collect_set("domain")).alias("domains"))


def overlap(a, b) -> Column:
    return F.size(F.array_intersect(a, b))


def usage_totals(calls: DataFrame) -> DataFrame:
    """(call_tag, n_calls, prompt_tokens, completion_tokens), with ``all`` for the sum."""
    out = calls.rollup("call_tag").agg(F.count("*").alias("n_calls"), F.coalesce(F.sum("usage.prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("usage.completion_tokens"), F.lit(0)).alias("completion_tokens"))
    return out.withColumn("call_tag", F.coalesce("call_tag", F.lit("all")))


def predict(dialogues: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Predictions of a caller's function from a pandas frame of dialogues to one of the same length, batch by batch."""

    def run(frames):
        for frame in frames:
            out = fn(frame)
            if len(out) != len(frame):
                raise ValueError(f"{len(out)} predictions for {len(frame)} dialogues")
            yield out

    return dialogues.mapInPandas(run, schema)


def score_with_cache(calls: DataFrame, cache: DataFrame, fn: Callable, model: str = "model", messages: str = "messages") -> tuple[DataFrame, DataFrame]:
    """(calls with ``reply``, the new rows of the cache(key, reply)): the function, from a pandas series of JSON messages to
    replies, sees each call that the cache has not got once."""
    keyed = calls.withColumns({"key": cache_key(F.col(model), F.col(messages)), "__json": F.to_json(messages)})
    missing = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.any_value("__json").alias("json"))

    def run(frames):
        for frame in frames:
            yield frame.assign(reply=fn(frame["json"]))[["key", "reply"]]

    new = missing.mapInPandas(run, "key string, reply string")
    known = cache.select("key", "reply").unionByName(new)
    return keyed.drop("__json").join(known, "key", "left"), new


def reply_table(spark, name: str, path: str | None = None, buckets: int = 64) -> str:
    """The name of a table of replies(key, reply), bucketed by key, made if it is not there.  With ``path`` its files outlive the
    session and its catalog; they must be opened with the number of buckets that they were written with."""
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (key STRING, reply STRING) USING parquet CLUSTERED BY (key) INTO {int(buckets)} BUCKETS{place}")
    return name


def score_through(calls: DataFrame, table: str, fn: Callable, buckets: int = 64, model: str = "model", messages: str = "messages") -> DataFrame:
    """calls with ``key``, ``reply`` and ``hit`` (the table had it before); what it had not is appended, so that the next call finds it.

    Different calls are gathered first and written, so a call that is made very often is one row of the join with the
    table and a skewed key that the engine may split in the join with the calls.  The table is read by bucket and is not
    moved; a call that runs again after it was stopped finds what it has appended.  Two callers at once may append a key
    twice: its least reply counts, for both of them from their next call on.  The function gets JSON messages, each missing key once
    (again where a task is tried again), and must give as many replies; null replies are kept.  Null messages are a call like others."""
    spark = calls.sparkSession
    keyed = calls.withColumn("key", cache_key(F.col(model), F.col(messages)))
    asked = cut(keyed.groupBy("key").agg(F.any_value(F.to_json(messages)).alias("json")))

    def stored() -> DataFrame:
        return spark.table(table).groupBy("key").agg(F.min("reply").alias("reply")).hint("merge")

    def run(frames):
        for frame in frames:
            yield frame.assign(reply=fn(frame["json"]))[["key", "reply"]]

    before = cut(asked.join(stored().select("key", F.lit(True).alias("hit")), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))))
    new = before.where("not hit").select("key", "json").mapInPandas(run, "key string, reply string")
    new.repartition(buckets, "key").write.mode("append").insertInto(table)
    spark.catalog.refreshTable(table)
    replies = cut(before.select("key", "hit").join(stored(), "key"))
    return keyed.join(replies, "key")


def analyse(rows: DataFrame, fn: Callable, key: str = "instance_id") -> DataFrame:
    """(key, report, error): a caller's function of one row (a dict) for each row; what it raises becomes the row's error."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                try:
                    out.append((r[key], str(fn(r)), None))
                except Exception as e:
                    out.append((r[key], None, traceback.format_exception_only(e)[-1].strip()))
            yield pd.DataFrame(out, columns=[key, "report", "error"])

    return rows.mapInPandas(run, f"{key} {kind}, report string, error string")
