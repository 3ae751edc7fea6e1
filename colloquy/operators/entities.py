"""Constraint queries against entity tables.

Queries that want the same are answered once.  What they want meets the entities by equality joins on
(domain, attribute, value), of the rarest constraint; the others are checked on what is found.  The best n
in source order are kept by a window, which prunes before the shuffle.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType

from ..functions.lineage import cut, if_few
from ..functions.text import clock
from .ranges import nodes_above, nodes_before

# Attributes that results leave out, other names of attributes, and the
# values that mean "any".
META = ("id", "location", "takesbookings", "introduction", "openhours", "price")
RENAMED = {"hotel": {"pricerange": "price range"}, "restaurant": {"pricerange": "price range"}, "attraction": {"pricerange": "price range"}, "train": {"arriveBy": "arrive by", "leaveAt": "leave at", "trainID": "train id"}}
ANY = ("", "dont care", "not mentioned", "don't care", "dontcare", "do n't care")
#: Domains that are looked up whole, or by one attribute, and how many rows they return.
WHOLE, BY_DEPARTMENT = "police", "hospital"
#: Times as numbers, hours times 100 plus minutes, are below this.
LATEST = 1 << 14
QUERY_NAMES = {"arrive by": "arriveBy", "leave at": "leaveAt", "train id": "trainID", "price range": "pricerange"}


def rename_attributes(entities: DataFrame) -> DataFrame:
    """entities(domain, attrs) with attribute names as slots are called; where an entity has both names, the value of the slot's name stays."""
    names = F.create_map(*[F.lit(x) for d, m in RENAMED.items() for k, v in m.items() for x in (f"{d}\x1f{k}", v)])
    new = lambda k: F.try_element_at(names, F.concat_ws("\x1f", "domain", k))
    single = F.map_filter("attrs", lambda k, v: new(k).isNull() | ~F.array_contains(F.map_keys("attrs"), F.coalesce(new(k), k)))
    return entities.withColumn("attrs", F.transform_keys(single, lambda k, v: F.coalesce(new(k), k)))


def drop_meta(attrs) -> Column:
    return F.map_filter(attrs, lambda k, v: ~k.isin(*META))


def first_in_order(found: DataFrame, most: int, *by: str) -> DataFrame:
    """The first ``most`` rows of each query, in source order, with ``rank`` from 1."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).where(F.col("rank") <= most)


def _distinct(queries: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(queries(query_id, s), sets(s, columns)): queries that want the same are answered once; s numbers what they want."""
    entries = lambda c: F.map_entries(c) if isinstance(queries.schema[c].dataType, MapType) else F.col(c)
    plain = [F.to_json(F.struct(F.col("domain"), *[F.array_sort(entries(c)).alias(c) for c in columns]))]
    keyed = queries.select("query_id", F.sha2(F.concat(*plain).cast("binary"), 256).alias("s"), "domain", *columns)
    return keyed.select("query_id", "s"), cut(keyed.drop("query_id").dropDuplicates(["s"]))


def _grams(value: Column) -> Column:
    """The parts of three letters of a text (all of it, if it is shorter), '' besides."""
    n = F.length(value)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(value, i, 3))
    short = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(value, i, 2))
    single = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(value, i, 1))
    return F.array_distinct(F.concat(parts, short, single, F.array(F.lit(""))))


def _checked(rows: DataFrame, ok: Column) -> DataFrame:
    """Rows for which ok holds, tested on the joined rows: as a condition of the join itself the engine may lose columns that
    only a lambda in it reads."""
    return rows.select("*", F.explode(F.array(ok)).alias("__ok")).where("__ok").drop("__ok")


def _first_of_kinds(entities: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """Of the entities(domain, ord, attrs) that have the same values of all attributes that are asked(domain, k) of their domain, the
    first ``most``, with these ``keys``, written; an answer takes no others.  A null k asks for the domain alone.

    Entities are dealt out first, because few and small files may hold many of them."""
    keys = cut(asked.distinct().groupBy("domain").agg(F.collect_set("k").alias("keys")))
    rows = entities.select("domain", "ord", "attrs").repartition("domain", "ord").join(if_few(keys, items=F.size("keys") + 1), "domain")
    rows = rows.withColumn("kind", F.transform("keys", lambda k: F.try_element_at(F.col("attrs"), k)))
    return cut(first_in_order(rows, most, "domain", "kind").drop("kind", "rank"))


def _to_all(ids: DataFrame, found: DataFrame) -> DataFrame:
    """ids(query_id, s) with what was found(s, attrs, ...) for s."""
    found = cut(found)
    return ids.join(if_few(found, items=F.coalesce(F.size("attrs"), F.lit(0)) + 1), "s")


def containing(entities: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """entities(domain, ord, attrs) of which every constraint of queries(query_id, domain, constraints) is
    part, without regard to case; a constraint on an attribute that is not there fails.  The first ``most``.

    Of entities with the same values of what is asked for only the first count.  Wanted values and the different values of
    these meet by their parts of three letters; a set of constraints then takes the entities of its rarest one, by an equality join on (domain, attribute, value), and is checked on them.
    Without constraints the first entities of the domain are the answer."""
    ids, sets = _distinct(queries.withColumn("constraints", F.coalesce("constraints", F.create_map().cast("map<string,string>"))), "constraints")
    kept = _first_of_kinds(entities, sets.select("domain", F.explode_outer(F.map_keys("constraints")).alias("k")), most)
    each = kept.select("domain", "ord", "attrs", F.explode("keys").alias("k")).withColumn("v", F.lower(F.try_element_at(F.col("attrs"), F.col("k")))).where("v is not null")
    values = cut(each.groupBy("domain", "k", "v").agg(F.count("*").alias("n")))
    wants = cut(sets.select("s", "domain", F.explode("constraints").alias("k", "want")).withColumn("want", F.lower("want")))
    gram = F.left("want", F.lit(3))  # values have all their parts of one to three letters, so any part of the wanted text finds them
    texts = cut(wants.select("domain", "k", "want").distinct().withColumn("g", gram))
    pairs = values.withColumn("g", F.explode(_grams(F.col("v")))).join(if_few(texts), ["domain", "k", "g"]).where(F.contains("v", "want")).select("domain", "k", "want", "v", "n")
    pairs = cut(pairs)
    size = pairs.groupBy("domain", "k", "want").agg(F.sum("n").alias("size"))
    rarest = wants.join(size, ["domain", "k", "want"]).groupBy("s").agg(F.min_by(F.struct("domain", "k", "want"), "size").alias("x"), F.count("*").alias("found"))
    rarest = sets.select("s", "constraints").join(rarest, "s").where("found = size(constraints)").select("s", "constraints", "x.*")
    ok = F.forall(F.map_entries(F.col("constraints")), lambda c: F.coalesce(F.contains(F.lower(F.try_element_at(F.col("attrs"), c["key"])), F.lower(c["value"])), F.lit(False)))
    hits = _checked(rarest.join(pairs.drop("n"), ["domain", "k", "want"]).join(each.hint("merge"), ["domain", "k", "v"]), ok)
    found = first_in_order(hits.select("s", "domain", "ord", "attrs"), most, "s")
    heads = first_in_order(kept.select("domain", "ord", "attrs"), most, "domain")
    found = found.unionByName(sets.where("size(constraints) = 0").select("s", "domain").join(heads, "domain"))
    return _to_all(ids, found).select("query_id", "domain", "ord", "attrs", "rank")


def likeness(a: str, b: str) -> float:
    """How far the shorter text is like a part of the longer one, 0 to 100 in whole numbers.

    The parts that count have its length (or end with the longer text) and start where some block that both
    have in common would be in line; likeness is twice the matching letters over those of both.  Equal texts have 100, an empty one
    and another 0."""
    if a == b or not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    starts = {max(block.b - block.a, 0) for block in SequenceMatcher(None, short, long).get_matching_blocks()}
    best = max(SequenceMatcher(None, short, long[i : i + len(short)]).ratio() for i in starts)
    return 100.0 if best > 0.995 else float(round(100 * best))


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The likeness of two texts."""
    return pd.Series([likeness(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def _letters(v: Column) -> Column:
    """The letters of a text, each with its number among equal ones, so that common elements count common letters."""
    each = lambda ch: F.transform(F.sequence(F.lit(1), F.length(v) - F.length(F.replace(v, ch, F.lit("")))), lambda i: F.concat(ch, i.cast("string")))
    return F.flatten(F.transform(F.array_distinct(F.split(v, "")), each))


def alike(pairs: DataFrame, ratio: float) -> DataFrame:
    """The different (a, b) of pairs that are ``ratio`` alike (``likeness``); a null is an empty text.

    A part that is alike enough has so many letters of the shorter text that both texts must have r / (2 - r) of its length in common.
    Letters are put in order once for each different text; only pairs that keep that bound are compared letter by letter."""
    pairs = cut(pairs.select(F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b")).distinct())
    r = max(ratio - 0.5, 0) / 100  # a likeness is rounded
    words = cut(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct().select("w", F.when(F.col("w") == "", F.array().cast("array<string>")).otherwise(_letters(F.col("w"))).alias("bag")))
    side = lambda c, bag: if_few(words, items=F.size("bag") + 1).select(F.col("w").alias(c), F.col("bag").alias(bag))
    both = pairs.join(side("a", "bag_a"), "a").join(side("b", "bag_b"), "b")
    near = F.size(F.array_intersect("bag_a", "bag_b")) >= F.least(F.size("bag_a"), F.size("bag_b")) * F.lit(r / (2 - r)) - 1e-9
    return both.where(near).select("a", "b").repartition("a", "b").where(partial_ratio("a", "b") >= ratio)


def satisfying(entities: DataFrame, queries: DataFrame, most: int = 10, ignore_open: bool = False, ratio: float = 60) -> DataFrame:
    """entities(domain, ord, attrs) that meet queries(query_id, domain, hard, soft: map<string,string>).

    Values that mean "any" and attributes an entity has not got or has as ``?`` do not count.  ``leaveAt``
    wants that time or later, ``arriveBy`` that or earlier; other hard constraints want equal values,
    without regard to case, soft ones values that are ``ratio`` alike.  Two names of one attribute are two constraints.  With ``ref``, the position as
    eight digits.  The ``police`` domain has all its entities for an answer and ``hospital`` those of the wanted department (all, if none is
    wanted), both without a limit, other constraints or a ``ref``.

    Of entities with the same values of what is asked for only the first count.  A set of constraints takes those that have its rarest wanted value or none at all there, by an equality join on
    (domain, attribute, value).  One that wants a time of departure alone, or nothing, takes the first entities of a handful of nodes of a tree
    over the times; one that wants more takes the entities of the hours that its time admits.  Soft
    values are compared once for each different pair of texts."""
    names = F.create_map(*[F.lit(x) for kv in QUERY_NAMES.items() for x in kv])
    key = lambda k: F.coalesce(F.try_element_at(names, k), k)
    fix = lambda k, v: F.when((k == "area") & (v == "center"), F.lit("centre")).otherwise(v)
    empty = F.create_map().cast("map<string,string>")
    named = F.transform(F.map_entries(F.coalesce("hard", empty)), lambda e: F.struct(key(e["key"]).alias("key"), fix(e["key"], e["value"]).alias("value")))
    clean = queries.where(~F.col("domain").isin(WHOLE, BY_DEPARTMENT)).select("query_id", "domain", F.array_sort(F.array_distinct(named)).alias("hard"), F.coalesce("soft", empty).alias("soft"))
    ids, sets = _distinct(clean, "hard", "soft")
    plain = lambda c: F.lower(F.trim(c))
    times = ("leaveAt", "arriveBy")

    def skipped(k: Column, v: Column) -> Column:
        have = F.try_element_at(F.col("attrs"), k)
        none = v.isNull() | v.isin(*ANY) | have.isNull()
        if ignore_open:
            none = none | k.isin("destination", "departure")
        return none | (F.trim(have) == "?") & ~k.isin(*times)

    def meets(e: Column) -> Column:
        have = F.try_element_at(F.col("attrs"), e["key"])
        by_time = F.when(e["key"] == "leaveAt", clock(have) >= clock(e["value"])).when(e["key"] == "arriveBy", clock(have) <= clock(e["value"]))
        return skipped(e["key"], e["value"]) | F.when(e["key"].isin(*times), F.coalesce(by_time, F.lit(True))).otherwise(plain(have) == plain(e["value"]))

    open_keys = ("destination", "departure") if ignore_open else ()
    count = lambda k, v: v.isNotNull() & ~v.isin(*ANY) & ~k.isin(*open_keys)
    hards, softs = sets.select("domain", F.inline_outer("hard").alias("k", "v")), sets.select("domain", F.explode_outer("soft").alias("k", "v"))
    kept = _first_of_kinds(entities, hards.unionByName(softs).select("domain", F.when(count(F.col("k"), F.col("v")), F.col("k")).alias("k")), most)
    each = sets.select("s", "domain", F.inline("hard").alias("k", "v")).where(F.col("v").isNotNull() & ~F.col("v").isin(*ANY) & ~F.col("k").isin(*times, *open_keys))
    wants = cut(each.select("s", "domain", "k", plain("v").alias("v")))
    # an entity stands under its value of every attribute that is asked for, or under null where that does not count
    asked = cut(wants.select("domain", "k").distinct().groupBy("domain").agg(F.collect_set("k").alias("keys")))
    have = F.try_element_at(F.col("attrs"), F.col("k"))
    placed = kept.drop("keys").join(if_few(asked, items=F.size("keys")), "domain").select("domain", "ord", "attrs", F.explode("keys").alias("k")).withColumn("v", F.when(F.trim(have) != "?", plain(have)))
    size = placed.groupBy("domain", "k", "v").agg(F.count("*").alias("n"))
    rarest = wants.join(size, ["domain", "k", "v"], "left").groupBy("s").agg(F.min_by(F.struct("domain", "k", "v"), F.coalesce("n", F.lit(0))).alias("x"))
    chosen = sets.drop("domain").join(rarest, "s").select("s", "hard", "soft", "x.domain", "x.k", F.explode(F.array(F.col("x.v"), F.lit(None))).alias("v"))
    mark = lambda df: df.withColumn("v", F.coalesce(F.concat(F.lit("="), "v"), F.lit("")))
    by_value = mark(chosen).join(mark(placed).hint("merge"), ["domain", "k", "v"])
    # without such a constraint: by the time of departure, if one is wanted, else all of the domain
    wanted = lambda k: F.array_max(F.transform(F.filter("hard", lambda e: (e["key"] == k) & ~e["value"].isin(*ANY)), lambda e: clock(e["value"])))
    rest = cut(sets.join(wants.select("s").distinct(), "s", "left_anti").withColumns({"leave": wanted("leaveAt"), "arrive": wanted("arriveBy")}))
    alone = (F.size("soft") == 0) & F.col("arrive").isNull()
    timed = kept.select("domain", "ord", "attrs", clock(F.try_element_at("attrs", F.lit("leaveAt"))).alias("at"))
    columns = ["s", "domain", "hard", "soft", "ord", "attrs"]
    by_node = _first_of_times(timed, rest.where(alone).withColumnRenamed("leave", "at"), most).select(*columns)
    rest = rest.where(~alone)
    hour = lambda c: F.when(c.isNotNull(), F.least(F.floor(c / 100), F.lit(24))).cast("int")
    rest = rest.withColumn("hour", F.explode(F.concat(F.array(F.lit(-1)), F.sequence(F.coalesce(hour(F.col("leave")), F.lit(0)), F.lit(24)))))
    by_hour = rest.join(timed.withColumn("hour", F.coalesce(hour(F.col("at")), F.lit(-1))).hint("merge"), ["domain", "hour"])
    found = _checked(by_value.select(*columns).unionByName(by_hour.select(*columns)).unionByName(by_node), F.forall("hard", meets))
    plainly = first_in_order(found.where(F.size("soft") == 0).select("s", "domain", "ord", "attrs"), most, "s")
    if sets.where(F.size("soft") > 0).isEmpty():
        rows = plainly
    else:
        soft = cut(found.where(F.size("soft") > 0).select("s", "domain", "ord", "attrs", F.explode("soft").alias("k", "v")))
        soft = soft.withColumns({"skip": skipped(F.col("k"), F.col("v")), "a": plain("v"), "b": plain(have)})
        like = alike(soft.where("not skip"), ratio).withColumn("like", F.lit(True))
        soft = soft.join(like, ["a", "b"], "left").withColumn("ok", F.col("skip") | F.coalesce("like", F.lit(False)))
        good = soft.groupBy("s", "domain", "ord").agg(F.bool_and("ok").alias("ok"), F.first("attrs").alias("attrs")).where("ok").drop("ok")
        rows = plainly.unionByName(first_in_order(good, most, "s"))
    answers = _to_all(ids, rows).select("query_id", "domain", "ord", "attrs", "rank", F.lpad(F.col("ord").cast("string"), 8, "0").alias("ref"))
    return answers.unionByName(_special(entities, queries))


def _special(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """The answers of the domains without constraints, in source order."""
    hard = F.coalesce("hard", F.create_map().cast("map<string,string>"))
    wanted = F.nullif(F.when(F.col("domain") == BY_DEPARTMENT, F.try_element_at(hard, F.lit("department"))), F.lit(""))
    asked = queries.where(F.col("domain").isin(WHOLE, BY_DEPARTMENT)).select("query_id", "domain", F.lower(F.trim(wanted)).alias("want"))
    rows = entities.where(F.col("domain").isin(WHOLE, BY_DEPARTMENT)).select("domain", "ord", "attrs", F.explode(F.array(F.lit(None).cast("string"), F.coalesce(F.lower(F.try_element_at("attrs", F.lit("department"))), F.lit("")))).alias("want"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("domain", "want").orderBy("ord")))
    mark = lambda df: df.withColumn("want", F.coalesce(F.concat(F.lit("="), "want"), F.lit("")))
    return mark(asked).join(mark(rows), ["domain", "want"]).select("query_id", "domain", "ord", "attrs", "rank", F.lit(None).cast("string").alias("ref"))


_LEVELS = LATEST.bit_length() - 1


def _later(at: Column) -> Column:
    """The nodes (level, node) of the times from ``at`` on."""
    return nodes_before(F.lit(LATEST) - F.least(at, F.lit(LATEST)), _LEVELS)


def _placed_times(have: DataFrame) -> DataFrame:
    """have(at, ...) with the nodes ``n`` above each time; times count from the latest down."""
    return have.withColumn("n", F.explode(nodes_above(F.greatest(F.lit(LATEST - 1) - F.col("at"), F.lit(0)), _LEVELS)))


def _first_of_times(timed: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """sets(domain, at, ...) with the first entities timed(domain, ord, attrs, at) at that time or later, or at any time or none if null, and those without a time.

    Each node of a tree over the times has its domain's first ``most`` entities; a set takes the nodes of its times."""
    none = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("node")))
    whole = F.array(F.struct(F.lit(_LEVELS).alias("level"), F.lit(0).cast("long").alias("node")))
    lists = _placed_times(timed.where("at is not null")).unionByName(timed.where("at is null").withColumn("n", F.explode(none)))
    lists = first_in_order(lists.select("domain", "ord", "attrs", "n.level", "n.node"), most, "domain", "level", "node").drop("rank")
    nodes = F.concat(none, F.coalesce(F.when(F.col("at").isNotNull(), _later(F.col("at"))), whole))
    return sets.withColumn("n", F.explode(nodes)).withColumns({"level": F.col("n.level"), "node": F.col("n.node")}).join(lists, ["domain", "level", "node"])


def within_times(entities: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, n, ords): how many of entities(domain, ord, leave_at) leave at want_leave_at or later, and the first ``most``.

    Entities are counted by their time, and each node of a tree over the times has its count and its first ``most``; a wanted time
    takes the nodes of the times from it on, about ten of them, whatever the number of entities and queries."""
    have = entities.select("domain", "ord", clock("leave_at").alias("at")).where("at is not null")
    counts = _placed_times(have.groupBy("domain", "at").agg(F.count("*").alias("c"))).groupBy("domain", "n").agg(F.sum("c").alias("c"))
    lists = first_in_order(_placed_times(first_in_order(have, most, "domain", "at").drop("rank")), most, "domain", "n")
    lists = lists.groupBy("domain", "n").agg(F.collect_list("ord").alias("ords"))
    nodes = counts.join(lists, ["domain", "n"]).select("domain", "n.level", "n.node", "c", "ords")
    q = queries.select("query_id", "domain", clock("want_leave_at").alias("at")).where("at is not null")
    asked = q.select("domain", "at").distinct().withColumn("n", F.explode(_later(F.col("at")))).select("domain", "at", "n.level", "n.node")
    found = asked.join(nodes, ["domain", "level", "node"]).groupBy("domain", "at").agg(F.sum("c").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ords"))), 1, most).alias("ords"))
    return q.join(found, ["domain", "at"]).select("query_id", "n", "ords")


def as_text(found: DataFrame, queries: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, text): each query's first results as numbered lines of sorted attributes, or a note of what was looked for."""
    line = F.concat(F.lit("  "), F.col("rank").cast("string"), F.lit(". "), F.array_join(F.transform(F.array_sort(F.map_entries(drop_meta("attrs"))), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", "))
    by = found.where(F.col("rank") <= most).groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    wanted = F.array_join(F.transform(F.map_entries("constraints"), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    none = F.concat(F.lit("No "), F.col("domain"), F.lit(" found matching: "), F.when(wanted == "", "none").otherwise(wanted))
    some = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" "), F.col("domain"), F.lit("(s):\n"), F.array_join("x.line", "\n"))
    return queries.join(by.hint("merge"), "query_id", "left").select("query_id", F.when(F.col("n").isNull(), none).otherwise(some).alias("text"))
