"""Queries: entity lookups, splits, samples and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import splits as P
from .fixtures import fixture as fx
from .registry import query


def _entities(spark, d):
    attrs = F.map_filter(F.create_map(*[x for c in ("brand", "type", "size") for x in (F.lit(c), F.col(c))], F.lit("leaveAt"), F.col("leave_at"), F.lit("id"), F.col("ord").cast("string")), lambda k, v: v.isNotNull())
    return fx(spark, d, "entities").select("domain", "ord", attrs.alias("attrs"))


def _queries(spark, d):
    want = F.map_filter(F.create_map(F.lit("brand"), F.col("want_brand"), F.lit("type"), F.when(F.col("want_type") != "dontcare", F.col("want_type"))), lambda k, v: v.isNotNull())
    return fx(spark, d, "entity_queries").select("query_id", "domain", want.alias("constraints"))


_SUB = """sub AS (SELECT query_id, q.domain, e.ord, row_number() OVER (PARTITION BY query_id ORDER BY e.ord) AS rank, e.brand, e.type, e.size, e.leave_at FROM entity_queries q JOIN entities e ON q.domain = e.domain
 AND contains(lower(e.brand), lower(want_brand)) AND (want_type IS NULL OR want_type = 'dontcare' OR coalesce(contains(lower(e.type), lower(want_type)), false)))"""


@query("j5_containing", "entities entity_queries", "SELECT query_id, ord, rank FROM sub WHERE rank <= 10", _SUB)
def j5(spark, d):
    return E.containing(_entities(spark, d), _queries(spark, d)).select("query_id", "ord", "rank")


@query("k1_first_in_order", "entities", "SELECT domain, ord, rank FROM (SELECT domain, ord, row_number() OVER (PARTITION BY domain, brand ORDER BY ord) AS rank FROM entities) WHERE rank <= 10")
def k1(spark, d):
    return E.first_in_order(fx(spark, d, "entities"), 10, "domain", "brand").select("domain", "ord", "rank")


@query(
    "j6_satisfying",
    "entities entity_queries",
    """SELECT query_id, ord, ref FROM (SELECT query_id, e.ord, lpad(CAST(e.ord AS STRING), 8, '0') AS ref, row_number() OVER (PARTITION BY query_id ORDER BY e.ord) AS rank FROM entity_queries q JOIN entities e ON q.domain = e.domain
 AND lower(e.brand) = replace(want_brand, '#', '#1') AND (want_type IS NULL OR want_type = 'dontcare' OR e.type IS NULL OR e.type = '?' OR lower(e.type) = lower(want_type))
 AND CAST(replace(e.leave_at, ':', '') AS INT) >= CAST(replace(want_leave_at, ':', '') AS INT)) WHERE rank <= 10""",
)
def j6(spark, d):
    q = fx(spark, d, "entity_queries")
    hard = F.create_map(F.lit("brand"), F.replace("want_brand", F.lit("#"), F.lit("#1")), F.lit("type"), F.col("want_type"), F.lit("leave at"), F.col("want_leave_at"))
    q = q.select("query_id", "domain", F.map_filter(hard, lambda k, v: v.isNotNull()).alias("hard"), F.create_map().cast("map<string,string>").alias("soft"))
    return E.satisfying(_entities(spark, d), q).select("query_id", "ord", "ref")


@query(
    "j6_soft_match",
    "entities entity_queries",
    """SELECT query_id, ord, lpad(CAST(ord AS STRING), 8, '0') AS ref FROM (SELECT query_id, e.ord, row_number() OVER (PARTITION BY query_id ORDER BY e.ord) AS rank FROM entity_queries q JOIN entities e ON q.domain = e.domain AND want_type IS NOT NULL
 AND (want_type = 'dontcare' OR e.type IS NULL OR e.type = '?' OR contains(lower(e.type), lower(want_type)))) WHERE rank <= 10""",
)
def j6s(spark, d):
    """Of the types in the tables only those that hold the wanted one are alike by 60 or more."""
    q = fx(spark, d, "entity_queries").where("want_type is not null")
    q = q.select("query_id", "domain", F.create_map().cast("map<string,string>").alias("hard"), F.create_map(F.lit("type"), F.col("want_type")).alias("soft"))
    return E.satisfying(_entities(spark, d), q).select("query_id", "ord", "ref")


_SPECIAL = """e AS (SELECT 'police' AS domain, r_regionkey AS ord, CAST(NULL AS VARCHAR) AS department FROM region UNION ALL SELECT 'hospital', n_nationkey, n_name FROM nation),
q AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 7 = 0 THEN 'police' ELSE 'hospital' END AS domain, CASE WHEN s_suppkey % 5 <> 0 THEN n_name END AS want FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""


@query("j6_special_domains", "", "SELECT query_id, ord, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS rank, CAST(NULL AS VARCHAR) AS ref FROM q JOIN e ON q.domain = e.domain AND (q.domain = 'police' OR want IS NULL OR want = e.department)", _SPECIAL)
def j6d(spark, d):
    """Police has all its rows for an answer, hospital those of the wanted department; neither has a limit."""
    name = lambda k, c: F.create_map(F.lit(k), c)
    e = fx(spark, d, "region").select(F.lit("police").alias("domain"), F.col("r_regionkey").alias("ord"), name("name", F.col("r_name")).alias("attrs"))
    e = e.unionByName(fx(spark, d, "nation").select(F.lit("hospital"), "n_nationkey", name("department", F.col("n_name"))).toDF("domain", "ord", "attrs"))
    q = fx(spark, d, "supplier").join(F.broadcast(fx(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    want = F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit(" "), F.lower("n_name")))
    hard = F.create_map(F.lit("department"), want, F.lit("phone"), F.lit("not asked for"))
    q = q.select(F.col("s_suppkey").alias("query_id"), F.when(F.col("s_suppkey") % 7 == 0, "police").otherwise("hospital").alias("domain"), hard.alias("hard"), F.create_map().cast("map<string,string>").alias("soft"))
    return E.satisfying(e, q, 3).select("query_id", "ord", "rank", "ref")


@query("j7_time_range", "entities entity_queries", "SELECT query_id, count(*) AS n, array_to_string(list(ord ORDER BY ord)[1:10], ',') AS ords FROM entity_queries q JOIN entities e ON q.domain = e.domain AND CAST(replace(e.leave_at, ':', '') AS INT) >= CAST(replace(want_leave_at, ':', '') AS INT) GROUP BY query_id")
def j7(spark, d):
    return E.within_times(fx(spark, d, "entities"), fx(spark, d, "entity_queries")).select("query_id", "n", F.array_join("ords", ",").alias("ords"))


@query(
    "m7_entities_as_text",
    "entities entity_queries",
    """SELECT q.query_id, CASE WHEN x.n IS NULL THEN 'No ' || q.domain || ' found matching: brand=' || want_brand || CASE WHEN want_type <> 'dontcare' THEN ', type=' || want_type ELSE '' END ELSE 'Found ' || x.n || ' ' || q.domain || '(s):' || chr(10) || lines END AS text
FROM entity_queries q LEFT JOIN (SELECT query_id, count(*) AS n, string_agg('  ' || rank || '. brand: ' || brand || ', leaveAt: ' || leave_at || ', size: ' || size || CASE WHEN type IS NULL THEN '' ELSE ', type: ' || type END, chr(10) ORDER BY rank) AS lines FROM sub WHERE rank <= 5 GROUP BY query_id) x ON q.query_id = x.query_id""",
    _SUB,
)
def m7(spark, d):
    q = _queries(spark, d)
    return E.as_text(E.containing(_entities(spark, d), q, 5), q)


@query("p8_rename_attributes", "entities", "SELECT domain, ord, CASE domain WHEN 'train' THEN 'brand,id,leave at,size' ELSE 'brand,id,leaveAt,size' END || CASE WHEN type IS NULL THEN '' ELSE ',type' END AS names FROM entities")
def p8(spark, d):
    return E.rename_attributes(_entities(spark, d)).select("domain", "ord", F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("names"))


@query("p9_drop_meta", "entities", "SELECT domain, ord, CASE WHEN type IS NULL THEN 3 ELSE 4 END AS n_attributes FROM entities")
def p9(spark, d):
    return _entities(spark, d).select("domain", "ord", F.size(E.drop_meta("attrs")).alias("n_attributes"))


def _orders(spark, d):
    return fx(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


_KEY = "(o_orderkey * 7919) % 100003"


@query("p4_slice", "", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_orderstatus = 'F') WHERE i >= 100 AND i < 900")
def p4(spark, d):
    return P.in_slice(_orders(spark, d).where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 900)


def _structkey():
    return F.struct(F.expr(_KEY), F.col("o_orderkey"))


_I = f"i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {_KEY}, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM (SELECT *, o_custkey % 200 AS g FROM orders))"


@query("k3_hold_out", "", "SELECT o_orderkey, CASE WHEN i < greatest(1, floor(n * 0.2::DOUBLE)) THEN 'validation' ELSE 'train' END AS part FROM i", _I)
def k3(spark, d):
    return P.hold_out(_orders(spark, d).withColumn("g", F.expr("o_custkey % 200")), 0.2, _structkey(), "g").select("o_orderkey", "part")


@query(
    "k4_scenario_split",
    "",
    "SELECT o_orderkey, CASE WHEN n < 3 OR i < a THEN 'train' WHEN i < a + b THEN 'validation' ELSE 'test' END AS part FROM (SELECT *, CASE WHEN n - a - b0 < 1 THEN greatest(1, n - a - 1) ELSE b0 END AS b FROM (SELECT *, greatest(1, floor(n * 0.8::DOUBLE)) AS a, greatest(1, floor(n * 0.1::DOUBLE)) AS b0 FROM i))",
    _I.replace("o_custkey % 200", "o_custkey"),
)
def k4(spark, d):
    return P.scenario_split(_orders(spark, d).withColumn("scenario", F.col("o_custkey")), _structkey()).select("o_orderkey", "part")


@query("k4_scenario_key", "domains", "SELECT dialogue_id, coalesce(nullif(string_agg(domain, '_' ORDER BY domain), ''), 'none') AS scenario FROM domains GROUP BY dialogue_id")
def k4s(spark, d):
    return fx(spark, d, "domains").groupBy("dialogue_id").agg(F.collect_list("domain").alias("x")).select("dialogue_id", P.scenario_key(F.array_append("x", F.lit("general"))).alias("scenario"))


@query("k5_group_fraction", "", "SELECT o_orderkey, o_custkey FROM i WHERE i < greatest(1, floor(n * 0.1::DOUBLE))", _I)
def k5(spark, d):
    return P.group_fraction(_orders(spark, d).withColumn("g", F.expr("o_custkey % 200")), 0.1, _structkey(), "g").select("o_orderkey", "o_custkey")


@query("k6_three_ways", "", f"SELECT o_orderkey, CASE WHEN s = 'test' THEN 'test' WHEN i < greatest(1, floor(n * 0.2::DOUBLE)) THEN 'validation' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {_KEY}, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN 'test' ELSE 'train' END AS s FROM orders))")
def k6(spark, d):
    rows = _orders(spark, d).withColumn("s", F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 'test' ELSE 'train' END"))
    return P.three_ways(rows, "s", _structkey()).select("o_orderkey", "part")


@query("k7_batches", "", "SELECT o_orderkey, CAST(i // 10 AS INTEGER) AS batch_no FROM i WHERE i < 35", _I.replace(f"{_KEY}, ", ""))
def k7(spark, d):
    return P.batches(_orders(spark, d).withColumn("g", F.expr("o_custkey % 200")), 10, "o_orderkey", "g", most=35).select("o_orderkey", "batch_no")


_K8 = "CAST(CASE WHEN n <= 7 THEN 0 WHEN i < (n // 7) * 7 THEN i // 7 WHEN n % 7 < 3.5 THEN (i - (n // 7) * 7) % (n // 7) ELSE n // 7 END AS INTEGER)"


@query("k8_balanced_batches", "", f"SELECT o_orderkey, {_K8} AS batch_no FROM i", _I.replace(f"{_KEY}, ", ""))
def k8(spark, d):
    return P.balanced_batches(_orders(spark, d).withColumn("g", F.expr("o_custkey % 200")), 7, "o_orderkey", "g").select("o_orderkey", "batch_no")


@query("k10_take_shuffled", "", f"SELECT o_orderkey FROM orders ORDER BY {_KEY}, o_orderkey LIMIT 500")
def k10(spark, d):
    return P.take_shuffled(_orders(spark, d).select("o_orderkey"), 500, _structkey())


@query("k11_cluster_sample", "", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY (o_custkey * 7919) % 100003, o_custkey LIMIT 50)")
def k11(spark, d):
    return P.cluster_sample(_orders(spark, d).select("o_orderkey", "o_custkey"), 50, F.struct(F.expr("(o_custkey * 7919) % 100003"), F.col("o_custkey")), "o_custkey")


@query("k12_judge_sample", "", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY (user_id * 7919) % 100003, user_id LIMIT 40")
def k12(spark, d):
    return P.take_shuffled(fx(spark, d, "events").select("user_id").distinct(), 40, F.struct(F.expr("(user_id * 7919) % 100003"), F.col("user_id")))


@query("k14_first_seen", "", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def k14(spark, d):
    return P.first_seen(_orders(spark, d), "o_custkey", "o_orderstatus", "o_orderkey")


@query("k2_sort_by_id", "", "SELECT CAST(o_orderkey AS STRING) AS instance_id, o_orderstatus FROM orders ORDER BY 1")
def k2(spark, d):
    return fx(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("instance_id"), "o_orderstatus").orderBy("instance_id")
