"""Derived tables: dialogue, trace and benchmark data computed from the base tables.

The statements run unchanged in Spark and in DuckDB; ``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES = {
    "slot_base": """SELECT l_orderkey AS dialogue_id, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "slots": """SELECT dialogue_id,
 CASE n % 3 WHEN 0 THEN 'hotel' WHEN 1 THEN 'restaurant' ELSE 'train' END AS domain,
 CASE WHEN n = 7 THEN 'book people' ELSE 'slot ' || CAST(n AS STRING) END AS slot,
 CASE WHEN n <= 4 THEN 'inform' WHEN n <= 6 THEN 'request' ELSE 'booking' END AS kind,
 CASE WHEN n <= 4 THEN 'Value ' || CAST(s % 10 AS STRING) || '|alt ' || CAST(p % 10 AS STRING) END AS gt_value,
 CASE WHEN n > 4 OR p % 11 = 0 THEN NULL WHEN p % 7 = 0 THEN 'wrong' WHEN p % 2 = 0 THEN '  VALUE   ' || CAST(s % 10 AS STRING) || '. ' ELSE 'Alt ' || CAST(p % 10 AS STRING) END AS pred_value,
 CASE WHEN n IN (5, 6) THEN p % 4 <> 0 END AS pred_requested,
 CASE WHEN n = 7 AND p % 5 <> 0 THEN 'REF' || CAST(p AS STRING) WHEN n = 7 THEN '' END AS booking_ref
FROM {slot_base}""",
    "turns": """SELECT conv_id AS dialogue_id, turn AS utt_idx, CASE WHEN role = 'user' THEN 'user' ELSE 'system' END AS speaker, text AS utterance,
 CASE WHEN (conv_id + turn) % 4 = 0 THEN NULL WHEN (conv_id * 7 + turn * 3) % 5 < 2 THEN 'hotel' WHEN (conv_id * 7 + turn * 3) % 5 < 4 THEN 'restaurant' ELSE 'train' END AS act_domain,
 (conv_id * 3 + turn) % 6 >= 4 AS booked FROM {conversations}""",
    "entities": """SELECT CASE p_partkey % 3 WHEN 0 THEN 'hotel' WHEN 1 THEN 'restaurant' ELSE 'train' END AS domain, p_partkey AS ord, p_brand AS brand,
 CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN '?' ELSE p_type END AS type, CAST(p_size AS STRING) AS size,
 lpad(CAST(p_partkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST((p_partkey * 7) % 60 AS STRING), 2, '0') AS leave_at FROM {part}""",
    "entity_queries": """SELECT s_suppkey AS query_id, CASE s_suppkey % 3 WHEN 0 THEN 'hotel' WHEN 1 THEN 'restaurant' ELSE 'train' END AS domain,
 'brand#' || CAST(s_suppkey % 3 + 1 AS STRING) AS want_brand, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'dontcare' WHEN 2 THEN 'small' ELSE 'LARGE' END AS want_type,
 lpad(CAST(s_suppkey % 24 AS STRING), 2, '0') || ':30' AS want_leave_at FROM {supplier}""",
    "judge": """SELECT event_id, user_id AS dialogue_id, CASE event_type WHEN 'signup' THEN 'task_completion' WHEN 'error' THEN 'slot_accuracy' WHEN 'click' THEN 'dialogue_fluency' WHEN 'view' THEN 'helpfulness' ELSE 'efficiency' END AS dimension,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 5 + 1 END AS score, 'judge ' || CAST(event_id % 5 AS STRING) AS judge FROM {events}""",
    "cases": """SELECT l_partkey AS instance_id, l_linenumber AS seed, l_suppkey % 3 AS case_no,
 CASE WHEN l_partkey % 3 = 0 THEN 'cell' WHEN l_partkey % 3 = 1 THEN 'sheet' ELSE '' END AS instruction_type,
 min(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS passed FROM {lineitem} GROUP BY l_partkey, l_linenumber, l_suppkey % 3""",
    "cells": """SELECT o_orderkey AS workbook, 'Sheet1' AS sheet, 'A' || CAST(o_orderkey % 50 + 1 AS STRING) AS cell, CAST(round(o_totalprice * 100) AS BIGINT) AS gt_cents,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) + 1 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS out_cents FROM {orders}""",
    "reports": """SELECT doc_id AS instance_id, source, lang, doc_id % 3 AS n_items, doc_id % 5 <> 0 AS pass_flag,
 CASE WHEN doc_id % 4 = 0 THEN 'plan</think>' ELSE '' END ||
 CASE WHEN doc_id % 3 >= 1 THEN '# Failure Cause Item 1' || chr(10) || '## Title' || chr(10) || source || chr(10) || '## Content' || chr(10) || lang || chr(10) ELSE '' END ||
 CASE WHEN doc_id % 3 >= 2 THEN '# Failure Memory Item 2' || chr(10) || '## Title' || chr(10) || lang || chr(10) || '## Skill Reflection' || chr(10) || source || chr(10) ELSE '' END AS report FROM {documents}""",
    "logs": """SELECT o_orderkey AS row_id, o_custkey AS custkey, 'cli_only_agent_' || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 7 AS STRING) || '_' || CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'SUCCEED' END || '.md' AS file_name,
 'seed_' || CAST(o_orderkey % 3 AS STRING) AS seed FROM {orders}""",
    "domains": """SELECT DISTINCT user_id AS dialogue_id, event_type AS domain, user_id % 10 AS batch_no FROM {events}
 WHERE (user_id + CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END) % 3 = 0""",
    "edits": """SELECT o_custkey % 50 AS batch_index, o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN 'createFile' WHEN 1 THEN 'insert_after' WHEN 2 THEN 'append_to_section' ELSE 'bogus' END AS op,
 CASE WHEN o_orderkey % 4 = 0 THEN 'references/r' || CAST(o_orderkey % 8 AS STRING) || '.md' ELSE 'SKILL.md' END AS file,
 'see references/r' || CAST((o_orderkey * 3) % 8 AS STRING) || '.md' || repeat('x', CAST(o_orderkey % 6 AS INT)) AS content FROM {orders}""",
    "predictions": """SELECT o_orderkey AS dialogue_id, 1 AS ord, o_orderpriority AS response_text FROM {orders} WHERE o_orderkey % 19 <> 0
UNION ALL SELECT o_orderkey, 2, o_orderstatus FROM {orders} WHERE o_orderkey % 19 <> 0 AND o_orderkey % 5 = 0
UNION ALL SELECT c_custkey + 100000000, 1, 'extra' FROM {customer} WHERE c_custkey % 100 = 0""",
}


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", FIXTURES[name])))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived one."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(FIXTURES[name], **{n: fixture(spark, sf_dir, n) for n in _needs(name)})


def with_fixtures(names: str, body: str, ctes: str = "") -> str:
    """DuckDB SQL: the named derived tables (blank-separated) as CTEs, more of them, and the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _needs(name):
            if n not in BASE:
                add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        if n not in BASE:
            add(n)
    parts = [f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', FIXTURES[n])})" for n in order]
    if ctes:
        parts.append(ctes)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dialogue_id, goal, prediction) in the nested form of the sources, a row for each order.

    One shuffle by dialogue serves the slots and their one grouping; the maps are made of a dialogue's slots inside its row."""
    lines = spark.sql(FIXTURES["slot_base"], lineitem=fixture(spark, sf_dir, "lineitem").repartition("l_orderkey"))
    s = spark.sql(FIXTURES["slots"], slot_base=lines)
    ids = fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dialogue_id")).distinct()
    rows = s.groupBy("dialogue_id").agg(F.collect_list(F.struct("domain", "kind", "slot", "gt_value", "pred_value", "pred_requested", "booking_ref")).alias("r"))

    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))

    def fold(name, ok, value, inner=F.map_from_entries):
        """The slots that are ok, by domain: what ``inner`` makes of their values."""
        domains = F.array_distinct(F.transform(F.filter("r", ok), lambda x: x["domain"]))
        of = lambda d: inner(F.transform(F.filter("r", lambda x: (x["domain"] == d) & ok(x)), value))
        return F.map_from_entries(F.transform(domains, lambda d: pair(d, of(d)))).alias(name)

    out = ids.join(rows, "dialogue_id", "left").select(
        "dialogue_id",
        fold("gi", lambda x: x["kind"] != "request", lambda x: pair(x["slot"], F.coalesce(x["gt_value"], F.lit("2")))),
        fold("gr", lambda x: x["kind"] == "request", lambda x: pair(x["slot"], F.lit(""))),
        fold("pi", lambda x: x["pred_value"].isNotNull(), lambda x: pair(x["slot"], x["pred_value"])),
        fold("pb", lambda x: x["kind"] == "booking", lambda x: pair(F.lit("reference"), x["booking_ref"])),
        fold("pr", lambda x: x["pred_requested"], lambda x: x["slot"], lambda slots: slots),
    )
    mm = "map<string,map<string,string>>"
    none = lambda c, t=mm: F.coalesce(c, F.create_map().cast(t)).alias(c)
    out = out.select("dialogue_id", none("gi"), none("gr"), none("pi"), none("pr", "map<string,array<string>>"), none("pb"))
    return out.select(
        "dialogue_id",
        F.struct(F.lit("").alias("description"), F.col("gi").alias("inform"), F.col("gr").alias("request")).alias("goal"),
        F.struct(F.col("pi").alias("inform_slots"), F.col("pr").alias("request_slots"), F.col("pb").alias("booking")).alias("prediction"),
    )
