"""Queries: benchmark scoring and judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as B
from .fixtures import fixture as fx
from .registry import query

DIMENSIONS = ("task_completion", "slot_accuracy", "dialogue_fluency", "helpfulness", "efficiency")


def _cases(spark, d):
    return fx(spark, d, "cases")


_SCORES = """sc AS (SELECT instance_id, seed, instruction_type, CAST(sum(passed) AS BIGINT) AS n_passed, count(*) AS n_cases, sum(passed)::DOUBLE / count(*) AS soft, CAST(sum(passed) = count(*) AS INTEGER) AS hard FROM cases GROUP BY ALL)"""


def _scores(spark, d):
    return B.case_scores(_cases(spark, d), "instance_id", "seed", "instruction_type")


@query("a10_case_scores", "cases", "SELECT * FROM sc", _SCORES)
def a10(spark, d):
    return _scores(spark, d)


_POS = "sc2 AS (SELECT *, instance_id % 11 <> 0 AS has_position, CASE WHEN instance_id % 13 <> 0 THEN soft END AS s, CASE WHEN instance_id % 13 <> 0 THEN hard END AS h FROM sc)"


@query("a11_benchmark_summary", "cases", "SELECT count(*) AS n, count(s) AS n_scored, avg(CASE WHEN h = 1 THEN 1 ELSE 0 END) AS accuracy, avg(s) AS soft, avg(h) AS hard FROM sc2 WHERE has_position", f"{_SCORES}, {_POS}")
def a11(spark, d):
    rows = _scores(spark, d).withColumns({"has_position": F.expr("instance_id % 11 <> 0"), "soft": F.expr("CASE WHEN instance_id % 13 <> 0 THEN soft END"), "hard": F.expr("CASE WHEN instance_id % 13 <> 0 THEN hard END")})
    return B.benchmark_summary(rows)


@query("a12_by_type", "cases", "SELECT coalesce(t, 'all') AS instruction_type, count(*) AS n, avg(soft) AS soft, avg(hard) AS hard FROM (SELECT *, coalesce(nullif(instruction_type, ''), 'unknown') AS t FROM sc) GROUP BY ROLLUP (t)", _SCORES)
def a12(spark, d):
    return B.by_type(_scores(spark, d))


@query("a13_pass_any_all", "cases", "SELECT count(*) AS n, count(*) FILTER (a) AS n_any, count(*) FILTER (e) AS n_all FROM (SELECT instance_id, bool_or(hard = 1) AS a, bool_and(hard = 1) AS e FROM sc GROUP BY instance_id)", _SCORES)
def a13(spark, d):
    return B.pass_any_all(_scores(spark, d))


_RUN = "SELECT count(*) AS total, count(*) FILTER (p) AS n_passed, count(*) FILTER (NOT p) AS n_failed, count(log) AS n_with_log, count(*) FILTER (log IS NULL) AS n_without_log, coalesce(count(*) FILTER (p)::DOUBLE / nullif(count(*), 0), 0) AS success_rate FROM (SELECT file_name LIKE '%SUCCEED%' AS p, CASE WHEN row_id % 7 <> 0 THEN file_name END AS log FROM logs)"


def _run(spark, d):
    return fx(spark, d, "logs").select(F.expr("file_name LIKE '%SUCCEED%'").alias("passed"), F.expr("CASE WHEN row_id % 7 <> 0 THEN file_name END").alias("log"))


@query("a14_run_summary", "logs", _RUN)
def a14(spark, d):
    return B.run_summary(_run(spark, d))


@query("a15_success_rate", "logs", f"SELECT success_rate FROM ({_RUN})")
def a15(spark, d):
    return B.run_summary(_run(spark, d)).select("success_rate")


@query("w9_first_error", "cases", "SELECT instance_id, seed, CASE WHEN instance_id % 5 = 0 THEN 'top' ELSE min_by('case ' || case_no, case_no) FILTER (passed = 0) END AS error FROM cases GROUP BY instance_id, seed")
def w9(spark, d):
    rows = _cases(spark, d).withColumns({"passed": F.col("passed") == 1, "message": F.concat(F.lit("case "), F.col("case_no").cast("string")), "error": F.expr("CASE WHEN instance_id % 5 = 0 THEN 'top' ELSE '' END")})
    return B.first_error(rows, "instance_id", "seed")


@query("a8_judge_averages", "judge", "SELECT dimension, avg(score) AS average, count(score) AS n FROM judge GROUP BY dimension")
def a8(spark, d):
    return B.judge_averages(fx(spark, d, "judge"), DIMENSIONS)


@query("a9_judge_matrix", "judge", "SELECT dialogue_id, dimension, " + ", ".join(f"avg(score) FILTER (judge = 'judge {i}') AS \"judge {i}\"" for i in range(5)) + " FROM judge GROUP BY ALL")
def a9(spark, d):
    return B.judge_matrix(fx(spark, d, "judge"), tuple(f"judge {i}" for i in range(5)))


@query("w8_metric_deltas", "slots", "SELECT step, rate, rate - min_by(rate, step) OVER () AS delta FROM (SELECT dialogue_id % 20 AS step, count(*) FILTER (pred_requested)::DOUBLE / count(*) AS rate FROM slots GROUP BY 1)")
def w8(spark, d):
    h = fx(spark, d, "slots").groupBy((F.col("dialogue_id") % 20).alias("step")).agg((F.count_if("pred_requested") / F.count("*")).alias("rate"))
    return B.deltas(h, "rate")


_RANGES = "(SELECT o_orderkey, chr(CAST(65 + o_orderkey % 3 AS INT)) || CAST(1 + o_orderkey % 5 AS STRING) || ':' || chr(CAST(66 + o_orderkey % 3 AS INT)) || CAST(3 + o_orderkey % 5 AS STRING) AS range FROM {orders})"


@query("p15_cells_of_range", "", "SELECT o_orderkey, chr(CAST(65 + o_orderkey % 3 + c AS INT)) || CAST(1 + o_orderkey % 5 + r AS STRING) AS cell FROM orders, (VALUES (0), (1)) a(c), (VALUES (0), (1), (2)) b(r)")
def p15(spark, d):
    return B.cells_of(spark.sql(f"SELECT * FROM {_RANGES}", orders=fx(spark, d, "orders"))).select("o_orderkey", "cell")


@query("p16_positions", "", "SELECT o_orderkey, CASE i WHEN 0 THEN 'Data' ELSE 'Sheet1' END AS sheet, CASE i WHEN 0 THEN 'A' || o_orderkey % 9 ELSE 'B1:B' || o_orderkey % 7 END AS range FROM orders, (VALUES (0), (1)) v(i)")
def p16(spark, d):
    rows = fx(spark, d, "orders").selectExpr("o_orderkey", "\"'Data'!A\" || o_orderkey % 9 || ', B1:B' || o_orderkey % 7 AS pos")
    return B.positions(rows, "pos", F.lit("Sheet1")).select("o_orderkey", "sheet", "range")


@query("j12_compare_cells", "cells", "SELECT workbook, cell, gt_cents AS expected, out_cents AS actual, gt_cents IS NOT DISTINCT FROM out_cents AS same FROM cells")
def j12(spark, d):
    c = fx(spark, d, "cells")
    side = lambda v: c.where(f"{v} is not null").select("workbook", "sheet", "cell", F.col(v).alias("value"))
    return B.compare_cells(c.select("workbook", "sheet", "cell"), side("gt_cents"), side("out_cents")).drop("sheet")


@query("m24_cell_equality", "cells", "SELECT workbook, CASE workbook % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE out_cents IS NOT DISTINCT FROM gt_cents END AS same FROM cells")
def m24(spark, d):
    c = fx(spark, d, "cells").withColumn("k", F.col("workbook") % 4)
    text = lambda v: F.concat(F.floor(F.col(v) / 100).cast("string"), F.lit("."), F.lpad((F.col(v) % 100).cast("string"), 2, "0"))
    none, now = F.lit(None).cast("timestamp"), F.lit(None).cast("double")
    # as a number against its text, a text against a number, empty against '', expected against actual
    left = B.normal_cell(F.when(F.col("k") == 2, "string").when(F.col("k") == 1, "string").otherwise("number"), F.col("gt_cents") / 100, F.when(F.col("k") == 2, "").otherwise(F.concat(F.lit("no "), text("gt_cents"))), none)
    kind = F.when(F.col("k") == 0, "string").when(F.col("k") == 2, "empty").when(F.col("k") == 3, F.when(F.col("out_cents").isNull(), "empty").otherwise("number")).otherwise("number")
    right = B.normal_cell(kind, F.coalesce(F.col("out_cents") / 100, now), text("gt_cents"), none)
    return c.select("workbook", left.alias("a"), right.alias("b")).select("workbook", B.same_cell(F.col("a"), F.col("b")).alias("same"))
