"""Queries: sources, sinks and streams, by way of files that the given tables are written to."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_dir, cut
from ..operators import corpus as C
from ..operators import memory as M
from ..operators import slots
from ..operators import traces as X
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import batches as S
from .evaluation import SCORED, SUMMARY, _metrics
from .fixtures import dialogues
from .fixtures import fixture as fx
from .registry import query


def _place(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def _raw(spark, d):
    split = F.expr("CASE dialogue_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END")
    x = dialogues(spark, d)
    return x.select(F.col("dialogue_id").cast("string").alias("dialogue_id"), split.alias("data_split"), F.struct(F.col("goal.inform").alias("inform"), F.col("goal.request").alias("request")).alias("goal"))


@query("s1_read_dialogues", "", "SELECT CAST(o_orderkey AS STRING) AS dialogue_id FROM (SELECT DISTINCT o_orderkey FROM orders) WHERE o_orderkey % 10 = 1")
def s1(spark, d):
    p = _place(spark)
    W.write_json(_raw(spark, d), f"{p}/dialogues.jsonl")
    return R.read_dialogues(spark, p, "validation").select("dialogue_id")


@query("s2_typed_dialogues", "slots", "SELECT CAST(dialogue_id AS STRING) AS dialogue_id, CAST(count(*) FILTER (kind <> 'request') AS BIGINT) AS n_inform, '' AS description, '' AS dataset FROM slots GROUP BY dialogue_id")
def s2(spark, d):
    p = _place(spark)
    W.write_json(_raw(spark, d), p)
    n = F.aggregate(F.map_values("goal.inform"), F.lit(0).cast("long"), lambda t, x: t + F.size(x))
    rows = R.typed_dialogues(spark.read.schema(R.DIALOGUE).json(p))
    return rows.where(F.size("goal.inform") + F.size("goal.request") > 0).select("dialogue_id", n.alias("n_inform"), "goal.description", "dataset")


@query("s3_dataset_registry", "", "SELECT o_orderstatus AS data_split, count(*) AS n FROM orders GROUP BY 1")
def s3(spark, d):
    R.register_loader("orders", lambda s, path, split: fx(s, path, "orders").withColumnRenamed("o_orderstatus", "data_split"))
    return R.load_dataset(spark, "orders", d).groupBy("data_split").agg(F.count("*").alias("n"))


@query("x2_custom_loader", "", "SELECT p_brand AS data_split, count(*) AS n FROM part WHERE p_brand = 'Brand#11' GROUP BY 1")
def x2(spark, d):
    R.register_loader("parts", lambda s, path, split: fx(s, path, "part").withColumnRenamed("p_brand", "data_split").where(F.col("data_split") == split))
    return R.load_dataset(spark, "parts", d, "Brand#11").groupBy("data_split").agg(F.count("*").alias("n"))


@query("s4_read_predictions", "slots", "SELECT CAST(dialogue_id AS STRING) AS dialogue_id, count(pred_value) AS n_values, count(*) FILTER (pred_requested) AS n_requested FROM slots GROUP BY dialogue_id")
def s4(spark, d):
    p = f"{_place(spark)}/x.jsonl"
    rows = dialogues(spark, d).where(F.size("goal.inform") + F.size("goal.request") > 0)
    W.write_json(rows.select("dialogue_id", "prediction.inform_slots", "prediction.request_slots"), p)
    n = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda t, x: t + F.size(x))
    return R.read_predictions(spark, p).select("dialogue_id", n("inform_slots").alias("n_values"), n("request_slots").alias("n_requested"))


@query("s6_read_entities", "entities", "SELECT domain, brand, count(*) AS n FROM entities WHERE domain <> 'train' GROUP BY ALL")
def s6(spark, d):
    p = _place(spark)
    e = fx(spark, d, "entities").withColumn("file", F.floor(F.col("ord") / 1000))
    for name in ("hotel", "restaurant"):
        rows = e.where(F.col("domain") == name).groupBy("file").agg(F.to_json(F.collect_list(F.struct("brand", "size"))).alias("value"))
        rows.write.partitionBy("file").text(f"{p}/{name}")
    return R.read_entities(spark, {"hotel": f"{p}/hotel", "restaurant": f"{p}/restaurant", "train": f"{p}/missing"}).groupBy("domain", F.try_element_at("attrs", F.lit("brand")).alias("brand")).agg(F.count("*").alias("n"))


@query("s7_labelled_split", "", "SELECT CAST(o_orderkey AS STRING) AS dialogue_id, CASE WHEN o_orderkey % 10 = 0 THEN 'validation' WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS data_split FROM (SELECT DISTINCT o_orderkey FROM orders)")
def s7(spark, d):
    p = _place(spark)
    ids = fx(spark, d, "orders").select(F.col("o_orderkey")).distinct()
    text = F.col("o_orderkey").cast("string").alias("value")
    ids.where("o_orderkey % 10 = 0").select(text).write.text(f"{p}/v")
    ids.where("o_orderkey % 5 = 0").select(text).write.text(f"{p}/t")
    return R.labelled_split(ids.select(text.alias("dialogue_id")), spark.read.text(f"{p}/v"), spark.read.text(f"{p}/t")).select("dialogue_id", "data_split")


@query("s8_read_instances", "", "SELECT CAST(p_partkey AS STRING) AS id, p_name AS instruction, '' AS answer_position, p_brand AS brand FROM part")
def s8(spark, d):
    p = f"{_place(spark)}/x.jsonl"
    W.write_json(fx(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("instruction"), F.col("p_brand").alias("brand")), p)
    return R.read_instances(spark, p).select("id", "instruction", "answer_position", F.try_element_at("metadata", F.lit("brand")).alias("brand"))


@query("s11_report_paths", "reports", "SELECT instance_id AS doc, CASE WHEN instance_id % 3 < 2 THEN CAST(instance_id AS STRING) END AS instance_id, instance_id % 3 = 0 AS in_directory FROM reports")
def s11(spark, d):
    i = F.col("doc").cast("string")
    path = F.when(F.col("doc") % 3 == 0, F.concat(F.lit("/x/"), i, F.lit("/analysis_report.md"))).when(F.col("doc") % 3 == 1, F.concat(F.lit("/x/error_analysis_"), i, F.lit(".md"))).otherwise(F.concat(F.lit("/x/error_analysis_"), i, F.lit("_prompt.md")))
    return fx(spark, d, "reports").select(F.col("instance_id").alias("doc")).withColumn("path", path).select("doc", *R.report_id("path"))


def _runs(spark, d, *by):
    """A log of each supplier (and seed), with a step for each of its lines in the order of the keys; some names are no logs'."""
    step = lambda x: F.concat_ws("\n", F.concat(F.lit("[thought] order "), x["l_orderkey"]), F.concat(F.lit("[action] take "), x["l_partkey"]), F.concat(F.lit("[observation] line "), x["l_linenumber"]))
    rows = fx(spark, d, "lineitem").select("l_suppkey", F.concat(F.lit("seed_"), F.col("l_linenumber") % 3).alias("seed"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("step"))
    rows = rows.groupBy("l_suppkey", *by).agg(F.array_sort(F.collect_list("step")).alias("steps"), F.sum("step.l_linenumber").alias("t"))
    end = F.expr("CASE WHEN t % 5 = 0 THEN '.md' WHEN t % 2 = 0 THEN '_FAILED.md' ELSE '_SUCCEED.md' END")
    return rows.select(*by, F.concat(F.lit("cli_agent_"), "l_suppkey", end).alias("file_name"), F.array_join(F.transform("steps", step), "\n").alias("text"))


_RUNS = """r AS (SELECT l_suppkey, {0} AS seed, sum(l_linenumber) AS t FROM lineitem GROUP BY ALL),
z AS (SELECT l_suppkey, {0} AS seed, row_number() OVER (PARTITION BY l_suppkey, {0} ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS step, l_orderkey, l_partkey, l_linenumber FROM lineitem),
x AS (SELECT CAST(l_suppkey AS STRING) AS instance_id, seed, CASE WHEN t % 2 = 0 THEN 'FAILED' ELSE 'SUCCEED' END AS outcome, step,
 '[thought] order ' || l_orderkey AS thought, '[action] take ' || l_partkey AS action, '[observation] line ' || l_linenumber AS observation FROM z JOIN r USING (l_suppkey, seed) WHERE t % 5 <> 0)"""


@query("s9_scan_logs", "", "SELECT instance_id, outcome, step, thought, action, observation FROM x", _RUNS.format("''"))
def s9(spark, d):
    """A folder of logs, written and scanned, and the steps in them."""
    p = _place(spark)
    W.write_texts(_runs(spark, d), p, "file_name")
    logs = R.read_logs(spark, p, stored=True)
    steps = X.trajectory_steps(logs.withColumn("instance_id", F.concat_ws("/", "instance_id", "outcome")))
    return steps.select(F.split_part("instance_id", F.lit("/"), F.lit(1)).alias("instance_id"), F.split_part("instance_id", F.lit("/"), F.lit(2)).alias("outcome"), "step", "thought", "action", "observation")


@query("s10_scan_seeds", "", "SELECT instance_id || '_' || seed AS run_id, step, action FROM x", _RUNS.format("'seed_' || l_linenumber % 3"))
def s10(spark, d):
    """Logs in the folders of their seeds, written and scanned; those of one instance stay apart."""
    p = _place(spark)
    W.write_texts(_runs(spark, d, "seed"), p, "seed", "file_name")
    logs = X.with_seed(R.read_logs(spark, p, seeds=True, stored=True))
    return X.trajectory_steps(logs.withColumn("instance_id", F.col("run_id"))).select(F.col("instance_id").alias("run_id"), "step", "action")


@query(
    "s11_scan_reports",
    "",
    """SELECT CAST(s_suppkey AS STRING) AS instance_id, s_suppkey % 3 = 0 AS in_directory, n AS number, s_name AS title, CASE n WHEN 1 THEN CAST(s_nationkey AS STRING) ELSE 'again' END AS content
 FROM supplier, (VALUES (1), (2)) v(n) WHERE s_suppkey % 3 < 2 AND n <= 1 + s_nationkey % 2""",
)
def s11s(spark, d):
    """Reports, flat or in a folder of their instance, written and scanned, and the items in them; prompts are none."""
    p, i = _place(spark), F.col("s_suppkey").cast("string")
    kind = F.col("s_suppkey") % 3
    name = F.when(kind == 0, "analysis_report.md").otherwise(F.concat(F.lit("error_analysis_"), i, F.when(kind == 1, ".md").otherwise("_prompt.md")))
    item = lambda head, text: F.concat(F.lit(f"# {head}\n## Title\n"), "s_name", F.lit("\n## Content\n"), text, F.lit("\n"))
    text = F.concat(item("Failure Cause Item 1", F.col("s_nationkey").cast("string")), F.when(F.col("s_nationkey") % 2 == 1, item("Failure Memory Item 2", F.lit("again"))).otherwise(""))
    W.write_texts(fx(spark, d, "supplier").select(F.when(kind == 0, i).otherwise("flat").alias("folder"), name.alias("file_name"), text.alias("text")), p, "folder", "file_name")
    rows = X.parse_reports(R.read_reports(spark, p, stored=True))[0]
    return rows.select("instance_id", "in_directory", F.explode("items").alias("i")).select("instance_id", "in_directory", "i.number", "i.title", "i.content")


@query("s12_evaluation_sink", "slots", f"SELECT 'per_dialogue' AS part, CAST(dialogue_id AS STRING) AS key, info_rate AS rate, CAST(1 AS BIGINT) AS n FROM met UNION ALL SELECT 'overall', '', micro_rate, n_dialogues FROM (SELECT {SUMMARY} FROM met) UNION ALL SELECT 'per_domain', domain, sum(CAST(correct AS INT)) FILTER (kind <> 'booking')::DOUBLE / count(*) FILTER (kind <> 'booking'), count(DISTINCT dialogue_id) FROM scored GROUP BY domain", SCORED)
def s12(spark, d):
    """All three tables of an evaluation, written and read back."""
    p, x = _place(spark), dialogues(spark, d)
    metrics, scored = cut(_metrics(spark, d)), slots.scored(x)
    W.write_evaluation(metrics, slots.corpus(metrics), slots.per_domain(x, scored), p)
    part = lambda name, key, rate, n: spark.read.schema(f"dialogue_id string, domain string, {rate} double, n_dialogues long").json(f"{p}/{name}").select(F.lit(name).alias("part"), key.alias("key"), F.col(rate).alias("rate"), n.alias("n"))
    n = F.col("n_dialogues")
    return part("per_dialogue", F.col("dialogue_id"), "info_rate", F.lit(1).cast("long")).unionByName(part("overall", F.lit(""), "micro_rate", n)).unionByName(part("per_domain", F.col("domain"), "micro_rate", n))


def _parts(spark, d):
    part = F.expr("CASE o_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END")
    return fx(spark, d, "orders").select((F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("dialogue_id"), F.col("o_orderpriority").alias("scenario"), part.alias("part"))


_SUMMARY = "SELECT coalesce(o_orderpriority, 'all') AS scenario, count(*) FILTER (o_orderkey % 10 > 1) AS train, count(*) FILTER (o_orderkey % 10 = 1) AS validation, count(*) FILTER (o_orderkey % 10 = 0) AS test, count(*) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)"


@query("s13_split_sink", "", "SELECT dialogue_id, part FROM (SELECT o_orderkey - o_orderkey % 2 AS dialogue_id, CASE o_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS part, row_number() OVER (PARTITION BY o_orderkey - o_orderkey % 2 ORDER BY o_orderpriority, CASE o_orderkey % 10 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END) AS rn FROM orders) WHERE rn = 1")
def s13(spark, d):
    p = _place(spark)
    W.write_splits(_parts(spark, d), p)
    return spark.read.schema("dialogue_id long, part string").json(f"{p}/all")


@query("a16_split_summary", "", _SUMMARY)
def a16(spark, d):
    return W.split_summary(_parts(spark, d))


@query("s15_call_log", "", "SELECT CAST(event_id AS INTEGER) AS call_index, event_type AS call_tag, CAST(user_id AS BIGINT) AS prompt_tokens FROM events")
def s15(spark, d):
    p = _place(spark)
    e = fx(spark, d, "events")
    W.append_calls(e.select(F.col("event_id").alias("call_index"), F.col("event_type").alias("call_tag")), f"{p}/prompts")
    W.append_calls(e.select(F.col("event_id").alias("call_index"), F.struct(F.col("user_id").alias("prompt_tokens")).alias("usage")), f"{p}/responses")
    return R.read_calls(spark, f"{p}/prompts", f"{p}/responses").select("call_index", "call_tag", "usage.prompt_tokens")


def _steps(spark, d):
    s = fx(spark, d, "slots")
    return s.groupBy((F.col("dialogue_id") % 4).alias("g")).agg((F.count_if("pred_requested") / F.count("*")).alias("rate"))


@query("s16_step_table", "slots", "SELECT CAST(g AS INTEGER) AS step, rate FROM (SELECT dialogue_id % 4 AS g, count(*) FILTER (pred_requested)::DOUBLE / count(*) AS rate FROM slots GROUP BY 1)")
def s16(spark, d):
    p, rows = _place(spark), cut(_steps(spark, d))
    for step in (0, 1, 1, 2, 3):  # a step that is written twice stays once
        W.write_step(spark, rows.where(F.col("g") == step).select("rate"), p, step)
    return spark.read.parquet(p).select("step", "rate")


@query("t4_resume_step", "slots", "SELECT CAST(max(dialogue_id % 4) AS INTEGER) AS last_step FROM slots")
def t4(spark, d):
    p = _place(spark)
    _steps(spark, d).withColumnRenamed("g", "step").write.partitionBy("step").parquet(p)
    return spark.createDataFrame([(W.last_step(spark, p),)], "last_step int")


@query("t1_batch_loop", "slots", "SELECT count(*) AS n, count(*) FILTER (pred_requested) AS n_requested FROM slots WHERE kind = 'request'")
def t1(spark, d):
    p = _place(spark)
    fx(spark, d, "slots").where("kind = 'request'").select("dialogue_id", "pred_requested").repartition(3, "dialogue_id").write.parquet(f"{p}/in")
    stream = spark.readStream.schema("dialogue_id long, pred_requested boolean").option("maxFilesPerTrigger", 1).parquet(f"{p}/in")
    S.score_batches(stream, lambda b: b.agg(F.count("*").alias("n"), F.count_if("pred_requested").alias("r")), f"{p}/out", f"{p}/state").awaitTermination()
    return spark.read.parquet(f"{p}/out").agg(F.sum("n").alias("n"), F.sum("r").alias("n_requested"))


@query(
    "t2_memory_stream",
    "domains",
    "SELECT * FROM best UNION ALL SELECT query_id, ord, 0, rank FROM (SELECT q.dialogue_id AS query_id, e.dialogue_id AS ord, row_number() OVER (PARTITION BY q.dialogue_id ORDER BY e.dialogue_id) AS rank FROM s q JOIN s e ON e.b < q.b AND e.good WHERE q.dialogue_id NOT IN (SELECT query_id FROM best)) WHERE rank <= 3",
    """s AS (SELECT DISTINCT dialogue_id, dialogue_id // 7 % 3 AS b, dialogue_id % 4 <> 1 AS good FROM domains),
ov AS (SELECT a.dialogue_id AS query_id, b.dialogue_id AS ord, count(*) AS overlap FROM domains a JOIN domains b ON a.domain = b.domain AND b.dialogue_id // 7 % 3 < a.dialogue_id // 7 % 3 AND b.dialogue_id % 4 <> 1 GROUP BY ALL),
best AS (SELECT query_id, ord, overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, ord) AS rank FROM ov) WHERE rank <= 3)""",
)
def t2s(spark, d):
    """Three micro-batches; the second fails after its writes and is run again from the checkpoint."""
    p = _place(spark)
    rows = cut(M.batch_domains(fx(spark, d, "domains"), "dialogue_id").select(F.col("dialogue_id").cast("long").alias("query_id"), "domains", F.col("dialogue_id").cast("long").alias("ord"), (F.col("dialogue_id") % 4 != 1).alias("success"), F.expr("dialogue_id div 7 % 3").alias("b")))
    schema = "query_id long, domains array<string>, ord long, success boolean"

    def run(after=None):
        S.grow_memory(spark.readStream.schema(schema).parquet(f"{p}/in"), 3, f"{p}/memory", f"{p}/found", f"{p}/state", after).awaitTermination()

    def stop(number):
        raise RuntimeError("stopped after its writes")

    for batch in range(3):
        rows.where(F.col("b") == batch).drop("b").write.mode("append").parquet(f"{p}/in")
        if batch == 1:
            with contextlib.suppress(StreamingQueryException):
                run(stop)
        run()
    return spark.read.schema("query_id long, ord long, overlap long, rank int, step int").parquet(f"{p}/found").drop("step")


@query(
    "t3_running_state",
    "turns",
    """SELECT dialogue_id, utt_idx, last_value(act_domain IGNORE NULLS) OVER (PARTITION BY dialogue_id ORDER BY utt_idx ROWS UNBOUNDED PRECEDING) AS current_domain,
 CASE WHEN booked AND act_domain IS NOT NULL AND utt_idx = min(CASE WHEN booked AND act_domain IS NOT NULL THEN utt_idx END) OVER (PARTITION BY dialogue_id, act_domain) THEN act_domain END AS booked_domain FROM turns""",
)
def t3(spark, d):
    p = _place(spark)
    schema = "dialogue_id long, utt_idx long, act_domain string, booked boolean"
    turns = fx(spark, d, "turns").select("dialogue_id", "utt_idx", "act_domain", "booked").repartition(4, "dialogue_id").sortWithinPartitions(F.desc("utt_idx"))
    for part in ("utt_idx < 3", "utt_idx >= 3"):  # most dialogues come in two batches, and backwards in each
        turns.where(part).write.mode("append").parquet(f"{p}/in")
    n = spark.read.schema(schema).parquet(f"{p}/in").where("utt_idx < 3").select(F.input_file_name()).distinct().count()
    out = S.running_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(f"{p}/in"))
    out.writeStream.format("parquet").option("path", f"{p}/out").option("checkpointLocation", f"{p}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("dialogue_id long, utt_idx long, current_domain string, booked_domain string").parquet(f"{p}/out")


WHITELIST = {"hotel": ("slot 3", "slot 6"), "restaurant": ("slot 1", "slot 4"), "train": ("slot 2", "slot 5")}


@query("p10_relevant_slots", "slots", "SELECT dialogue_id, domain, slot FROM slots WHERE slot IN ('slot 1', 'slot 2', 'slot 3', 'slot 4', 'slot 5', 'slot 6')")
def p10(spark, d):
    return C.relevant(fx(spark, d, "slots").select("dialogue_id", "domain", "slot"), WHITELIST)


@query("j17_known_slot", "slots", "SELECT dialogue_id, slot, CASE WHEN slot = 'book people' THEN 'book people' ELSE '-' END AS canonical FROM slots")
def j17(spark, d):
    s = fx(spark, d, "slots").withColumn("raw", F.when(F.col("slot") == "book people", "People").otherwise(F.col("slot")))
    known = C.known_slots({x: ["book people"] for x in ("hotel", "restaurant", "train")})
    return s.select("dialogue_id", "slot", F.coalesce(C.canonical_slot("domain", "raw", known), F.lit("-")).alias("canonical"))
