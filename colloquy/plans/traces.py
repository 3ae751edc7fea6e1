"""Queries: traces, reports, patches, memory, model calls."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import checkpoint_dir, cut
from ..operators import memory as M
from ..operators import patches as P
from ..operators import traces as R
from ..sources.writers import write_triage
from .fixtures import fixture as fx
from .registry import query


def _logs(spark, d):
    return fx(spark, d, "logs").select("row_id", "custkey", "file_name", "seed", *R.log_outcome("file_name"))


_ID = "CAST(custkey AS STRING) || '-' || CAST(row_id % 7 AS STRING)"
_OUT = "CASE WHEN file_name LIKE '%FAILED.md' THEN 'FAILED' ELSE 'SUCCEED' END"
_L = f"l AS (SELECT *, {_ID} AS instance_id, {_OUT} AS outcome FROM logs)"


@query("s9_log_names", "logs", "SELECT row_id, instance_id, outcome FROM l", _L)
def s9(spark, d):
    return _logs(spark, d).select("row_id", "instance_id", "outcome")


@query("s10_run_ids", "logs", "SELECT row_id, instance_id || '_' || seed AS run_id FROM l", _L)
def s10(spark, d):
    return R.with_seed(_logs(spark, d)).select("row_id", "run_id")


@query("p5_only_failed", "logs", "SELECT row_id, instance_id FROM l WHERE outcome = 'FAILED'", _L)
def p5(spark, d):
    return R.only(_logs(spark, d), "FAILED").select("row_id", "instance_id")


def _wanted(spark, d):
    return fx(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.col("c_custkey").cast("string"), F.lit("-1")).alias("instance_id"))


_W = "w AS (SELECT CAST(c_custkey AS STRING) || '-1' AS instance_id FROM customer WHERE c_custkey % 3 = 0)"


@query("p6_by_ids", "logs", "SELECT row_id, instance_id FROM l WHERE instance_id IN (SELECT instance_id FROM w)", f"{_L}, {_W}")
def p6(spark, d):
    return R.by_ids(_logs(spark, d), _wanted(spark, d))[0].select("row_id", "instance_id")


@query("u3_missing_ids", "logs", "SELECT instance_id FROM w WHERE instance_id NOT IN (SELECT instance_id FROM l)", f"{_L}, {_W}")
def u3(spark, d):
    return R.by_ids(_logs(spark, d), _wanted(spark, d))[1]


def _reports(spark, d):
    return fx(spark, d, "reports").withColumn("in_directory", F.expr("instance_id % 2 = 0"))


@query("p7_pass_gate", "reports", "SELECT instance_id FROM reports WHERE pass_flag OR instance_id % 2 = 1")
def p7(spark, d):
    return R.pass_gate(_reports(spark, d))[0].select("instance_id")


_LOG_ID = "CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 9 AS STRING)"
_ASKED = f"CASE o_orderkey % 5 WHEN 0 THEN {_LOG_ID} WHEN 1 THEN {_LOG_ID} || '_FAILED' WHEN 2 THEN 'agent_' || {_LOG_ID} || '_SUCCEED' WHEN 3 THEN 'FAILED' ELSE 'log.' || {_LOG_ID} END"


@query(
    "j8_match_logs",
    "logs",
    f"SELECT r.id AS instance_id, log_file FROM (SELECT {_ASKED} AS id FROM orders) r LEFT JOIN (SELECT id, min(name) AS log_file FROM c GROUP BY id) x ON r.id = x.id",
    f"""{_L}, n AS (SELECT instance_id AS i, outcome AS o, file_name AS name FROM l UNION ALL SELECT instance_id, outcome, 'run_log.' || instance_id || '.md' FROM l WHERE row_id % 3 = 0),
c AS (SELECT i AS id, name FROM n WHERE name LIKE 'cli%' UNION ALL SELECT i || '_' || o, name FROM n WHERE name LIKE 'cli%' UNION ALL SELECT o, name FROM n WHERE name LIKE 'cli%' UNION ALL SELECT 'agent_' || i || '_' || o, name FROM n WHERE name LIKE 'cli%' UNION ALL SELECT 'log.' || i, name FROM n WHERE name LIKE 'run%')""",
)
def j8(spark, d):
    """Ids with and without ``_`` and ``.``; some logs have no ``_agent_`` in their names."""
    results = fx(spark, d, "orders").selectExpr(f"{_ASKED} AS instance_id")
    logs = _logs(spark, d).select("row_id", "file_name", "instance_id")
    more = logs.where("row_id % 3 = 0").select("row_id", F.concat(F.lit("run_log."), "instance_id", F.lit(".md")).alias("file_name"), "instance_id")
    return R.match_logs(results, logs.unionByName(more).select("file_name")).select("instance_id", "log_file")


@query("j9_unfinished", "", "SELECT c_custkey AS instance_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)")
def j9(spark, d):
    want = fx(spark, d, "customer").select(F.col("c_custkey").alias("instance_id"), F.array(F.lit("out_0"), F.lit("out_1")).alias("expected"))
    have = fx(spark, d, "orders").select(F.col("o_custkey").alias("instance_id"), F.concat(F.lit("out_"), (F.col("o_orderkey") % 3).cast("string")).alias("name"))
    return R.unfinished(want, have).select("instance_id")


@query("j10_pending", "logs", "SELECT row_id, instance_id FROM l WHERE instance_id NOT IN (SELECT CAST(c_custkey AS STRING) || '-1' FROM customer)", _L)
def j10(spark, d):
    done = fx(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("-1")).alias("instance_id"))
    return R.pending(_logs(spark, d), done).select("row_id", "instance_id")


@query("j11_of_tasks", "logs", "SELECT row_id, instance_id AS key FROM l WHERE instance_id IN (SELECT instance_id FROM w)", f"{_L}, {_W}")
def j11(spark, d):
    rows = _logs(spark, d).select("row_id", F.when(F.col("row_id") % 2 == 0, F.concat("instance_id", F.lit("_prompt"))).alias("task_id"), "instance_id")
    return R.of_tasks(rows, _wanted(spark, d).withColumnRenamed("instance_id", "task_id"), "task_id", "instance_id").select("row_id", "key")


@query("m10_after_think", "reports", "SELECT instance_id, trim(CASE WHEN instance_id % 4 = 0 THEN substr(report, 13) ELSE report END, ' ' || chr(10)) AS body FROM reports")
def m10(spark, d):
    return fx(spark, d, "reports").select("instance_id", T.strip_fences(T.after_think("report")).alias("body"))


_ITEMS = """it AS (SELECT instance_id, 'failure_cause' AS type, 1 AS number, source AS title, lang AS content, '' AS relation_to_skill, NULL AS skill_reflection FROM reports WHERE n_items >= 1
UNION ALL SELECT instance_id, 'failure_memory', 2, lang, '', NULL, source FROM reports WHERE n_items >= 2)"""


def _records(spark, d):
    return R.parse_reports(fx(spark, d, "reports"))


@query("m11_error_items", "reports", "SELECT * FROM it", _ITEMS)
def m11(spark, d):
    rows = _records(spark, d)[0].select("instance_id", F.explode("items").alias("i")).select("instance_id", "i.*")
    return rows.select("instance_id", "type", "number", "title", "content", "relation_to_skill", "skill_reflection")


@query("s17_quarantine", "reports", "SELECT instance_id FROM reports WHERE n_items = 0")
def s17(spark, d):
    return _records(spark, d)[1].select("instance_id")


@query("a24_item_counts", "reports", "SELECT coalesce(type, 'all') AS type, count(*) AS n FROM it GROUP BY ROLLUP (type)", _ITEMS)
def a24(spark, d):
    return R.item_counts(_records(spark, d)[0])


@query("m12_success_items", "", "SELECT doc_id AS instance_id, CAST(doc_id % 7 AS INTEGER) AS number, lang AS title, '' AS description, source || chr(10) || 'more' AS content FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 8, source, lang, '' FROM documents WHERE doc_id % 2 = 0")
def m12(spark, d):
    text = F.concat(
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("## Success Memory Item "), (F.col("doc_id") % 7).cast("string"), F.lit("\n### Title\nold\n### Title\n"), "lang", F.lit("\n### Content\n"), "source", F.lit("\nmore\n---\n"))).otherwise(""),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Success Memory Item 8\n## Title\n"), "source", F.lit("\n## Description\n"), "lang", F.lit("\n"))).otherwise(""),
    )
    return R.success_items(fx(spark, d, "documents").select(F.col("doc_id").alias("instance_id"), text.alias("report")))


@query("m13_strip_log", "turns", "SELECT dialogue_id, utt_idx, trim(utterance, ' ' || chr(10) || chr(9) || chr(13)) || CASE WHEN utt_idx % 2 = 0 THEN '' ELSE chr(10) || '## RESULT of' END AS body, trim(utterance, ' ' || chr(10) || chr(9) || chr(13)) AS before_result FROM turns")
def m13(spark, d):
    """Of logs that mention a result before their result section, one variant keeps what is between."""
    log = F.concat(F.lit("# Chat History x\n\n**Timestamp**: now\n\n---\n\n"), F.trim("utterance"), F.when(F.col("utt_idx") % 2 == 0, "").otherwise("\n## RESULT of"), F.lit("\n---\n\n## RESULT\nfine\nall"))
    return fx(spark, d, "turns").select("dialogue_id", "utt_idx", T.strip_log(log).alias("body"), T.before_result(F.concat(F.lit("\n "), log)).alias("before_result"))


@query("m14_trajectory_steps", "turns", "SELECT dialogue_id AS instance_id, count(*) AS n_steps, count(thought) AS n_thoughts FROM (SELECT dialogue_id, utt_idx, CASE WHEN speaker = 'user' THEN 'x' END AS thought FROM turns) GROUP BY dialogue_id")
def m14(spark, d):
    line = F.concat(F.when(F.col("speaker") == "user", "[thought] t\n").otherwise(""), F.lit("[action] a\nplain\n\n  [observation] o"))
    logs = fx(spark, d, "turns").groupBy(F.col("dialogue_id").alias("instance_id")).agg(F.array_sort(F.collect_list(F.struct("utt_idx", line.alias("line")))).alias("x")).select("instance_id", F.array_join("x.line", "\n").alias("text"))
    return R.trajectory_steps(logs).groupBy("instance_id").agg(F.count("*").alias("n_steps"), F.count("thought").alias("n_thoughts"))


@query("m15_response_parts", "turns", "SELECT dialogue_id, utt_idx, CASE utt_idx % 3 WHEN 0 THEN 'query_db' WHEN 1 THEN 'final' END AS action, CASE WHEN utt_idx % 3 < 2 THEN coalesce(act_domain, '') ELSE '-' END AS domain, CASE WHEN utt_idx % 3 = 1 THEN speaker ELSE '' END AS reply FROM turns")
def m15(spark, d):
    args = F.concat(F.lit('{"domain": "'), F.coalesce("act_domain", F.lit("")), F.lit('", "n": {"a": 1}}'))
    r = F.when(F.col("utt_idx") % 3 == 0, F.concat(F.lit("ACTION: query_db\nARGUMENTS: "), args)).when(F.col("utt_idx") % 3 == 1, F.concat(F.lit("action: final\nRESPONSE: "), "speaker", F.lit("\nARGUMENTS: "), args)).otherwise(F.lit("just talk"))
    rows = fx(spark, d, "turns").select("dialogue_id", "utt_idx", T.response_parts(r).alias("p"))
    return rows.select("dialogue_id", "utt_idx", "p.action", F.when(F.col("p.action").isNull(), "-").otherwise(F.coalesce(F.try_element_at("p.arguments", F.lit("domain")), F.lit(""))).alias("domain"), "p.reply")


@query("m16_tool_calls", "turns", "SELECT dialogue_id, utt_idx, CASE utt_idx % 4 WHEN 0 THEN 'action' WHEN 1 THEN 'action' WHEN 2 THEN 'format_error' ELSE 'task_complete' END AS kind, CASE WHEN utt_idx % 4 < 2 THEN speaker END AS tool FROM turns")
def m16(spark, d):
    k = F.col("utt_idx") % 4
    r = F.when(k == 0, F.concat(F.lit('Action: {"name": "'), "speaker", F.lit('", "arguments": {"x": {"y": 1}}} {"z": 2}'))).when(k == 1, F.concat(F.lit("Action: {'name': '"), "speaker", F.lit("'} rest"))).when(k == 2, F.lit("Action: {no")).otherwise(F.lit("the end"))
    return R.tool_calls(fx(spark, d, "turns").select("dialogue_id", "utt_idx", r.alias("response"))).select("dialogue_id", "utt_idx", "kind", "tool")


@query("m17_first_fence", "", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS v FROM documents")
def m17(spark, d):
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('note ```x``` ```json\n{"v": "'), "lang", F.lit('"}\n``` end'))).otherwise(F.concat(F.lit(' {"v": "'), "source", F.lit('"} ')))
    return fx(spark, d, "documents").select("doc_id", F.get_json_object(T.first_fence(body), "$.v").alias("v"))


def _payloads(spark, d):
    good = F.concat(F.lit('{"reasoning": "r", "edits": [{"file": "f", "op": "create"}, "text", {"file": "'), F.when(F.col("doc_id") % 2 == 0, "g").otherwise(""), F.lit('"}]'), F.when(F.col("doc_id") % 7 == 0, ', "changelog_entries": "none"').when(F.col("doc_id") % 3 == 0, ', "changelog_entries": ["```c```"]').otherwise(""), F.lit("}"))
    k, fence = F.col("doc_id") % 11, F.concat(F.lit("text ```json\n"), good)
    body = F.when(F.col("doc_id") % 5 == 0, "no json").when(k == 1, fence).when(k == 2, F.concat(F.lit("see "), good)).when(k == 3, F.concat(F.lit("\n "), good, F.lit(" "))).otherwise(F.concat(fence, F.lit("\n```\nmore ``` of it")))
    return fx(spark, d, "documents").select("doc_id", T.patch_payload(body).alias("payload"))


#: Documents whose fence closes, or whose text begins with a brace.
_HAS = "doc_id % 5 <> 0 AND doc_id % 11 NOT IN (1, 2)"


@query("m18_patch_payload", "", f"SELECT doc_id, {_HAS} AS has_payload, CASE WHEN {_HAS} THEN 'r' END AS reasoning FROM documents")
def m18(spark, d):
    return _payloads(spark, d).select("doc_id", F.col("payload").isNotNull().alias("has_payload"), F.get_json_object("payload", "$.reasoning").alias("reasoning"))


@query("p13_payload_issues", "", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Top-level field ''changelog_entries'' must be a list; ' WHEN doc_id % 3 = 0 THEN '' ELSE 'Missing top-level field: changelog_entries; ' END || 'Edit #2 must be an object; ' || CASE WHEN doc_id % 2 = 1 THEN 'Edit #3 is missing required field: file; ' ELSE '' END || 'Edit #3 is missing required field: op' AS issues FROM documents WHERE " + _HAS)
def p13(spark, d):
    return _payloads(spark, d).where("payload is not null").select("doc_id", F.array_join(P.payload_issues("payload"), "; ").alias("issues"))


@query("m19_semantic_blocks", "", "SELECT doc_id, lang AS reasoning, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n_items, source AS target_file, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS n_issues FROM documents")
def m19(spark, d):
    item = lambda i, hint: F.concat(F.lit(f"[ITEM_{i}_START]\nTarget File: "), "source", F.lit("\nEdit_Intent: fix\nmore of it\nLocation Hint:"), hint, F.lit(f"\nChange Instruction: do\n[ITEM_{i}_END]\n"))
    body = F.concat(F.lit("x ===== PATCH START =====\nReasoning: "), "lang", F.lit("\nItems:\n"), item(1, F.lit(" top")), item(2, F.when(F.col("doc_id") % 2 == 0, " end").otherwise("")), F.lit("Changelog:\n- one\n===== PATCH END ===== y"))
    rows = fx(spark, d, "documents").select("doc_id", F.explode(P.semantic_blocks(body)).alias("b"))
    return rows.select("doc_id", "b.reasoning", F.size("b.items").alias("n_items"), F.get("b.items.target_file", F.lit(0)).alias("target_file"), F.size("b.issues").alias("n_issues"))


@query("m20_section", "", "SELECT doc_id AS instance_id, '## Rules' || chr(10) || lang || chr(10) || '### Sub' || chr(10) || source AS section FROM documents")
def m20(spark, d):
    text = F.concat(F.lit("# Top\nx\n## Rules\n"), "lang", F.lit("\n### Sub\n"), "source", F.when(F.col("doc_id") % 2 == 0, "\n## Next\ny").otherwise("\n# Other"))
    return R.section(fx(spark, d, "documents").select(F.col("doc_id").alias("instance_id"), text.alias("text")), "## Rules")


@query("m21_front_matter", "", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS name, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS description, 'body' AS body FROM documents")
def m21(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nname: "), "source", F.lit("\ndescription: "), "lang", F.lit("\n---\nbody\n"))).otherwise(F.lit("body"))
    return fx(spark, d, "documents").select("doc_id", T.front_matter(text).alias("m")).select("doc_id", "m.*")


@query("m22_references", "edits", "SELECT ord, 'references/r' || CAST((ord * 3) % 8 AS STRING) || '.md' AS refs FROM edits")
def m22(spark, d):
    return fx(spark, d, "edits").select("ord", F.array_join(T.references(F.concat("content", F.lit(" "), "content")), ",").alias("refs"))


@query("m23_elide_middle", "", "SELECT doc_id, CASE WHEN length(text) > 1000 AND doc_id % 3 <> 0 THEN length(text[1:300]) + 300 + length('\n\n[WARNING: Output truncated. Showing first 300 and last 300 characters. ' || CAST(length(text) - 600 AS STRING) || ' characters elided.]\n\n') ELSE length(text) END AS n, left(text, 300) AS head FROM documents".replace("\n", "_"))
def m23(spark, d):
    """Every third action reads a file that is never shortened."""
    action = F.when(F.col("doc_id") % 3 == 0, "cat /skills/a.md").when(F.col("doc_id") % 3 == 1, "ls")
    e = T.elide_middle("text", 1000, 300, action, ("/skills/", "SKILL.md"))
    return fx(spark, d, "documents").select("doc_id", F.length(e).cast("long").alias("n"), F.left(e, F.lit(300)).alias("head"))


@query("m32_safe_tag", "", "SELECT doc_id, 'a_b_' || source || '_' AS tag FROM documents")
def m32(spark, d):
    return fx(spark, d, "documents").select("doc_id", T.safe_tag(F.concat(F.lit("a/b "), "source", F.lit("?"))).alias("tag"))


@query("m33_cache_key", "turns", "SELECT dialogue_id, utt_idx, sha256('m' || chr(10) || '[{\"content\":\"' || CAST(utt_idx AS STRING) || '\",\"role\":\"' || speaker || '\"}]') AS key, utt_idx % 3 = 0 AS transient FROM turns")
def m33(spark, d):
    msg = F.array(F.struct(F.col("speaker").alias("role"), F.col("utt_idx").cast("string").alias("content")))
    reply = F.when(F.col("utt_idx") % 3 == 0, "Error 429: slow down").otherwise("1429 rows")
    return fx(spark, d, "turns").select("dialogue_id", "utt_idx", T.cache_key(F.lit("m"), msg).alias("key"), T.is_transient(reply).alias("transient"))


@query("m8_case_text", "turns", "SELECT dialogue_id, utt_idx, 'Speaker: ' || speaker || chr(10) || 'Domain: ' || coalesce(act_domain, 'none') AS prompt FROM turns")
def m8(spark, d):
    t = fx(spark, d, "turns")
    return t.select("dialogue_id", "utt_idx", T.rendered("Speaker: {speaker}\nDomain: {act_domain}", {"act_domain": "none"}).alias("prompt"))


@query("p12_truncate", "", "SELECT doc_id, left(text, 500) AS short FROM documents")
def p12(spark, d):
    return fx(spark, d, "documents").select("doc_id", F.substring("text", 1, 500).alias("short"))


def _edits(spark, d):
    return fx(spark, d, "edits")


_OPS = "e AS (SELECT batch_index, ord, CASE op WHEN 'createFile' THEN 'create' ELSE op END AS op, file, content, 'references/r' || CAST((ord * 3) % 8 AS STRING) || '.md' AS ref FROM edits WHERE op <> 'bogus')"


@query("p14_canonical_ops", "edits", "SELECT batch_index, ord, op FROM e", _OPS)
def p14(spark, d):
    return P.canonical_ops(_edits(spark, d)).select("batch_index", "ord", "op")


_HAVE = "e2 AS (SELECT * FROM e), ex AS (SELECT 'references/r' || CAST(i AS STRING) || '.md' AS file FROM (VALUES (3), (5)) v(i))"


def _some(spark, d):
    edits = P.canonical_ops(_edits(spark, d))
    existing = spark.createDataFrame([("references/r3.md",), ("references/r5.md",)], "file string")
    return edits, existing


@query(
    "j13_paired_edits",
    "edits",
    """SELECT batch_index, ord, op FROM e2 x WHERE op = 'create' AND EXISTS (SELECT 1 FROM e2 y WHERE y.batch_index = x.batch_index AND y.op <> 'create' AND y.ref = x.file AND y.ref NOT IN (SELECT file FROM ex))
UNION ALL SELECT batch_index, ord, op FROM e2 x WHERE op <> 'create' AND (ref IN (SELECT file FROM ex) OR EXISTS (SELECT 1 FROM e2 y WHERE y.batch_index = x.batch_index AND y.op = 'create' AND y.file = x.ref))""",
    f"{_OPS}, {_HAVE}",
)
def j13(spark, d):
    return P.paired(*_some(spark, d)).select("batch_index", "ord", "op")


@query(
    "j14_sanitized_edits",
    "edits",
    """SELECT batch_index, ord, op FROM k WHERE op <> 'create' OR EXISTS (SELECT 1 FROM k y WHERE y.batch_index = k.batch_index AND y.file = 'SKILL.md' AND y.ref = k.file)""",
    f"{_OPS}, {_HAVE}, k AS (SELECT * FROM e2 x WHERE file <> 'SKILL.md' OR ref IN (SELECT file FROM ex) OR EXISTS (SELECT 1 FROM e2 y WHERE y.batch_index = x.batch_index AND y.op = 'create' AND y.file = x.ref))",
)
def j14(spark, d):
    return P.sanitized(*_some(spark, d)).select("batch_index", "ord", "op")


@query("j15_snapshot_diff", "", "SELECT 'f' || CAST(o_orderkey AS STRING) AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 11 = 0 THEN 'removed' WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'same' END AS change FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 11 = 0)")
def j15(spark, d):
    o = fx(spark, d, "orders").withColumn("path", F.concat(F.lit("f"), F.col("o_orderkey").cast("string")))
    before = o.where("o_orderkey % 7 <> 0").select("path", F.lit("a").alias("content"))
    after = o.where("o_orderkey % 11 <> 0").select("path", F.when(F.col("o_orderkey") % 3 == 0, "b").otherwise("a").alias("content"))
    return P.snapshot_diff(before, after)


@query("a20_longest_edit", "edits", "SELECT batch_index, file, op, min(ord) AS ord, length(max(content)) AS n FROM (SELECT *, first_value(content) OVER (PARTITION BY batch_index, file, op ORDER BY length(content) DESC, ord) AS best FROM edits) WHERE content = best GROUP BY batch_index, file, op".replace("min(ord) AS ord, length(max(content)) AS n FROM (SELECT *,", "min(m) AS ord, length(max(content)) AS n FROM (SELECT *, min(ord) OVER (PARTITION BY batch_index, file, op) AS m,"))
def a20(spark, d):
    return P.longest(_edits(spark, d), "batch_index", "file", "op").select("batch_index", "file", "op", "ord", F.length("content").cast("long").alias("n"))


def _patches(spark, d):
    return _edits(spark, d).select("batch_index", "ord", F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("ord").cast("string")).alias("reasoning"), F.array("file").alias("edits"), F.array(F.col("op")).alias("changelog"))


_PARTS = """SELECT {0} AS {1}, 'reasoning' AS kind, row_number() OVER (PARTITION BY {0} ORDER BY ord) - 1 AS pos, CAST(ord AS VARCHAR) AS body FROM e WHERE ord % 3 <> 0
UNION ALL SELECT {0}, kind, pos, CASE kind WHEN 'edits' THEN file ELSE op END FROM (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY ord) - 1 AS pos FROM e), (VALUES ('edits'), ('changelog')) v(kind)"""
_CUSTOMERS = "e AS (SELECT edits.*, o_custkey AS k FROM edits JOIN orders ON ord = o_orderkey)"


@query("a21_coalesced", "edits", _PARTS.format("batch_index", "batch_index"), "e AS (SELECT * FROM edits)")
def a21(spark, d):
    """The patches of a batch as one, as a table of its parts."""
    return P.coalesced(_patches(spark, d), "batch_index").select("batch_index", "kind", "pos", "body")


def _of_customers(spark, d):
    key = fx(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("k"))
    return _patches(spark, d).join(key, "ord")


@query("a21_patch_text", "edits", "SELECT k, coalesce(string_agg(CASE WHEN ord % 3 <> 0 THEN CAST(ord AS STRING) END, chr(10) || chr(10) ORDER BY ord), '') AS reasoning, string_agg(file, ',' ORDER BY ord) AS files, string_agg(op, ',' ORDER BY ord) AS ops FROM e GROUP BY k", _CUSTOMERS)
def a21t(spark, d):
    """The patches of every customer as one, put together as a sink would write it."""
    return P.patch_text(P.coalesced(_of_customers(spark, d), "k"), "k").select("k", "reasoning", F.array_join("edits", ",").alias("files"), F.array_join("changelog", ",").alias("ops"))


@query(
    "k13_merged",
    "edits",
    """SELECT kind, body, count(*) OVER (PARTITION BY kind) AS n, CAST((SELECT max(level) FROM s) AS INTEGER) AS levels FROM (SELECT 'reasoning' AS kind, string_agg(CAST(ord AS VARCHAR), chr(10) || chr(10) ORDER BY ord) AS body FROM e WHERE ord % 3 <> 0 GROUP BY k UNION ALL SELECT 'edits', file FROM e UNION ALL SELECT 'changelog', op FROM e)""",
    _CUSTOMERS
    + """,
s AS (WITH RECURSIVE s(n, level) AS (SELECT count(DISTINCT k), 0 FROM e UNION ALL SELECT CASE WHEN n <= 5 THEN 1 WHEN n % 5 BETWEEN 1 AND 2 THEN n // 5 ELSE n // 5 + CAST(n % 5 > 0 AS BIGINT) END, level + 1 FROM s WHERE n > 1) SELECT * FROM s)""",
)
def k13(spark, d):
    """The edits of every customer are a patch; all patches are merged in groups of five, level by level; nothing is lost.

    ``n`` is the last place of the kind and one more, so every part must have a place of its own."""
    parts = P.patch_text(P.coalesced(_of_customers(spark, d), "k"), "k").withColumnRenamed("k", "ord")
    rows = cut(P.merged(parts, 5))
    n = rows.groupBy("kind").agg((F.max("pos") + 1).alias("n"), F.count_distinct("pos").alias("places"))
    return rows.join(F.broadcast(n.where("n = places")), "kind").select("kind", "body", "n", "levels")


@query("u1_tagged_union", "logs", "SELECT row_id, CASE outcome WHEN 'FAILED' THEN 'error' ELSE 'success' END AS source, CASE outcome WHEN 'FAILED' THEN 0 ELSE 1 END AS source_order FROM l", _L)
def u1(spark, d):
    l = _logs(spark, d)
    return R.tagged_union(R.only(l, "FAILED"), R.only(l, "SUCCEED")).select("row_id", "source", "source_order")


@query("u2_keyed_union", "", "SELECT coalesce(a.k, b.k) AS key, coalesce(b.v, a.v) AS value FROM (SELECT o_custkey AS k, 'e' || max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, 's' || max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
def u2(spark, d):
    o = fx(spark, d, "orders")
    side = lambda st, p: o.where(F.col("o_orderstatus") == st).groupBy(F.col("o_custkey").alias("key")).agg(F.concat(F.lit(p), F.max("o_orderkey").cast("string")).alias("value"))
    return R.keyed_union(side("F", "e"), side("O", "s"), "key", "value")


@query("u4_path_union", "edits", "SELECT DISTINCT file AS path FROM edits")
def u4(spark, d):
    e = _edits(spark, d).select(F.col("file").alias("path"), "ord")
    return P.snapshot_diff(*(e.where(c).groupBy("path").agg(F.max("ord").alias("content")) for c in ("ord % 4 = 0", "ord % 4 <> 0"))).select("path")


@query("u5_of_seeds", "logs", "SELECT row_id, seed FROM logs")
def u5(spark, d):
    rows = fx(spark, d, "logs")
    return R.of_seeds({s: rows.where(F.col("seed") == s).drop("seed") for s in ("seed_0", "seed_1", "seed_2")}).select("row_id", "seed")


@query("s14_triage", "logs", "SELECT instance_id, outcome = 'SUCCEED' AS passed, 0.5::DOUBLE AS soft_score, 1 AS hard_score, CASE WHEN row_id % 5 = 0 THEN 'a, \"quoted\"' ELSE '' END AS error, CASE WHEN row_id % 7 = 0 THEN '' ELSE file_name END AS log_file, left(file_name || file_name || file_name, 100) AS instruction FROM l", _L)
def s14(spark, d):
    """The triage table, written as CSV and read back."""
    p = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    error = F.when(F.col("row_id") % 5 == 0, 'a, "quoted"')
    rows = _logs(spark, d).select("instance_id", (F.col("outcome") == "SUCCEED").alias("passed"), F.lit(0.5).alias("soft_score"), F.lit(1).alias("hard_score"), error.alias("error"), F.when(F.col("row_id") % 7 != 0, F.col("file_name")).alias("log_file"), F.repeat("file_name", F.lit(3)).alias("instruction"))
    write_triage(R.triage(rows), p)
    back = spark.read.option("header", True).option("escape", '"').schema("instance_id string, passed boolean, soft_score double, hard_score int, error string, log_file string, instruction string").csv(p)
    return back.withColumns({c: F.coalesce(c, F.lit("")) for c in ("error", "log_file")})


def _exemplars(spark, d):
    x = M.batch_domains(fx(spark, d, "domains"), "dialogue_id", "batch_no")
    return x.withColumn("ord", F.col("dialogue_id"))


_SETS = "ov AS (SELECT a.dialogue_id AS query_id, b.dialogue_id AS ord, count(*) AS overlap, a.batch_no AS qb, b.batch_no AS eb FROM domains a JOIN domains b ON a.domain = b.domain GROUP BY ALL)"


@query("j16_retrieve", "domains", "SELECT query_id, ord, overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, ord) AS rank FROM ov) WHERE rank <= 3", _SETS)
def j16(spark, d):
    x = _exemplars(spark, d)
    return M.retrieve(x.select(F.col("dialogue_id").alias("query_id"), "domains"), x.select("ord", "domains"), 3)


_BATCHED = """best AS (SELECT query_id, ord, overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, ord) AS rank FROM ov WHERE eb < qb) WHERE rank <= 3),
s AS (SELECT DISTINCT dialogue_id, batch_no FROM domains)"""


@query(
    "t2_growing_memory",
    "domains",
    "SELECT * FROM best UNION ALL SELECT query_id, ord, 0, rank FROM (SELECT q.dialogue_id AS query_id, e.dialogue_id AS ord, row_number() OVER (PARTITION BY q.dialogue_id ORDER BY e.dialogue_id) AS rank FROM s q JOIN s e ON e.batch_no < q.batch_no WHERE q.dialogue_id NOT IN (SELECT query_id FROM best)) WHERE rank <= 3",
    f"{_SETS}, {_BATCHED}",
)
def t2(spark, d):
    x = _exemplars(spark, d)
    return M.retrieve(x.select(F.col("dialogue_id").alias("query_id"), "domains", "batch_no"), x.select("ord", "domains", "batch_no"), 3)


@query("m9_exemplar_text", "domains", "SELECT query_id, string_agg('### Example ' || rank || chr(10) || 'Goal: goal ' || ord, chr(10) || chr(10) ORDER BY rank) AS text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, ord) AS rank FROM ov) WHERE rank <= 3 GROUP BY query_id", _SETS)
def m9(spark, d):
    x = _exemplars(spark, d).withColumns({"goal": F.concat(F.lit("goal "), F.col("ord").cast("string")), "trajectory": F.lit("")})
    return M.exemplar_text(M.retrieve(x.select(F.col("dialogue_id").alias("query_id"), "domains"), x.select("ord", "domains"), 3), x)


@query("a23_batch_domains", "domains", "SELECT batch_no, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM domains GROUP BY batch_no")
def a23(spark, d):
    return M.batch_domains(fx(spark, d, "domains"), "batch_no").select("batch_no", F.array_join("domains", ",").alias("domains"))


@query("u6_overlap", "domains", "SELECT a.dialogue_id, count(b.domain) AS n FROM domains a LEFT JOIN (VALUES ('click'), ('view')) b(domain) ON a.domain = b.domain GROUP BY 1")
def u6(spark, d):
    x = _exemplars(spark, d)
    return x.select("dialogue_id", M.overlap("domains", F.array(F.lit("click"), F.lit("view"))).cast("long").alias("n"))


@query("a22_usage_totals", "", "SELECT coalesce(event_type, 'all') AS call_tag, count(*) AS n_calls, CAST(sum(user_id) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 100) AS BIGINT) AS completion_tokens FROM events GROUP BY ROLLUP (event_type)")
def a22(spark, d):
    calls = fx(spark, d, "events").select(F.col("event_type").alias("call_tag"), F.struct(F.col("user_id").cast("long").alias("prompt_tokens"), F.expr("cast(event_id % 100 as long)").alias("completion_tokens")).alias("usage"))
    return M.usage_totals(calls)


@query("x1_predict", "turns", "SELECT dialogue_id, utt_idx, length(utterance) AS n FROM turns")
def x1(spark, d):
    t = fx(spark, d, "turns").select("dialogue_id", "utt_idx", "utterance")
    return M.predict(t, lambda f: f[["dialogue_id", "utt_idx"]].assign(n=f["utterance"].str.len()), "dialogue_id long, utt_idx long, n long")


@query("x3_cached_scores", "turns", "SELECT dialogue_id, utt_idx, CASE WHEN speaker = 'user' THEN 'known' ELSE 'new' END AS reply FROM turns")
def x3(spark, d):
    msg = F.array(F.struct(F.col("speaker").alias("role"), F.lit("").alias("content")))
    calls = fx(spark, d, "turns").select("dialogue_id", "utt_idx", F.lit("m").alias("model"), msg.alias("messages"), "speaker")
    cache = calls.where("speaker = 'user'").select(T.cache_key(F.col("model"), F.col("messages")).alias("key"), F.lit("known").alias("reply")).distinct()
    return M.score_with_cache(calls, cache, lambda s: s.map(lambda x: "new"))[0].select("dialogue_id", "utt_idx", "reply")


_CALLED = "first AS (SELECT DISTINCT speaker, utterance FROM turns WHERE dialogue_id % 2 = 0)"


@query("x3_reply_table", "turns", "SELECT dialogue_id, utt_idx, f.speaker IS NOT NULL AS hit, CAST(length(t.utterance) AS VARCHAR) AS reply FROM turns t LEFT JOIN first f ON t.speaker = f.speaker AND t.utterance = f.utterance", _CALLED)
def x3_table(spark, d):
    """Replies of two calls through one table: what the first one asked is not asked again by the second."""
    msg = F.array(F.struct(F.col("speaker").alias("role"), F.col("utterance").alias("content")))
    calls = fx(spark, d, "turns").select("dialogue_id", "utt_idx", F.lit("m").alias("model"), msg.alias("messages"))
    name = f"replies_{uuid.uuid4().hex}"
    M.reply_table(spark, name, f"{checkpoint_dir(spark)}/{name}")
    reply = lambda s: s.map(lambda x: str(len(json.loads(x)[0]["content"])))
    M.score_through(calls.where("dialogue_id % 2 = 0"), name, reply)
    out = M.score_through(calls, name, reply).select("dialogue_id", "utt_idx", "hit", "reply")
    spark.sql(f"DROP TABLE {name}")
    return out


@query("x4_analyse", "turns", "SELECT dialogue_id, utt_idx, CASE WHEN act_domain IS NOT NULL THEN act_domain || '!' END AS report, CASE WHEN act_domain IS NULL THEN 'ValueError: no domain' END AS error FROM turns")
def x4(spark, d):
    def fn(row):
        if not isinstance(row["act_domain"], str):
            raise ValueError("no domain")
        return row["act_domain"] + "!"

    t = fx(spark, d, "turns").select(F.concat_ws(":", "dialogue_id", "utt_idx").alias("id"), "act_domain")
    out = M.analyse(t, fn, "id")
    part = lambda i: F.split_part("id", F.lit(":"), F.lit(i)).cast("long")
    return out.select(part(1).alias("dialogue_id"), part(2).alias("utt_idx"), "report", "error")
