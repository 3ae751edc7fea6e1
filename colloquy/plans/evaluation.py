"""Queries: dialogue evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import slots as S
from .fixtures import dialogues
from .fixtures import fixture as fx
from .registry import query

# The value normalisation in SQL, for ASCII text.
NORM = "regexp_replace(trim(regexp_replace(trim(lower({0}), ' ' || chr(9) || chr(10) || chr(13)), '[.,;:!?]+$', ''), ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')"
HIT = f"list_contains(list_transform(string_split(gt_value, '|'), lambda a: {NORM.format('a')}), {NORM.format('pred_value')})"
SCORED = f"""scored AS (SELECT dialogue_id, domain, kind, slot, coalesce(CASE kind WHEN 'inform' THEN {HIT} WHEN 'request' THEN pred_requested ELSE booking_ref <> '' END, false) AS correct FROM slots),
per AS (SELECT o.dialogue_id, coalesce(ic, 0) AS ic, coalesce(it, 0) AS it, coalesce(rc, 0) AS rc, coalesce(rt, 0) AS rt, coalesce(bc, 0) AS bc, coalesce(bt, 0) AS bt
 FROM (SELECT DISTINCT o_orderkey AS dialogue_id FROM orders) o LEFT JOIN (SELECT dialogue_id, count(*) FILTER (kind = 'inform' AND correct) AS ic, count(*) FILTER (kind = 'inform') AS it, count(*) FILTER (kind = 'request' AND correct) AS rc,
 count(*) FILTER (kind = 'request') AS rt, count(DISTINCT CASE WHEN kind = 'booking' AND correct THEN domain END) AS bc, count(DISTINCT CASE WHEN kind = 'booking' THEN domain END) AS bt FROM scored GROUP BY dialogue_id) s ON o.dialogue_id = s.dialogue_id),
met AS (SELECT dialogue_id, CASE WHEN it + rt = 0 THEN 1.0::DOUBLE ELSE (ic + rc)::DOUBLE / (it + rt) END AS info_rate, ic = it AND rc = rt AND bc = bt AS success,
 ic AS inform_correct, it AS inform_total, rc AS request_correct, rt AS request_total, CASE WHEN ic < it OR rc < rt OR bt = 0 THEN NULL ELSE bc = bt END AS booking_passed FROM per)"""
SUMMARY = """count(*) AS n_dialogues, coalesce(sum(inform_correct + request_correct), 0)::DOUBLE / greatest(coalesce(sum(inform_total + request_total), 0), 1) AS micro_rate, coalesce(avg(info_rate), 0.0) AS macro_rate,
 coalesce(avg(CAST(success AS INT)), 0.0) AS success_rate, count(*) FILTER (success) AS n_success, CAST(coalesce(sum(inform_correct + request_correct), 0) AS BIGINT) AS n_correct, CAST(coalesce(sum(inform_total + request_total), 0) AS BIGINT) AS n_total"""


def _ids(spark, d):
    return fx(spark, d, "orders").select(F.col("o_orderkey").alias("dialogue_id")).distinct()


def _metrics(spark, d):
    return S.per_dialogue(_ids(spark, d), S.scored(dialogues(spark, d)))


@query("p1_inform_slots", "slots", "SELECT dialogue_id, domain, slot, gt_value AS value FROM slots WHERE kind = 'inform'")
def p1(spark, d):
    return S.inform_slots(dialogues(spark, d))


@query("p2_booking_domains", "slots", "SELECT DISTINCT dialogue_id, domain FROM slots WHERE slot LIKE 'book %'")
def p2(spark, d):
    return S.booking_domains(dialogues(spark, d))


@query("p3_request_slots", "slots", "SELECT dialogue_id, domain, slot FROM slots WHERE kind = 'request'")
def p3(spark, d):
    return S.request_slots(dialogues(spark, d))


@query(
    "j1_align_predictions",
    "predictions",
    """SELECT o.dialogue_id, coalesce(p.response_text, '') AS response_text, p.dialogue_id IS NULL AS missing FROM (SELECT DISTINCT o_orderkey AS dialogue_id FROM orders) o
LEFT JOIN (SELECT dialogue_id, response_text, row_number() OVER (PARTITION BY dialogue_id ORDER BY ord DESC) AS rn FROM predictions) p ON o.dialogue_id = p.dialogue_id AND rn = 1""",
)
def j1(spark, d):
    return S.align(_ids(spark, d), fx(spark, d, "predictions"), {"response_text": ""})


@query("j2_inform_hits", "slots", f"SELECT dialogue_id, domain, slot, gt_value AS value, pred_value AS pred, coalesce({HIT}, false) AS correct FROM slots WHERE kind = 'inform'")
def j2(spark, d):
    s = fx(spark, d, "slots")
    goal = s.where("kind = 'inform'").select("dialogue_id", "domain", "slot", F.col("gt_value").alias("value"))
    return S.inform_hits(goal, s.where("pred_value is not null").withColumnRenamed("pred_value", "pred"))


@query("j3_request_hits", "slots", "SELECT dialogue_id, domain, slot, coalesce(pred_requested, false) AS correct FROM slots WHERE kind = 'request'")
def j3(spark, d):
    s = fx(spark, d, "slots")
    return S.request_hits(s.where("kind = 'request'").select("dialogue_id", "domain", "slot"), s.where("pred_requested"))


@query("j4_booking_hits", "slots", "SELECT DISTINCT dialogue_id, domain, booking_ref <> '' AS correct FROM slots WHERE kind = 'booking'")
def j4(spark, d):
    s = fx(spark, d, "slots").where("kind = 'booking'")
    return S.booking_hits(s.select("dialogue_id", "domain"), s.withColumnRenamed("booking_ref", "reference"))


@query("a2_information_rate", "slots", "SELECT dialogue_id, info_rate, inform_correct + request_correct AS n_correct, inform_total + request_total AS n_total FROM met", SCORED)
def a2(spark, d):
    return _metrics(spark, d).select("dialogue_id", "info_rate", (F.col("inform_correct") + F.col("request_correct")).alias("n_correct"), (F.col("inform_total") + F.col("request_total")).alias("n_total"))


@query("a3_success", "slots", "SELECT dialogue_id, success, booking_passed FROM met", SCORED)
def a3(spark, d):
    return _metrics(spark, d).select("dialogue_id", "success", "booking_passed")


@query(
    "a4_dialogue_metrics",
    "slots",
    "SELECT met.*, coalesce(ds, '') AS domains FROM met LEFT JOIN (SELECT dialogue_id, string_agg(DISTINCT domain, ',' ORDER BY domain) AS ds FROM slots GROUP BY dialogue_id) x ON met.dialogue_id = x.dialogue_id",
    SCORED,
)
def a4(spark, d):
    x = dialogues(spark, d)
    return S.with_domains(_metrics(spark, d), x).withColumn("domains", F.array_join("domains_evaluated", ",")).drop("domains_evaluated")


@query("a5_corpus_metrics", "slots", f"SELECT {SUMMARY} FROM met", SCORED)
def a5(spark, d):
    return S.corpus(_metrics(spark, d))


@query(
    "a6_domain_metrics",
    "slots",
    f"SELECT domain, {SUMMARY} FROM dm GROUP BY domain",
    SCORED
    + """, dp AS (SELECT dialogue_id, domain, count(*) FILTER (kind = 'inform' AND correct) AS inform_correct, count(*) FILTER (kind = 'inform') AS inform_total, count(*) FILTER (kind = 'request' AND correct) AS request_correct, count(*) FILTER (kind = 'request') AS request_total,
 bool_and(correct) FILTER (kind = 'booking') AS b FROM scored GROUP BY dialogue_id, domain),
dm AS (SELECT *, CASE WHEN inform_total + request_total = 0 THEN 1.0::DOUBLE ELSE (inform_correct + request_correct)::DOUBLE / (inform_total + request_total) END AS info_rate,
 inform_correct = inform_total AND request_correct = request_total AND coalesce(b, true) AS success FROM dp)""",
)
def a6(spark, d):
    x = dialogues(spark, d)
    return S.per_domain(x, S.scored(x))


@query("a7_prediction_volume", "slots", "SELECT CAST(count(*) FILTER (pred_value IS NOT NULL) AS BIGINT) AS n_inform, CAST(count(*) FILTER (pred_requested) AS BIGINT) AS n_request, count(DISTINCT dialogue_id) FILTER (kind = 'booking') AS n_booking FROM slots")
def a7(spark, d):
    return S.prediction_volume(dialogues(spark, d)).withColumns({"n_inform": F.col("n_inform").cast("long"), "n_request": F.col("n_request").cast("long")})


@query("a1_split_counts", "", "SELECT CASE o_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS data_split, count(*) AS n FROM orders GROUP BY ALL")
def a1(spark, d):
    rows = fx(spark, d, "orders").withColumn("data_split", F.expr("CASE o_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"))
    return rows.groupBy("data_split").agg(F.count("*").alias("n"))


@query("m1_norm_value", "slots", f"SELECT dialogue_id, slot, {NORM.format('pred_value')} AS norm FROM slots WHERE pred_value IS NOT NULL")
def m1(spark, d):
    return fx(spark, d, "slots").where("pred_value is not null").select("dialogue_id", "slot", T.norm_value("pred_value").alias("norm"))


@query("m2_value_matches", "slots", f"SELECT domain, slot, count(*) AS n, count(*) FILTER (coalesce({HIT}, false)) AS n_match FROM slots WHERE kind = 'inform' GROUP BY ALL")
def m2(spark, d):
    s = fx(spark, d, "slots").where("kind = 'inform'")
    return s.groupBy("domain", "slot").agg(F.count("*").alias("n"), F.count_if(T.value_matches("pred_value", "gt_value")).alias("n_match"))


@query(
    "p11_failure_cases",
    "slots turns",
    """SELECT m.dialogue_id, info_rate, coalesce(gd, '') AS goal_domains, coalesce(pd, '') AS predicted_domains, coalesce(t, '') AS trajectory FROM met m
LEFT JOIN (SELECT dialogue_id, string_agg(DISTINCT domain, ',' ORDER BY domain) FILTER (kind <> 'request') AS gd, string_agg(DISTINCT domain, ',' ORDER BY domain) FILTER (pred_value IS NOT NULL) AS pd FROM slots GROUP BY dialogue_id) s ON m.dialogue_id = s.dialogue_id
LEFT JOIN (SELECT dialogue_id, string_agg(speaker, ' ' ORDER BY utt_idx) AS t FROM turns GROUP BY dialogue_id) l ON m.dialogue_id = l.dialogue_id WHERE NOT success""",
    SCORED,
)
def p11(spark, d):
    logs = fx(spark, d, "turns").groupBy("dialogue_id").agg(F.array_sort(F.collect_list(F.struct("utt_idx", "speaker"))).alias("x")).select("dialogue_id", F.array_join("x.speaker", " ").alias("trajectory"))
    out = S.failure_cases(dialogues(spark, d), _metrics(spark, d), logs)
    return out.withColumns({c: F.array_join(c, ",") for c in ("goal_domains", "predicted_domains")})
