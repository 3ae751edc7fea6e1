"""Dialogue evaluation: goal slots against predictions, at the grain of one slot.

All scores come from one long table, a row for each slot that counts, with
``correct``.  One shuffle on dialogue_id serves the per-dialogue scores; the per-domain
ones add the domain to the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_value, value_matches


def inform_slots(dialogues: DataFrame) -> DataFrame:
    """(dialogue_id, domain, slot, value) of the goal's inform slots that are no booking slots."""
    rows = dialogues.select("dialogue_id", F.explode("goal.inform").alias("domain", "s")).select("dialogue_id", "domain", F.explode("s").alias("slot", "value"))
    return rows.where(~F.col("slot").startswith("book "))


def booking_domains(dialogues: DataFrame) -> DataFrame:
    """(dialogue_id, domain) with a booking slot in the goal."""
    rows = dialogues.select("dialogue_id", F.explode("goal.inform").alias("domain", "s"))
    return rows.where(F.exists(F.map_keys("s"), lambda k: k.startswith("book "))).select("dialogue_id", "domain")


def request_slots(dialogues: DataFrame) -> DataFrame:
    """(dialogue_id, domain, slot) of requests; a domain without slots and blank slots are left out."""
    rows = dialogues.select("dialogue_id", F.explode("goal.request").alias("domain", "s")).select("dialogue_id", "domain", F.explode("s").alias("slot", "v"))
    return rows.where("slot <> ''").select("dialogue_id", "domain", "slot")


def align(dialogues: DataFrame, predictions: DataFrame, empty: dict, order: str = "ord") -> DataFrame:
    """Every dialogue with its prediction: of several the last by ``order``; without one the values of
    ``empty`` and ``missing`` true.  Predictions of unknown dialogues go."""
    last = Window.partitionBy("dialogue_id").orderBy(F.desc(order))
    best = predictions.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn").withColumn("__hit", F.lit(True))
    out = dialogues.join(best, "dialogue_id", "left")
    filled = {k: F.coalesce(F.col(k), F.lit(v) if not hasattr(v, "cast") else v) for k, v in empty.items()}
    return out.withColumns(filled).withColumn("missing", F.col("__hit").isNull()).drop("__hit", order)


def inform_hits(goal: DataFrame, predicted: DataFrame) -> DataFrame:
    """goal(dialogue_id, domain, slot, value) with ``correct``: predicted(.., pred) agrees with an alternative."""
    keys = ["dialogue_id", "domain", "slot"]
    return goal.join(predicted.select(*keys, "pred"), keys, "left").withColumn("correct", value_matches("pred", "value"))


def request_hits(goal: DataFrame, predicted: DataFrame) -> DataFrame:
    """goal(dialogue_id, domain, slot) with ``correct``: the normalised slot was predicted for the domain."""
    had = predicted.select("dialogue_id", "domain", norm_value("slot").alias("norm")).distinct().withColumn("hit", F.lit(True))
    rows = goal.withColumn("norm", norm_value("slot")).join(had, ["dialogue_id", "domain", "norm"], "left")
    return rows.withColumn("correct", F.col("hit").isNotNull()).drop("norm", "hit")


def booking_hits(needed: DataFrame, references: DataFrame) -> DataFrame:
    """needed(dialogue_id, domain) with ``correct``: there is a reference that is not blank."""
    rows = needed.join(references.select("dialogue_id", "domain", "reference"), ["dialogue_id", "domain"], "left")
    return rows.withColumn("correct", F.coalesce(F.col("reference") != "", F.lit(False))).drop("reference")


def scored(dialogues: DataFrame) -> DataFrame:
    """(dialogue_id, domain, kind, slot, correct) of nested dialogues(dialogue_id, goal, prediction).

    Goal and prediction of a dialogue are in one row, so nothing is joined or shuffled, and all kinds come from one pass."""
    have = lambda m, k: F.try_element_at(m, k)
    entries = lambda m, kind: F.map_entries(F.coalesce(m, F.create_map().cast(kind)))
    part = lambda kind: F.transform(entries(F.col(f"goal.{kind}"), "map<string,map<string,string>>"), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("domain"), e["value"].alias("s")))
    d = dialogues.select("dialogue_id", "prediction", F.inline(F.concat(part("inform"), part("request"))))
    ref = have(have(F.col("prediction.booking"), F.col("domain")), F.lit("reference"))
    d = d.select("dialogue_id", "kind", "domain", "s", have(F.col("prediction.inform_slots"), F.col("domain")).alias("given"), have(F.col("prediction.request_slots"), F.col("domain")).alias("asked"), ref.alias("ref"))
    inform = F.col("kind") == "inform"
    row = lambda kind, slot, value: F.struct(kind.alias("kind"), slot.cast("string").alias("slot"), value.cast("string").alias("value"))
    each = F.transform(entries(F.col("s"), "map<string,string>"), lambda e: row(F.col("kind"), e["key"], e["value"]))
    each = F.filter(each, lambda x: F.when(x["kind"] == "inform", ~x["slot"].startswith("book ")).otherwise(x["slot"] != ""))
    books = inform & F.exists(F.map_keys("s"), lambda k: k.startswith("book "))
    each = F.concat(each, F.when(books, F.array(row(F.lit("booking"), F.lit(None), F.lit(None)))).otherwise(F.array().cast("array<struct<kind:string,slot:string,value:string>>")))
    d = d.select("dialogue_id", "domain", "given", "asked", "ref", F.inline(each))
    had = F.transform(F.coalesce("asked", F.array().cast("array<string>")), norm_value)
    correct = F.when(F.col("kind") == "inform", value_matches(have(F.col("given"), F.col("slot")), "value")).when(F.col("kind") == "request", F.array_contains(had, norm_value("slot"))).otherwise(F.coalesce(F.col("ref") != "", F.lit(False)))
    return d.select("dialogue_id", "domain", "kind", "slot", correct.alias("correct"))


def _counts() -> list:
    n = lambda k, ok: F.count_if((F.col("kind") == k) & (F.col("correct") if ok else F.lit(True)))
    return [n(k, ok).alias(f"{k}_{'correct' if ok else 'total'}") for k in ("inform", "request", "booking") for ok in (True, False)]


def _judged(df: DataFrame) -> DataFrame:
    """info_rate, success and the three-valued booking_passed from the counts of a group."""
    c = {x: F.coalesce(F.col(x), F.lit(0)) for x in ("inform_correct", "inform_total", "request_correct", "request_total", "booking_correct", "booking_total")}
    total, right = c["inform_total"] + c["request_total"], c["inform_correct"] + c["request_correct"]
    slots_ok, books_ok = right == total, c["booking_correct"] == c["booking_total"]
    rate = F.when(total == 0, 1.0).otherwise(right / total)
    passed = F.when(~slots_ok | (c["booking_total"] == 0), F.lit(None).cast("boolean")).otherwise(books_ok)
    return df.withColumns({**c, "info_rate": rate, "success": slots_ok & books_ok, "booking_passed": passed})


METRICS = ["dialogue_id", "info_rate", "success", "inform_correct", "inform_total", "request_correct", "request_total", "booking_passed"]


def per_dialogue(ids: DataFrame, slots: DataFrame) -> DataFrame:
    """A row of metrics for every id, also those without slots (rate 1, success)."""
    return _judged(ids.join(slots.groupBy("dialogue_id").agg(*_counts()), "dialogue_id", "left")).select(*METRICS)


def with_domains(metrics: DataFrame, dialogues: DataFrame) -> DataFrame:
    """metrics with ``domains_evaluated``, the sorted domains of either part of the goal."""
    d = dialogues.select("dialogue_id", F.array_sort(F.array_union(F.map_keys("goal.inform"), F.map_keys("goal.request"))).alias("domains_evaluated"))
    return metrics.join(d, "dialogue_id")


def _summary() -> list:
    right, total = F.sum(F.col("inform_correct") + F.col("request_correct")), F.sum(F.col("inform_total") + F.col("request_total"))
    return [
        F.count("*").alias("n_dialogues"),
        (F.coalesce(right, F.lit(0)) / F.greatest(F.coalesce(total, F.lit(0)), F.lit(1))).alias("micro_rate"),
        F.coalesce(F.avg("info_rate"), F.lit(0.0)).alias("macro_rate"),
        F.coalesce(F.avg(F.col("success").cast("int")), F.lit(0.0)).alias("success_rate"),
        F.count_if("success").alias("n_success"),
        F.coalesce(right, F.lit(0)).alias("n_correct"),
        F.coalesce(total, F.lit(0)).alias("n_total"),
    ]


def corpus(metrics: DataFrame) -> DataFrame:
    """One row: micro and macro rate, success rate and counts.  Without slots the micro rate is 0."""
    return metrics.agg(*_summary())


def per_domain(dialogues: DataFrame, slots: DataFrame) -> DataFrame:
    """The corpus row for each domain, every dialogue scored on that domain's part of its goal only;
    a domain counts for a dialogue by being in its goal, even without slots."""
    keys = dialogues.select("dialogue_id", F.explode(F.array_union(F.map_keys("goal.inform"), F.map_keys("goal.request"))).alias("domain"))
    rows = _judged(keys.join(slots.groupBy("dialogue_id", "domain").agg(*_counts()), ["dialogue_id", "domain"], "left"))
    return rows.groupBy("domain").agg(*_summary())


def prediction_volume(dialogues: DataFrame) -> DataFrame:
    """One row: predicted inform slots, request slots, and dialogues with a booking."""
    n = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda t, x: t + F.size(x))
    p = "prediction."
    return dialogues.agg(F.sum(n(p + "inform_slots")).alias("n_inform"), F.sum(n(p + "request_slots")).alias("n_request"), F.count_if(F.size(p + "booking") > 0).alias("n_booking"))


def failure_cases(dialogues: DataFrame, metrics: DataFrame, logs: DataFrame) -> DataFrame:
    """Failed dialogues with goal domains, the slots that were given, and the log text ('' for none)."""
    bad = metrics.where("not success").select("dialogue_id", "info_rate")
    goal = dialogues.select("dialogue_id", F.array_sort(F.map_keys("goal.inform")).alias("goal_domains"), F.array_sort(F.map_keys(F.map_filter("prediction.inform_slots", lambda k, v: F.size(v) > 0))).alias("predicted_domains"))
    return bad.join(goal, "dialogue_id").join(logs.select("dialogue_id", "trajectory"), "dialogue_id", "left").withColumn("trajectory", F.coalesce("trajectory", F.lit("")))
