"""Queries: corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from .fixtures import fixture as fx
from .registry import query

ONTOLOGY = {"hotel": ["book people", "book day", "ref", "price range"], "restaurant": ["book people", "book day", "ref", "price range", "book time"], "train": ["book people", "ref", "day", "duration"], "taxi": ["type", "phone"]}
_SPLIT = "CASE dialogue_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"


def _turns(spark, d):
    return fx(spark, d, "turns")


@query("w1_dialogue_number", "", "SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS INTEGER) AS dialogue_no FROM orders")
def w1(spark, d):
    return C.number_dialogues(fx(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query("w2_turn_context", "turns", "SELECT * FROM (SELECT dialogue_id, utt_idx, speaker, lag(act_domain) OVER w AS prev_user_domain, lead(act_domain) OVER w AS next_user_domain FROM turns WINDOW w AS (PARTITION BY dialogue_id ORDER BY utt_idx)) WHERE speaker = 'system'")
def w2(spark, d):
    return C.turn_context(_turns(spark, d)).select("dialogue_id", "utt_idx", "speaker", "prev_user_domain", "next_user_domain")


_CARRY = "SELECT dialogue_id, utt_idx, speaker, last_value(act_domain IGNORE NULLS) OVER (PARTITION BY dialogue_id, speaker ORDER BY utt_idx ROWS UNBOUNDED PRECEDING) AS current_domain FROM turns"


@query("w3_carried_domain", "turns", _CARRY)
def w3(spark, d):
    return C.carried_domain(_turns(spark, d)).select("dialogue_id", "utt_idx", "speaker", "current_domain")


def _booked(spark, d):
    return _turns(spark, d).where("booked and act_domain is not null").select("dialogue_id", "utt_idx", F.col("act_domain").alias("domain"), F.lit(0).alias("key_ord"), "speaker")


_SECOND = "CASE {} WHEN 'hotel' THEN 'train' WHEN 'restaurant' THEN 'hotel' ELSE 'restaurant' END"


@query(
    "w4_newly_booked",
    "turns",
    "SELECT dialogue_id, m // 2 AS utt_idx, arg_max(domain, m % 2) AS booked_domain FROM (SELECT dialogue_id, domain, min(utt_idx * 2 + key_ord) AS m FROM b GROUP BY dialogue_id, domain) GROUP BY dialogue_id, m // 2",
    f"b AS (SELECT dialogue_id, utt_idx, act_domain AS domain, 0 AS key_ord FROM turns WHERE booked AND act_domain IS NOT NULL UNION ALL SELECT dialogue_id, utt_idx, {_SECOND.format('act_domain')}, 1 FROM turns WHERE booked AND act_domain IS NOT NULL AND dialogue_id % 2 = 0)",
)
def w4(spark, d):
    one = _booked(spark, d)
    two = one.where("dialogue_id % 2 = 0").withColumns({"domain": F.expr(_SECOND.format("domain")), "key_ord": F.lit(1)})
    return C.newly_booked(one.unionByName(two))


@query("w5_blank_first", "turns", "SELECT dialogue_id, utt_idx, act_domain AS domain, CASE WHEN utt_idx = min(utt_idx) OVER (PARTITION BY dialogue_id, act_domain) THEN '' ELSE speaker END AS payload FROM turns WHERE booked AND act_domain IS NOT NULL")
def w5(spark, d):
    return C.blank_first(_booked(spark, d).withColumnRenamed("speaker", "payload"), "payload").drop("key_ord")


@query("w6_state_of_next", "turns", "SELECT * FROM (SELECT dialogue_id, utt_idx, speaker, lead(act_domain) OVER (PARTITION BY dialogue_id ORDER BY utt_idx) AS act_domain FROM turns) WHERE speaker = 'user'")
def w6(spark, d):
    return C.state_of_next(_turns(spark, d).select("dialogue_id", "utt_idx", "speaker", "act_domain"), "act_domain")


@query("w7_speaker_parity", "turns", "SELECT dialogue_id, utt_idx, CASE WHEN utt_idx % 2 = 0 THEN 'user' ELSE 'system' END AS by_parity FROM turns")
def w7(spark, d):
    return _turns(spark, d).select("dialogue_id", "utt_idx", C.speaker_of("utt_idx").alias("by_parity"))


@query(
    "a17_corpus_statistics",
    "turns slots",
    """SELECT b.*, categorical_match, span_coverage FROM (SELECT coalesce(data_split, 'all') AS data_split, count(*) AS n_dialogues, CAST(sum(n) AS BIGINT) AS n_utterances, avg(n) AS avg_turns, sum(words)::DOUBLE / sum(n) AS avg_words, avg(domains) AS avg_domains
FROM (SELECT data_split, dialogue_id, count(*) AS n, sum(len(regexp_extract_all(utterance, '\\S+'))) AS words, count(DISTINCT act_domain) AS domains FROM t GROUP BY ALL) GROUP BY ROLLUP (data_split)) b
LEFT JOIN (SELECT coalesce(data_split, 'all') AS data_split, 100 * avg(CASE WHEN domain = 'hotel' THEN CAST(gt_value LIKE '%|alt 3' OR gt_value LIKE '%|alt 4' AS INT)::DOUBLE END) AS categorical_match, 100 * avg(CASE WHEN domain <> 'hotel' THEN CAST(pred_value IS NOT NULL AS INT)::DOUBLE END) AS span_coverage FROM v GROUP BY ROLLUP (data_split)) s ON b.data_split = s.data_split""",
    f"t AS (SELECT {_SPLIT} AS data_split, * FROM turns), v AS (SELECT {_SPLIT} AS data_split, * FROM slots WHERE kind = 'inform')",
)
def a17(spark, d):
    s = fx(spark, d, "slots").where("kind = 'inform'")
    acts = s.select(F.expr(_SPLIT).alias("data_split"), F.when(F.col("domain") == "hotel", "categorical").otherwise("non-categorical").alias("act_type"), "domain", "slot", F.col("gt_value").alias("value"), F.when(F.col("pred_value").isNotNull(), F.lit(0)).alias("start"))
    known = [f"Value {a}|alt {b}" for a in range(10) for b in (3, 4)]
    ontology = spark.createDataFrame([("hotel", "slot 3", known)], "domain string, slot string, possible_values array<string>")
    return C.corpus_statistics(_turns(spark, d).withColumn("data_split", F.expr(_SPLIT)), acts, ontology)


@query("a18_act_inventory", "slots", "SELECT kind AS act_type, kind AS intent, domain, slot, bool_or(dialogue_id % 2 = 0) AS by_user, bool_or(dialogue_id % 2 = 1) AS by_system FROM slots GROUP BY ALL")
def a18(spark, d):
    rows = fx(spark, d, "slots").select(F.col("kind").alias("act_type"), F.col("kind").alias("intent"), "domain", "slot", F.when(F.col("dialogue_id") % 2 == 0, "user").otherwise("system").alias("speaker"))
    return C.act_inventory(rows)


@query(
    "a19_goals",
    "",
    """SELECT o_custkey AS dialogue_id, 'hotel' AS domain, slot, string_agg(o_orderstatus || o_orderkey, '|' ORDER BY CASE section WHEN 'fail_info' THEN 1 WHEN 'info' THEN 2 WHEN 'fail_book' THEN 3 ELSE 4 END, o_orderkey) AS value
FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'book' WHEN 1 THEN 'info' WHEN 2 THEN 'fail_info' ELSE 'fail_book' END AS section, CASE o_orderkey % 3 WHEN 0 THEN 'area' WHEN 1 THEN 'invalid area' ELSE 'stars' END AS slot FROM orders) WHERE slot NOT LIKE '%invalid%' GROUP BY o_custkey, slot""",
)
def a19(spark, d):
    rows = fx(spark, d, "orders").selectExpr(
        "o_custkey AS dialogue_id", "'hotel' AS domain", "o_orderkey AS ord", "o_orderstatus || o_orderkey AS value",
        "CASE o_orderkey % 4 WHEN 0 THEN 'book' WHEN 1 THEN 'info' WHEN 2 THEN 'fail_info' ELSE 'fail_book' END AS section",
        "CASE o_orderkey % 3 WHEN 0 THEN 'area' WHEN 1 THEN 'invalid area' ELSE 'stars' END AS slot",
    )
    return C.build_goals(rows)


@query("m4_grammar", "turns", "SELECT dialogue_id, utt_idx, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, ' Im ', ' I''m ', 'g'), ' im ', ' i''m ', 'g'), '^Im ', 'I''m '), '^im ', 'i''m '), 'theres', 'there''s', 'g'), 'dont', 'don''t', 'g'), 'whats', 'what''s', 'g'), 'thats', 'that''s', 'g') AS fixed FROM (SELECT *, 'im ' || replace(utterance, ' the ', ' dont ') AS u FROM turns)")
def m4(spark, d):
    return _turns(spark, d).select("dialogue_id", "utt_idx", T.fix_grammar(F.concat(F.lit("im "), F.replace("utterance", F.lit(" the "), F.lit(" dont ")))).alias("fixed"))


@query("m5_strip_spans", "turns", "SELECT dialogue_id, utt_idx, utterance AS plain FROM turns")
def m5(spark, d):
    return _turns(spark, d).select("dialogue_id", "utt_idx", T.strip_spans(F.concat(F.lit("<span class='a'>"), "utterance", F.lit("</span>"))).alias("plain"))


@query("m6_dialogue_text", "turns", "SELECT dialogue_id, string_agg('[' || speaker || '] ' || utterance, chr(10) ORDER BY utt_idx) AS text FROM turns GROUP BY dialogue_id")
def m6(spark, d):
    return C.dialogue_text(_turns(spark, d))


_ACTS = """acts AS (SELECT dialogue_id, utt_idx, CASE WHEN (dialogue_id + utt_idx) % 2 = 0 THEN 'Booking' WHEN utt_idx % 5 = 1 THEN 'Taxi' WHEN act_domain = 'train' THEN 'Train' ELSE 'Hotel' END AS domain,
 CASE (dialogue_id + utt_idx) % 5 WHEN 0 THEN 'Book' WHEN 1 THEN 'Inform' WHEN 2 THEN 'NoBook' WHEN 3 THEN 'Request' ELSE 'OfferBooked' END AS intent, CASE utt_idx % 4 WHEN 0 THEN 'Ref' WHEN 1 THEN 'Car' WHEN 2 THEN 'People' ELSE 'Time' END AS slot,
 CAST(dialogue_id AS STRING) AS value, act_domain, booked, lag(act_domain) OVER (PARTITION BY dialogue_id ORDER BY utt_idx) AS prev FROM turns)"""


def _acts(spark, d):
    t = _turns(spark, d)
    body = _ACTS[len("acts AS (") : -1].replace("FROM turns", "FROM {t}")
    return spark.sql(body, t=t)


@query("m3_normalise_acts", "turns", "SELECT lower(domain) AS domain, s AS slot, count(*) AS n FROM (SELECT domain, CASE slot WHEN 'Ref' THEN 'ref' WHEN 'Car' THEN 'type' WHEN 'People' THEN 'book people' ELSE CASE lower(domain) WHEN 'train' THEN 'duration' END END AS s FROM acts WHERE domain <> 'Booking') WHERE (lower(domain), s) IN (('hotel','book people'),('hotel','ref'),('train','book people'),('train','ref'),('train','duration'),('taxi','type')) GROUP BY ALL", _ACTS)
def m3(spark, d):
    good, _ = C.normalise_acts(_acts(spark, d).where("domain <> 'Booking'").select("domain", "slot", "value"), ONTOLOGY)
    return good.groupBy("domain", "slot").agg(F.count("*").alias("n"))


@query("m25_find_span", "turns", "SELECT dialogue_id, utt_idx, instr(lower(utterance), lower(substr(utterance, 5, 6))) - 1 AS start, instr(lower(utterance), lower(substr(utterance, 5, 6))) - 1 + length(substr(utterance, 5, 6)) AS \"end\", 'exact' AS category FROM turns WHERE length(utterance) >= 5")
def m25(spark, d):
    rows = _turns(spark, d).where("length(utterance) >= 5")
    s = C.find_span(F.substring("utterance", 5, 6), F.col("utterance"))
    return rows.select("dialogue_id", "utt_idx", s.alias("s")).select("dialogue_id", "utt_idx", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.category")


#: Value, first and last word, place and category, for texts that start with the words below: each rule once.
_ALIGNED = [("AT", 0, 0, 0, 2, "exact"), ("2", 2, 2, 8, 11, "number word"), ("email", 3, 4, 12, 18, "blanks"), ("mai", 4, 4, 14, 17, "inside"), ("05:30", 1, 1, 3, 7, "leading zero"), ("two", 1, 1, 8, 11, "window 1"), ("two", 0, 0, 8, 11, "window 2"), ("no such text", 1, 2, -1, -1, "none"), ("at", 2, 1, -1, -1, "none")]
_CASES = " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(len(_ALIGNED)))


def _case(k: int) -> str:
    return "CASE (dialogue_id + utt_idx) % 10 " + _CASES.format(*[f"'{a[k]}'" if isinstance(a[k], str) else a[k] for a in _ALIGNED])


_HEAD = "'at 5:30 two e mail '"


@query("m25_align_spans", "turns", f"SELECT dialogue_id, utt_idx, CAST({_case(3)} ELSE length(u) - 3 END AS INTEGER) AS start, CAST({_case(4)} ELSE length(u) END AS INTEGER) AS \"end\", {_case(5)} ELSE 'exact' END AS category FROM (SELECT *, {_HEAD} || utterance || ' end' AS u FROM turns)")
def m25b(spark, d):
    """The tenth case asks for words beyond the text, which are moved back to its last word."""
    rows = _turns(spark, d).selectExpr("dialogue_id", "utt_idx", f"{_HEAD} || utterance || ' end' AS utterance", f"{_case(0)} ELSE 'END' END AS value", f"{_case(1)} ELSE 100000 END AS start_word", f"{_case(2)} ELSE 100000 END AS end_word")
    return C.align_spans(rows).select("dialogue_id", "utt_idx", "start", "end", "category")


@query("m26_act_class", "slots", "SELECT dialogue_id, slot, CASE WHEN kind = 'request' OR gt_value IS NULL THEN 'binary' WHEN domain = 'hotel' THEN 'categorical' ELSE 'non-categorical' END AS act_type FROM slots")
def m26(spark, d):
    return fx(spark, d, "slots").select("dialogue_id", "slot", C.act_class("kind", F.col("slot"), F.col("gt_value"), F.col("domain") == "hotel").alias("act_type"))


@query(
    "m27_remap_booking",
    "turns",
    """SELECT dialogue_id, utt_idx, about AS domain, 'Book' AS intent, 'none' AS slot, 'none' AS value FROM a WHERE domain = 'Booking' AND intent = 'Book' AND slot = 'Ref' AND about IS NOT NULL
UNION ALL SELECT dialogue_id, utt_idx, about, CASE intent WHEN 'Book' THEN 'Inform' WHEN 'Inform' THEN 'OfferBook' ELSE intent END, slot, value FROM a WHERE domain = 'Booking' AND intent <> 'OfferBooked' AND about IS NOT NULL AND fits
UNION ALL SELECT dialogue_id, utt_idx, domain, intent, slot, value FROM a WHERE domain = 'Booking' AND intent = 'OfferBooked'
UNION ALL SELECT dialogue_id, utt_idx, domain, 'Book', 'none', 'none' FROM a WHERE domain || intent || slot IN ('TaxiInformCar', 'TrainInformRef', 'TrainOfferBookedRef')
UNION ALL SELECT dialogue_id, utt_idx, domain, CASE WHEN domain = 'Train' AND intent = 'OfferBooked' THEN 'Inform' ELSE intent END, slot, value FROM a WHERE domain <> 'Booking'""",
    _ACTS
    + """, a AS (SELECT *, CASE about WHEN 'Hotel' THEN slot IN ('Ref', 'People') WHEN 'Restaurant' THEN slot IN ('Ref', 'People', 'Time') WHEN 'Train' THEN slot IN ('Ref', 'People', 'Time') END AS fits
 FROM (SELECT *, CASE CASE WHEN prev IS NOT NULL AND (dialogue_id + utt_idx) % 7 <> 0 THEN prev WHEN booked AND act_domain IS NOT NULL THEN act_domain WHEN utt_idx % 3 = 1 THEN 'hotel' WHEN dialogue_id % 3 = 0 THEN 'restaurant'
 WHEN dialogue_id % 3 = 1 THEN 'train' WHEN utt_idx % 2 = 0 THEN 'hotel' ELSE prev END WHEN 'hotel' THEN 'Hotel' WHEN 'restaurant' THEN 'Restaurant' WHEN 'train' THEN 'Train' END AS about FROM acts))""",
)
def m27(spark, d):
    """Every source of the domain decides somewhere; two domains at once decide nothing but as the last resort."""
    named = lambda cond, *names: F.when(F.expr(cond), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    prev = F.initcap("prev")
    current = F.when(F.col("prev").isNull(), F.array().cast("array<string>")).when(F.expr("(dialogue_id + utt_idx) % 7 = 0"), F.array(prev, F.lit("Police"))).otherwise(F.array(prev))
    context = {
        "current_user": current,
        "booked_domain": F.when(F.col("booked"), F.initcap("act_domain")),
        "keyword_user": F.when(F.expr("utt_idx % 3 = 2"), F.array(F.lit("Hotel"), F.lit("Train"))).otherwise(named("utt_idx % 3 = 1", "Hotel")),
        "keyword_system": named("dialogue_id % 3 = 0", "Restaurant"),
        "current_system": named("dialogue_id % 3 = 1", "Train"),
        "next_user": named("dialogue_id % 3 = 2 and utt_idx % 2 = 0", "Hotel"),
    }
    return C.remap_booking_acts(_acts(spark, d).withColumns(context).drop("act_domain", "booked", "prev"), ONTOLOGY)


@query("m28_flatten_acts", "slots", "SELECT dialogue_id, domain, kind AS intent, slot, coalesce(gt_value, '') AS value FROM slots")
def m28(spark, d):
    flat = fx(spark, d, "slots").select("dialogue_id", "domain", F.col("kind").alias("intent"), F.lit(0).alias("pos"), "slot", F.coalesce("gt_value", F.lit("")).alias("value"))
    return C.flatten_acts(C.unflatten_acts(flat, "dialogue_id")).drop("pos")


@query("m29_raw_names", "slots", "SELECT dialogue_id, slot, upper(substr(domain, 1, 1)) || substr(domain, 2) || '-' || upper(substr(kind, 1, 1)) || substr(kind, 2) AS raw_act, CASE slot WHEN 'book people' THEN 'People' ELSE 'S' || substr(slot, 2) END AS raw_slot, CASE WHEN gt_value IS NOT NULL THEN gt_value WHEN kind = 'request' THEN '?' ELSE 'none' END AS raw_value FROM slots")
def m29(spark, d):
    return C.raw_names(fx(spark, d, "slots").select("dialogue_id", F.col("kind").alias("intent"), "domain", "slot", F.col("gt_value").alias("value"))).select("dialogue_id", "slot", "raw_act", "raw_slot", "raw_value")


@query("m30_keyword_domains", "turns", "SELECT dialogue_id, utt_idx, concat_ws(',', CASE WHEN contains(lower(u), 'hotel') THEN 'Hotel' END, CASE WHEN contains(lower(u), 'restaurant') THEN 'Restaurant' END, CASE WHEN contains(lower(u), 'train') THEN 'Train' END) AS keywords FROM (SELECT *, utterance || coalesce(act_domain, '') AS u FROM turns)")
def m30(spark, d):
    return _turns(spark, d).select("dialogue_id", "utt_idx", F.array_join(T.keyword_domains(F.concat("utterance", F.coalesce("act_domain", F.lit("")))), ",").alias("keywords"))


@query(
    "m31_belief_state",
    "turns",
    "SELECT t.dialogue_id, t.utt_idx, p.domain, p.slot, coalesce(CASE WHEN p.domain = t.act_domain AND p.slot = 'book people' THEN CAST(t.dialogue_id % 7 AS STRING) END, '') AS value FROM (SELECT * FROM turns WHERE act_domain IN ('hotel', 'train')) t, (VALUES ('hotel', 'book people'), ('hotel', 'area'), ('train', 'book people'), ('train', 'day')) p(domain, slot)",
)
def m31(spark, d):
    rows = _turns(spark, d).where("act_domain in ('hotel', 'train')").selectExpr("dialogue_id", "utt_idx", "act_domain AS domain", "explode(array('people', 'ticket')) AS slot", "CAST(dialogue_id % 7 AS STRING) AS value")
    return C.belief_state(rows, {"hotel": ["book people", "area"], "train": ["book people", "day"]})
