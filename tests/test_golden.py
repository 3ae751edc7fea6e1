"""Worked examples and traps, by hand."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import corpus, entities, memory, patches, scoring, slots, splits, traces
from colloquy.sources import readers, writers


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_value_normalisation(spark):
    cases = {"one.": "1", "one .": "one", " Yes! ": "yes", "dont care": "dontcare", "don't care": "don't care", "a  b": "a b", "\tTwenty\t": "20", "": "", "a  b": "a b"}
    assert column(spark, list(cases), T.norm_value) == list(cases.values())
    assert column(spark, ["Alt 3", None, "Value"], lambda v: T.value_matches(v, F.lit("Value 1|alt 3"))) == [True, False, False]


def test_text_functions(spark):
    assert column(spark, ["Im here, dont say im late theres"], T.fix_grammar) == ["I'm here, don't say i'm late there's"]
    assert column(spark, ["a</think>b</think>c", "x"], T.after_think) == ["c", "x"]
    assert column(spark, ["```json\n{}\n```", " a "], T.strip_fences) == ["{}", "a"]
    assert column(spark, ["x ```json\n{1}\n``` ```{2}```", "```a```b", "c"], T.first_fence) == ["{1}", "a", "c"]
    assert column(spark, ["9:05", "19:30", "noon", None], T.clock) == [905, 1930, None, None]


def goal(inform, request):
    return ("", inform, request)


DIALOGUES = "dialogue_id string, goal struct<description:string,inform:map<string,map<string,string>>,request:map<string,map<string,string>>>, prediction struct<inform_slots:map<string,map<string,string>>,request_slots:map<string,array<string>>,booking:map<string,map<string,string>>>"


def test_scores(spark):
    rows = [
        ("five of seven", goal({"hotel": {"a": "1", "b": "2", "c": "x|y"}, "train": {"d": "4", "e": "5"}}, {"hotel": {"phone": "", "post": ""}}), ({"hotel": {"a": "one", "b": "2", "c": "Y."}}, {"hotel": ["Phone", "post"]}, {})),
        ("empty goal", goal({}, {}), ({}, {}, {})),
        ("no booking", goal({"hotel": {"book stay": "2"}}, {}), ({}, {}, {"hotel": {"reference": ""}})),
        ("booked", goal({"hotel": {"book stay": "2", "a": "1"}}, {"train": {}}), ({"hotel": {"a": "1"}}, {}, {"hotel": {"reference": "R"}})),
    ]
    d = spark.createDataFrame(rows, DIALOGUES)
    s = slots.scored(d)
    m = {r.dialogue_id: r for r in slots.per_dialogue(d.select("dialogue_id"), s).collect()}
    assert m["five of seven"].info_rate == pytest.approx(5 / 7) and m["five of seven"].success is False and m["five of seven"].booking_passed is None
    assert m["empty goal"].info_rate == 1.0 and m["empty goal"].success is True and m["empty goal"].booking_passed is None
    assert m["no booking"].success is False and m["no booking"].booking_passed is False
    assert m["booked"].success is True and m["booked"].booking_passed is True
    total = slots.corpus(slots.per_dialogue(d.select("dialogue_id"), s)).first()
    assert total.micro_rate == pytest.approx(6 / 8) and total.n_success == 2
    by = {r.domain: r for r in slots.per_domain(d, s).collect()}
    assert by["train"].n_dialogues == 2 and by["train"].n_success == 1  # one has the domain without slots
    assert by["hotel"].n_dialogues == 3
    only = d.where("dialogue_id = 'empty goal'")
    assert slots.corpus(slots.per_dialogue(only.select("dialogue_id"), slots.scored(only))).first().micro_rate == 0.0


@pytest.mark.parametrize(("n", "want"), [(1, (1, 0, 0)), (2, (2, 0, 0)), (3, (2, 1, 0)), (10, (8, 1, 1)), (25, (20, 2, 3))])
def test_scenario_split(spark, n, want):
    df = spark.range(n).withColumn("scenario", F.lit("x"))
    got = {r.part: r["count"] for r in splits.scenario_split(df, "id").groupBy("part").count().collect()}
    assert tuple(got.get(p, 0) for p in ("train", "validation", "test")) == want


@pytest.mark.parametrize(("n", "want"), [(11, [6, 5]), (13, [5, 5, 3]), (4, [4]), (10, [5, 5]), (12, [6, 6])])
def test_balanced_batches(spark, n, want):
    got = splits.balanced_batches(spark.range(n), 5, "id").groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [r["count"] for r in got] == want


def test_large_groups(spark, monkeypatch):
    df = spark.range(0, 500, 1, 5).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2))
    key = F.expr("(id * 7919) % 1009")
    small = splits.hold_out(df, 0.2, key, "g").orderBy("id").collect()
    monkeypatch.setattr(splits, "GROUP", 10)
    assert splits.hold_out(df, 0.2, key, "g").orderBy("id").collect() == small
    assert splits.hold_out(df, 0.2, F.desc("id")).where("part = 'validation'").agg(F.min("id")).first()[0] == 400


def test_samples(spark):
    parts = splits.hold_out(spark.range(4), 0.2, "id").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"validation": 1, "train": 3}
    assert splits.group_fraction(spark.range(5).withColumn("g", F.lit(1)), 0.1, "id", "g").count() == 1
    assert [r.id for r in splits.in_slice(spark.range(0, 1000, 1, 7), F.desc("id"), 2, 5).collect()] == [997, 996, 995]
    assert splits.merge_schedule(11, 5, 10) == [[6, 5], [2]] and splits.merge_schedule(50, 5, 1) == [[5] * 10, [10]]
    with pytest.raises(Exception, match="no task_id"):
        splits.cluster_sample(spark.createDataFrame([("a",), (None,)], "task_id string"), 1, "task_id").collect()


def test_cells(spark):
    kind = "kind string, num double, str string, ts timestamp"
    noon = datetime.datetime(2024, 1, 2, 13, 5)
    pairs = [
        (("string", None, "3.0", None), ("number", 3.0, None, None), True),
        (("string", None, "", None), ("empty", None, None, None), True),
        (("string", None, "abc", None), ("number", 3.0, None, None), False),
        (("number", 2.675, None, None), ("number", 2.67, None, None), True),
        (("number", 0.125, None, None), ("number", 0.12, None, None), True),
        (("time", None, None, noon), ("string", None, "13:05", None), False),
        (("datetime", None, None, noon), ("number", 45294.0, None, None), True),
        (("number", float("nan"), None, None), ("number", float("nan"), None, None), False),
        (("string", None, "1_000", None), ("number", 1000.0, None, None), True),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], f"i int, a struct<{kind.replace(' ', ':').replace(',:', ',')}>, b struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    cell = lambda c: scoring.normal_cell(*[F.col(f"{c}.{k}") for k in ("kind", "num", "str", "ts")])
    got = df.select("i", cell("a").alias("a"), cell("b").alias("b")).select("i", "a", "b", scoring.same_cell(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [w for *_, w in pairs] and got[5].a.str == "13:05"
    ranges = spark.createDataFrame([("A1:B3",), ("Z9",), ("AA2:AB2",), ("C:C",)], "range string")
    assert [r.cell for r in scoring.cells_of(ranges, max_row=2, max_column=3).collect()] == ["A1", "A2", "A3", "B1", "B2", "B3", "Z9", "AA2", "AB2", "C1", "C2"]


def test_passes(spark):
    rows = [("x", 1, 1), ("x", 2, 0), ("y", 1, 1), ("z", 1, 0)]
    r = scoring.pass_any_all(spark.createDataFrame(rows, "instance_id string, seed int, hard int")).first()
    assert (r.n, r.n_any, r.n_all) == (3, 2, 1)


def test_longest_edit(spark):
    rows = [(1, "k", "aa"), (2, "k", "bbbb"), (3, "k", "cc"), (4, "j", "q")]
    got = patches.longest(spark.createDataFrame(rows, "ord int, file string, content string"), "file").orderBy("ord").collect()
    assert [(r.ord, r.content) for r in got] == [(1, "bbbb"), (4, "q")]
    odd = spark.createDataFrame([(1, "k", None), (3, "k", "ab"), (2, "k", "cd"), (5, None, None)], "ord int, file string, content string")
    got = patches.longest(odd, "file")
    assert got.columns == odd.columns and sorted((r.ord, r.content) for r in got.collect()) == [(1, "cd"), (5, None)]
    plan = patches.longest(odd, "file")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


def test_stored_texts(spark, tmp_path):
    p = str(tmp_path)
    rows = [("seed_1", "agent_a_FAILED.md", "x\ny\n"), ("seed_2", "agent_a_FAILED.md", ""), ("seed_2", "notes.md", "no log"), ("seed_2", "agent_b-1_SUCCEED.md", "é\n\nz")]
    texts = spark.createDataFrame(rows, "seed string, file_name string, text string")
    writers.write_texts(texts, p + "/l", "seed", "file_name")
    got = sorted((r.seed, r.instance_id, r.outcome, r.text) for r in readers.read_logs(spark, p + "/l", seeds=True, stored=True).collect())
    assert got == [("seed_1", "a", "FAILED", "x\ny\n"), ("seed_2", "a", "FAILED", ""), ("seed_2", "b-1", "SUCCEED", "é\n\nz")]
    writers.write_texts(texts.where("seed = 'seed_2'"), p + "/f", "file_name")
    assert sorted(r.instance_id for r in readers.read_logs(spark, p + "/f", stored=True).collect()) == ["a", "b-1"]
    reports = spark.createDataFrame([("7", "analysis_report.md", "r"), ("x", "success_analysis_8.md", "s"), ("x", "success_analysis_8_prompt.md", "p")], "folder string, file_name string, text string")
    writers.write_texts(reports, p + "/r", "folder", "file_name")
    assert sorted((r.instance_id, r.in_directory, r.report) for r in readers.read_reports(spark, p + "/r", stored=True).collect()) == [("7", True, "r"), ("8", False, "s")]


def test_retrieval(spark):
    mem = spark.createDataFrame([(1, ["train"]), (2, ["hotel"]), (3, ["hotel", "train"])], "ord int, domains array<string>")
    ask = spark.createDataFrame([("h", ["hotel"]), ("p", ["police"])], "query_id string, domains array<string>")
    got = memory.retrieve(ask, mem, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.ord) for r in got] == [("h", 2), ("h", 3), ("p", 1), ("p", 2)]


@pytest.mark.parametrize("batches", [0, 9])
def test_retrieve_many_sets(spark, batches):
    """2,000 different sets of 40 domains, one of them in most sets, against brute force; the pairs that are compared are few and linear in the sets."""
    rng = random.Random(batches)
    names = [f"d{i:02}" for i in range(40)]

    def some():
        n = rng.choice([0, 1, 2, 3, 4, 5, 6, 7] + [11] * (batches > 0))
        return sorted(set(rng.sample(names, n)) | ({"d00"} if rng.random() < 0.7 else set()))

    sets = [some() for _ in range(2000)]
    batch = [rng.randrange(max(batches, 1)) for _ in sets]
    cols = "long, domains array<string>" + (", batch_no int" if batches else "")
    row = lambda i, s: (i, s, batch[i]) if batches else (i, s)
    mem = spark.createDataFrame([row(i, s) for i, s in enumerate(sets)], f"ord {cols}")
    ask = spark.createDataFrame([row(i, s) for i, s in enumerate(sets)] + [(2000, ["none"], 5) if batches else (2000, ["none"])], f"query_id {cols}")
    got = {}
    for r in memory.retrieve(ask, mem, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.ord, r.overlap))
    have = [set(s) for s in sets]
    for i, s, *b in ask.collect():
        earlier = [j for j in range(2000) if not b or batch[j] < b[0]]
        best = sorted(((-len(have[j] & set(s)), j) for j in earlier))[:3]
        if best and best[0][0] < 0:
            best = [x for x in best if x[0] < 0]
        assert got.get(i, []) == [(j, -n) for n, j in best], (i, s)
    if not batches:
        heads, asked = mem.select("ord", F.col("domains").alias("has"), F.lit(0).alias("made")), ask.select(F.col("domains").alias("wants"), F.lit(1).alias("at")).distinct()
        n, m = memory.candidates(asked, heads, 3).count(), asked.count()
        half = memory.candidates(asked.where(F.xxhash64("wants") % 2 == 0), heads, 3).count()
        assert n < 80 * m and half < 0.7 * n


def test_soft_match(spark):
    like = spark.createDataFrame([("abc", "xxabcxx"), ("abc", "abd"), ("", "a")], "a string, b string").select(entities.partial_ratio("a", "b").alias("x")).collect()
    assert [round(r.x) for r in like] == [100, 67, 0]


def test_alike(spark):
    """As pair by pair, for texts around the limit; few pairs pass the bound of letters."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdé𝒳 +") for _ in range(n))
    pairs = [("", ""), ("", "a"), ("a", ""), (None, ""), ("aa", "a"), ("ab", "ba")]
    for _ in range(600):
        a = word(rnd.randrange(1, 14))
        b = list(a * rnd.randrange(1, 3))
        for _ in range(rnd.randrange(len(b) + 1)):
            b[rnd.randrange(len(b))] = rnd.choice("abcdxyz")
        pairs += [(a, "".join(b)), (a, word(rnd.randrange(1, 20)))]
    df = spark.createDataFrame(pairs + pairs[:50], "a string, b string")
    for ratio in (60, 85, 100, 0):
        got = sorted((r.a, r.b) for r in entities.alike(df, ratio).collect())
        assert got == sorted({(a or "", b) for a, b in pairs if entities.likeness(a or "", b) >= ratio}), ratio
    assert entities.alike(df.limit(0), 60).count() == 0


def test_spans(spark):
    rows = [("at 5:00 for two", "05:00", 1, 1), ("at 5:00 for two", "2", 3, 3), ("the Gon ville hotel", "gonville", 1, 2), ("a b c d here", "d", 1, 1), ("x", "y", 0, 0), ("", "y", 0, 0)]
    got = corpus.align_spans(spark.createDataFrame(rows, "utterance string, value string, start_word int, end_word int")).collect()
    assert [r.category for r in got] == ["leading zero", "number word", "blanks", "window 2", "none", "none"]
    assert got[3].start == 6


def test_report_items(spark):
    text = "x</think>```\n# Failure Memory Item 2\n## Title\nT\n## Skill Reflection\nwell\n\n# Failure Cause Item 3\nno sections\n```"
    r = spark.createDataFrame([("i", text), ("j", "nothing")], "instance_id string, report string")
    good, bad = traces.parse_reports(r)
    items = good.first()["items"]
    assert [(i.type, i.number, i.title, i.skill_reflection, i.relation_to_skill) for i in items] == [("failure_memory", 2, "T", "well", None), ("failure_cause", 3, "", None, "")]
    assert [x.instance_id for x in bad.collect()] == ["j"]


def test_files(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "data.json").write_text('[{"dialogue_id": "a", "data_split": "test", "goal": {"inform": {"h": {"x": 4}}}, "turns": [{"utterance": "hi"}]}, {"dialogue_id": "b"}]')
    rows = {r.dialogue_id: r for r in readers.read_dialogues(spark, p + "/d").collect()}
    assert rows["a"].goal.inform == {"h": {"x": "4"}} and rows["a"].turns[0].utt_idx == 0 and rows["b"].goal.inform == {} and rows["b"].turns == []
    assert readers.read_dialogues(spark, p + "/d", "test").count() == 1
    with pytest.raises(ValueError, match="unknown dataset"):
        readers.load_dataset(spark, "nope", p)
    (tmp_path / "l" / "seed_1").mkdir(parents=True)
    (tmp_path / "l" / "seed_1" / "agent_10-2_FAILED.md").write_text("text\nmore")
    (tmp_path / "l" / "seed_1" / "other.md").write_text("x")
    log = readers.read_logs(spark, p + "/l", seeds=True).collect()
    assert [(r.instance_id, r.outcome, r.seed, r.text) for r in log] == [("10-2", "FAILED", "seed_1", "text\nmore")]
    for name in ("r/7/analysis_report.md", "r/error_analysis_8.md", "r/error_analysis_8_prompt.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("report")
    assert sorted((r.instance_id, r.in_directory) for r in readers.read_reports(spark, p + "/r").collect()) == [("7", True), ("8", False)]
    (tmp_path / "i.json").write_text('[{"id": 1, "instruction": "do", "extra": "e"}]')
    i = readers.read_instances(spark, p + "/i.json").first()
    assert (i.id, i.answer_position, i.metadata) == ("1", "", {"extra": "e"})
    writers.write_step(spark, spark.createDataFrame([(0.5,)], "rate double"), p + "/s", 3)
    writers.write_step(spark, spark.createDataFrame([(0.7,)], "rate double"), p + "/s", 3)
    assert writers.last_step(spark, p + "/s") == 3 and [r.rate for r in spark.read.parquet(p + "/s").collect()] == [0.7]
    bad = tmp_path / "e.json"
    bad.write_text("{not json")
    assert readers.read_entities(spark, {"x": str(bad), "y": p + "/none"}).count() == 0


def test_ids_of_logs(spark):
    names = ["cli_agent_a_1.md", "run_13-1.md", "x_agent_7_FAILED.tar.log", "p_agent_q_agent_9.log", "plain", ".md"]
    rows = spark.createDataFrame([(n,) for n in names], "file_name string").select("file_name", traces.ids_of_log(F.col("file_name")).alias("ids")).collect()
    got = {r.file_name: set(r.ids) for r in rows}

    def belongs(name, i):  # the three ways in which an id may be in a name
        stem = name.rsplit(".", 1)[0] if "." in name.lstrip(".") else name
        return f"_agent_{i}." in name or f"_agent_{i}_" in name or stem.endswith(f"_{i}")

    asked = {x for ids in got.values() for x in ids} | {"a", "1", "a_1", "13-1", "7", "7_FAILED", "FAILED.tar", "9", "q_agent_9", "agent_9", "run", ""}
    for n in names:
        assert got[n] == {i for i in asked if belongs(n, i)}, n
    results = spark.createDataFrame([("a_1",), ("13-1",), ("none",)], "instance_id string")
    found = traces.match_logs(results, spark.createDataFrame([(n,) for n in names], "file_name string")).collect()
    assert {r.instance_id: r.log_file for r in found} == {"a_1": "cli_agent_a_1.md", "13-1": "run_13-1.md", "none": None}


def test_logs_and_reports_of_one_id_stay_apart(spark):
    logs = spark.createDataFrame([("a", "[thought] 1\n[action] x\n[observation] o\nACTION: y\n[thought] 2"), ("a", "**Think 3\n[action] z"), ("a", None), ("b", "nothing")], "instance_id string, text string")
    steps = traces.trajectory_steps(logs)
    assert sorted((r.step, r.thought or "", r.action or "", r.observation or "") for r in steps.collect()) == [(0, "**Think 3", "[action] z", ""), (0, "[thought] 1", "[action] x", "[observation] o"), (1, "", "ACTION: y", "")]
    item = "# Success Memory Item {}\n## Title\n{}\n# Content\nc\n***\n"
    reports = spark.createDataFrame([("a", item.format(1, "one") + item.format(99999999999, "big")), ("a", "# Title\nstray\n" + item.format(2, "two") + "## Title\nlast"), ("a", "")], "instance_id string, report string")
    items = traces.success_items(reports)
    assert sorted((r.number or 0, r.title, r.description, r.content) for r in items.collect()) == [(0, "big", "", "c"), (1, "one", "", "c"), (2, "last", "", "c")]
    texts = spark.createDataFrame([("a", "## R\n1\n### s\n## Q\n2"), ("a", "x\n ## R \n3"), ("a", "none")], "instance_id string, text string")
    cut = traces.section(texts, "## R")
    assert sorted(r.section for r in cut.collect()) == [" ## R \n3", "## R\n1\n### s"]
    for df in (steps, items, cut):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    big = spark.createDataFrame([("i", "# Failure Cause Item 99999999999\n## Title\nT")], "instance_id string, report string")
    assert [i.number for i in traces.parse_reports(big)[0].first()["items"]] == [None]


def test_tool_calls_in_the_engine(spark):
    rng = random.Random(1)

    def brute(t):
        depth, low = 0, None
        for i, c in enumerate(t):
            if c == "{":
                low = i if depth == 0 else low
                depth += 1
            elif c == "}":
                depth -= 1
                if depth == 0 and low is not None:
                    return t[low : i + 1]

    texts = ["".join(rng.choice("{}{}ab\0é😀\n") for _ in range(rng.randrange(25))) for _ in range(400)] + ["", "{}", "}{", "x\0{\0}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", traces.first_object(F.col("t")).alias("x"))
    assert {r.i: r.x for r in rows.collect()} == {i: brute(t) for i, t in enumerate(texts)}
    nul = spark.createDataFrame([("a\0b Action: {\"name\": \"q\"}",), ("Action: {",)], "response string")
    out = traces.tool_calls(nul)
    assert [(r.kind, r.tool) for r in out.collect()] == [("action", "q"), ("format_error", None)] and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_payloads_and_front_matter(spark):
    texts = ["some {text} here", "```json\n{\"a\": 1}", "```json x\n{\"a\": 1}\n```\n```json\n{}\n``` \nend ``` of", " {\"a\": 1} ", "```\n{}\n```", "```json\n```", ""]
    want = [None, None, "{\"a\": 1}\n```\n```json\n{}", "{\"a\": 1}", None, "", None]
    rows = spark.createDataFrame(list(zip(texts, want)), "t string, w string").select("w", T.patch_payload("t").alias("p")).collect()
    assert [r.p for r in rows] == [r.w for r in rows]
    heads = ["---\nname: \"my skill\"\ndescription: 'it''s'\n---\n\nbody", "---  \nname:  x y \n---\nb", "--- no\nname: x\n---\n", "---\nother: 1\n---"]
    got = [tuple(r.m) for r in spark.createDataFrame([(t,) for t in heads], "t string").select(T.front_matter("t").alias("m")).collect()]
    assert got == [("my skill", "it", "body"), ("x y", "", "b"), ("", "", "--- no\nname: x\n---"), ("", "", "")]
    assert [r[0] for r in spark.createDataFrame([("HTTP 429",), ("quota of x",), ("1429",)], "t string").select(T.is_transient("t")).collect()] == [True, False, False]
    assert spark.createDataFrame([("quota of x",)], "t string").select(T.is_transient("t", ("quota",))).first()[0]


def test_tokens_of_other_letters(spark):
    rows = [("ein hôtel in Zürich", "hôtel", 1, 1), ("ein hôtel in Zürich", "zürich", 3, 3)]
    got = corpus.align_spans(spark.createDataFrame(rows, "utterance string, value string, start_word int, end_word int")).collect()
    assert [(r.start, r.end, r.category) for r in got] == [(4, 9, "exact"), (13, 19, "exact")]


def test_first_of_times_and_two_names(spark):
    """Sets that want a time alone, against brute force; two spellings of a name are two constraints, or one attribute."""
    rng = random.Random(3)
    clock = lambda: f"{rng.randrange(26):02}:{rng.randrange(60):02}"
    rows = [(rng.choice(["train", "bus"]), i, {k: v for k, v in (("leaveAt", rng.choice([clock(), clock(), None, "?", "late"])), ("arriveBy", rng.choice([clock(), None]))) if v}) for i in range(300)]
    asks = [(i, rng.choice(["train", "bus", "none"]), rng.choice([{}, {"leave at": clock()}, {"leaveAt": clock(), "leave at": clock()}, {"leaveAt": "dontcare"}, {"leaveAt": clock(), "arrive by": clock()}, {"arriveBy": "x"}]), {}) for i in range(60)]
    e = spark.createDataFrame(rows, "domain string, ord long, attrs map<string,string>")
    q = spark.createDataFrame(asks, "query_id long, domain string, hard map<string,string>, soft map<string,string>")
    got = {}
    for r in entities.satisfying(e, q, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.ord)
    number = lambda x: int(x[:2]) * 100 + int(x[3:]) if x and x[:2].isdigit() else None

    def ok(want, attrs):
        for k, v in want.items():
            k = {"leave at": "leaveAt", "arrive by": "arriveBy"}.get(k, k)
            a, b = number(v), number(attrs.get(k))
            if a is not None and b is not None and (b < a if k == "leaveAt" else b > a):
                return False
        return True

    for i, d, want, _ in asks:
        assert got.get(i, []) == [o for dd, o, at in rows if dd == d and ok(want, at)][:4], (i, want)
    times = spark.createDataFrame([(d, o, a.get("leaveAt")) for d, o, a in rows], "domain string, ord long, leave_at string")
    wants = spark.createDataFrame([(i, d, next(iter(w.values()), None)) for i, d, w, _ in asks], "query_id long, domain string, want_leave_at string")
    have = {r.query_id: (r.n, r.ords) for r in entities.within_times(times, wants, 3).collect()}
    for i, d, w in wants.collect():
        hits = [o for dd, o, at in rows if dd == d and number(w) is not None and number(at.get("leaveAt")) is not None and number(at["leaveAt"]) >= number(w)]
        assert have.get(i, (0, [])) == (len(hits), hits[:3])
    both = spark.createDataFrame([("train", 1, {"leaveAt": "05:00", "leave at": "06:00", "x": "y"}), ("train", 2, {"leaveAt": "07:00"})], "domain string, ord long, attrs map<string,string>")
    assert [r.attrs for r in entities.rename_attributes(both).orderBy("ord").collect()] == [{"leave at": "06:00", "x": "y"}, {"leave at": "07:00"}]


@pytest.mark.parametrize("n,most", [(0, 10), (1, 10), (4, 10), (5, 10), (23, 10), (131, 10), (131, 1)])
def test_merged_patches(spark, n, most):
    """The places of all parts against a merge of lists, group by group and level by level."""
    rng = random.Random(n)
    rows = [(3 * i, rng.choice(["", f"r{i}", None]), [f"e{i}.{j}" for j in range(rng.randrange(3))], [f"c{i}.{j}" for j in range(rng.randrange(2))]) for i in range(n)]
    schema = "ord long, reasoning string, edits array<string>, changelog array<string>"
    now, levels = [([r] if r else [], e, c) for _, r, e, c in rows], 0
    while len(now) > 1:
        size, m = 5, len(now)
        full = m // size
        no = lambda i: 0 if levels == most or m <= size else i // size if i < full * size else (i - full * size) % full if m % size < size / 2 else full
        groups = {}
        for i, p in enumerate(now):
            groups.setdefault(no(i), []).append(p)
        now = [tuple(sum((p[k] for p in g), []) for k in range(3)) for _, g in sorted(groups.items())]
        levels += 1
    got = patches.merged(spark.createDataFrame(rows, schema).repartition(3), 5, most)
    parts = {k: [r.body for r in got.where(F.col("kind") == k).orderBy("pos").collect()] for k in patches.KINDS}
    assert parts == dict(zip(patches.KINDS, now[0] if now else ([], [], []))) and all(r.levels == levels for r in got.collect())
    if n == 23:
        x = spark.createDataFrame([(r[0] % 2, *r) for r in rows], f"g long, {schema}")
        text = {r.g: r for r in patches.patch_text(patches.coalesced(x, "g"), "g").collect()}
        for g in (0, 1):
            mine = [r for r in rows if r[0] % 2 == g]
            assert text[g].reasoning == "\n\n".join(r[1] for r in mine if r[1]) and text[g].edits == sum((r[2] for r in mine), []) and text[g].changelog == sum((r[3] for r in mine), [])


def test_likeness():
    assert entities.likeness("", "") == 100 and entities.likeness("", "a") == 0 and entities.likeness("a", "a") == 100
    assert entities.likeness("yankees", "new york yankees") == 100 and entities.likeness("abcd", "XXbcdeEEE") == 75


def test_tool_call_text(spark):
    texts = ["Action: {\"name\": \"a\", \"arguments\": {\"b\": 1, \"a\": \"é{\"}} {x}", "Action: } {\"name\": 1}", "Action: {'name': 'q'}", "Action: {} {\"name\": 2}", "Action: {\"name\": \"a\"", "plain", None, "Action: [1] TASK_COMPLETE"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    got = {r.i: (r.kind, r.tool, r.arguments) for r in traces.tool_calls(rows).collect()}
    assert got[1] == got[3] == got[4] == ("format_error", None, None) and got[5] == got[6] == got[7] == ("task_complete", None, None)
    assert got[2] == ("action", "q", "{}") and got[0][0] == "format_error"  # the brace inside the text counts, too


def test_same_numbers_either_way(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id", "id % 3 AS g", "id % 5 AS k")
    one = splits.hold_out(rows, 0.2, "k", "g").collect()
    monkeypatch.setattr(splits, "GROUP", 10)
    assert sorted(map(tuple, splits.hold_out(rows, 0.2, "k", "g").collect())) == sorted(map(tuple, one))


def test_state_over_batches(spark, tmp_path):
    from colloquy.streaming import batches

    schema = "dialogue_id long, utt_idx long, act_domain string, booked boolean"
    parts = [[(1, 1, "train", True), (1, 0, "hotel", True), (2, 0, None, False)], [(1, 3, None, True), (1, 2, "hotel", True), (2, 1, "taxi", True)], [(1, 1, "police", True), (1, 4, None, False), (2, 2, "taxi", True)]]
    out = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = batches.running_state(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q.writeStream.format("parquet").option("path", str(tmp_path / f"out{i}")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination() if i == 0 else q.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    first = spark.read.schema("dialogue_id long, utt_idx long, current_domain string, booked_domain string, late boolean").parquet(str(tmp_path / "out0")).collect()
    got = sorted(tuple(r)[:4] for r in [*first, *out] if r.dialogue_id == 1)
    assert [(r.dialogue_id, r.utt_idx) for r in [*first, *out] if r.late] == [(1, 1)]
    late = (1, 1, "police", None)
    assert late in got
    got.remove(late)
    assert got == [(1, 0, "hotel", "hotel"), (1, 1, "train", "train"), (1, 2, "hotel", None), (1, 3, "hotel", None), (1, 4, "hotel", None)]
    assert sorted((r.utt_idx, r.booked_domain) for r in [*first, *out] if r.dialogue_id == 2) == [(0, None), (1, "taxi"), (2, None)]


def test_state_goes_with_its_timer(spark, tmp_path):
    import time

    from colloquy.streaming import batches

    schema = "dialogue_id long, utt_idx long, act_domain string, booked boolean"
    out, path = [], str(tmp_path / "in")
    parts = [[(1, 5, "hotel", True)], [(1, 6, None, False), (2, 0, None, None)], [(1, 2, None, False)]]
    spark.createDataFrame(parts[0], schema).coalesce(1).write.mode("append").parquet(path)
    q = batches.running_state(spark.readStream.schema(schema).parquet(path), 15000)
    stream = q.writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        for i, want in enumerate((1, 3, 4)):
            if i:
                time.sleep(25 if i == 2 else 0)
                spark.createDataFrame(parts[i], schema).coalesce(1).write.mode("append").parquet(path)
            until = time.time() + 40
            while len(out) < want and time.time() < until:
                time.sleep(0.2)
    finally:
        stream.stop()
    assert sorted(out) == [(1, 2, None, None, False), (1, 5, "hotel", "hotel", False), (1, 6, "hotel", None, False), (2, 0, None, None, False)]


def test_key_is_canonical(spark):
    row = spark.range(1).select(F.struct(F.lit("x").alias("role"), F.lit("y").alias("content")).alias("a"), F.struct(F.lit("y").alias("content"), F.lit("x").alias("role")).alias("b"))
    r = row.select(T.cache_key(F.lit("m"), F.array("a")).alias("a"), T.cache_key(F.lit("m"), F.array("b")).alias("b")).first()
    assert r.a == r.b


def test_lookups_against_brute_force(spark):
    import random

    rng = random.Random(6)
    value = lambda: rng.choice(["", "?", "North", "north end", "12:30", "09:15", "cheap", "Cheap eats", None])
    ents = [(rng.choice("ab"), i, {k: v for k, v in (("area", value()), ("price", value()), ("leaveAt", rng.choice(["08:00", "12:30", "x"]))) if v is not None}) for i in range(120)]
    asks = [(q, rng.choice("abc"), {k: rng.choice(["north", "NORTH", "cheap", "e", "", "dontcare"]) for k in rng.sample(["area", "price", "other"], rng.randrange(3))}) for q in range(60)]
    e = spark.createDataFrame(ents, "domain string, ord long, attrs map<string,string>")
    q = spark.createDataFrame(asks, "query_id int, domain string, constraints map<string,string>")
    got = {}
    for r in entities.containing(e, q, 4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.ord)
    for i, d, c in asks:
        want = [o for x, o, a in ents if x == d and all(k in a and v.lower() in a[k].lower() for k, v in c.items())][:4]
        assert got.get(i, []) == want, (i, d, c)
    hard = q.select("query_id", "domain", F.map_concat(F.map_filter("constraints", lambda k, v: k != "price"), F.when(F.col("query_id") % 3 == 0, F.create_map(F.lit("leave at"), F.lit("09:00"))).otherwise(F.create_map().cast("map<string,string>"))).alias("hard"), F.map_filter("constraints", lambda k, v: k == "price").alias("soft"))
    got = {}
    for r in entities.satisfying(e, hard, 4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.ord)

    def ok(a, i, c):
        def skip(k, v):
            return v in entities.ANY or k not in a or (a[k].strip() == "?")

        for k, v in c.items():
            if skip(k, v):
                continue
            have, want = a[k].strip().lower(), v.strip().lower()
            if k == "price" and entities.likeness(want, have) < 60 or k != "price" and have != want:
                return False
        return i % 3 != 0 or a["leaveAt"] == "x" or a["leaveAt"] >= "09:00"

    for i, d, c in asks:
        assert got.get(i, []) == [o for x, o, a in ents if x == d and ok(a, i, c)][:4], (i, d, c)


def test_rounding(spark, tmp_path):
    """Against the language's own rounding: random values of all sizes, and those next to and on a half."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    halves = rng.integers(-(10**9), 10**9, 100_000) / 1000 + 0.005
    ties = rng.integers(-(2**40), 2**40, 50_000) / 8
    big = rng.integers(2**50, 2**55, 50_000) / 128
    tiny = [2.675, 1.005, 0.125, 0.375, 1e300, -1e-300, 5e-324, np.inf, -np.inf, np.nan, 4503599627370497.5, 0.0, -0.0]
    x = np.concatenate([rng.normal(size=800_000) * 10.0 ** rng.integers(-6, 18, 800_000), halves, np.nextafter(halves, 0), np.nextafter(halves, 1e18), ties, big, -big, np.arange(-300, 300) / 200, tiny])
    pd.DataFrame({"i": range(len(x)), "x": x}).to_parquet(tmp_path / "x.parquet")
    rows = spark.read.parquet(str(tmp_path / "x.parquet")).select("i", scoring.round_half_even(F.col("x")).alias("r"))
    assert "Python" not in rows._jdf.queryExecution().toString() and "Arrow" not in rows._jdf.queryExecution().toString()
    got = rows.toArrow().to_pandas().sort_values("i")["r"].to_numpy(float)
    want = np.array([round(float(v), 2) if np.isfinite(v) else v for v in x])
    assert np.array_equal(got, want, equal_nan=True)
    assert spark.range(1).select(scoring.round_half_even(F.lit(None).cast("double")).alias("r")).first().r is None


def test_reply_table(spark, tmp_path):
    """Two calls: the second one asks nothing that the first one has; a repeated key is asked once; keys that came twice have one reply."""
    name = memory.reply_table(spark, "replies_of_test", str(tmp_path / "replies"), 8)
    msg = F.array(F.struct(F.lit("user").alias("role"), (F.col("id") % 50).cast("string").alias("content")))
    calls = spark.range(400).select("id", F.lit("m").alias("model"), F.when(F.col("id") != 399, msg).alias("messages"), F.lit("own").alias("json"))
    first = memory.score_through(calls.where("id < 25 or id = 399"), name, lambda s: s.fillna("none").str.upper(), 8)
    assert first.where("not hit").count() == 26
    second = memory.score_through(calls, name, lambda s: s.fillna("none").str.upper(), 8).collect()
    assert len(second) == 400 and sum(r.hit for r in second) == 25 * 8 + 1 and len({r.reply for r in second}) == 51
    assert spark.table(name).count() == 51

    def never(s):
        raise AssertionError("asked again")

    third = memory.score_through(calls, name, never, 8)
    assert third.where("hit").count() == 400 and third.where("json = 'own'").count() == 400
    assert memory.score_through(calls.limit(0), name, never, 8).count() == 0
    key = second[0].key
    spark.createDataFrame([(key, "A")], "key string, reply string").write.insertInto(name)
    again = memory.score_through(calls, name, never, 8).where(F.col("key") == key).collect()
    assert {r.reply for r in again} == {min("A", second[0].reply)} and len(again) == sum(r.key == key for r in second)
    asked = calls.select(memory.cache_key(F.col("model"), F.col("messages")).alias("key")).distinct().checkpoint()
    plan = asked.join(spark.table(name).groupBy("key").agg(F.min("reply").alias("reply")).hint("merge"), "key", "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "SelectedBucketsCount: 8 out of 8" in plan
    # a session that does not know the table finds its files
    spark.sql(f"DROP TABLE {name}")
    memory.reply_table(spark, name, str(tmp_path / "replies"), 8)
    assert memory.score_through(calls, name, never, 8).where("hit").count() == 400


def _many_entities(spark):
    return spark.range(6000).select(F.lit("d").alias("domain"), F.col("id").alias("ord"), F.create_map(F.lit("a"), F.concat(F.lit("A"), F.col("id") % 5), F.lit("id"), F.col("id").cast("string")).alias("attrs"))


def test_containing_keeps_few_entities(spark, monkeypatch):
    """Attributes that nobody asks for are not taken apart, and of equal entities only the first go on."""
    seen, cut = [], entities.cut
    monkeypatch.setattr(entities, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    q = spark.createDataFrame([(1, "d", {"a": "a3"}), (2, "d", {"a": "a"}), (3, "d", {})], "query_id int, domain string, constraints map<string,string>")
    got = sorted((r.query_id, r.rank, r.ord) for r in entities.containing(_many_entities(spark), q, 2).collect())
    assert got == [(1, 1, 3), (1, 2, 8), (2, 1, 0), (2, 2, 1), (3, 1, 0), (3, 2, 1)]
    assert max(df.count() for df in seen) <= 10


def test_answers_as_text_are_not_broadcast(spark):
    q = spark.createDataFrame([(1, "d", {"a": "a3"}), (2, "d", {"a": "x"})], "query_id int, domain string, constraints map<string,string>")
    text = entities.as_text(entities.containing(_many_entities(spark), q, 2), q)
    assert {r.query_id: r.text for r in text.collect()} == {1: "Found 2 d(s):\n  1. a: A3\n  2. a: A3", 2: "No d found matching: a=x"}
    assert "Join LeftOuter" in (plan := text._jdf.queryExecution().optimizedPlan().toString()) and "strategy=merge" in plan


@pytest.mark.parametrize("soft", [False, True])
def test_satisfying_keeps_few_entities(spark, monkeypatch, soft):
    seen, checked = [], entities._checked
    monkeypatch.setattr(entities, "_checked", lambda rows, ok: seen.append(rows) or checked(rows, ok))
    want = spark.createDataFrame([(1, "d", {"a": "a3"}), (2, "d", {"a": "a4"})], "query_id int, domain string, want map<string,string>")
    none = F.create_map().cast("map<string,string>")
    q = want.select("query_id", "domain", (none if soft else F.col("want")).alias("hard"), (F.col("want") if soft else none).alias("soft"))
    got = sorted((r.query_id, r.rank, r.ord) for r in entities.satisfying(_many_entities(spark), q, 2, ratio=100).collect())
    assert got == [(1, 1, 3), (1, 2, 8), (2, 1, 4), (2, 2, 9)]
    assert sum(df.count() for df in seen) <= 20


def test_stored_texts_share_files(spark, tmp_path):
    """The number of files goes with that of the tasks, not of the texts; any text and name comes back."""
    p = str(tmp_path / "t")
    rows = spark.range(0, 400, 1, 2).select(F.concat(F.lit("seed_"), F.col("id") % 3).alias("seed"), F.concat(F.lit("agent_a b="), "id", F.lit("_FAILED.md")).alias("file_name"), F.concat(F.lit("l\r\n\"\\\u2028"), "id", F.lit("\n\n")).alias("text"))
    writers.write_texts(rows, p, "seed", "file_name")
    assert len(list((tmp_path / "t").rglob("part-*"))) == 2
    got = {(r.seed, r.instance_id): r.text for r in readers.read_logs(spark, p, seeds=True, stored=True).collect()}
    assert got == {(f"seed_{i % 3}", f"a b={i}"): f"l\r\n\"\\\u2028{i}\n\n" for i in range(400)}
    assert readers.read_logs(spark, p, stored=True).count() == 0


def test_stored_reports_share_files(spark, tmp_path):
    """A folder for each instance is a part of the path, no folder of the file system."""
    p = str(tmp_path / "t")
    rows = spark.range(0, 300, 1, 2).select(F.col("id").cast("string").alias("folder"), F.lit("analysis_report.md").alias("file_name"), F.concat(F.lit("r"), "id").alias("text"))
    writers.write_texts(rows, p, "folder", "file_name")
    assert [x.name for x in (tmp_path / "t").iterdir() if x.is_dir()] == [] and len(list((tmp_path / "t").glob("part-*"))) == 2
    got = sorted((int(r.instance_id), r.in_directory, r.report) for r in readers.read_reports(spark, p, stored=True).collect())
    assert got == [(i, True, f"r{i}") for i in range(300)]


def test_scored_in_one_pass(spark):
    """The dialogues are read once for all kinds of slots."""
    rows = [("a", goal({"hotel": {"book stay": "2", "a": "1"}, "none": None}, {"train": {"t": "", "": ""}, "taxi": {}}), ({"hotel": {"a": "one"}}, {"train": ["T."]}, {"hotel": {"reference": "R"}})), ("b", goal(None, {"bus": {"x": ""}}), None), ("c", None, None)]
    got = slots.scored(spark.createDataFrame(rows, DIALOGUES))
    assert sorted(map(str, got.select(F.array(*[F.col(c).cast("string") for c in ("dialogue_id", "domain", "kind", "slot", "correct")]).alias("x")).toPandas().x.map(list))) == ["['a', 'hotel', 'booking', None, 'true']", "['a', 'hotel', 'inform', 'a', 'true']", "['a', 'train', 'request', 't', 'true']", "['b', 'bus', 'request', 'x', 'false']"]
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_dialogues_in_one_shuffle(spark, data_dir):
    from colloquy.plans.fixtures import dialogues

    plan = slots.scored(dialogues(spark, data_dir))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 == plan.count("Exchange hashpartitioning(dialogue_id")  # lines, orders


def test_failure_cases_read_lines_twice(spark, data_dir):
    """Once for the metrics, once for the goals."""
    from colloquy.plans.catalog import QUERIES

    plan = QUERIES["p11_failure_cases"](spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber#") > 0 and sum("Relation" in x and "l_orderkey" in x for x in plan.splitlines()) == 2


def test_dialogues_in_one_grouping(spark, data_dir):
    """A dialogue's slots are gathered once; its maps are made of them inside the row."""
    from colloquy.plans.fixtures import dialogues

    plan = dialogues(spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1


def test_values_with_blanks(spark):
    """As by one step after the other."""
    parts = ["", " ", "\t", "\u00a0", "\u2003", ".", "?!", "One", "b", "don't care", "dont  care"]
    values = sorted({x + y + z + w for x in parts for y in parts for z in parts for w in ("", ".", "\u00a0", " ;")})

    def slow(s):
        v = s.lower().strip().rstrip(".,;:!?")
        return "dontcare" if v in T.DONT_CARE else T.NUMBER_WORDS.get(v, " ".join(v.split()))

    assert column(spark, values, T.norm_value) == [slow(v) for v in values]
    got = spark.createDataFrame([(None, "a"), ("A. ", "b| a"), ("a", None), ("", "b|")], "p string, t string").select(T.value_matches("p", "t").alias("x"))
    assert [r.x for r in got.collect()] == [False, True, False, True]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 2  # each value is put in lower case once
