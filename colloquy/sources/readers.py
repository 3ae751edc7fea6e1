"""Readers with explicit schemas; missing keys become the empty value of their type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traces import log_outcome

_MM = "map<string,map<string,string>>"
ACT = "struct<intent:string,domain:string,slot:string,value:string,start:int,end:int>"
TURN = f"struct<speaker:string,utterance:string,utt_idx:int,dialogue_acts:struct<categorical:array<{ACT}>,`non-categorical`:array<{ACT}>,binary:array<{ACT}>>,state:{_MM},booked:map<string,array<map<string,string>>>>"
DIALOGUE = f"dataset string, data_split string, dialogue_id string, original_id string, domains array<string>, goal struct<description:string,inform:{_MM},request:{_MM}>, turns array<{TURN}>"
PREDICTION = f"dialogue_id string, inform_slots {_MM}, request_slots map<string,array<string>>, booking {_MM}, response_text string"
CALL = "call_index int, call_tag string, timestamp string, num_messages int, messages array<struct<role:string,content:string>>, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
#: What a dialogue folder's file may be called, best first.
NAMES = ("data/data/dialogues.json", "data.json", "dataset.json")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines for .jsonl, else JSON arrays; lines that are blank are left out."""
    lines = path.endswith(".jsonl")
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def _none(c: str, kind: str):
    return F.coalesce(F.col(c), F.lit("") if kind == "string" else F.array().cast(kind) if kind.startswith("array") else F.create_map().cast(kind))


def resolve(spark: SparkSession, path: str) -> str:
    """The dialogue file of a path: itself, or in a folder the first of ``NAMES`` or else the first JSON file by name.

    Asks the file system that the path belongs to, so it works on any store Spark can read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        return path
    for n in NAMES:
        if fs.exists(jvm.org.apache.hadoop.fs.Path(p, n)):
            return f"{path.rstrip('/')}/{n}"
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    for n in names:
        if n.endswith((".json", ".jsonl")):
            return f"{path.rstrip('/')}/{n}"
    raise FileNotFoundError(f"no dialogues in {path}")


def typed_dialogues(raw: DataFrame) -> DataFrame:
    """Rows of ``DIALOGUE`` with defaults; a turn without an index has its place as one."""
    turn = lambda t, i: F.struct(F.coalesce(t["speaker"], F.lit("")).alias("speaker"), F.coalesce(t["utterance"], F.lit("")).alias("utterance"), F.coalesce(t["utt_idx"], i).alias("utt_idx"), t["dialogue_acts"].alias("dialogue_acts"), t["state"].alias("state"), t["booked"].alias("booked"))
    goal = F.struct(F.coalesce("goal.description", F.lit("")).alias("description"), _none("goal.inform", _MM).alias("inform"), _none("goal.request", _MM).alias("request"))
    texts = [_none(c, "string").alias(c) for c in ("dataset", "data_split", "dialogue_id", "original_id")]
    return raw.select(*texts, _none("domains", "array<string>").alias("domains"), goal.alias("goal"), F.transform(F.coalesce("turns", F.array().cast(f"array<{TURN}>")), turn).alias("turns"))


def read_dialogues(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = typed_dialogues(_json(spark, resolve(spark, path), DIALOGUE))
    return rows if split is None else rows.where(F.col("data_split") == split)


_LOADERS: dict[str, Callable[[SparkSession, str, str | None], DataFrame]] = {"dialogues": read_dialogues}


def register_loader(name: str, loader: Callable[[SparkSession, str, str | None], DataFrame]) -> None:
    _LOADERS[name] = loader


def load_dataset(spark: SparkSession, name: str, path: str, split: str | None = None) -> DataFrame:
    if name not in _LOADERS:
        raise ValueError(f"unknown dataset {name!r}; there are {', '.join(sorted(_LOADERS))}")
    return _LOADERS[name](spark, path, split)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, PREDICTION)
    return rows.select("dialogue_id", _none("inform_slots", _MM).alias("inform_slots"), _none("request_slots", "map<string,array<string>>").alias("request_slots"), _none("booking", _MM).alias("booking"), _none("response_text", "string").alias("response_text"))


def read_entities(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(domain, ord, attrs) of one JSON array a domain; a file that is missing or no array is an empty domain."""
    out = spark.createDataFrame([], "domain string, ord long, attrs map<string,string>")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for domain, path in paths.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            continue
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<map<string,string>>").alias("rows"))
        out = out.unionByName(whole.select(F.lit(domain).alias("domain"), F.posexplode("rows").alias("ord", "attrs")).withColumn("ord", F.col("ord").cast("long")))
    return out


def labelled_split(dialogues: DataFrame, validation: DataFrame, test: DataFrame) -> DataFrame:
    """dialogues with ``data_split`` from two id lists (column ``value``): validation, else test, else train."""
    mark = lambda ids, name: ids.select(F.trim("value").alias("dialogue_id"), F.lit(True).alias(name)).distinct()
    rows = dialogues.join(mark(validation, "__v"), "dialogue_id", "left").join(mark(test, "__t"), "dialogue_id", "left")
    return rows.withColumn("data_split", F.when(F.col("__v"), "validation").when(F.col("__t"), "test").otherwise("train")).drop("__v", "__t")


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark instances; unknown fields go to ``metadata``."""
    known = ("id", "instruction", "spreadsheet_path", "instruction_type", "answer_position")
    if path.endswith(".jsonl"):
        rows = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", "map<string,string>").alias("m"))
    else:
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
    return instance_columns(rows, known)


def instance_columns(rows: DataFrame, known=("id", "instruction", "spreadsheet_path", "instruction_type", "answer_position")) -> DataFrame:
    keep = [c for c in rows.columns if c != "m"]
    return rows.select(*keep, *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")).alias(k) for k in known], F.map_filter("m", lambda k, v: ~k.isin(*known)).alias("metadata"))


def _text_files(reader, path: str, stored: bool) -> DataFrame:
    """(file, text): the whole text of each file; of ``stored`` ones as ``write_texts`` has put them down."""
    if stored:
        return reader.schema("file string, text string").json(path)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_logs(spark: SparkSession, path: str, seeds: bool = False, stored: bool = False) -> DataFrame:
    """(file_name, text, instance_id, outcome) of a folder's logs; with ``seeds`` of its seed_* folders, and their ``seed``.

    Logs are files, or, if ``stored``, what ``write_texts`` has written by (seed and) file_name."""
    rows = _text_files(spark.read, path if stored or not seeds else f"{path}/seed_*", stored)
    if stored:
        rows = rows.where(F.size(F.split("file", "/")) == 1 + seeds)
    rows = rows.withColumn("file_name", F.element_at(F.split("file", "/"), -1)).where(F.endswith("file_name", F.lit(".md")))
    if seeds:
        rows = rows.withColumn("seed", F.element_at(F.split("file", "/"), -2))
    return rows.select("*", *log_outcome("file_name")).drop("file").where("instance_id is not null")


def report_id(path) -> list:
    """``instance_id`` and ``in_directory`` of a report's path; null for files that are none (prompts, others)."""
    inside = F.nullif(F.regexp_extract(path, r"([^/]+)/analysis_report\.md$", 1), F.lit(""))
    flat = F.nullif(F.regexp_extract(path, r"(?:error|success)_analysis_([^/]+?)\.md$", 1), F.lit(""))
    one = F.coalesce(inside, F.when(~F.endswith(flat, F.lit("_prompt")), flat))
    return [one.alias("instance_id"), inside.isNotNull().alias("in_directory")]


def read_reports(spark: SparkSession, path: str, stored: bool = False) -> DataFrame:
    """(instance_id, in_directory, report) of a folder of reports, flat or a folder for each instance; or, if ``stored``, of what
    ``write_texts`` has written by folder and file_name."""
    reader = spark.read if stored else spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    rows = _text_files(reader, path, stored)
    return rows.select(*report_id("file"), F.col("text").alias("report")).where("instance_id is not null")


def read_calls(spark: SparkSession, prompts: str, responses: str) -> DataFrame:
    """Model calls: prompts with the responses of the same index."""
    a = spark.read.schema(CALL).json(prompts).drop("usage")
    b = spark.read.schema("call_index int, content string, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>").json(responses)
    return a.join(b, "call_index", "left")
