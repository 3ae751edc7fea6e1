"""Benchmark results: cell ranges, cell comparison, case, instance and run scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A spreadsheet cell: kind is number, time, datetime, string or empty.
CELL = "kind string, num double, str string, ts timestamp"


def column_number(letters: Column) -> Column:
    """A = 1, Z = 26, AA = 27 ..."""
    digits = F.transform(F.split(letters, ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(F.filter(digits, lambda x: x > 0), F.lit(0), lambda n, x: n * 26 + x)


def column_letters(number: Column) -> Column:
    """The inverse, for up to three letters."""
    one = lambda n: F.char(F.lit(65) + (n - 1) % 26)
    up = lambda n: F.floor((n - 1) / 26)
    two, three = up(number), up(up(number))
    return F.concat(F.when(three > 0, one(three)).otherwise(""), F.when(two > 0, one(two)).otherwise(""), one(number))


def positions(df: DataFrame, column: str, first_sheet) -> DataFrame:
    """df with a row for each part of a comma list ``'Sheet'!A1:B2``: ``sheet`` (the first one, if it names none) and ``range``."""
    rows = df.withColumn("__part", F.explode(F.split(column, ","))).withColumn("__part", F.trim("__part"))
    named = F.contains("__part", F.lit("!"))
    bare = lambda c: F.regexp_replace(c, r"^'+|'+$", "")
    sheet = F.when(named, bare(F.split_part("__part", F.lit("!"), F.lit(1)))).otherwise(first_sheet)
    cells = bare(F.when(named, F.split_part("__part", F.lit("!"), F.lit(2))).otherwise(F.col("__part")))
    return rows.withColumns({"sheet": sheet, "range": cells}).drop("__part")


def cells_of(df: DataFrame, column: str = "range", max_row=None, max_column=None) -> DataFrame:
    """df with a row for each ``cell`` of its range.  Whole columns (``A:C``) and rows (``2:5``) end at the bounds given."""
    last = F.when(F.contains(column, F.lit(":")), F.split_part(column, F.lit(":"), F.lit(2))).otherwise(F.col(column))
    first = F.split_part(column, F.lit(":"), F.lit(1))
    letters = lambda c: F.upper(F.regexp_extract(c, "([A-Za-z]*)", 1))
    digits = lambda c: F.regexp_extract(c, r"(\d*)$", 1)
    number = lambda c, other: F.when(digits(c) == "", other).otherwise(digits(c).try_cast("int"))
    col = lambda c, other: F.when(letters(c) == "", other).otherwise(column_number(letters(c)))
    bound = lambda x: F.lit(x) if x is None or isinstance(x, int) else x
    c1, c2 = col(first, F.lit(1)), col(last, bound(max_column))
    r1, r2 = number(first, F.lit(1)), number(last, bound(max_row))
    rows = df.withColumn("__c", F.explode(F.sequence(c1.cast("int"), c2.cast("int")))).withColumn("__r", F.explode(F.sequence(r1.cast("int"), r2.cast("int"))))
    return rows.withColumn("cell", F.concat(column_letters(F.col("__c")), F.col("__r").cast("string"))).drop("__c", "__r")


def round_half_even(x: Column) -> Column:
    """To two decimals, exactly as the binary double is nearer (half to even).

    The hundredfold is kept as a sum of two doubles without an error: the rounded product and, from the two halves of
    the value's digits, what rounding took from it.  Where the product is on a half, the second one tells the side.
    From 2 ** 46 a double next to the rounded value is the value itself."""

    def rounded(v: Column) -> Column:
        high = v * 134217729.0 - (v * 134217729.0 - v)  # the upper 26 bits
        whole = v * 100.0
        rest = (high * 100.0 - whole) + (v - high) * 100.0
        near = F.rint(whole)
        off = whole - near
        cents = F.when((off == 0.5) & (rest > 0), near + 1).when((off == -0.5) & (rest < 0), near - 1).otherwise(near)
        return F.when(F.abs(v) < float(1 << 46), cents / 100.0).otherwise(v)

    return F.element_at(F.transform(F.array(x), rounded), 1)


def normal_cell(kind: Column, num: Column, text: Column, ts: Column) -> Column:
    """struct(kind, num, str): numbers and numeric texts to two decimals, date times to whole serial days, times to
    HH:MM; an empty text is an empty cell."""
    as_number = F.coalesce(F.when(kind == "number", num), F.when((kind == "string") & text.rlike(r"^\s*[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.regexp_replace(F.trim(text), "_", "").try_cast("double")))
    days = F.unix_micros(ts) / F.lit(86_400_000_000.0) + 25569
    n = F.when(kind == "datetime", F.rint(days)).otherwise(round_half_even(as_number))
    new = F.when(kind.isNull() | (kind == "empty") | (kind == "string") & (text == ""), "empty").when(n.isNotNull(), "number").otherwise(kind)
    s = F.when(new == "time", F.date_format(ts, "HH:mm")).when(new == "string", text)
    return F.struct(new.alias("kind"), F.when(new == "number", n).alias("num"), s.alias("str"))


def same_cell(a: Column, b: Column) -> Column:
    """Equality of two ``normal_cell`` structs; not-a-number equals nothing."""
    equal = F.when(a["kind"] == "number", ~F.isnan(a["num"]) & (a["num"] == b["num"])).when(a["kind"] == "empty", True).otherwise(a["str"] == b["str"])
    return F.coalesce((a["kind"] == b["kind"]) & equal, F.lit(False))


def compare_cells(wanted: DataFrame, truth: DataFrame, output: DataFrame) -> DataFrame:
    """wanted(workbook, sheet, cell) with ``expected``, ``actual`` and ``same``; a cell that a side has not got is null, that is, empty."""
    keys = ["workbook", "sheet", "cell"]
    rows = wanted.join(truth.select(*keys, F.col("value").alias("expected")), keys, "left").join(output.select(*keys, F.col("value").alias("actual")), keys, "left")
    return rows.withColumn("same", F.col("expected").eqNullSafe(F.col("actual")))


def case_scores(cases: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_passed, n_cases, soft, hard): the share of passed cases, and 1 if all passed."""
    by = cases.groupBy(*keys).agg(F.sum(F.col("passed").cast("int")).alias("n_passed"), F.count("*").alias("n_cases"))
    return by.withColumns({"soft": F.col("n_passed") / F.col("n_cases"), "hard": (F.col("n_passed") == F.col("n_cases")).cast("int")})


def benchmark_summary(results: DataFrame) -> DataFrame:
    """One row: accuracy over all result rows with a position, averages of soft and hard over those that were scored."""
    rows = results.where("has_position")
    hit = F.coalesce(F.col("hard") == 1, F.lit(False)).cast("int")
    return rows.agg(F.count("*").alias("n"), F.count("soft").alias("n_scored"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg("soft"), F.lit(0.0)).alias("soft"), F.coalesce(F.avg("hard"), F.lit(0.0)).alias("hard"))


def by_type(scores: DataFrame) -> DataFrame:
    """Averages overall (``all``) and for each instruction type ('' is ``unknown``), in one pass."""
    rows = scores.withColumn("instruction_type", F.when(F.coalesce("instruction_type", F.lit("")) == "", "unknown").otherwise(F.col("instruction_type")))
    out = rows.rollup("instruction_type").agg(F.count("*").alias("n"), F.avg("soft").alias("soft"), F.avg("hard").alias("hard"), F.grouping("instruction_type").alias("g"))
    return out.withColumn("instruction_type", F.when(F.col("g") == 1, "all").otherwise(F.col("instruction_type"))).drop("g")


def pass_any_all(scores: DataFrame) -> DataFrame:
    """One row over scores(instance_id, seed, hard): instances, those that pass in some and in all of their seeds."""
    by = scores.groupBy("instance_id").agg(F.bool_or(F.col("hard") == 1).alias("a"), F.bool_and(F.col("hard") == 1).alias("e"))
    return by.agg(F.count("*").alias("n"), F.count_if("a").alias("n_any"), F.count_if("e").alias("n_all"))


def run_summary(rows: DataFrame) -> DataFrame:
    """One row over rows(passed, log): total, passed, failed, with and without a log, and the success rate (0 for none)."""
    out = rows.agg(F.count("*").alias("total"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.count("log").alias("n_with_log"), F.count_if(F.col("log").isNull()).alias("n_without_log"))
    return out.withColumn("success_rate", F.coalesce(F.try_divide("n_passed", "total"), F.lit(0.0)))


def first_error(cases: DataFrame, *keys: str) -> DataFrame:
    """(keys, error): the top-level error unless blank, else the message of the first case that did not pass."""
    top = F.nullif(F.max("error"), F.lit(""))
    return cases.groupBy(*keys).agg(F.coalesce(top, F.min_by("message", F.when(~F.col("passed"), F.col("case_no")))).alias("error"))


def judge_averages(scores: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """(dimension, average, n) for each of the dimensions; nulls do not count, 0 where there is no score."""
    dims = scores.sparkSession.createDataFrame([(d,) for d in dimensions], "dimension string")
    by = scores.groupBy("dimension").agg(F.avg("score").alias("a"), F.count("score").alias("n"))
    return dims.join(by, "dimension", "left").select("dimension", F.coalesce("a", F.lit(0.0)).alias("average"), F.coalesce("n", F.lit(0)).alias("n"))


def judge_matrix(scores: DataFrame, judges: tuple[str, ...]) -> DataFrame:
    """(dialogue_id, dimension, a column for each judge): average scores."""
    return scores.groupBy("dialogue_id", "dimension").pivot("judge", list(judges)).agg(F.avg("score"))


def deltas(history: DataFrame, metric: str, order: str = "step") -> DataFrame:
    """history with ``delta``, the difference to the first step's metric."""
    base = history.agg(F.min_by(metric, order).alias("__base"))
    return history.join(F.broadcast(base)).withColumn("delta", F.col(metric) - F.col("__base")).drop("__base")
