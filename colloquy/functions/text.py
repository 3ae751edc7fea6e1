"""Column functions over utterances, slot values and model responses."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that count as digits, and the spellings of "any value is fine".
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20",
}
DONT_CARE = ("dont care", "doesn't care", "do not care")

# The spelling fixes of utterances, in order.
GRAMMAR = ((" Im ", " I'm "), (" im ", " i'm "), ("^Im ", "I'm "), ("^im ", "i'm "), ("theres", "there's"), ("dont", "don't"), ("whats", "what's"), ("thats", "that's"))

#: Java's white space classes follow Unicode only with (?U).
_SPACE = r"(?U)\s"


def strip(c: Column) -> Column:
    """Without white space at either end (tabs and Unicode blanks too)."""
    return F.regexp_replace(c, rf"{_SPACE}+\z|(?U)\A\s+", "")


def _trimmed(c: Column) -> Column:
    """Lower case, stripped, then trailing ``.,;:!?`` gone; one pattern does both."""
    return F.regexp_replace(F.lower(c), r"(?U)\A\s+|[.,;:!?]*\s*\z", "")


def _folded(v: Column) -> Column:
    """Don't-care spellings, number words, and runs of white space to one blank, which only values with such a run pay for."""
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    blanks = F.when(v.rlike(r"(?U)\s\s|[^\S ]|\A\s|\s\z"), F.regexp_replace(strip(v), rf"{_SPACE}+", " ")).otherwise(v)
    return F.when(v.isin(*DONT_CARE), "dontcare").otherwise(F.coalesce(F.try_element_at(words, v), blanks))


def norm_value(c) -> Column:
    """A slot value in comparable form.

    In this order: lower case, stripped, trailing ``.,;:!?`` gone, don't-care spellings, number
    words (before blanks are folded: ``one .`` stays a word), runs of white space to one blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.element_at(F.transform(F.array(_trimmed(c)), _folded), 1)


def value_matches(pred, truth) -> Column:
    """Whether a predicted value equals one of the ``|`` alternatives of the truth; false for no prediction."""
    pred, truth = (F.col(c) if isinstance(c, str) else c for c in (pred, truth))
    either = F.transform(F.transform(F.split(truth, r"\|"), _trimmed), _folded)
    return F.coalesce(pred.isNotNull() & F.array_contains(either, norm_value(pred)), F.lit(False))


def fix_grammar(c) -> Column:
    """Utterance with missing apostrophes put in."""
    c = F.col(c) if isinstance(c, str) else c
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), GRAMMAR, c)


def strip_spans(c) -> Column:
    """Utterance without <span> marks."""
    return F.regexp_replace(c, r"<span[^>]*>|</span>", "")


def after_think(c) -> Column:
    """What follows the last ``</think>``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?s)\A.*</think>", "")


def strip_fences(c) -> Column:
    """A text that is one fenced block without its fences; any other stripped."""
    t = strip(F.col(c) if isinstance(c, str) else c)
    inner = F.regexp_replace(F.regexp_replace(t, r"\A```\w*\n?", ""), r"\n?```\z", "")
    return F.when(t.startswith("```") & t.endswith("```"), inner).otherwise(t)


def strip_log(c) -> Column:
    """A log without its header and its result section."""
    # The header and the result mark of the log format.
    c = F.col(c) if isinstance(c, str) else c
    body = F.regexp_replace(c, r"\A# Chat History[^\n]*\n\n\*\*Timestamp\*\*:[^\n]*\n\n---\n\n", "")
    return strip(F.regexp_replace(body, r"(?s)\n---\n\n## RESULT\n.*\z", ""))


def before_result(c) -> Column:
    """A log without blanks and header at its start, from the first ``## RESULT`` on, and rules at its end."""
    c = F.col(c) if isinstance(c, str) else c
    # The header and the result mark of the log format.
    body = F.regexp_replace(F.regexp_replace(c, r"(?U)\A\s+", ""), r"\A# Chat History[^\n]*\n\n\*\*Timestamp\*\*:[^\n]*\n\n---\n\n", "")
    end = r"(?U)\s+\z"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring_index(body, "## RESULT", 1), end, ""), r"\n---\z", ""), end, "")


def keyword_domains(c) -> Column:
    """Names of bookable domains that a text mentions, in fixed order."""
    low = F.lower(c)
    return F.filter(F.array(F.lit("Hotel"), F.lit("Restaurant"), F.lit("Train")), lambda d: F.contains(low, F.lower(d)))


def safe_tag(c, most: int = 80) -> Column:
    """A text as part of a file name."""
    return F.left(F.regexp_replace(c, r"[^\p{L}\p{N}_.\-]", "_"), F.lit(most))


def elide_middle(c, limit: int = 6000, side: int = 3000, action=None, whole: tuple[str, ...] = ()) -> Column:
    """Texts over the limit as their two ends around a note of what is left out.

    Whole stays what an ``action`` (a column) gave that names one of the patterns of ``whole``."""
    c = F.col(c) if isinstance(c, str) else c
    # Fixed value: the note, which later steps look for.
    note = F.concat(F.lit(f"\n\n[WARNING: Output truncated. Showing first {side} and last {side} characters. "), (F.length(c) - 2 * side).cast("string"), F.lit(" characters elided.]\n\n"))
    long = F.length(c) > limit
    if action is not None and whole:
        action = F.coalesce(F.col(action) if isinstance(action, str) else action, F.lit(""))
        long = long & ~reduce(lambda a, b: a | b, [action.contains(x) for x in whole])
    return F.when(long, F.concat(F.left(c, F.lit(side)), note, F.right(c, F.lit(side)))).otherwise(c)


def first_fence(c) -> Column:
    """The first fenced block's body (one marked json before others), else the whole text."""
    c = F.col(c) if isinstance(c, str) else c
    block = lambda mark: strip(F.split_part(F.split_part(c, F.lit(mark), F.lit(2)), F.lit("```"), F.lit(1)))
    return F.when(c.contains("```json"), block("```json")).when(c.contains("```"), block("```")).otherwise(strip(c))


def patch_payload(c) -> Column:
    """From the first line that opens a ``json`` fence to the last line that closes one; null if none does.  Without such a
    fence the whole text, if it begins with a brace, else null."""
    c = F.col(c) if isinstance(c, str) else c
    # How fences open and close.
    opens, shut = r"```json[^\n]*\n", r"(?dm:^)```[ \t]*\r?(?dm:$)"
    tail = F.regexp_extract(c, rf"(?s){opens}(.*)", 1)
    body = F.when(tail.rlike(shut), strip(F.regexp_extract(tail, rf"(?s)\A(.*){shut}", 1)))
    return F.when(c.rlike(opens), body).when(strip(c).startswith("{"), strip(c))


def references(c) -> Column:
    """Reference paths that a text mentions, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"references/[\w.\-]+\.md"), F.lit(0)))


def front_matter(c) -> Column:
    """struct(name, description, body) of a text that opens with a ``---`` block; body is all of any other.

    The opening line may end in blanks; a value may stand in quotes, which go, and ends with its line or at a quote."""
    c = F.col(c) if isinstance(c, str) else c
    # The marks of the block and of its values.
    block = r"(?sU)\A---\s*\n(.*?)\n---"
    head = F.regexp_extract(c, block, 1)
    field = lambda k: strip(F.regexp_extract(head, rf"(?dmU)^{k}:\s*[\"']?([^\"'\n]+)", 1))
    return F.struct(field("name").alias("name"), field("description").alias("description"), strip(F.regexp_replace(c, block, "")).alias("body"))


def response_parts(c) -> Column:
    """struct(action, arguments, reply) of an agent's response.

    The action is query_db or final; arguments are the JSON object up to the last brace, null if it is
    none; all are null or empty where no action is named."""
    c = F.col(c) if isinstance(c, str) else c
    # The marks of the response format.
    action = F.lower(F.regexp_extract(c, r"(?i)ACTION:\s*(query_db|FINAL)", 1))
    args = F.regexp_extract(c, r"(?s)ARGUMENTS:\s*(\{.*\})", 1)
    reply = strip(F.regexp_extract(c, r"(?s)RESPONSE:\s*(.+?)(?=\nARGUMENTS:|\n\z)", 1))
    named = action != ""
    return F.struct(
        F.when(named, action).alias("action"),
        F.when(named, F.coalesce(F.from_json(args, "map<string,string>"), F.create_map().cast("map<string,string>"))).alias("arguments"),
        F.when(named, reply).otherwise("").alias("reply"),
    )


def issues(*checks: tuple[Column, str]) -> Column:
    """The texts of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in checks]), lambda x: x.isNotNull())


# What marks a reply as a provider's error that is worth another try; a provider's own messages are given besides.
TRANSIENT = (r"\b429\b", "resource exhausted", "resource_exhausted", "rate limit", "too many requests")


def canonical_json(c: Column) -> Column:
    """A value as JSON with the keys of every object in order, whatever the order of its fields."""
    return F.to_json(F.parse_json(F.to_json(c)))


def cache_key(model, messages) -> Column:
    """Key of a model call: model and the messages as canonical JSON."""
    return F.sha2(F.concat_ws("\n", model, canonical_json(F.col(messages) if isinstance(messages, str) else messages)).cast("binary"), 256)


def is_transient(c, marks: tuple[str, ...] = TRANSIENT) -> Column:
    """Whether a reply has one of the marks (patterns, of lower-case letters)."""
    return F.lower(c).rlike("|".join(marks))


def clock(c) -> Column:
    """HH:MM as hours times 100 plus minutes; null for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    ok = c.rlike(r"^\s*\d+:\d+")
    part = lambda i: F.try_to_number(F.regexp_extract(c, r"(\d+):(\d+)", i), F.lit("999999")).cast("int")
    return F.when(ok, part(1) * 100 + part(2))


def rendered(template: str, defaults: dict[str, str] | None = None) -> Column:
    """A template with ``{column}`` places filled in; a null is its default, or ''."""
    parts = re.split(r"\{(\w+)\}", template)
    fill = [F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit((defaults or {}).get(p, ""))) for i, p in enumerate(parts)]
    return F.concat(*fill)
