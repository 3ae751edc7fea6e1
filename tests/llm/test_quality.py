"""Line rules against a plain reading of them, and their edge cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.llm import quality

from test_llm import ODD, odd, table

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = SPACE.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    twice = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    seen, dup, removed, gone_chars, lines = set(), 0, 0, 0, 0
    for line in t.split("\n"):
        x = SPACE.findall(line)
        if not x:
            continue
        lines += 1
        again = line in seen
        seen.add(line)
        dup += again
        stops = sum(bool(re.search(quality.ENDS, v)) for v in x)
        parts = sum(bool(re.search(quality.SEPARATOR, v)) for v in x)
        pages = sum(bool(re.search(quality.PAGE, v)) for v in x)
        marks = sum(line.count(c) for c in "#*$%&|<>")
        gone = 10 * marks > len(x) or not stops or (len(x) >= 3 and 2 * stops > len(x))
        gone |= (parts >= 2 and 5 * parts >= len(x)) or (len(x) <= quality.MENU and pages > 0 and pages + parts == len(x))
        gone |= again or (len(x) <= quality.SHORT_LINE and bool(re.search(quality.PHRASE, line)))
        removed += gone
        gone_chars += gone * sum(map(len, x))
    chars = sum(map(len, w))
    failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
    return (len(w), chars, sum(t.count(c) for c in "#*$%&|<>"), dup, len(twice), failed, lines, removed, gone_chars, not failed and gone_chars <= quality.LOSS * chars)


def some(rng):
    kinds = [
        lambda: " ".join(rng.choice(["wörd", "the", "of", "漢字", "a"]) + rng.choice(["", "", "."]) for _ in range(rng.randrange(1, 30))) + ".",
        lambda: "Home | About | Contact",
        lambda: rng.choice(["Next", "home:", "LOGIN / Menu", "All Rights Reserved.", "We use of cookies here. Yes.", "» «", "", "  \t", "same line. again and again"]),
        lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60))) + rng.choice(["!", "?”", "。", "...", " &&& ***"]),
    ]
    return "\n".join(rng.choice(kinds)() for _ in range(rng.randrange(12))) + rng.choice(["", "\n", " "])


def test_same_as_plain_rules(spark):
    rng = random.Random(11)
    rows = [(i, some(rng)) for i in range(300)] + [(1000 + i, x[1]) for i, x in enumerate(ODD)] + [(None, "a b. c"), (2000, "a b c " * 40), (2001, "\v\f\r\x1c x y  z.\n" * 3)]
    got = quality.report(table(spark, rows, "doc_id long, text string"))
    assert sorted((x[0] or -1, *x[1:]) for x in got.collect()) == sorted((i or -1, *brute(t)) for i, t in rows)


@pytest.mark.parametrize("kinds", [5, 1 << 21])
def test_repeats_with_many_words(kinds):
    rng = random.Random(2)
    import numpy as np

    ids = np.array([rng.randrange(5) + (kinds - 5) for _ in range(200)], np.int64)
    w = ids.tolist()
    grams = Counter(zip(w, w[1:], w[2:]))
    assert quality._repeated(ids, np.array([0, 0, 200]), kinds)[1] == len({i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)})


def test_clean(spark):
    good = "\n".join(f"Line {i} tells some{i} people of {i * 7} things and {i * 11} more." for i in range(12))
    junk = "\n".join("Home | About | Contact" for _ in range(40))
    rows = [(1, f"{good}\nHome | About | Contact\nAll rights reserved.", "en", "a", 1), (2, f"{good}\n{junk}", "en", "a", 1), (3, good, None, None, None), (3, good, None, None, None)]
    docs = table(spark, rows).withColumns({"kept": F.lit("x"), "TEXT_": F.lit("y")})
    out = quality.clean(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, good), (3, good), (3, good)]
    assert quality.clean(odd(spark)).where("doc_id < 5").count() == 0
    assert quality.report(table(spark, [])).count() == 0 and quality.clean(table(spark, [])).count() == 0
    assert quality.report(odd(spark)).count() == len(ODD)
