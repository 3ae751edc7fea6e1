"""Language identification by rank-order profiles.

A profile is the ``PROFILE`` most frequent character 1- to 3-grams of a language's
texts, in order.  A document's own most frequent n-grams are compared with each
profile: every n-gram adds the difference of its two ranks, or ``PROFILE`` where
the profile has not got it (the out-of-place distance).  The language of the least
distance is the prediction.

n-grams are taken inside words padded with one blank on either side, of lower-cased
letters.  Training counts every training document, in Spark (per-piece counts, then
a map-side combined sum); only ``PROFILE`` rows a language come to the driver.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T
from .session import cut, held_slice, positional

PROFILE = 300
#: Languages whose profiles are sent to the tasks at once.
LANGUAGES = 256
_BITS, _ROWS = 18, 1000
_BREAK = 1


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> 2, 3, ... for letters, 1 for anything else, 0 for the mark between documents."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    out = np.where(letter, np.cumsum(letter) + 1, _BREAK).astype(np.uint64)
    out[0] = 0
    return out


def grams(texts: list[str | None], owner: np.ndarray) -> np.ndarray:
    """Every n-gram of every text as a key: the owner (a small number) of the text above three letters of 18 bits."""
    joined = "\0".join((t or "").replace("\0", " ") for t in texts).lower()
    c = _letters()[np.frombuffer(f"\0{joined}\0".encode("utf-32-le"), np.uint32)]
    gap = c == _BREAK
    c = c[~(gap & np.concatenate(([False], gap[:-1])))]
    doc = np.cumsum(c == 0) - 1
    c = np.maximum(c, _BREAK)
    is_letter = c > _BREAK
    mine = owner[np.minimum(doc, len(owner) - 1)].astype(np.uint64) << np.uint64(3 * _BITS)
    b, bb = np.uint64(_BITS), np.uint64(2 * _BITS)
    one = (mine | c << bb)[is_letter]
    left = is_letter[1:] | is_letter[:-1]
    two = (np.where(is_letter[:-1], mine[:-1], mine[1:]) | c[:-1] << bb | c[1:] << b)[left]
    three = (mine[1:-1] | c[:-2] << bb | c[1:-1] << b | c[2:])[is_letter[1:-1]]
    return np.concatenate((one, two, three))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _small(batches):
    for batch in batches:
        for rows, _, _ in T.pieces(batch, limit=1 << 20):
            for i in range(0, rows.num_rows, _ROWS):
                yield rows.slice(i, _ROWS)


_GRAM = np.uint64((1 << 3 * _BITS) - 1)


def _count(batches):
    for rows in _small(batches):
        names, owner = np.unique(np.array(rows.column("lang").to_pylist(), object).astype(str), return_inverse=True)
        keys, n = _counted(grams(rows.column("text").to_pylist(), owner))
        yield pa.RecordBatch.from_arrays([pa.array(names[(keys >> np.uint64(3 * _BITS)).astype(np.int64)].tolist(), pa.string()), pa.array((keys & _GRAM).view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0) of the most frequent n-grams of each non-null lang; ties by n-gram."""
    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", place - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


class Ranker:
    """The profiles as arrays: sorted n-grams and their rank in each language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.langs = sorted({r[0] for r in rows})
        self.size = size
        self.known = np.unique(np.array([r[1] for r in rows], np.int64).view(np.uint64)) if rows else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.known) + 1, len(self.langs)), -1, np.int32)
        for lang, gram, rank in rows:
            self.rank[np.searchsorted(self.known, np.uint64(gram)), self.langs.index(lang)] = rank

    def least(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its different n-grams that count, the least distance to a language, and that language (-1 without letters)."""
        n = len(texts)
        used, distance, best = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
        keys, count = _counted(grams(texts, np.arange(n)))
        if not len(keys) or not self.langs:
            return used, distance, best
        doc = (keys >> np.uint64(3 * _BITS)).astype(np.int64)
        order = np.lexsort((-count, doc)) if count.max() >= 1 << 24 else np.argsort((doc << 24) - count, kind="stable")
        first = np.searchsorted(doc, np.arange(n + 1))
        place = np.arange(len(keys)) - first[doc]
        top = place < self.size
        gram, doc, place = (keys & _GRAM)[order][top], doc[top], place[top]
        at = np.minimum(np.searchsorted(self.known, gram), max(len(self.known) - 1, 0))
        at = np.where(self.known[at] == gram, at, len(self.known))
        has, starts = np.unique(doc, return_index=True)
        used[has] = np.diff(np.append(starts, len(doc)))
        for low in range(0, len(self.langs), 16):  # some languages at a time
            rank = self.rank[at, low : low + 16]
            total = np.add.reduceat(np.where(rank < 0, self.size, np.abs(rank - place[:, None])), starts)
            k = total.argmin(1)
            mine = total[np.arange(len(k)), k]
            nearer = (best[has] < 0) | (mine < distance[has])
            best[has[nearer]], distance[has[nearer]] = k[nearer] + low, mine[nearer]
        return used, distance, best


def fit(docs: DataFrame, size: int = PROFILE, most: int = LANGUAGES) -> list[Ranker]:
    """Profiles of the labelled rows of docs(text, lang), ready to be sent to tasks, ``most`` languages at a time."""
    top = cut(profiles(docs, size))
    langs = [r.lang for r in top.select("lang").distinct().orderBy("lang").collect()]
    blocks = [langs[i : i + most] for i in range(0, len(langs), most)]
    rows = [top.where((F.col("lang") >= b[0]) & (F.col("lang") <= b[-1])).collect() for b in blocks]
    return [Ranker([(r.lang, r.gram, r.rank) for r in x], size) for x in rows] or [Ranker([], size)]


def identify(docs: DataFrame, models: list[Ranker]) -> DataFrame:
    """docs with ``lang_pred`` and ``score``: 1 - distance / greatest possible distance, 0 to 1.

    ``und`` with score 0 where the text is null or has no letters (or nothing was
    learned).  Ties go to the first language by name.  Whole texts are used; repeated rows
    are treated alike; other columns pass through, those named ``lang_pred`` or ``score`` are replaced."""
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    out = docs.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", lang_pred string, score double"

    def run(batches):
        for rows in _small(batches):
            texts = rows.column("text").to_pylist()
            lang, near = np.full(len(texts), "und", object), np.full(len(texts), np.iinfo(np.int64).max)
            for m in models:
                used, distance, best = m.least(texts)
                nearer = np.flatnonzero((best >= 0) & (distance < near))
                near[nearer] = distance[nearer]
                lang[nearer] = np.array(m.langs, object)[best[nearer]] if len(nearer) else ()
            most = np.maximum(used * models[0].size, 1)
            score = np.where(lang == "und", 0.0, np.clip(1 - np.minimum(near, most) / most, 0, 1))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], names=[*rows.schema.names, "lang_pred", "score"])

    return out.mapInArrow(run, fields)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from the other two thirds.

    A null id is neither held out nor learned from; null texts are ``und``; repeated rows each get a row; an
    empty table gives none; other columns are ignored."""
    held = (held_slice("doc_id", 3) == 1).alias("held_out")
    model = fit(docs.where(held_slice("doc_id", 3).isin(0, 2)))
    return identify(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score")


#: Similarity below which a text is like no learned language.
LEAST = 0.05


def keep_known(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents with letters whose similarity to some language is ``least`` or more; columns as given, whatever their names.

    Null and empty texts, and those without letters, go; repeated rows are judged alike.  Profiles are learned from the rows
    with a lang (not null) and an id outside the held-out third; where there are none, nothing is known and nothing stays."""
    rows, new, names = positional(docs, "doc_id", "text", "lang")
    rows = rows.withColumnsRenamed({v: k for k, v in new.items()})
    model = fit(rows.where(held_slice("doc_id", 3).isin(0, 2)))
    found = identify(rows, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.drop("lang_pred", "score").toDF(*names)
