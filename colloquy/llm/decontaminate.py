"""Benchmark decontamination by winnowing.

A *window* is 10 consecutive words of a benchmark item; an item of fewer words,
but not none, is one window.  A document word inside any occurrence of a window
is *hit*.  Documents and items are fingerprinted alike: of the hashes of all
k-grams, every sliding window of w keeps its smallest (winnowing).  Two texts
that share ``k + w - 1 = 10`` consecutive words therefore share a kept
fingerprint at the same offset inside the shared span, so joining fingerprints
finds every such span; each join hit is then extended word by word in both
directions and counts only if the run reaches the window's length.

Items shorter than a window get k = their length and w = 1 (each k-gram is
kept), once per such length.

Plan: the benchmark is cut into blocks of bounded size; the blocks are sent to
the tasks and joined there with the fingerprints of whole documents, which never
move and are made once: one narrow pass.  A benchmark of more than ``CHAIN`` blocks first meets the documents'
fingerprints in a shuffled join, which leaves only the items that share one; a pass takes ``CHAIN`` blocks of them, and
a bitmap of hit words and the list of items go from pass to pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .session import cut, positional

WINDOW, GRAM = 10, 5
#: Bytes of benchmark text in one block that is sent to the tasks.
BLOCK = 8 << 20
#: Blocks that one pass over the documents takes.
CHAIN = 6


def winnow(grams: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the smallest (the rightmost, on ties) of some
    window of w grams of its document; of fewer than w grams, of them all."""
    n = len(grams)
    if n == 0 or w == 1:
        return np.arange(n)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    pos = np.arange(n)
    best, arg = grams.copy(), pos.copy()
    for i in range(1, w):
        ahead = np.minimum(pos + i, n - 1)
        better = (grams[ahead] <= best) & (doc[ahead] == doc) & (pos + i < n)
        arg[better] = ahead[better]
        best[better] = grams[ahead][better]
    last = first[1:][doc]
    whole = (pos + w <= last) | (pos == first[:-1][doc])
    keep = np.zeros(n, bool)
    keep[arg[whole]] = True
    return np.flatnonzero(keep)


def fingerprints(w: T.Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-gram hashes and the index of each one's first word."""
    full = T.rolling(w.hashes, k)
    n = w.counts
    per = np.maximum(n - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)[: len(full)]
    word = np.flatnonzero(w.first[1:][doc] - np.arange(len(full)) >= k)
    grams = full[word]
    kept = winnow(grams, np.concatenate(([0], np.cumsum(per))), window)
    return grams[kept], word[kept]


class Block:
    """Fingerprints of some benchmark items, by gram length."""

    def __init__(self, ids: list[str], texts: list[str]):
        data, offsets = T.text_bytes(pa.array(texts, pa.large_string()))
        w = T.words_of(data, offsets)
        self.ids, self.words, self.first = ids, w.hashes, w.first
        self.by_length = []
        n = w.counts
        for length in sorted({*n[(n > 0) & (n < WINDOW)].tolist(), *([WINDOW] if (n >= WINDOW).any() else [])}):
            k, win = (GRAM, WINDOW - GRAM + 1) if length == WINDOW else (length, 1)
            fp, at = fingerprints(w, k, win)
            item = np.searchsorted(self.first, at, "right") - 1
            mine = n[item] >= WINDOW if length == WINDOW else n[item] == length
            fp, at = fp[mine], at[mine]
            order = np.argsort(fp, kind="stable")
            self.by_length.append((length, k, win, fp[order], at[order]))

    def hits(self, w: T.Words, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of document words [low, high) inside a window's occurrence, and each run's item.

        ``known`` keeps the documents' fingerprints from block to block."""
        out = [(np.zeros(0, np.int64),) * 3]
        for length, k, win, fp, at in self.by_length:
            if (k, win) not in known:
                known[k, win] = fingerprints(w, k, win)
            have, word = known[k, win]
            low, high = np.searchsorted(fp, have, "left"), np.searchsorted(fp, have, "right")
            for some in _portions(np.flatnonzero(high > low), (high - low)):
                n = (high - low)[some]
                d = np.repeat(word[some], n)
                b = at[np.repeat(low[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                out.append(self._extend(w, d, b, k, length))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _extend(self, w: T.Words, d: np.ndarray, b: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item = np.searchsorted(self.first, b, "right") - 1
        doc = np.searchsorted(w.first, d, "right") - 1
        same = (w.hashes[d[:, None] + np.arange(k)] == self.words[b[:, None] + np.arange(k)]).all(1)
        d, b, item, doc = d[same], b[same], item[same], doc[same]
        back, on = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
        for step, room_d, room_b, got in ((-1, d - w.first[doc], b - self.first[item], back), (1, w.first[doc + 1] - d - k, self.first[item + 1] - b - k, on)):
            live = np.arange(len(d))
            for i in range(1, length - k + 1):
                live = live[(room_d[live] >= i) & (room_b[live] >= i)]
                at = -i if step < 0 else k - 1 + i
                live = live[w.hashes[d[live] + at] == self.words[b[live] + at]]
                if not len(live):
                    break
                got[live] = i
        ok = back + k + on >= length
        return (d - back)[ok], (d + k + on)[ok], item[ok]


def _portions(rows: np.ndarray, n: np.ndarray, limit: int = 1 << 18):
    """rows in runs whose n add up to about ``limit``, so that the pairs of a hot fingerprint fit in memory."""
    low, total = 0, np.cumsum(n[rows])
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + limit, "right")))
        yield rows[low:high]
        low = high


def _pass(blocks: list[Block]):
    """Marks the words of each batch that some block hits; documents are parted into words and fingerprinted once."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in T.pieces(batch):
                w = T.words_of(data, offsets)
                edge = np.zeros(len(w.hashes) + 1, np.int32)
                found: dict[int, set] = {}
                known: dict = {}
                for block in blocks:
                    low, high, item = block.hits(w, known)
                    np.add.at(edge, low, 1)
                    np.add.at(edge, high, -1)
                    doc = np.searchsorted(w.first, low, "right") - 1
                    for d, i in set(zip(doc.tolist(), item.tolist(), strict=True)):
                        found.setdefault(d, set()).add(block.ids[i])
                hit = np.cumsum(edge)[:-1] > 0
                bits, items = [], []
                columns = dict(zip(rows.schema.names, rows.columns, strict=True))
                old = (columns["__hit"].to_pylist(), columns["__items"].to_pylist())
                for d in range(rows.num_rows):
                    mine = hit[w.first[d] : w.first[d + 1]]
                    if old[0][d]:
                        mine = mine | np.unpackbits(np.frombuffer(old[0][d], np.uint8), count=len(mine)).astype(bool)
                    bits.append(np.packbits(mine).tobytes() if mine.any() else None)
                    items.append(sorted(found.get(d, set()) | set(old[1][d] or ())))
                columns |= {"__n_words": pa.array(w.counts, pa.int64()), "__hit": pa.array(bits, pa.binary()), "__items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _kinds(lengths: list[int]) -> list[tuple[int, int]]:
    """(k, w) of the fingerprints that items of these lengths (WINDOW at most) need."""
    return [(GRAM, WINDOW - GRAM + 1) if n == WINDOW else (n, 1) for n in lengths]


def _prints(kinds: list[tuple[int, int]], column: str):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in T.pieces(batch):
                w = T.words_of(data, offsets)
                for k, win in kinds:
                    fp, at = fingerprints(w, k, win)
                    doc = np.searchsorted(w.first, at, "right") - 1
                    fp = T.mix(fp + np.uint64(k))
                    if column:
                        yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), rows.column(column).take(pa.array(doc))], names=["fp", column])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(fp).view(np.int64))], names=["fp"])

    return run


def met(items: DataFrame, docs: DataFrame) -> DataFrame:
    """The items(id, text) that have a fingerprint in common with some document: both sides' fingerprints are made once
    and meet in a shuffled join, so that of a benchmark of any size only these go to the tasks."""
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    lengths = [r[0] for r in items.select(F.least(words, F.lit(WINDOW)).alias("n")).where("n > 0").distinct().collect()]
    kinds = _kinds(sorted(lengths))
    have = docs.select("text").mapInArrow(_prints(kinds, ""), "fp long").distinct()
    of = items.mapInArrow(_prints(kinds, "id"), "fp long, id string").distinct()
    return items.join(of.join(have, "fp", "left_semi").select("id").distinct(), "id", "left_semi")


def _one_after_the_other(steps: list):
    """The steps as one, each working on the batches of the one before it: one Python worker a task."""

    def run(batches):
        for step in steps:
            batches = step(batches)
        return batches

    return run


def hit_words(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, last=None, schema=None) -> DataFrame:
    """The documents with ``__n_words`` long, ``__hit`` (bits of the words that are hit,
    null if none is) and ``__items`` (sorted ids of items with occurring windows); with
    ``last`` what that function makes of these batches, of the given schema.

    Nulls: a null text has no words; items without words or without an id never
    match.  Repeated rows are each marked; columns of the documents pass through (none may have these three names)."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("id"), "text")

    def blocks_of(rows: DataFrame) -> int:
        total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
        return max(1, -(-total[0] // block), -(-total[1] // 500_000))

    n = blocks_of(items)
    if n > CHAIN:
        items = cut(met(items, docs))
        n = blocks_of(items)
    out = docs.withColumns({"__n_words": F.lit(0).cast("long"), "__hit": F.lit(None).cast("binary"), "__items": F.array().cast("array<string>")})
    chain = []
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).orderBy("id").collect()
        chain.append(Block([r.id for r in rows], [r.text for r in rows]))
        if len(chain) == CHAIN and i < n - 1:
            out, chain = cut(out.mapInArrow(_pass(chain), out.schema)), []
    return out.mapInArrow(_one_after_the_other([_pass(chain), *([last] if last else [])]), schema or out.schema)


def report(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Nulls and repeated rows as in ``hit_words``; a null id keeps its row; an empty table gives none, and no benchmark no hits."""
    return hit_words(docs.select("doc_id", "text"), benchmark, block, _digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _digest(batches):
    for b in batches:
        n_hit = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) if x else 0 for x in b.column("__hit").to_pylist()]
        items = b.column("__items").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), b.column("__n_words"), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([x > 0 for x in n_hit])],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def clean(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.5, block: int = BLOCK) -> DataFrame:
    """The documents with hit words cut out of their text; a document of which
    ``least_share`` or more of the words is hit goes.  Others stay as they are, null, empty and repeated rows too; columns may
    have any names, and an empty table stays empty."""
    rows, new, names = positional(docs, "text")
    rows = rows.withColumnsRenamed({new["text"]: "text"})
    return hit_words(rows, benchmark, block, _cut_out(least_share), rows.schema).toDF(*names)


def _cut_out(least_share: float):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in T.pieces(batch):
                marks = rows.column("__hit").to_pylist()
                texts, keep = rows.column("text").to_pylist(), np.ones(rows.num_rows, bool)
                if any(marks):
                    w = T.words_of(data, offsets)
                    for d, bits in enumerate(marks):
                        if not bits:
                            continue
                        a, b = w.first[d], w.first[d + 1]
                        hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                        if hit.mean() >= least_share:
                            keep[d] = False
                            continue
                        texts[d] = remove_words(data, offsets[d], offsets[d + 1], w.start[a:b], w.end[a:b], hit)
                names = [x for x in rows.schema.names if x not in ("__n_words", "__hit", "__items")]
                out = [pa.array(texts, pa.string()) if x == "text" else rows.column(x) for x in names]
                yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(keep))

    return run


def remove_words(data: np.ndarray, low: int, high: int, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> str:
    """The text without the words marked as gone: from each run's first word up to the next kept word."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    out, at = [], low
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(data[at : start[a]])
        at = start[b] if b < len(start) else high
    out.append(data[at:high])
    return np.concatenate(out).tobytes().decode("utf-8")
