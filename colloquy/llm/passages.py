"""Near-duplicate passages by compact windows.

A text is its sequence of word 5-shingles.  For a hash function, the node of the
Cartesian tree over the shingles' hashes that holds position c spans [l, r]: every
run of shingles inside [l, r] that contains c has its minimum, its min-hash, at c.
The compact windows of ``SPAN`` shingles or more (about 2 n / SPAN a text and
function) stand for all passages of that length.

1. One pass over the texts writes the windows; those of groups (function, min-hash) of two or more stay.
   The first window of a group leads it and every other one is paired with it: as many pairs as windows.
2. The pairs of two documents are joined as intervals, in the order of the text: windows
   that overlap or touch with about the same shift form a segment, which stays
   if ``MATCHES`` of the ``HASHES`` functions agree in it.
3. Segments are verified on the words themselves.  Documents give out the chunks of words that some
   segment needs, each chunk once, however many segments share it.  In a
   segment, runs of common shingles are taken together over short gaps and kept if
   the sets of shingles of the two passages have a Jaccard of 0.8; otherwise they
   are parted at the widest gap and tried again.  A run may take in up to four words beyond a changed
   word at its edge; one that is short of the least length by a few shingles is widened to it if
   the wider passages still have a Jaccard of 0.8.  (Here a word counts by 32 bits of its hash.)
4. The leader of a group may hold the min-hash in an unrelated place (a frequent line).  Groups in which
   some window is in no verified passage are therefore parted by contexts: hashes of the
   ``NEAR`` + 1 shingles from c - x to c + NEAR - x for x = 0, 5, .., NEAR, as far as they lie in the window.  Two windows
   that share a passage of SPAN shingles round c share one of these contexts, and all windows of
   a context share so many shingles that each verifies with the first one.  So one leader for each
   context is enough, no pass over pairs of members is needed, and no exact passage is lost.  Shorter contexts
   of ``FAR`` + 1 shingles give further leaders for passages with changed words.

Nothing is gathered by min-hash: hot groups meet only their leader (a small side, made by a
map-side combined minimum), in joins whose rows the engine may split further.

Exact copies of a text are one passage; they are found by hash beforehand and only
their first document goes through these steps.

A passage of ``WORDS`` words or more that occurred before, in a document of smaller
id or earlier in its own, is a repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T
from .decontaminate import remove_words
from .session import Stored, cut, if_small, positional

WORDS, SHINGLE, THRESHOLD = 50, 5, 0.8
SPAN = WORDS - SHINGLE + 1
HASHES, MATCHES = 4, 2
#: Shift in words that two neighbouring windows may differ by (insertions and deletions).
SLIP = 8
CHUNK = 64
#: Shingles on either side of a segment that are looked at, too.
WIDER = 24
#: Shingles without a counterpart that a passage may have in a row (two changed words).
GAP = 2 * SHINGLE
#: Shingles besides the min-hash in the two kinds of contexts.
NEAR, FAR = SPAN - 6, SPAN // 2 - 3
#: Shingles of a text whose segments are verified in one row.
PART = 1 << 16
_LEVELS = 12


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over [i, i + w) for every i that has a whole window."""
    step, out = 1, x
    while 2 * step <= w:
        out = f(out[:-step], out[step:])
        step *= 2
    rest = w - step
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def compact_windows(h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian tree's nodes that span ``span`` positions or more.

    h are different numbers; zeros part texts and no window reaches over them."""
    none = np.zeros(0, np.int64)
    if len(h) < span:
        return none, none, none
    least = _sliding(h, span, np.minimum)
    padded = np.concatenate((np.zeros(span - 1, h.dtype), least, np.zeros(span - 1, h.dtype)))
    c = np.flatnonzero((_sliding(padded, span, np.maximum) == h) & (h > 0))
    if not len(c):
        return none, none, none
    edge = np.zeros(1, h.dtype)
    x = np.concatenate((edge, h, edge))
    tables = [x]
    while len(tables) < _LEVELS and len(tables[-1]) > (1 << len(tables) - 1):
        s = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-s], tables[-1][s:]))
    at, low, high = x[c + 1], c + 1, c + 1
    for left in (True, False):
        p = c + 1
        live = np.arange(len(c))
        k = len(tables) - 1
        while k >= 0:
            q = p[live] - (1 << k) if left else p[live] + 1
            inside = (q >= 0) & (q < len(tables[k]))
            go = np.zeros(len(live), bool)
            go[inside] = tables[k][q[inside]] > at[live[inside]]
            p[live[go]] += -(1 << k) if left else 1 << k
            if k == len(tables) - 1 and go.any():
                live = live[go]
                continue
            live, k = np.arange(len(c)), k - 1
        if left:
            low = p
        else:
            high = p
    return low - 1, c, high - 1


def _parted(sh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of every shingle among all texts with a gap after each, and its text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.arange(len(sh)) + doc, doc


_WINDOW = "key long, doc_id long, c int, l int, r int"


def _windows(span: int):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in T.pieces(batch):
                sh, first = T.shingles(T.words_of(data, offsets), SHINGLE)
                place, doc = _parted(sh, first)
                tie = T.mix((np.arange(len(sh)) - first[doc]).astype(np.uint64)) & np.uint64(0xFFFFFF)
                ids = rows.column("doc_id").to_numpy()
                for f in range(HASHES):
                    h = T.mix(sh + np.uint64((f + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                    order = np.zeros(len(sh) + len(first), np.uint64)
                    order[place] = h & ~np.uint64(0xFFFFFF) | tie | np.uint64(1)
                    low, c, high = compact_windows(order, span)
                    d = np.searchsorted(first + np.arange(len(first)), c, "right") - 1
                    key = h[c - d] & ~np.uint64(7) | np.uint64(f)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[d]), *[pa.array(x.astype(np.int32)) for x in (c - d - first[d], c - low, high - c)]], names=["key", "doc_id", "c", "l", "r"])

    return run


def windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(key, doc_id, c, l, r) of every compact window [c - l, c + r]; the function's number is in the key's last bits."""
    return docs.select("doc_id", "text").mapInArrow(_windows(span), _WINDOW)


def shared_windows(docs: DataFrame, span: int = SPAN) -> Stored:
    """The windows of groups of two or more, with the group's size ``n``."""
    w = Stored(windows(docs, span))
    groups = cut(w.df.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    out = Stored(w.df.join(groups, "key"))
    w.drop()
    return out


def first_of(rows: DataFrame) -> DataFrame:
    """(key, lead, fc, fl, fr): the first window of each group of two or more."""
    by = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "c", "l", "r")).alias("x"))
    return by.where("n > 1").select("key", F.col("x.doc_id").alias("lead"), F.col("x.c").alias("fc"), F.col("x.l").alias("fl"), F.col("x.r").alias("fr"))


def _follows():
    return (F.col("doc_id") != F.col("lead")) | (F.col("c") != F.col("fc"))


def segments(pairs: DataFrame, span: int = SPAN, matches: int = MATCHES) -> DataFrame:
    """(doc_id, lead, a, b, la, lb, shift): shingles [a, b] of a document that may repeat [la, lb] of lead, ``shift`` further on.

    pairs are (key, doc_id, c, l, r, lead, fc, fl, fr): windows and those of the leaders they are compared with."""
    bit = F.expr("shiftleft(1, cast(key & 7 as int))").alias("bit")
    pairs = pairs.select("doc_id", "lead", (F.col("c") - F.least("l", "fl")).alias("a"), (F.col("c") + F.least("r", "fr")).alias("b"), (F.col("c") - F.col("fc")).alias("shift"), bit)
    pairs = pairs.withColumn("lane", F.floor(F.col("shift") / (4 * SLIP)).cast("int"))
    order = Window.partitionBy("doc_id", "lead", "lane").orderBy("a", "b", "shift")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("a") > before + 1), 1).otherwise(0)
    runs = pairs.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = runs.groupBy("doc_id", "lead", "lane", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("shift").alias("s1"), F.max("shift").alias("s2"), F.bit_or("bit").alias("bits"))
    joined = joined.where((F.bit_count("bits") >= matches) & (F.col("b") - F.col("a") + 1 >= NEAR - 2 * SLIP))
    zero = F.lit(0)
    return joined.select(
        "doc_id",
        "lead",
        F.greatest(F.col("a") - WIDER, zero).alias("a"),
        (F.col("b") + WIDER).alias("b"),
        F.greatest(F.col("a") - F.col("s2") - WIDER, zero).alias("la"),
        (F.col("b") - F.col("s1") + WIDER).alias("lb"),
        F.floor((F.col("s1") + F.col("s2")) / 2).cast("int").alias("shift"),
    )


def _own(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The words of each text, as 32 bits of their hashes."""
    w = T.words_of(data, offsets)
    h = (w.hashes >> np.uint64(32)).astype(np.uint32)
    return [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def _chunks(batches):
    for batch in batches:
        for rows, data, offsets in T.pieces(batch):
            out = []
            for i, wanted, mine in zip(rows.column("doc_id").to_pylist(), rows.column("chunks").to_pylist(), _own(data, offsets), strict=True):
                out += [(i, k, mine[k * CHUNK : (k + 1) * CHUNK].tobytes()) for k in wanted]
            if out:
                i, k, x = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], names=["lead", "chunk", "x"])


_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _range_hashes(sh: np.ndarray):
    """A function from (low, high) to hashes of the shingles in [low, high)."""
    n = len(sh)
    up = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, _MULTIPLIER, np.uint64))))
    down = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, _INVERSE, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sh * up[:n])))
    return lambda low, high: T.mix((sums[high] - sums[low]) * down[low])


def _contexts(batches):
    shapes = [(x, NEAR - x) for x in range(0, NEAR + 1, 5)] + [(0, FAR), (FAR // 2, FAR - FAR // 2), (FAR, 0)]
    for batch in batches:
        for rows, data, offsets in T.pieces(batch):
            sh, first = T.shingles(T.words_of(data, offsets), SHINGLE)
            at = _range_hashes(sh)
            some = rows.column("left").combine_chunks() if isinstance(rows.column("left"), pa.ChunkedArray) else rows.column("left")
            n = np.diff(some.offsets.to_numpy())
            key, c, left, right = (some.flatten().field(k).to_numpy() for k in ("key", "c", "l", "r"))
            open_ = some.flatten().field("open").to_numpy(zero_copy_only=False)
            doc = np.repeat(rows.column("doc_id").to_numpy(), n)
            here = np.repeat(first[:-1], n) + c
            for i, (x, y) in enumerate(shapes):
                ok = np.flatnonzero((left >= x) & (right >= y))
                fine = T.mix(at(here[ok] - x, here[ok] + y + 1) ^ key[ok].view(np.uint64) + np.uint64(i)) & ~np.uint64(7) | key[ok].view(np.uint64) & np.uint64(7)
                yield pa.RecordBatch.from_arrays([pa.array(fine.view(np.int64)), *[pa.array(v[ok]) for v in (doc, c, left, right, open_)]], names=["key", "doc_id", "c", "l", "r", "open"])


def finer(shared: DataFrame, first: DataFrame, found: DataFrame, docs: DataFrame) -> Stored:
    """(key, doc_id, c, l, r, open) of the windows by context, for all groups of three or more in which a window other than the leader's
    lies in no verified passage; ``open`` says that of the row's window."""
    by = cut(spans(found).select("doc_id", "spans"))
    held = F.exists("spans", lambda s: (s["low"] <= F.col("c")) & (F.col("c") <= s["high"] - SHINGLE))
    rows = shared.where("n > 2").join(if_small(by), "doc_id", "left").withColumn("open", ~F.coalesce(held, F.lit(False))).drop("spans", "n")
    rows = Stored(rows)
    keys = cut(rows.df.where("open").join(first, "key").where(_follows()).select("key").distinct())
    left = Stored(rows.df.join(if_small(keys), "key", "left_semi"))
    rows.drop()
    by = left.df.groupBy("doc_id").agg(F.collect_list(F.struct("key", "c", "l", "r", "open")).alias("left"))
    out = Stored(_of(docs, left.df).join(by.hint("merge"), "doc_id").mapInArrow(_contexts, f"{_WINDOW}, open boolean"))
    left.drop()
    return out


def joined_runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs [a, b] of hits, taken together over gaps of up to ``GAP``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    start, end = edges[::2], edges[1::2]
    apart = np.flatnonzero(start[1:] - end[:-1] > GAP)
    return list(zip(start[np.concatenate(([0], apart + 1))].tolist(), (end[np.concatenate((apart, [len(end) - 1]))] - 1).tolist(), strict=True)) if len(start) else []


def _shingled(words: np.ndarray) -> np.ndarray:
    return (T.rolling(words.astype(np.uint64), SHINGLE) >> np.uint64(32)).astype(np.uint32)


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    x, y = np.unique(x), np.unique(y)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _edge(x: np.ndarray, y: np.ndarray) -> int:
    """How many words at the start of x and y to take in: one changed word, and those after it that are equal (at most four)."""
    n = min(len(x), len(y), SHINGLE)
    same = x[1:n] == y[1:n]
    k = int(same.argmin()) if not same.all() else len(same)
    return k + 1 if k else 0


def _diagonal(x: np.ndarray, y: np.ndarray, shift: int, words: int) -> tuple[int, int] | None:
    """The plain case: one run of equal words at the expected place, long enough, and nothing around it that could be a passage."""
    low, high = max(shift, 0), min(len(x), len(y) + shift)
    if high - low < words:
        return None
    edges = np.flatnonzero(np.diff(np.concatenate(([False], x[low:high] == y[low - shift : high - shift], [False])).astype(np.int8)))
    size = edges[1::2] - edges[::2]
    k = size >= SHINGLE
    if k.sum() != 1:
        return None
    a, b = int(edges[::2][k][0]) + low, int(edges[1::2][k][0]) + low
    if b - a < words or max(a, len(x) - b) >= words - SHINGLE:
        return None
    return a - _edge(x[:a][::-1], y[: a - shift][::-1]), b + _edge(x[b:], y[b - shift :])


def verified(x: np.ndarray, y: np.ndarray, shift: int, earlier: int | None, words: int = WORDS, threshold: float = THRESHOLD):
    """Runs [low, high) of the words x that repeat a passage of the words y, which is expected ``shift`` places before.

    ``earlier`` is given in one document: x starts so many words after y, and only earlier places count."""
    whole = _diagonal(x, y, shift, words)
    if whole:
        yield whole
        return
    least = words - SHINGLE + 1
    sx, sy = _shingled(x), _shingled(y)
    if not len(sx) or not len(sy):
        return
    placed = np.sort(sy.astype(np.uint64) << np.uint64(32) | np.arange(len(sy), dtype=np.uint64))
    expected = np.clip(np.arange(len(sx)) - shift, 0, len(sy) - 1).astype(np.uint64)
    at = np.searchsorted(placed, sx.astype(np.uint64) << np.uint64(32) | expected)
    hit, place, apart = np.zeros(len(sx), bool), np.full(len(sx), -1), np.full(len(sx), 1 << 40)
    for near in (at, at - 1):  # the equal shingle nearest to where it is expected
        near = np.clip(near, 0, len(placed) - 1)
        where = (placed[near] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        gap = np.abs(where - expected.astype(np.int64))
        ok = ((placed[near] >> np.uint64(32)).astype(np.uint32) == sx) & (gap < apart)
        if earlier is not None:
            ok &= where < np.arange(len(sx)) + earlier
        hit, place, apart = hit | ok, np.where(ok, where, place), np.where(ok, gap, apart)
    todo = joined_runs(hit)
    while todo:
        a, b = todo.pop()
        n = b - a + 1
        if n < least and n < threshold * (2 * least - n):  # too short, even if widened
            continue
        on = np.flatnonzero(hit[a : b + 1]) + a
        p = place[on]
        pa_, pb = int(p.min()), int(p.max())
        if _jaccard(sx[a : b + 1], sy[pa_ : pb + 1]) >= threshold:
            low = a - _edge(x[:a][::-1], y[:pa_][::-1])
            high = b + SHINGLE + _edge(x[b + SHINGLE :], y[pb + SHINGLE :])
            need = words - (high - low)
            if need <= 0:
                yield low, high
                continue
            best = (0.0, 0)
            for e in range(need + 1):
                q = pa_ - (a - low)
                if low >= e and q >= e and high + need - e <= len(x) and q - e + words <= len(y):
                    best = max(best, (_jaccard(sx[low - e : low - e + least], sy[q - e : q - e + least]), e))
            if best[0] >= threshold:
                yield low - best[1], low - best[1] + words
        elif len(on) > 1:  # apart at the widest gap, of either text
            gap = np.maximum(np.diff(on) - 1, np.abs(np.diff(p) - np.diff(on)))
            k = int(gap.argmax())
            if gap[k]:
                todo += [(a, int(on[k])), (int(on[k + 1]), b)]


def _passages(words: int, threshold: float):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in T.pieces(batch):
                out = []
                for i, mine, parts in zip(rows.column("doc_id").to_pylist(), _own(data, offsets), rows.column("parts"), strict=True):
                    flat = parts.values
                    number = {k: flat.field(k).to_numpy() for k in ("seg", "lead", "a", "b", "la", "lb", "shift", "chunk")}
                    order = np.lexsort((number["chunk"], number["seg"]))
                    content = flat.field("x").take(pa.array(order)).to_pylist()
                    seg = number["seg"][order]
                    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
                    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(seg)], strict=True):
                        lead, a, b, la, lb, shift = (int(number[k][order[s]]) for k in ("lead", "a", "b", "la", "lb", "shift"))
                        if lead == i:
                            y = mine[la : lb + SHINGLE]
                        else:
                            y = np.frombuffer(b"".join(content[s:e]), np.uint32)[la - la // CHUNK * CHUNK :][: lb - la + SHINGLE]
                        found = verified(mine[a : b + SHINGLE], y, shift - (a - la), a - la if lead == i else None, words, threshold)
                        out += [(i, lead, a + low, a + high) for low, high in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "lead", "low", "high"])

    return run


def _whole(least: int):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in T.pieces(batch):
                n = T.words_of(data, offsets).counts
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lead"), pa.array(np.zeros(len(n), np.int64)), pa.array(n)], names=["doc_id", "lead", "low", "high"]).filter(pa.array(n >= least))

    return run


def _of(base: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts that rows ask for, so that no others are shuffled."""
    return base.join(if_small(cut(rows.select("doc_id").distinct())), "doc_id", "left_semi")


def _verified(base: DataFrame, seg: DataFrame, words: int, threshold: float) -> DataFrame:
    """(doc_id, lead, low, high) of the passages of segments that are repeats.

    A text meets its segments in rows of up to ``PART`` shingles' worth of them."""
    seg = cut(seg.withColumn("seg", F.monotonically_increasing_id()))
    chunk = F.explode(F.sequence(F.floor(F.col("la") / CHUNK).cast("int"), F.floor((F.col("lb") + SHINGLE - 1) / CHUNK).cast("int"))).alias("chunk")
    other = seg.where("doc_id <> lead").select("*", chunk)
    wanted = cut(other.select("lead", "chunk").distinct().groupBy("lead").agg(F.collect_list("chunk").alias("chunks")).withColumnRenamed("lead", "doc_id"))
    content = cut(base.join(if_small(wanted), "doc_id").mapInArrow(_chunks, "lead long, chunk int, x binary").groupBy("lead", "chunk").agg(F.max("x").alias("x")))
    given = other.join(content.hint("merge"), ["lead", "chunk"]).unionByName(seg.where("doc_id = lead").withColumns({"chunk": F.lit(0), "x": F.lit(None).cast("binary")}))
    parts = given.groupBy("doc_id", F.floor(F.col("a") / PART).alias("part")).agg(F.collect_list(F.struct("seg", "lead", "a", "b", "la", "lb", "shift", "chunk", "x")).alias("parts"))
    return _of(base, seg).join(parts.drop("part").hint("merge"), "doc_id").mapInArrow(_passages(words, threshold), "doc_id long, lead long, low long, high long").distinct()


def repeats(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, lead, low, high): words [low, high) of doc_id repeat a passage of lead.

    Rows without a doc_id or text are left out, and so are texts of fewer than ``words`` words.  Rows of the same id should
    have the same text: each is searched, but what repeats is said of the id.  Of equal texts those of greater
    ids repeat the first as a whole.  Other columns of docs are ignored; an empty table gives no rows."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashes = texts.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    equal = hashes.groupBy("h", "g").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = cut(hashes.join(equal, ["h", "g"]).where("doc_id <> lead").select("doc_id", "lead").distinct())
    base = texts.join(if_small(copies.select("doc_id")), "doc_id", "left_anti")
    span = words - SHINGLE + 1
    shared = shared_windows(base, span)
    first = cut(first_of(shared.df))
    found = cut(_verified(base, segments(shared.df.join(first, "key").where(_follows()), span), words, threshold))
    fine = finer(shared.df, first, found, base)
    shared.drop()
    lead = cut(first_of(fine.df))
    pairs = fine.df.where("open").join(lead, "key").where(_follows())
    pairs = pairs.withColumn("key", F.col("key").bitwiseAND(F.lit(7))).drop("open").distinct()
    more = cut(_verified(base, segments(pairs, span, 1), words, threshold))
    fine.drop()
    same = texts.join(if_small(copies), "doc_id").mapInArrow(_whole(words), "doc_id long, lead long, low long, high long").distinct()
    return found.unionByName(more).distinct().unionByName(same)


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, spans, leads): the disjoint word spans of each document that repeat, in order, and the documents they repeat."""
    order = Window.partitionBy("doc_id").orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(before.isNull() | (F.col("low") > before), 1).otherwise(0)).withColumn("run", F.sum("new").over(order))
    joined = runs.groupBy("doc_id", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_set("lead").alias("leads"))
    return joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("leads")))).alias("leads"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_spans, n_dup_words, spans ('low-high' of words, joined by ';'), leads (doc_ids of
    the first occurrences) and n_followers (documents that repeat a passage of this one), a row for each row of docs.

    Null ids and texts, texts without words and short ones have no spans; repeated rows each get
    their id's answer; an empty table gives none; other columns are ignored."""
    found = cut(repeats(docs))
    by = spans(found)
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["low"], s["high"])), ";")
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["high"] - s["low"])
    by = by.select("doc_id", F.size("spans").cast("long").alias("n_spans"), n.alias("n_dup_words"), text.alias("spans"), "leads")
    followers = found.where("doc_id <> lead").select("doc_id", "lead").distinct().groupBy(F.col("lead").alias("doc_id")).agg(F.count("*").alias("n_followers"))
    both = by.join(followers, "doc_id", "full")
    zero = F.lit(0).cast("long")
    return docs.select("doc_id").join(both, "doc_id", "left").select("doc_id", F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("n_dup_words", zero).alias("n_dup_words"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("leads", F.array().cast("array<long>")).alias("leads"), F.coalesce("n_followers", zero).alias("n_followers"))


def _without(batches):
    """Texts (column ``text``) without the words of ``spans``, which goes."""
    for batch in batches:
        for rows, data, offsets in T.pieces(batch):
            texts, marks = rows.column("text").to_pylist(), rows.column("spans").to_pylist()
            if any(marks):
                w = T.words_of(data, offsets)
                for d, cuts in enumerate(marks):
                    if cuts and texts[d] is not None:
                        a, b = w.first[d], w.first[d + 1]
                        gone = np.zeros(b - a, bool)
                        for c in cuts:
                            gone[c["low"] : c["high"]] = True
                        texts[d] = remove_words(data, offsets[d], offsets[d + 1], w.start[a:b], w.end[a:b], gone)
            names = [x for x in rows.schema.names if x != "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else rows.column(n) for n in names], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the passages that occurred before; texts without repeats stay as they are, columns as given.

    Rows with a null id or text stay as they are, repeated rows are cut alike, and a text that repeats
    as a whole is left as what is around its words.  Columns may have any names."""
    rows, new, names = positional(docs, "doc_id", "text")
    rows = rows.withColumnsRenamed({new["doc_id"]: "doc_id", new["text"]: "text"})
    by = cut(spans(repeats(rows)).select("doc_id", "spans"))
    out = rows.join(if_small(by), "doc_id", "left").select(*rows.columns, "spans")
    return out.mapInArrow(_without, rows.schema).toDF(*names)
