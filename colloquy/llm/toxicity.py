"""Toxicity scores from class-conditional Kneser-Ney models.

Each class c (toxic, ordinary) has an interpolated Kneser-Ney model of the letters
of words, each letter given up to five before it in its word:

    P_c,m(x | h) = max(n_c,m(h, x) - D, 0) / n_c,m(h) + l_c,m(h) * P_c,m-1(x | h')

with text counts at the highest order and continuation counts (different
predecessors) below, l the mass freed by the discount D.  Orders 6 to 3 are kept by
class; below, both classes share one continuation model, so that rare expressions
fall back on shared counts and say nothing for either class.  Letters rather than
words let a rare compound borrow from its parts.

The evidence of a text is its log-likelihood ratio, normalised by length: over n
(per letter) and over sqrt(n) (as a z-score).  A logistic curve over these two turns it into a score.
The curve is fitted on a quarter of the labelled texts with counts of the other three; the model that
scores has the counts of all.

Counting is Spark aggregation over all labelled texts, and what it gathers grows
with them.  Letters have codes of 10 bits: the ``DIRECT`` most frequent ones (UTF-16 units) of the labelled texts have one of their own, every other is
spelled as two codes that nothing else has.  So no two letters share a code, in whatever script.

The model is a table of seen letter groups; it is sent to the tasks in
blocks of bounded size (by the two letters before the predicted one, which all
orders of a position share).  Each pass over the texts takes ``CHAIN`` blocks, and passes beyond the first
give sums a document, which are added up by its id and text hash; texts are neither shuffled nor copied for a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .session import cut, held_slice, if_small

DISCOUNT = 0.75
HIGH, LOW = 6, 3
#: Letters with a code of their own; the upper and the lower byte of others have one each.
DIRECT = 510
CODES, BITS = DIRECT + 2 * 256, 10
#: Entries of a block of the model (16 bytes each).
BLOCK = 4_000_000
#: Blocks that a pass over the texts takes.
CHAIN = 4
_GRID = 128


def _mask(m: int) -> int:
    return (1 << BITS * m) - 1


def alphabet(labelled: DataFrame) -> np.ndarray:
    """The code of each UTF-16 unit, 0 for what is spelled: units of labelled texts by falling number (of equal ones the lesser first).

    Counts are sums of at most 65,536 rows, of which DIRECT reach the driver."""
    rows = labelled.select("text").mapInArrow(_units, "unit int, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << 16, np.uint16)
    for i, r in enumerate(rows.orderBy(F.desc("n"), "unit").limit(DIRECT).collect()):
        out[r["unit"]] = i + 1
    return out


def _units(batches):
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for _, data, _ in T.pieces(batch):
            units = np.frombuffer(data.tobytes().decode("utf-8").lower().encode("utf-16-le"), np.uint16)
            total += np.bincount(units, minlength=1 << 16)
    seen = np.flatnonzero(total)
    seen = seen[(seen > 127) | np.isin(seen, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))]
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["unit", "n"])


def _word_grams(w: T.Words, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the different words of w: the word's number for each word of w, the letter
    groups of all its positions (codes of HIGH letters, 0 before the word), and their word."""
    _, some, code = np.unique(w.hashes, return_index=True, return_inverse=True)
    if not len(some):
        return code, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start, size = w.start[some], w.end[some] - w.start[some] + 1
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    gap = at == np.repeat(size - 1, size)
    data = np.where(gap, np.uint8(32), w.data[np.minimum(np.repeat(start, size) + at, len(w.data) - 1)])
    units = np.frombuffer(data.tobytes().decode("utf-8").lower().encode("utf-16-le"), np.uint16)
    word = np.cumsum(units == 32) - (units == 32)
    c = np.where(units == 32, 0, letters[units]).astype(np.uint64)
    spelled = (c == 0) & (units != 32)
    if spelled.any():
        first = np.cumsum(1 + spelled) - (1 + spelled)
        c, word, high = np.repeat(c, 1 + spelled), np.repeat(word, 1 + spelled), first[spelled]
        c[high], c[high + 1] = DIRECT + 1 + (units[spelled] >> 8), DIRECT + 257 + (units[spelled] & 255)
    out, alive = c.copy(), c > 0
    for j in range(1, HIGH):
        before = np.concatenate((np.zeros(j, np.uint64), c[:-j])) if j < len(c) else np.zeros_like(c)
        alive = alive & (before > 0)
        out += np.where(alive, before, np.uint64(0)) << np.uint64(BITS * j)
    return code, out[c > 0], word[c > 0]


def _count(letters: np.ndarray):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in T.pieces(batch):
                w = T.words_of(data, offsets)
                code, grams, word = _word_grams(w, letters)
                toxic, apart = (np.repeat(rows.column(c).to_numpy(zero_copy_only=False) == 1, w.counts) for c in ("toxic", "apart"))
                n = int(code.max()) + 1 if len(code) else 0
                known, which = np.unique(grams, return_inverse=True)
                per = [np.bincount(code[some], minlength=n) for some in (toxic, ~toxic, toxic & ~apart, ~toxic & ~apart)]
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), *[pa.array(np.bincount(which, x[word], len(known)).astype(np.int64)) for x in per]], names=["k", *_COUNTS])

    return run


_COUNTS = ("t0", "o0", "t1", "o1")


def counts(labelled: DataFrame, letters: np.ndarray) -> DataFrame:
    """(k, t0, o0, t1, o1): letter group of the highest order, its count in toxic and in ordinary texts of labelled(text, toxic, apart), of
    all of them and of those that are not ``apart`` (1)."""
    rows = labelled if "apart" in labelled.columns else labelled.withColumn("apart", F.lit(0))
    return rows.select("text", "toxic", "apart").mapInArrow(_count(letters), "k long, t0 long, o0 long, t1 long, o1 long").groupBy("k").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def model_table(highest: DataFrame) -> DataFrame:
    """(m, k, v0, v1, own) from counts: v is log P_toxic / P_ordinary of a seen group of m
    letters (own) or, for a seen context (not own), the log ratio of the freed masses; v0 by the counts of all
    texts, v1 by those of the texts that are not apart (null for what those have not got).  Both come from the same joins."""
    both = (0, 1)
    levels = {HIGH: highest}
    for m in range(HIGH - 1, LOW - 2, -1):
        seen = [F.count_if(F.col(c) > 0).alias(c) for c in _COUNTS]
        levels[m] = cut(levels[m + 1].groupBy(F.col("k").bitwiseAND(F.lit(_mask(m))).alias("k")).agg(*seen))  # three plans read each
    ctx = F.shiftrightunsigned("k", BITS).alias("h")
    base = levels[LOW - 1].select("k", ctx, *[(F.col(f"t{i}") + F.col(f"o{i}")).alias(f"s{i}") for i in both])
    total = base.groupBy("h").agg(*[x for i in both for x in (F.sum(f"s{i}").alias(f"n{i}"), F.count_if(F.col(f"s{i}") > 0).alias(f"kinds{i}"))])
    p = lambda i: F.when(F.col(f"n{i}") > 0, (F.greatest(F.col(f"s{i}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds{i}") / CODES) / F.col(f"n{i}"))
    lower = base.join(total, "h").select("k", *[p(i).alias(f"p{c}{i}") for i in both for c in "to"])
    out = None
    for m in range(LOW, HIGH + 1):
        now = levels[m].select("k", *_COUNTS, ctx, F.col("k").bitwiseAND(F.lit(_mask(m - 1))).alias("low"))
        cut_off = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT)))
        by = now.groupBy("h").agg(*[x for c in _COUNTS for x in (F.sum(c).alias(f"n{c}"), cut_off(c).alias(f"d{c}"))])
        by = by.select("h", *[f"n{c}" for c in _COUNTS], *[F.when(F.col(f"n{c}") > 0, F.col(f"d{c}") / F.col(f"n{c}")).otherwise(1.0).alias(f"l{c}") for c in _COUNTS])
        full = now.join(by, "h").join(lower.withColumnRenamed("k", "low"), "low")
        part = lambda c: F.when(F.col(f"n{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"n{c}")).otherwise(0.0)
        any_ = lambda i, a, b: F.col(a) + F.col(b) > 0
        lower = full.select("k", *[(F.when(any_(i, f"t{i}", f"o{i}"), part(f"{c}{i}") + F.col(f"l{c}{i}") * F.col(f"p{c}{i}"))).alias(f"p{c}{i}") for i in both for c in "to"])
        lower = cut(lower)
        rows = lower.select(F.lit(m).alias("m"), "k", *[F.log(F.col(f"pt{i}") / F.col(f"po{i}")).alias(f"v{i}") for i in both], F.lit(True).alias("own"))
        freed = [F.when(any_(i, f"nt{i}", f"no{i}"), F.log(F.col(f"lt{i}") / F.col(f"lo{i}"))).alias(f"v{i}") for i in both]
        rows = rows.unionByName(by.select(F.lit(m).alias("m"), F.col("h").alias("k"), *freed, F.lit(False).alias("own")))
        out = rows if out is None else out.unionByName(rows)
    return cut(out)


def _of(table: DataFrame, i: int) -> DataFrame:
    """(m, k, v, own) of one of the two models."""
    return table.where(F.col(f"v{i}").isNotNull()).select("m", "k", F.col(f"v{i}").alias("v"), "own")


class Lookup:
    """Values by key: sorted keys with an index over their upper bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        mixed = T.mix(keys)
        order = np.argsort(mixed)
        self.keys, self.values = mixed[order], values[order].astype(np.float64)
        bits = max(8, int(np.ceil(np.log2(len(keys) + 1))))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one."""
        out, found = np.zeros(len(keys)), np.zeros(len(keys), bool)
        mixed = T.mix(keys)
        top = (mixed >> self.shift).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.keys[at[live]] == mixed[live]
            out[live[hit]] = self.values[at[live[hit]]]
            found[live[hit]] = True
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out, found


def _pair(own: bool):
    """The two letters before the predicted one, of a group of letters or of its context."""
    return (F.shiftrightunsigned("k", BITS) if own else F.col("k")).bitwiseAND(F.lit(_mask(2)))


def _block_of(pair: np.ndarray, n: int) -> np.ndarray:
    return pair % np.uint64(8191) % np.uint64(n)


class Model:
    """One block of the table."""

    def __init__(self, rows: pa.Table, block: int, blocks: int):
        self.block, self.blocks = block, blocks
        m, k, v, own = (rows.column(c).to_numpy() for c in ("m", "k", "v", "own"))
        self.tables = {(i, x): Lookup(k[(m == i) & (own == x)].view(np.uint64), v[(m == i) & (own == x)]) for i in range(LOW, HIGH + 1) for x in (True, False)}

    def ratios(self, grams: np.ndarray) -> np.ndarray:
        """log P_toxic / P_ordinary of each position that belongs to this block, 0 for others."""
        out = np.zeros(len(grams))
        live = np.arange(len(grams))
        if self.blocks > 1:
            live = np.flatnonzero(_block_of(grams >> np.uint64(BITS) & np.uint64(_mask(2)), self.blocks) == self.block)
        for m in range(HIGH, LOW - 1, -1):
            g = grams[live] & np.uint64(_mask(m))
            v, found = self.tables[m, True].find(g)
            out[live] += v
            live, g = live[~found], g[~found]
            if not len(live):
                break
            out[live] += self.tables[m, False].find(g >> np.uint64(BITS))[0]
        return out


def models(table: DataFrame, block: int = BLOCK):
    """The table as blocks of about ``block`` entries, one after the other."""
    n = max(1, -(-table.count() // block))
    pair = F.when(F.col("own"), _pair(True)).otherwise(_pair(False))
    for i in range(n):
        yield Model(table.where(pair % 8191 % n == i).toArrow(), i, n)


def _add(chain: list[Model], letters: np.ndarray):
    """rows with ``__sum``, the sum of the log ratios of a text's positions in the blocks, and ``__n``, its letters (codes)."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in T.pieces(batch):
                w = T.words_of(data, offsets)
                code, grams, word = _word_grams(w, letters)
                n = int(code.max()) + 1 if len(code) else 0
                each = sum((np.bincount(word, m.ratios(grams), n) for m in chain), np.zeros(n)) if n else np.zeros(0)
                lengths = np.bincount(word, minlength=n) if n else np.zeros(0)
                total, size = (np.concatenate(([0.0], np.cumsum(x[code] if n else x))) for x in (each, lengths))
                keep = [c for c in rows.schema.names if c != "text"]
                found = [pa.array(total[w.first[1:]] - total[w.first[:-1]]), pa.array((size[w.first[1:]] - size[w.first[:-1]]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *found], names=[*keep, "__sum", "__n"])

    return run


def evidence(docs: DataFrame, table: DataFrame, letters: np.ndarray, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ..) without the text, with ``__n`` letters and ``__sum`` of their log ratios."""
    names = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", __sum double, __n long"
    rest, out, chain = models(table, block), None, []
    for model in rest:
        chain.append(model)
        if len(chain) == CHAIN:
            part = docs.mapInArrow(_add(chain, letters), kinds)
            out, chain = part if out is None else out.unionByName(part), []
    if out is None:
        return docs.mapInArrow(_add(chain, letters), kinds)
    if chain:
        out = out.unionByName(docs.mapInArrow(_add(chain, letters), kinds))
    return out


def _summed(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by).agg(F.sum("__sum").alias("__sum"), F.max("__n").alias("__n"))


def _per_letter():
    return F.col("__sum") / F.col("__n")


def _z():
    return F.col("__sum") / F.sqrt(F.col("__n").cast("double"))


def calibrate(scored: DataFrame) -> np.ndarray:
    """Logistic fit of toxic on (per letter, z, 1); from means of the cells of a grid of bounded size."""
    x = scored.where("__n > 0").select(_per_letter().alias("x"), _z().alias("z"), F.col("toxic").cast("long").alias("toxic"))
    a = x.agg(F.min("x"), F.max("x"), F.min("z"), F.max("z")).first()
    if a[0] is None:
        return np.zeros(3)
    cell = lambda c, lo, hi: F.floor((F.col(c) - lo) / max((hi - lo) / _GRID, 1e-9))
    rows = x.groupBy(cell("x", a[0], a[1]).alias("i"), cell("z", a[2], a[3]).alias("j")).agg(F.avg("x"), F.avg("z"), F.sum("toxic"), F.count("*")).collect()
    f = np.array([[r[2], r[3], 1.0] for r in rows])
    t, n = np.array([float(r[4]) for r in rows]), np.array([float(r[5]) for r in rows])
    scale = np.maximum(np.sqrt((f**2 * n[:, None]).sum(0) / n.sum()), 1e-12)
    z, beta = f / scale, np.zeros(3)
    loss = lambda b: (n * np.logaddexp(0, z @ b) - t * (z @ b)).sum() + 0.005 * (b**2).sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
        grad = z.T @ (t - n * p) - 0.01 * beta
        step = np.linalg.solve((z * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + 0.01 * np.eye(3), grad)
        rate = 1.0
        while rate > 1e-6 and loss(beta + rate * step) > loss(beta):
            rate /= 2
        beta = beta + rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return beta / scale


def report(docs: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of docs.

    Learned from rows with a label of 0 or 1 whose id is not held out; of repeated labels of an id
    the greater counts, and of repeated rows of an id each.  A null id is never held out.  A text without letters or digits (null, empty) has the share of toxic
    texts as its score.  Without labels nothing is learned and every score is 0."""
    mine = held_slice("doc_id", 5)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learn = cut(labels.where("toxic in (0, 1) and doc_id is not null").where(mine != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    rows = docs.where(mine != 0).join(if_small(learn), "doc_id")
    letters = alphabet(rows)
    both = model_table(cut(counts(rows.withColumn("apart", (mine == 1).cast("int")), letters)))
    beta = calibrate(cut(_scores(rows.where(mine == 1), _of(both, 1), letters, block)))
    table = _of(both, 0)
    share = learn.agg(F.avg("toxic")).first()[0]
    none = float(np.log((share + 1e-6) / (1 - share + 1e-6))) if share is not None else -30.0
    if not beta.any():
        beta = np.array([0.0, 0.0, none])
    out = _scores(docs, table, letters, block)
    z = F.when(F.col("__n") > 0, F.lit(float(beta[0])) * _per_letter() + F.lit(float(beta[1])) * _z() + F.lit(float(beta[2]))).otherwise(F.lit(none))
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return out.select("doc_id", F.coalesce(mine == 0, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def _scores(docs: DataFrame, table: DataFrame, letters: np.ndarray, block: int) -> DataFrame:
    """Each row's evidence; of many blocks the sums are added up by id and text."""
    if table.count() <= CHAIN * block:
        return evidence(docs, table, letters, block)
    keyed = docs.withColumn("h", F.xxhash64("text"))
    sums = _summed(evidence(keyed.dropDuplicates(["doc_id", "h"]), table, letters, block), *[c for c in keyed.columns if c != "text"])
    again = keyed.groupBy("doc_id", "h").agg((F.count("*") - 1).cast("int").alias("k")).where("k > 0")
    same = [sums[c].eqNullSafe(again[c]) for c in ("doc_id", "h")]
    k = F.coalesce("k", F.lit(0))
    return sums.join(again, same, "left").select(*[sums[c] for c in sums.columns if c != "h"], F.explode(F.array_repeat(F.lit(0), k + 1)).alias("i")).drop("i")
