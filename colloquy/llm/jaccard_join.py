"""Jaccard join of documents over word 5-shingles, with Bayesian pruning.

1. One pass over the texts gives each document its set of shingles as a 128-bit
   key, its size and 128 MinHash values.  Documents of equal sets form a class
   whose representative is the least doc_id; only representatives go on.
2. 32 bands of 4 values deal representatives into buckets (a pair of Jaccard
   0.8 shares none with probability 5e-8).  Buckets of one member go; of buckets
   with the same members only the first stays.
3. In each bucket, pairs are compared on 32, 64, 96 and 128 values.  With a
   uniform prior the posterior that a pair with m of n equal values reaches the
   threshold t is P(Binomial(n + 1, t) <= m); a pair goes once that is below
   ``TOLERANCE``.  The rest are verified on the sets themselves.  A pair that
   shares several buckets counts in its first band only.
4. Large buckets that share members are put together where that is less work, so that near copies of one text,
   which meet in many bands, are compared once.  A bucket of more than ``BUCKET`` members, or ``BYTES`` of their sets, is dealt into parts by hash, and each
   pair of parts is a group of its own: no group grows with the data, and no
   link is lost.  Pairs never become rows; a group returns, for each member,
   its number of links and the least member that it is connected with.  As links are
   counted exactly, the comparisons of a bucket of m different sets grow with its square, and a set of it is given to
   m / ``BUCKET`` groups.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import numbered
from . import tokens as T
from .components import components
from .session import cut, if_small, positional

THRESHOLD, SHINGLE = 0.8, 5
HASHES, BAND = 128, 4
STEP = 32
TOLERANCE = 1e-9
#: Members that are compared in one group, and bytes of their signatures and sets.
BUCKET, BYTES = 512, 16 << 20


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values, the fewest equal ones of a pair that stays."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _features(batches):
    for batch in batches:
        for rows, data, offsets in T.pieces(batch):
            sh, first = T.unique_sets(*T.shingles(T.words_of(data, offsets), SHINGLE))
            sig = T.minhash(sh, first, HASHES)
            bands = np.zeros((rows.num_rows, HASHES // BAND), np.uint64)
            for i in range(BAND):
                bands = T.mix(bands + sig[:, i::BAND].astype(np.uint64) + np.uint64(i + 1))
            bands = bands + np.arange(HASHES // BAND, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            n, k1, k2 = keys(sh, first)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n, pa.int32()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(T.mix(bands).view(np.int64).ravel()), HASHES // BAND).cast(pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "n", "sig", "bands"],
            )


def keys(sh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free 64-bit keys of each set of shingles."""
    n = np.diff(first)
    has = n > 0
    out = []
    for salt in (0x51, 0xA7):
        k = np.zeros(len(n), np.uint64)
        if has.any():
            k[has] = np.add.reduceat(T.mix(sh ^ np.uint64(salt)), first[:-1][has])
        out.append(T.mix(k + n.astype(np.uint64)))
    return n, *out


def _sets(batches):
    for batch in batches:
        for rows, data, offsets in T.pieces(batch):
            sh, first = T.unique_sets(*T.shingles(T.words_of(data, offsets), SHINGLE))
            _, k1, _ = keys(sh, first)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), pa.array(k1.view(np.int64)), pa.array([sh[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())],
                names=["doc_id", "k1", "shingles"],
            )


_NONE = -(1 << 63)


def _met(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each row of sig and band whether all values of the band equal other's."""
    return (sig == other).reshape(len(sig), HASHES // BAND, BAND).all(2)


def _linked(table: pa.Table, threshold: float, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of one group: pairs i < j of rows that reach the threshold and share no earlier band."""
    n = table.num_rows
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(n, HASHES)
    part, band = table.column("part").to_numpy(), table.column("band")[0].as_py()
    size = table.column("n").to_numpy().astype(np.int64)
    grp = table.column("grp").fill_null(_NONE).to_numpy()
    cross = table.column("p")[0].as_py() != table.column("q")[0].as_py()
    found = []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        if cross:
            j = j[part[j] != part[i]]
        lo, hi = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        j = j[lo >= threshold * hi]
        m = np.zeros(len(j), np.int64)
        for k in range(0, HASHES, STEP):
            m += (sig[j, k : k + STEP] == sig[i, k : k + STEP]).sum(1)
            stay = m >= least[k + STEP]
            j, m = j[stay], m[stay]
            if not len(j):
                break
        if band >= 0:  # a pair of one merged bucket, or that met in an earlier band, is verified there
            j = j[(grp[j] != grp[i]) | (grp[i] == _NONE)]
            met = _met(sig[j], sig[i])
            j = j[met.argmax(1) == band]
        found.append(np.stack([np.full(len(j), i), j]))
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    if not len(a):
        return a, b
    shared = _shared(table.column("shingles").to_pylist(), a, b)
    ok = shared >= threshold * (size[a] + size[b] - shared)
    return a[ok], b[ok]


def _shared(sets: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of shingles shared by the sets of each pair.

    Few pairs intersect directly.  Many pairs go by 0/1 matrices over the
    shingles that occur twice or more, some columns at a time."""
    arrays = [np.frombuffer(x, np.uint64) for x in sets]
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(arrays[i], arrays[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    out = np.zeros(len(a), np.int64)
    owner = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
    _, code, count = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    many = (count > 1)[code]
    owner, code = owner[many], column[code[many]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        x, y = np.searchsorted(code, (low, low + 4096))
        m = np.zeros((len(arrays), 4096), np.float32)
        m[owner[x:y], code[x:y] - low] = 1
        out += (m @ m.T)[a, b].astype(np.int64)
    return out


def _group(threshold: float, least: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        a, b = _linked(table, threshold, least)
        ids = table.column("k1").to_numpy()
        links = np.bincount(np.concatenate((a, b)), minlength=len(ids))
        least_of = ids.copy()
        while len(a):
            new = least_of.copy()
            np.minimum.at(new, a, least_of[b])
            np.minimum.at(new, b, least_of[a])
            if (new == least_of).all():
                break
            least_of = new
        some = (links > 0) | (least_of != ids)
        return pa.table({"k1": pa.array(ids[some]), "least": pa.array(least_of[some]), "links": pa.array(links[some], pa.int64())})

    return run


def _merged(members: DataFrame, sizes: DataFrame, bucket: int) -> DataFrame:
    """members(k1, band, key, parts) with large buckets that share members put together where that is less work, and ``grp``.

    Near copies of one text meet in many bands, in a large bucket each.  All large buckets that hang together become
    one (of band -1), if comparing all its members once takes no more rows than the buckets take one by one.  Members
    carry the number of such a bucket as ``grp`` (null for none), so that other buckets leave their pairs out."""
    none = F.lit(None).cast("long").alias("grp")
    hot = cut(members.where("parts > 1"))
    if hot.isEmpty():
        return members.select("*", none)
    each = cut(hot.groupBy("band", "key").agg(F.min("k1").alias("low"), (F.count("*") * F.max("parts")).alias("rows")))
    links = hot.join(if_small(each.select("band", "key", "low")), ["band", "key"]).select(F.col("k1").alias("a"), F.col("low").alias("b"))
    group = cut(components(links).withColumnRenamed("node", "k1"))
    apart = each.join(group.withColumnRenamed("k1", "low"), "low").groupBy("root").agg(F.sum("rows").alias("rows"))
    together = group.join(sizes, "k1").groupBy("root").agg(F.count("*").alias("m"), F.sum(F.col("n").cast("long") * 8 + 4 * HASHES).alias("bytes"))
    together = together.withColumn("parts", F.least("m", F.greatest(F.ceil(F.col("m") / bucket), F.ceil(F.col("bytes") / BYTES))).cast("int"))
    together = cut(together.join(apart, "root").where(F.col("m") * F.col("parts") <= F.col("rows")).select("root", "parts"))
    chosen = cut(group.join(if_small(together), "root").select("k1", F.col("root").alias("grp"), F.col("parts").alias("all_parts")))
    gone = cut(each.join(chosen.select(F.col("k1").alias("low")), "low", "left_semi").select("band", "key"))
    rest = members.join(if_small(gone), ["band", "key"], "left_anti").join(if_small(chosen.select("k1", "grp")), "k1", "left")
    new = chosen.select("k1", F.lit(-1).cast(members.schema["band"].dataType).alias("band"), F.col("grp").alias("key"), F.col("all_parts").alias("parts"), none)
    return rest.select("k1", "band", "key", "parts", "grp").unionByName(new)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, set_id, class_id, n_copies, n_links), a row for each row of docs.

    ``set_id`` is the least doc_id with the same set of shingles, ``class_id`` the
    least doc_id of the connected group, ``n_copies`` the rows of the same set and
    ``n_links`` the number of different sets of Jaccard ``threshold`` or more.
    A document of 1 to 4 words has all of them as its one shingle.  Documents
    without words (null, empty, punctuation) are never linked: their own class.
    Rows without a doc_id are left out.  Other columns are ignored.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = cut(texts.mapInArrow(_features, "doc_id long, k1 long, k2 long, n int, sig binary, bands array<long>"))
    reps = cut(seen.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")))

    in_band = reps.select("k1", "n", F.posexplode("bands").alias("band", "key"))
    bytes_of = F.sum(F.col("n").cast("long") * 8 + 4 * HASHES).alias("bytes")
    sizes = in_band.groupBy("band", "key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("k1").cast("decimal(20,0)")).alias("members"), F.min("k1").alias("low"), bytes_of).where("m > 1")
    first = Window.partitionBy("m", "members", "low").orderBy("band", "key")
    sizes = cut(sizes.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("band", "key", F.least("m", F.greatest(F.ceil(F.col("m") / bucket), F.ceil(F.col("bytes") / BYTES))).cast("int").alias("parts")))
    members = cut(in_band.drop("n").join(if_small(sizes), ["band", "key"]))
    near = cut(members.select("k1").distinct().join(reps.select("rep", "k1", "n", "sig"), "k1"))
    wanted = near.select(F.col("rep").alias("doc_id"), "k1")
    sets = texts.join(if_small(wanted.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, k1 long, shingles binary")
    sets = sets.join(if_small(wanted), ["doc_id", "k1"], "left_semi").groupBy("k1").agg(F.any_value("shingles").alias("shingles"))
    full = near.join(sets, "k1").select("k1", "n", "sig", "shingles")

    part = F.pmod(F.xxhash64("k1"), F.col("parts")).cast("int")
    members = _merged(members, near.select("k1", "n"), bucket)
    dealt = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("k1", "band", "key", "grp", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    found = cut(dealt.join(full, "k1").groupBy("band", "key", "p", "q").applyInArrow(_group(threshold, least_matches(threshold, tolerance)), "k1 long, least long, links long"))
    root = components(found.select(F.col("k1").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "k1")
    links = found.groupBy("k1").agg(F.sum("links").alias("n_links"))
    linked = cut(root.join(links, "k1").join(near.select("k1", "rep"), "k1"))
    linked = linked.join(linked.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("k1", "class_id", "n_links")
    classes = reps.select("k1", "k2", "rep", "n_copies").join(if_small(linked), "k1", "left")
    classes = classes.select("k1", "k2", "rep", "n_copies", F.coalesce("class_id", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = seen.select("doc_id", "k1", "k2", "n").join(classes, ["k1", "k2"], "left")
    none = F.col("n") == 0
    return out.select(
        "doc_id",
        F.when(none, F.col("doc_id")).otherwise(F.col("rep")).alias("set_id"),
        F.when(none, F.col("doc_id")).otherwise(F.col("root")).alias("class_id"),
        F.when(none, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        F.when(none, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of which ``class_id`` is their own id; columns as given.

    Of rows with the same id and text one stays, whichever; rows with the same id and other texts are
    documents of their own, the one of the lesser text hash first.  Rows without an id stay, and so do texts
    without words.  Columns may have any names; an empty table stays empty."""
    rows, new, names = positional(docs, "doc_id", "text")
    rows = rows.withColumnsRenamed({new["doc_id"]: "doc_id", new["text"]: "text"})
    if rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        drop = cut(near_classes(rows, threshold).where("doc_id <> class_id").select("doc_id"))
        return rows.join(if_small(drop), "doc_id", "left_anti").select(*rows.columns).toDF(*names)
    hashed = rows.withColumn("h", F.xxhash64("text"))
    single = hashed.where("doc_id is not null").select("doc_id", "text", "h").dropDuplicates(["doc_id", "h"])
    ids = cut(numbered(single.select("doc_id", "h"), F.struct("doc_id", "h")).select("doc_id", "h", F.col("__i").alias("i")))
    classes = near_classes(single.join(ids, ["doc_id", "h"]).select(F.col("i").alias("doc_id"), "text"), threshold)
    stay = cut(classes.where("doc_id = class_id").select(F.col("doc_id").alias("i")).join(ids, "i").drop("i"))
    out = hashed.join(if_small(stay), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).select(*rows.columns)
    return out.unionByName(rows.where("doc_id is null")).toDF(*names)
