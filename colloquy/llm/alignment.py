"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers, A and B, cut the same bytes (a space and the text).  Every token points to the token, of either of them, that overlaps it and
reaches farthest to the right; of two that reach equally far it is B's.  A token that points to itself ends where both
tokenizers end.  Doubling the pointers (``succ = succ[succ]``, over all tokens at once) until nothing changes leads every
token to the last one of its component, which labels its group: the smallest runs of bytes that both tokenizers end.

Neither tokenizer has a token that goes on over a blank after other text (this is checked for B when its model is loaded; A's pattern
says so), so a text may be cut before every such blank, and the different chunks of a piece are encoded and aligned once for all the places
where they stand.  Where a model has such tokens, whole texts are the chunks.

``align`` makes a row for each document, with its different linked pairs of ids and how often it links them; ``pair_counts`` counts for
each pair the documents that hold it, corpus-wide; ``report`` puts both together.  Pairs are counted with map-side sums; the counts, whose
number is bounded by the vocabularies and not by the documents, are broadcast while they are few and joined by a shuffle beyond that.

The vocabularies are parameters: paths that every executor can read, or names of files given to the job (``SparkContext.addFile``).
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .session import BROADCAST_ROWS, Stored, cut, if_small, positional

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are worked on at once.
PIECE = 2 << 20
#: Links of a group above which its different ids are paired instead of its tokens.
LARGE = 4096
#: Pairs are one number: A's id times this, and B's id.
PAIR = 1 << 20
#: Bytes of plain chunks that B's tokenizer is given at once.
RUN = 2048
_BLANK = "▁"
# Fixed value: the pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of characters whose classes no two libraries see differently: ASCII but for rare controls, Latin and Greek letters and their second bytes.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(9, 14), *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xD0)]] = True
_BLANKS = np.zeros(256, bool)
_BLANKS[[*range(9, 14), 32]] = True


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others, in order, for 256 and above."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Byte strings by number, end to end."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, which: np.ndarray) -> np.ndarray:
        return taken(self.bytes, self.first, self.size, which)


def taken(values: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs number ``which`` of a table of runs, end to end."""
    n = size[which]
    end = np.cumsum(n)
    return values[np.arange(end[-1] if len(end) else 0) + np.repeat(first[which] - (end - n), n)]


class Chunks(NamedTuple):
    """Aligned chunks, a place each: whether both tokenizers keep its bytes, tokens, groups, links; its groups as written in the
    digest; its links ``pair[first : first + size]`` with their ``times``."""

    good: np.ndarray
    numbers: dict[str, np.ndarray]
    written: pa.Array
    first: np.ndarray
    size: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def components(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of A and of B, numbered from 0, from the ends of the tokens of two cuts of the same bytes."""
    n = len(end_a)
    succ = np.empty(n + len(end_b), np.int64)
    succ[:n] = n + np.searchsorted(end_b, end_a)  # B's token over A's last byte reaches at least as far
    over = np.searchsorted(end_a, end_b)
    succ[n:] = np.where(end_a[over] > end_b, over, np.arange(n, len(succ)))
    while True:
        jumped = succ[succ]
        if np.array_equal(jumped, succ):
            break
        succ = jumped
    last = np.flatnonzero(succ == np.arange(len(succ)))
    group = np.searchsorted(last, succ)
    return group[:n], group[n:]


def linked(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: int, large: int = LARGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of all links, in order of the groups: a row for each pair of tokens, or for each pair of different ids in groups of more than ``large`` links."""
    per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
    big = np.flatnonzero(per_a * per_b > large)
    few = np.ones(n_groups, bool)
    few[big] = False
    left = np.flatnonzero(few[group_a])
    each = per_b[group_a[left]]
    end = np.cumsum(each)
    right = np.arange(end[-1] if len(end) else 0) - np.repeat(end - each, each) + np.repeat(first_b[group_a[left]], each)
    groups, pairs = np.repeat(group_a[left], each), np.repeat(a[left], each) * PAIR + b[right]
    times = np.ones(len(pairs), np.int64)
    if not len(big):
        return groups, pairs, times
    parts = [(groups, pairs, times)]
    for g in big.tolist():
        x, nx = np.unique(a[first_a[g] : first_a[g] + per_a[g]], return_counts=True)
        y, ny = np.unique(b[first_b[g] : first_b[g] + per_b[g]], return_counts=True)
        both = (x[:, None] * PAIR + y).ravel()
        parts.append((np.full(len(both), g), both, np.outer(nx, ny).ravel()))
    groups, pairs, times = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(groups, kind="stable")
    return groups[order], pairs[order], times[order]


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(path_a if os.path.exists(path_a) else SparkFiles.get(path_a), encoding="utf-8") as f:
            said = f.read()
        self.a = Tokenizer.from_str(said)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = {i: t for t, i in json.loads(said)["model"]["vocab"].items()}
        self.bytes_a = Table([bytes(letters.get(c, 0) for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b if os.path.exists(path_b) else SparkFiles.get(path_b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)])
        self.decimal = Table([b"%d," % i for i in range(max(len(vocabulary), len(pieces)))])
        self.blank = self.b.piece_to_id(_BLANK)
        probe = " x  y "
        inside = any(_BLANK in p.lstrip(_BLANK) for p in pieces)
        self.whole = inside or self.bytes_b.joined(np.array(self.b.encode(probe))).tobytes() != f" {probe}".encode()
        self.ranked = self._ranked(json.loads(said)["model"], len(vocabulary))

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin: at texts, and at blanks after a character that is surely no white space."""
        begins = np.zeros(len(data), bool)
        if not self.whole and len(data) > 4:
            at = np.flatnonzero(data[4:] == 32) + 4  # the first bytes of a run of texts are not worth a rule
            one, two, three, four = (data[at - k] for k in (1, 2, 3, 4))
            far = one >= 0x80
            plain = (one > 0x20) & (one < 0x7F)
            of_two = far & (two >= 0xC3) & (two <= 0xDF)
            of_three = far & (two >= 0x80) & (two < 0xC0) & ((three == 0xE0) | ((three >= 0xE4) & (three <= 0xEF)) | ((three == 0xE3) & (two > 0x80)))
            of_four = far & (three >= 0x80) & (three < 0xC0) & (four >= 0xF0)
            begins[at[plain | of_two | of_three | of_four]] = True
        begins[offsets[:-1]] = True
        return np.flatnonzero(begins)

    def _ranked(self, model: dict, n: int):
        """A's encoder by ranks, a faster one, where the vocabulary numbers bytes and merges in their order; else None."""
        import tiktoken

        ids, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if self.whole or any(ids.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)) or n < 256 + len(merges):
            return None
        first, size, every = self.bytes_a.first.tolist(), self.bytes_a.size.tolist(), self.bytes_a.bytes.tobytes()
        ranks = {every[first[i] : first[i] + size[i]]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("of_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _tokens(self, texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For A and for B the tokens of the texts, end to end, and how many each has.

        Texts of plain letters that end in one are encoded end to end, as they would be cut there again; the others one by one."""
        raw, offsets = T.text_bytes(texts)
        odd = np.append(0, np.cumsum(~_PLAIN[raw]))
        plain = (odd[offsets[1:]] == odd[offsets[:-1]]) & ~_BLANKS[raw[offsets[1:] - 1]] & (self.ranked is not None)
        size = np.diff(offsets)
        run = taken(raw, offsets[:-1], size, np.flatnonzero(plain))
        upto = np.append(0, np.cumsum(size[plain]))
        cuts = np.append(upto[np.searchsorted(upto, np.arange(0, upto[-1], RUN))], upto[-1])
        joined = [run[x:y].tobytes().decode() for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y > x]
        rest = texts.filter(pa.array(~plain)).to_pylist()
        out = []
        for table, fast, slow in (
            (self.bytes_a, lambda: [self.ranked.encode_to_numpy("".join(joined), disallowed_special=())] if joined else [], lambda: [e.ids for e in self.a.encode_batch_fast(rest, add_special_tokens=False)]),
            (self.bytes_b, lambda: self.b.encode([t[1:] for t in joined], num_threads=1), lambda: [x or ([] if self.whole else [self.blank]) for x in self.b.encode([t[1:] for t in rest], num_threads=1)]),
        ):
            ids = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in fast()]])
            at = np.searchsorted(np.append(0, np.cumsum(table.size[ids])), upto)
            lists = slow()
            n = np.empty(len(texts), np.int64)
            n[plain], n[~plain] = np.diff(at), [len(x) for x in lists]
            place = np.empty(len(texts), np.int64)
            place[plain], place[~plain] = at[:-1], len(ids) + np.cumsum(n[~plain]) - n[~plain]
            every = np.concatenate((ids, np.fromiter((i for x in lists for i in x), np.int64, int(n[~plain].sum()))))
            out.append((taken(every, place, n, np.arange(len(texts))), n))
        return tuple(out)

    def aligned(self, texts: pa.Array) -> Chunks:
        """Each of these texts begins with a blank."""
        raw, offsets = T.text_bytes(texts)
        (a, n_a), (b, n_b) = self._tokens(texts)
        good = self._kept(self.bytes_a, a, n_a, raw, offsets) & self._kept(self.bytes_b, b, n_b, raw, offsets)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        group_a, group_b = components(np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b]))
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        groups, pair, times = linked(a, b, group_a, group_b, n_groups)
        upto_a, upto_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        last = np.append(0, group_a + 1)[upto_a]  # the number of groups up to each text
        link = np.searchsorted(groups, last)
        per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        # the written form: A's ids, then B's, group by group, each with what follows it
        ids = np.empty(len(a) + len(b), np.int64)
        ids[np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]] = a
        ids[np.arange(len(b)) + np.cumsum(per_a)[group_b]] = b
        body = self.decimal.joined(ids)
        end = np.append(0, np.cumsum(self.decimal.size[ids]))
        ends = np.cumsum(per_a + per_b)
        body[end[ends - per_b] - 1], body[end[ends] - 1] = ord("|"), ord(";")
        written = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(end[upto_a + upto_b]), pa.py_buffer(body)])
        total = np.append(0, np.cumsum(times))[link]
        numbers = {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(last), "n_links": np.diff(total)}
        return Chunks(good, numbers, written, link[:-1], np.diff(link), pair, times)

    @staticmethod
    def _kept(table: Table, ids: np.ndarray, n: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts (bytes between offsets) are the joined bytes of their n tokens."""
        upto = np.append(0, np.cumsum(table.size[ids]))[np.append(0, np.cumsum(n))]
        joined = table.joined(ids)
        if np.array_equal(upto, offsets) and np.array_equal(joined, raw):
            return np.ones(len(n), bool)
        return np.array([np.array_equal(joined[a:b], raw[x:y]) for a, b, x, y in zip(upto[:-1], upto[1:], offsets[:-1], offsets[1:], strict=True)], bool)


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _rows(data: np.ndarray, offsets: np.ndarray, by: Aligner) -> tuple[list[pa.Array], pa.Array, pa.Array]:
    """Numbers, digests, pairs and times of a run of texts."""
    n = len(offsets) - 1
    full = np.flatnonzero(np.diff(offsets) > 0)
    spaced = np.insert(data, offsets[full], 32)
    bounds = np.append(offsets[full], offsets[-1]) + np.arange(len(full) + 1)
    start = by.chunks(spaced, bounds) if len(full) else np.zeros(0, np.int64)
    every = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(np.append(start, len(spaced))), pa.py_buffer(np.ascontiguousarray(spaced))])
    coded = every.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    chunks = by.aligned(coded.dictionary)
    text = full[np.searchsorted(bounds, start, "right") - 1]
    bad = np.zeros(n, bool)
    bad[text[~chunks.good[ids]]] = True
    first = np.searchsorted(text, np.arange(n + 1))
    sums = []
    for each in chunks.numbers.values():
        upto = np.append(0, np.cumsum(each[ids]))
        sums.append(pa.array(np.where(bad, 0, upto[first[1:]] - upto[first[:-1]])))
    written = chunks.written.take(pa.array(ids))
    body, at = written.buffers()[2], np.frombuffer(written.buffers()[1], np.int64)[: len(ids) + 1][first].tolist()
    body = memoryview(body) if body is not None else b""
    digests = ["" if x or low == high else hashlib.sha256(body[low : high - 1]).hexdigest() for x, low, high in zip(bad.tolist(), at[:-1], at[1:], strict=True)]
    sums.append(pa.array(digests, pa.string()))
    # each text's different chunks, then their pairs
    kinds = max(len(chunks.good), 1)
    key, count = np.unique(text * kinds + ids, return_counts=True)
    doc, which = np.divmod(key, kinds)
    stays = ~bad[doc]
    doc, which, count = doc[stays], which[stays], count[stays]
    n_pairs = chunks.size[which]
    times = taken(chunks.times, chunks.first, chunks.size, which) * np.repeat(count, n_pairs)
    key = np.repeat(doc, n_pairs) << 42 | taken(chunks.pair, chunks.first, chunks.size, which)
    order = np.argsort(key)
    key, times = key[order], times[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    times = np.add.reduceat(times, new) if len(new) else times
    doc, pair = key[new] >> 42, key[new] & ((1 << 42) - 1)
    lists = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return sums, *(pa.ListArray.from_arrays(pa.array(lists), pa.array(x)) for x in (pair, times))


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def align(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the text's different linked id pairs with how often each is linked
    (``pairs``: A's id times ``PAIR`` plus B's id; ``times``), a row for each row of docs.

    A null or empty text, or one whose bytes either tokenizer does not keep, has no tokens: zeros, an empty digest and no pairs.
    Repeated rows and null ids each have their row; a text of any length is encoded whole; other columns are ignored."""
    rows, new, _ = positional(docs, "doc_id", "text")
    given = rows.select(*[F.col(v).alias(k) for k, v in new.items()])
    names = ["doc_id", *[x.split()[0] for x in _ALIGNED.split(", ")]]

    def run(batches):
        by = aligner(path_a, path_b)
        for batch in batches:
            for part, data, offsets in T.pieces(batch, limit=PIECE):
                sums, pairs, times = _rows(data, offsets, by)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *sums, pairs, times], names=names)

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, {_ALIGNED}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold a pair linked, and whether no other pair of its A id is held by more."""
    n = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.shiftright("pair", PAIR.bit_length() - 1)
    top = n.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return n.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def report(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE, most: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, a row for each row of docs.

    ``most`` is the number of counts up to which they are broadcast.  Edge cases are as in ``align``; documents with equal ids or texts count each for
    themselves; of equal counts all are best; an empty table gives no rows."""
    stored = Stored(align(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counts = if_small(cut(pair_counts(stored.df)), most)
    links = stored.df.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    rows = stored.df.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
