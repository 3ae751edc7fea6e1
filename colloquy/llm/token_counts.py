"""Edit-aware token counts.

A text is cut by the tokenizer's pattern into pre-tokens, which are encoded apart from
each other; its token count is their sum.  Each document keeps a segment tree: leaves are runs of
pre-tokens (length and tokens of each), inner nodes the sums of characters and tokens below, in heap order
(node i has the children 2 i and 2 i + 1).  The nodes are columns of the state, beside the text.
An edit is applied by walking down to the pre-tokens it touches, splitting the new
text from the last boundary that the edit cannot reach until it meets an old boundary
again, encoding only those pre-tokens, dealing them to the leaves in between, and renewing the sums above
those.  Only a text that outgrows its leaves fourfold is planted anew (from stored counts; nothing is encoded again).

A boundary is safe where the pre-token before it ends two characters or more before
the edit: the pattern's alternatives look at most one character beyond what follows
a match (the contractions) and never back.

``build`` makes the state (text, leaves and nodes) of whole documents, and
``apply_edits`` turns a state and edits into the next state; both are narrow passes,
so a document's text moves only when its edits come from another table.  The vocabulary is a parameter: a
path that every executor can read, or the name of a file that was given to the job (``SparkContext.addFile``).
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens in a leaf of the tree; a leaf of more than four times as many is parted.
LEAF = 64
#: Pre-tokens whose counts a worker remembers at once.
MEMORY = 300_000


class _Counter:
    """Token counts of pre-tokens."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("of_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding._encode_single_piece(piece))  # by merges alone: a piece is not split again
            if len(self.known) >= MEMORY:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n


@lru_cache(4)
def counter(path: str) -> _Counter:
    return _Counter(path)


class Edit(NamedTuple):
    """``length`` characters from ``start`` are replaced by ``text``; both are cut to the text's bounds."""

    start: int
    length: int
    text: str


class TokenTree:
    """A text's tree: pre-token lengths and tokens by leaf, and the nodes' sums.

    ``sizes`` and ``tokens`` are those of every pre-token, ``held`` how many of them each leaf has; without
    ``chars`` and ``sums`` (the nodes) the tree is planted."""

    def __init__(self, text: str, sizes, tokens, by: _Counter, held=None, chars=None, sums=None):
        self.text, self.by, self.encoded = text, by, 0
        sizes, tokens = np.asarray(sizes, np.int32), np.asarray(tokens, np.int32)
        self._part(sizes, tokens, np.asarray(held, np.int64) if held is not None else np.diff(np.append(np.arange(0, max(len(sizes), 1), LEAF), len(sizes))))
        if chars is None:
            self._plant()
        else:
            self.chars, self.sums = np.array(chars, np.int64), np.array(sums, np.int64)
            self.base = len(self.chars) // 2

    @classmethod
    def of(cls, text: str, by: _Counter) -> TokenTree:
        pieces = by.pattern.findall(text)
        return cls(text, [len(p) for p in pieces], [by.count(p) for p in pieces], by)

    def _part(self, sizes: np.ndarray, tokens: np.ndarray, held: np.ndarray) -> None:
        end = np.cumsum(held).tolist()
        self.leaves = [(sizes[a:b], tokens[a:b]) for a, b in zip([0, *end[:-1]], end, strict=True)]

    def _plant(self) -> None:
        self.base = 1 << max(len(self.leaves) - 1, 0).bit_length()
        self.chars, self.sums = np.zeros(2 * self.base, np.int64), np.zeros(2 * self.base, np.int64)
        self._renew(0, len(self.leaves) - 1)

    def _renew(self, low: int, high: int) -> None:
        """The sums of the leaves low to high and of all nodes above them."""
        for k in range(low, high + 1):
            self.chars[self.base + k], self.sums[self.base + k] = (int(x.sum()) for x in self.leaves[k])
        low, high = self.base + low, self.base + high
        while low > 1:
            low, high = low // 2, high // 2
            for x in (self.chars, self.sums):
                x[low : high + 1] = x[2 * low : 2 * high + 2].reshape(-1, 2).sum(1)

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1])

    def state(self) -> dict:
        return {"leaf_chars": np.concatenate([a for a, _ in self.leaves]), "leaf_tokens": np.concatenate([b for _, b in self.leaves]), "leaf_held": np.array([len(a) for a, _ in self.leaves], np.int32), "node_chars": self.chars, "node_tokens": self.sums}

    def find(self, end: int) -> tuple[int, int, int]:
        """(leaf, index, start) of the first pre-token that ends at ``end`` or later; past the last one if none does."""
        i, start = 1, 0
        if self.chars[1] < end:
            return len(self.leaves) - 1, len(self.leaves[-1][0]), int(self.chars[1])
        while i < self.base:
            i *= 2
            if start + self.chars[i] < end or self.chars[i] == 0:
                start += int(self.chars[i])
                i += 1
        ends = start + np.cumsum(self.leaves[i - self.base][0], dtype=np.int64)
        k = int(np.searchsorted(ends, end))
        return i - self.base, k, int(ends[k - 1]) if k else start

    def apply(self, edit: Edit) -> None:
        a = min(max(edit.start, 0), len(self.text))
        b = min(a + max(edit.length, 0), len(self.text))
        leaf, index, start = self.find(max(a - 1, 1))
        text = self.text[:a] + edit.text + self.text[b:]
        grown = len(text) - len(self.text)
        old_leaf, old_index, old = leaf, index, start
        sizes, tokens, at = [], [], start
        for m in self.by.pattern.finditer(text, start):
            sizes.append(m.end() - at)
            tokens.append(self.by.count(m.group()))
            self.encoded += 1
            at = m.end()
            if at < b + grown:
                continue
            while old < at - grown and old_leaf < len(self.leaves):
                if old_index >= len(self.leaves[old_leaf][0]):
                    old_leaf, old_index = old_leaf + 1, 0
                    continue
                old += int(self.leaves[old_leaf][0][old_index])
                old_index += 1
            if old == at - grown and old >= b:
                break
        else:
            old_leaf, old_index = len(self.leaves) - 1, len(self.leaves[-1][0])
        if old_leaf == len(self.leaves):
            old_leaf, old_index = old_leaf - 1, len(self.leaves[-1][0])
        self.text = text
        first, last = self.leaves[leaf], self.leaves[old_leaf]
        merged = [np.concatenate((first[j][:index], np.array(new, np.int32), last[j][old_index:])) for j, new in enumerate((sizes, tokens))]
        n, count = len(merged[0]), old_leaf - leaf + 1
        if n <= 4 * LEAF * count:
            cuts = [n * k // count for k in range(count + 1)]
            self.leaves[leaf : old_leaf + 1] = [(merged[0][x:y], merged[1][x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            self._renew(leaf, old_leaf)
        else:
            parts = self.leaves[:leaf] + [tuple(merged)] + self.leaves[old_leaf + 1 :]
            sizes, tokens = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
            self._part(sizes, tokens, np.diff(np.append(np.arange(0, len(sizes), LEAF), len(sizes))))
            self._plant()


_STATE = {"leaf_chars": "array<int>", "leaf_tokens": "array<int>", "leaf_held": "array<int>", "node_chars": "array<long>", "node_tokens": "array<long>"}
_SQL = ", ".join(f"{k} {v}" for k, v in _STATE.items()) + ", n_tokens long"
_ROWS = 256


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _columns(trees: list[TokenTree]) -> dict[str, pa.Array]:
    states = [t.state() for t in trees]
    out = {}
    for k, kind in _STATE.items():
        parts = [s[k] for s in states]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
        values = np.concatenate(parts) if parts else np.zeros(0)
        out[k] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32() if kind == "array<int>" else pa.int64()))
    return out | {"n_tokens": pa.array([t.n_tokens for t in trees], pa.int64())}


def _build(path: str):
    def run(batches):
        by = counter(path)
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(i, _ROWS)
                new = _columns([TokenTree.of(t or "", by) for t in rows.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*rows.columns, *new.values()], names=[*rows.schema.names, *new])

    return run


def _numbers(column) -> list[np.ndarray]:
    """The lists of a column as arrays; null is empty."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    none = column.is_null().to_numpy(zero_copy_only=False)
    return [values[a:a] if x else values[a:b] for a, b, x in zip(offsets[:-1], offsets[1:], none, strict=True)]


def _apply(path: str, edits: str):
    def run(batches):
        by = counter(path)
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(i, _ROWS)
                texts, trees = [], []
                for text, todo, *state in zip(rows.column("text").to_pylist(), rows.column(edits).to_pylist(), *(_numbers(rows.column(k)) for k in _STATE), strict=True):
                    sizes, tokens, held, chars, sums = state
                    tree = TokenTree(text or "", sizes, tokens, by, held, chars, sums) if len(chars) else TokenTree.of(text or "", by)
                    for e in todo or ():
                        if e is not None:
                            tree.apply(Edit(e["start"] or 0, e["length"] or 0, e["text"] or ""))
                    texts.append(tree.text if todo else text)
                    trees.append(tree)
                new = {"text": pa.array(texts, pa.string())} | _columns(trees) | {"n_encoded": pa.array([t.encoded for t in trees], pa.int64())}
                columns = dict(zip(rows.schema.names, rows.columns, strict=True)) | new
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def build(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs with its trees: ``leaf_chars`` and ``leaf_tokens`` of every pre-token, ``leaf_held`` (pre-tokens of each leaf),
    ``node_chars`` and ``node_tokens`` (the nodes in heap order, the root is number 1), and ``n_tokens``.

    A null text has the tree of an empty one; columns of these names are replaced; repeated rows each have a tree."""
    out = docs.select(*[c for c in docs.columns if c.lower() not in (*_STATE, "n_tokens")])
    return out.mapInArrow(_build(path), f"{_fields(out)}, {_SQL}")


def apply_edits(state: DataFrame, edits: str = "edits", path: str = VOCABULARY) -> DataFrame:
    """The next state: texts, leaves, nodes and counts after the edits of each row, one after the other, with
    ``n_encoded``, the pre-tokens that had to be encoded.

    ``edits`` names an array<struct<start, length, text>> column; null stands for no edit and a null text for ''."""
    old = state.drop("n_encoded")
    return old.mapInArrow(_apply(path, edits), f"{_fields(old)}, n_encoded long")


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """state with the column ``edits`` from a table edits(doc_id, seq, start, length, text), in the order of (seq, start, length, text)."""
    by = edits.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "text"))).alias("edits"))
    return state.join(by, "doc_id", "left")


def report(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_pretokens_after, n_encoded and n_chars_after, a row for each row of docs.

    Three edits a text: five characters go at a third, its first twenty are put in again at
    the half, and ten at two thirds become ``(edited)``.  A null text is an empty one; repeated rows are counted
    alike; an empty table gives no rows; other columns are ignored."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda at, length, text: F.struct(at.cast("int").alias("start"), F.lit(length).alias("length"), text.alias("text"))
    three = F.array(edit(F.floor(n / 3), 5, F.lit("")), edit(F.floor(n / 2), 0, F.coalesce(F.substring("text", 1, 20), F.lit(""))), edit(F.floor(n * 2 / 3), 10, F.lit("(edited)")))
    given = docs.select("doc_id", "text", three.alias("edits"))

    def run(batches):  # one worker: the state goes from one step to the next as it is
        def before():
            for b in _build(path)(batches):
                yield b.append_column("n_before", b.column("n_tokens"))

        for b in _apply(path, "edits")(before()):
            n = pa.array([len(x) for x in _numbers(b.column("leaf_chars"))], pa.int64())
            chars = pa.array([len(t or "") for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_before"), b.column("n_tokens"), n, b.column("n_encoded"), chars], names=["doc_id", "n_tokens", "n_tokens_after", "n_pretokens_after", "n_encoded", "n_chars_after"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_tokens_after long, n_pretokens_after long, n_encoded long, n_chars_after long")
