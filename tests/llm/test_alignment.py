"""The alignment of two tokenizers against a plain one over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm import ODD, odd, prose, table
from tokenizers import Tokenizer

from colloquy.llm import alignment


def plain(texts):
    """For each text its groups, by whole texts and sets of ends; None without tokens."""
    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    letters = alignment._byte_letters()
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        e = a.encode(" " + t, add_special_tokens=False)
        ba = [bytes(letters[c] for c in x) for x in e.tokens]
        ids = b.encode(t)
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids)]
        if not b"".join(ba) == b"".join(bb) == (" " + t).encode():
            out.append(None)
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (ba, bb)]
        both = sorted(set(ends[0]) & set(ends[1]))
        group = [[int(np.searchsorted(both, x)) for x in y] for y in ends]
        out.append([([i for i, g in zip(e.ids, group[0]) if g == k], [i for i, g in zip(ids, group[1]) if g == k]) for k in range(len(both))])
    return out


def expected(texts):
    docs = plain(texts)
    links = [Counter((x, y) for a, b in d or () for x in a for y in b) for d in docs]
    held = Counter(p for x in links for p in x)
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    rows = []
    for d, x in zip(docs, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in d or ())
        sums = [sum(len(y[k]) for y in d or ()) for k in (0, 1)]
        rows.append((*sums, len(d or ()), sum(x.values()), sum(n for p, n in x.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in x.items()), hashlib.sha256(text.encode()).hexdigest() if d else ""))
    return rows


def made(rng):
    bits = ["the ", "Wörter", " ", "  ", "\n", "\n \n", "\t", "漢字", " ", "　", " x ", "don't", "é" * 3, "<s>", "<|endoftext|>", "<0x41>", "12345", "aaaaaaaaaaaa", "😀 ", ". ", "\r\n", "ß", "naïve ", "\x00", "\x1c ", "\u0085 ", "ﬁ ", "﻿", "é "]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))


@pytest.mark.parametrize("most", [10**6, 10])
def test_same_as_whole_texts(spark, most):
    rng = random.Random(4)
    texts = [made(rng) for _ in range(300)] + [prose(rng, 60) for _ in range(20)] + [None, "", " ", "a ", "a  ", "▁", "x▁y", "same text", "same text", "z" * 3000, " " * 500]
    texts += [t for _, t, *_ in ODD if t and len(t) < 100]
    got = alignment.report(table(spark, list(enumerate(texts)), "doc_id long, text string"), most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = {r[0]: tuple(r[1:]) for r in got.collect()}
    for i, x in enumerate(expected(texts)):
        assert rows[i] == x, (i, texts[i])


def test_components_and_large_groups():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = [np.append(np.flatnonzero(rng.random(n) < p), n) for p in rng.random(2)]
        ends = [np.unique(e[e > 0]) for e in ends]
        ga, gb = alignment.components(*ends)
        both = np.intersect1d(*ends)
        assert (ga == np.searchsorted(both, ends[0])).all() and (gb == np.searchsorted(both, ends[1])).all()
        a, b = (rng.integers(0, 4, len(e)) for e in ends)
        want = Counter((int(g), int(x) * alignment.PAIR + int(y)) for x, g in zip(a, ga) for y, h in zip(b, gb) if g == h)
        for large in (0, 3, 10**6):
            got = Counter()
            for g, p, t in zip(*alignment.linked(a, b, ga, gb, len(both), large)):
                got[int(g), int(p)] += int(t)
            assert got == want


def test_edges(spark):
    out = alignment.report(odd(spark)).collect()
    assert len(out) == len(ODD) and {(r.doc_id, r.n_a, r.groups_sha256) for r in out if r.doc_id < 3} == {(1, 0, ""), (2, 0, "")}
    same = {tuple(r[1:]) for r in out if r.doc_id in (4, 5)}
    assert len(same) == 1
    assert alignment.report(table(spark, [])).count() == 0
    many = table(spark, [(None, "a b", None, None, None)]).withColumn("pairs", F.lit(1))
    assert alignment.report(many).first().n_a == 2


def test_texts_are_cut_into_chunks():
    by = alignment.aligner(alignment.BYTE_BPE, alignment.PIECE_BPE)
    raw = np.frombuffer(" one two  three\u3000 four \n five é six".encode(), np.uint8)
    at = by.chunks(raw, np.array([0, len(raw)]))
    assert not by.whole and [raw[a:b].tobytes().decode() for a, b in zip(at, [*at[1:], len(raw)])] == [" one", " two", "  three\u3000 four", " \n five", " é", " six"]
