"""The training-data operators against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import components, decontaminate, jaccard_join, language, licences, media, mixing, passages, queries, token_counts, tokens, toxicity, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "!!! ...", "en", "a", 7),
    (4, "short text", "en", None, 10),
    (5, "short text", "en", None, 10),
    (5, "short text", "en", None, 10),
    (6, "Ünïcode Wörter 漢字 çà", "fr", "b", 20),
    (7, "nul \0 inside " + "long " * 60000, "en", "b", None),
]


def odd(spark):
    """Nulls, empty, repeated and long rows, with extra columns of clashing names."""
    return table(spark, ODD).withColumns({c: F.lit("x") for c in ("score", "lang_pred", "media", "n_tokens", "key", "lead", "k1", "toxic", "__key", "edits")})


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(name, spark, duck, same_rows, data_dir):
    same_rows(queries.QUERIES[name](spark, data_dir), duck.sql(queries.ORACLE[name]))


def test_tokens():
    import pyarrow as pa

    texts = ["Ab c-d", None, "", "é漢x 9", "a" * 70000 + " b"]
    w = tokens.words_of(*tokens.text_bytes(pa.array(texts)))
    assert [int(x) for x in w.counts] == [len(words(t)) for t in texts]
    same = tokens.words_of(*tokens.text_bytes(pa.array(["x c", "C x"])))
    assert same.hashes[0] == same.hashes[3] and same.hashes[1] == same.hashes[2] and same.hashes[0] != same.hashes[1]
    sh, first = tokens.shingles(w)
    assert [int(x) for x in np.diff(first)] == [1, 0, 0, 1, 1]
    part = pa.array(["zz", "a b", "c"]).slice(1)
    assert list(tokens.words_of(*tokens.text_bytes(part)).counts) == [2, 1]


def test_language(spark, data_dir):
    d = spark.read.parquet(f"{data_dir}/documents.parquet")
    r = language.report(d).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    held = r[r.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and r.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for h, i in zip(r.held_out, r.doc_id))
    out = {(x.doc_id, x.lang_pred) for x in language.report(odd(spark)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= out
    assert language.report(table(spark, [])).count() == 0
    kept = language.keep_known(odd(spark))
    assert kept.columns == odd(spark).columns and {x.doc_id for x in kept.collect()} <= {4, 5, 6, 7}


def test_language_brute_force():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab cé.") for _ in range(80)) for _ in range(6)] + [None, ""]

    def brute(t):
        c = Counter()
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            p = f" {w} "
            c.update(w)
            c.update(p[i : i + 2] for i in range(len(p) - 1))
            c.update(p[i : i + 3] for i in range(len(p) - 2))
        return c

    keys = language.grams(texts, np.arange(len(texts)))
    got = Counter((keys >> np.uint64(54)).astype(int).tolist())
    assert [got[i] for i in range(len(texts))] == [sum(brute(t).values()) for t in texts]
    per, n = language._counted(keys)
    kinds = Counter((per >> np.uint64(54)).astype(int).tolist())
    assert [kinds[i] for i in range(len(texts))] == [len(brute(t)) for t in texts] and n.sum() == sum(got.values())


def hit_brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, item in items:
        v = words(item)
        n = min(10, len(v))
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(i)
    return len(w), len(hit), found


@pytest.mark.parametrize("block", [8 << 20, 60, 9])
def test_decontaminate(spark, block):
    rng = random.Random(5)
    items = [(i, prose(rng, n, 6)) for i, n in enumerate((30, 12, 10, 9, 3, 1, 0, 25))] + [(8, None), (9, "w1 w2"), (10, "w1 w2")]
    docs = [(i, " ".join(filter(None, (prose(rng, 20, 6), items[i % 8][1], prose(rng, 5, 6))))) for i in range(30)]
    docs += [(100 + i, t) for i, t, *_ in ODD[:7]]
    bench = table(spark, [(None, "w1 w1"), *items], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(table(spark, docs, "doc_id long, text string"), bench, block).collect()}
    for i, t in docs:
        n, h, found = hit_brute(t, [x for x in items if x[1]])
        r = got[i]
        ids = ",".join(sorted(map(str, found)))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, h, len(found), h > 0), i
        assert r.items_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    none = table(spark, [], "item_id long, text string")
    assert decontaminate.report(table(spark, docs, "doc_id long, text string"), none).where("contaminated").count() == 0


def test_decontaminate_clean(spark):
    span = "one two three four five six seven eight nine ten"
    long = " ".join(f"x{i}" for i in range(40))
    docs = odd(spark).unionByName(table(spark, [(20, f"{long} {span}. {long}", "en", "a", 1), (21, span, "en", "a", 1)]), allowMissingColumns=True)
    out = decontaminate.clean(docs, table(spark, [(1, span)], "item_id long, text string"))
    rows = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and rows[20] == f"{long} {long}" and 21 not in rows and rows[4] == "short text" and rows[1] is None


def jaccard_brute(texts, threshold=0.8):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0)))
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    ids = [i for s, i in rep.items() if s]
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if len(x & y) >= threshold * len(x | y):
                links[ids[a]] += 1
                links[ids[b]] += 1
                p, q = sorted((find(ids[a]), find(ids[b])))
                root[q] = p
    return {i: (i, 0) if not s else (find(rep[s]), links[rep[s]]) for i, s in sets.items()}


@pytest.mark.parametrize("bucket", [1024, 20, 4])
def test_jaccard_join(spark, bucket):
    rng = random.Random(7)
    base = [prose(rng, 120) for _ in range(12)]
    texts = {}
    for i in range(130):
        w = base[i % 12 if i < 40 else 0].split()
        for _ in range(rng.randrange(4 if i < 70 else 2)):
            w[rng.randrange(len(w))] = f"n{i}"
        texts[i] = " ".join(w)
    texts |= {200: "a b", 201: "A, b!", 202: "a c", 203: "", 204: "?!", 205: texts[3].upper()}
    docs = table(spark, [(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_classes(docs, bucket=bucket).collect()}
    assert got == jaccard_brute(texts)


def test_jaccard_join_odd(spark):
    rows = jaccard_join.near_classes(odd(spark)).collect()
    by = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(ODD) and by[5] == 4 and by[1] == 1 and by[2] == 2 and by[3] == 3
    kept = jaccard_join.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7]
    assert jaccard_join.near_classes(table(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000 + i, 2000) for i in range(50)] + [(7777, 7777), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r.node: r.root for r in components.components(table(spark, links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_compact_windows():
    rng = np.random.default_rng(0)
    for n, t in ((300, 10), (1000, 46), (45, 46), (9000, 46)):
        h = rng.permutation(n).astype(np.uint64) + np.uint64(1)
        h[n // 3] = 0
        want = set()
        for i in np.flatnonzero(h).tolist():
            a = b = i
            while a > 0 and h[a - 1] > h[i]:
                a -= 1
            while b < n - 1 and h[b + 1] > h[i]:
                b += 1
            if b - a + 1 >= t:
                want.add((a, i, b))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(h, t)))) == want


def test_passages(spark):
    rng = random.Random(11)
    shared = prose(rng, 70, 5000)
    near = shared.split()
    near[30] = "changed"
    fresh = lambda n: prose(rng, n, 10**6)
    docs = {1: f"{fresh(40)} {shared} {fresh(30)}", 2: f"{fresh(90)} {shared}", 3: f"{fresh(20)} {' '.join(near)} {fresh(20)}", 4: fresh(300), 5: f"{shared} {fresh(80)} {shared}", 6: fresh(60)}
    docs |= {7: docs[6], 8: " ".join(shared.split()[:40]) + " " + fresh(60), 9: "spam " * 500}
    rows = [(i, t, "en", "a", 1) for i, t in docs.items()]
    got = {r.doc_id: r for r in passages.report(table(spark, rows)).collect()}
    spans = {i: [tuple(map(int, s.split("-"))) for s in got[i].spans.split(";")] if got[i].spans else [] for i in docs}
    assert spans[1] == [] and spans[4] == [] and spans[6] == [] and spans[8] == []
    assert spans[2] == [(90, 160)] and spans[7] == [(0, 60)] and got[7].leads == [6] and got[2].leads == [1]
    assert spans[3] == [(20, 90)] and spans[5] == [(0, 70), (150, 220)] and got[1].n_followers >= 3
    clean = {r.doc_id: r.text for r in passages.remove_repeats(table(spark, rows)).collect()}
    assert words(clean[2]) == words(docs[2])[:90] and clean[1] == docs[1] and clean[7] == "" and clean[4] == docs[4]


def test_passages_of_frequent_lines(spark):
    """The leader of a group holds the line in an unrelated place, and there are several passages in a group."""
    rng = random.Random(13)
    fresh = lambda n: prose(rng, n, 10**6)
    lines = [prose(rng, 30, 5000) for _ in range(12)]
    docs = {i: f"{fresh(40)} {line} {fresh(40)}" for i, line in enumerate(lines)}
    docs |= {20 + i: f"{fresh(40)} {line} {fresh(40)} {line} {fresh(9)}" for i, line in enumerate(lines)}
    pairs = [(a, b) for a in range(12) for b in range(a)][:60]  # both orders of two lines would be near copies
    for k, (a, b) in enumerate(pairs):
        docs[100 + k] = f"{fresh(30)} {lines[a]} {lines[b]} {fresh(30)}"
        docs[200 + k] = f"{fresh(50)} {lines[a]} {lines[b]} {fresh(30)}"
    got = {r.doc_id: r.spans for r in passages.report(table(spark, [(i, t, "en", "a", 1) for i, t in docs.items()])).collect()}
    assert {i: s for i, s in got.items() if s} == {200 + k: "50-110" for k in range(60)}


def test_passages_odd(spark):
    assert passages.report(odd(spark)).count() == len(ODD)
    out = passages.remove_repeats(odd(spark))
    assert out.columns == odd(spark).columns and out.count() == len(ODD)
    assert passages.report(table(spark, [])).count() == 0


def test_licences(spark):
    mit = licences.TEMPLATES[0][1]
    rows = [
        (1, f"some text\nReleased under the MIT license!\nmore", "en", "a", 1),
        (2, "\n".join(mit[i : i + 80] for i in range(0, len(mit), 80)), "en", "a", 1),
        (3, f"intro\n\n{mit[:500]}\n{mit[500:]}\n\nend", "en", "a", 1),
        (4, "the licence of a poet is broad and free of any charge", "en", "a", 1),
        (5, "THIS work is licensed under the GNU General Public License, Version 3", "en", "a", 1),
    ]
    got = {r.doc_id: r for r in licences.report(table(spark, rows)).collect()}
    assert [got[i].licences for i in range(1, 6)] == ["MIT", "MIT", "MIT", "", "GPL-3.0"] and got[5].best_dice == 1.0 and got[4].best_dice == 0.0
    assert {r.doc_id: r.licences for r in licences.report(odd(spark)).collect()} == {i: "" for i in range(1, 8)}
    assert licences.report(table(spark, [])).count() == 0


def test_long_sentences_part_what_stands_around_them(spark):
    mit = licences.TEMPLATES[0][1]
    words = mit.split()
    half = len(words) // 2
    foreign = " ".join(f"w{i}" for i in range(600))
    rows = [(1, f"{' '.join(words[:half])}. {foreign}. {' '.join(words[half:])}"), (2, f"{' '.join(words[:half])}.\n{foreign}.\n{' '.join(words[half:])}"), (3, f"{' '.join(words[:half])}.\n\n{foreign}.\n\n{' '.join(words[half:])}"), (4, f"{foreign}.\n\n{mit}\n\n{foreign}")]
    got = {r.doc_id: r.licences for r in licences.report(table(spark, rows, "doc_id long, text string")).collect()}
    assert licences.most_words(licences.TEMPLATES) < 600 and got == {1: "", 2: "", 3: "", 4: "MIT"}


def test_licence_lines_of_the_documents(spark, data_dir):
    d = spark.read.parquet(f"{data_dir}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("text")).distinct()
    lines = d.where(r"lower(text) rlike 'licen[cs]ed under|released under|rights reserved|spdx'").select(F.xxhash64("text").alias("doc_id"), "text")
    found = licences.report(lines)
    assert found.count() >= 4 and found.where("n_matches = 0").count() == 0
    short = ["Licensed under CC BY-NC 4.0.", "Released under CC BY-SA 4.0", "SPDX-License-Identifier: MPL-2.0", "SPDX-License-Identifier: GPL-3.0-or-later"]
    got = {r.doc_id: r for r in licences.report(table(spark, list(enumerate(short)), "doc_id long, text string")).collect()}
    assert [got[i].best_dice for i in range(4)] == [1.0] * 4
    assert [i in got[k].licences.split(",") for k, i in enumerate(("CC-BY-NC-4.0", "CC-BY-SA-4.0", "MPL-2.0", "GPL-3.0"))] == [True] * 4


def test_token_tree():
    by = token_counts.counter(token_counts.VOCABULARY)
    rng = random.Random(1)
    alpha = "ab're'll 's  \n\t12,.!é 'd'x  "
    text = lambda *n: "".join(rng.choice(alpha) for _ in range(rng.choice(n)))
    for _ in range(250):
        tree = token_counts.TokenTree.of(text(0, 1, 5, 40, 900), by)
        for _ in range(4):
            e = token_counts.Edit(rng.randint(0, len(tree.text) + 1), rng.choice([0, 1, 3, 50, 10**6]), text(0, 1, 2, 20, 600))
            a = min(e.start, len(tree.text))
            want = tree.text[:a] + e.text + tree.text[a + e.length :]
            tree.apply(e)
            assert tree.text == want and tree.state()["leaf_chars"].tolist() == [len(p) for p in by.pattern.findall(want)]
            fresh = token_counts.TokenTree(want, tree.state()["leaf_chars"], tree.state()["leaf_tokens"], by, tree.state()["leaf_held"])
            assert (fresh.chars == tree.chars).all() and (fresh.sums == tree.sums).all()
            assert tree.n_tokens == len(by.encoding.encode_ordinary(want))
    big = token_counts.TokenTree.of("word and more " * 5000, by)
    big.apply(token_counts.Edit(30000, 3, "xyz"))
    assert big.encoded < 10


def test_token_counts(spark):
    by = token_counts.counter(token_counts.VOCABULARY)
    rows = token_counts.report(odd(spark)).collect()
    assert len(rows) == len(ODD)
    texts = {i: t or "" for i, t, *_ in ODD}
    for r in rows:
        assert r.n_tokens == len(by.encoding.encode_ordinary(texts[r.doc_id]))
    state = token_counts.build(table(spark, [(1, "one two three"), (2, None)], "doc_id long, text string"))
    edits = table(spark, [(1, 2, 0, 3, "ten"), (1, 1, 4, 3, "2")], "doc_id long, seq int, start int, length int, text string")
    out = {r.doc_id: r for r in token_counts.apply_edits(token_counts.with_edits(state, edits)).collect()}
    assert out[1].text == "ten 2 three" and out[1].n_tokens == 3 and out[2].text is None and out[2].n_tokens == 0


def test_media(spark):
    rows = {r.doc_id: r for r in media.report(odd(spark)).collect()}
    for i, t, *_ in ODD:
        raw = (t or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        file = media.wrap(want)
        frames, start = len(want) // 192, file.index(b"mdat") + 4
        keys = ",".join(f"{start + 192 * k}+192" for k in range(0, frames, 8))
        assert file[start : start + len(want)] == want and r.feature == f"codec=raw;seconds={frames / 25:.2f};samples={frames};keyframes={keys}"
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert rows[1].feature == rows[2].feature and rows[4].media_sha256 == rows[5].media_sha256
    assert media.report(odd(spark).limit(0)).collect() == []
    files = media.describe(media.with_media(odd(spark)).unionByName(table(spark, [(99, b"junk")], "doc_id long, media binary"), allowMissingColumns=True))
    got = {r.doc_id: r for r in files.collect()}
    assert got[99].codec is None and got[2].codec == "raw " and got[2].duration == pytest.approx(0.04)
    keys = got[7].keyframes
    assert bytes(got[7].media[keys[1].offset : keys[1].offset + 8]) == ODD[-1][1].encode()[8 * 192 : 8 * 192 + 8] and keys[0].length == 192


def test_media_boxes():
    file = media.wrap(bytes(range(192)) * 130)
    assert media.probe(file[:-9]) is None and media.probe(b"") is None and media.probe(b"\0" * 40) is None
    track = media.probe(file)
    assert media.payload(file, track) == bytes(range(192)) * 130 and track.key.tolist() == list(range(0, 130, 8))
    with pytest.raises(ValueError, match="positive multiple"):
        media.wrap(b"")


def test_warc(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(300)] + [(5, "http://h/5", "<p>5</p>" * 5), (None, None, None), (9, "u", "")]
    pages = table(spark, rows, "page_id long, url string, html string")
    a = warc.records(pages)
    worn = F.when(F.col("page_id").isin(17, 250), F.lit("x")).otherwise(F.col("html"))
    bad, seen = warc.audit(a, warc.records(pages.withColumn("w", worn), "w"))
    assert sorted(r.page_id for r in bad.collect()) == [17, 250]
    levels = {r.level: (r.compared, r.differ) for r in seen.collect()}
    assert levels[0][0] <= 32 and levels[0][1] == 2 and sum(c for c, _ in levels.values()) < 100
    assert warc.audit(a, a)[0].count() == 0
    file = sorted(a.where("file = 0").collect(), key=lambda r: r.offset)
    assert [r.offset for r in file] == [sum(x.length * x.copies for x in file[:k]) for k in range(len(file))] and [r.slot for r in file] == sorted(r.slot for r in file)
    none = warc.records(table(spark, [], "page_id long, url string, html string"))
    assert warc.audit(none, none)[0].count() == 0


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, rng.randrange(20, 60), 300).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["zqidiot", "zqtrash", "zqscum"])
        rows.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + r[0], *r[1:]) for r in ODD]
    docs, lab = table(spark, rows), table(spark, [*labels, (3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.report(docs, lab).toPandas().set_index("doc_id")
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert set(out.index[out.held_out & (out.index < 600)]) == set(held)
    assert all(out.predicted[i] == (i % 4 == 0) for i in held)
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all() and out.score.notna().all()
    few = toxicity.report(docs, lab, block=300).toPandas().set_index("doc_id")
    assert np.allclose(few.groupby(level=0).score.max(), out.groupby(level=0).score.max())
    nothing = toxicity.report(docs, table(spark, [], "doc_id long, quality int, toxic int"))
    assert nothing.where("predicted = 1").count() == 0
    assert toxicity.report(table(spark, []), lab).count() == 0


def fill(sizes):
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, target, free = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        share = total - sum(target[i] for i in range(len(sizes)) if i not in free)
        over = []
        for i in free:
            target[i] = share * weight[i] / sum(weight[k] for k in free)
            if target[i] > 2 * sizes[i]:
                over.append(i)
        if not over:
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
        free -= set(over)
    return target


def test_mixing(spark):
    for n in (1, 2, 5, 1000, 77777):
        assert sorted(mixing.permute(np.arange(n), n, 9).tolist()) == list(range(n))
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([0, 3, 40, 900])), "en", rng.choice(["a", "b", "Z", "é", None]), 1) for i in range(200)] + ODD
    docs = table(spark, rows)
    r = mixing.report(docs).toPandas()
    again = mixing.report(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert r.sort_values(key)[key].to_numpy().tolist() == again.sort_values(key)[key].to_numpy().tolist()
    assert (r.taken <= 2 * r["size"]).all() and len(r) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = {sizes[s]: t for s, t in zip(order, fill([sizes[s] for s in order]))}
    got = r.groupby("source_size").agg(target=("target", "max"), taken=("taken", "sum"))
    for size, t in want.items():
        assert got.target[size] == pytest.approx(t) and abs(got.taken[size] - t) <= 1
    m = mixing.mix(docs).toPandas()
    assert m.n_words.sum() == r.taken.sum() and not m.duplicated(["shard", "slot"]).any() and (m.n_words <= mixing.BLOCK).all()
    assert mixing.report(table(spark, [])).count() == 0 and mixing.mix(table(spark, [])).count() == 0


def test_pipeline(spark, data_dir):
    import corpus_pipeline as c

    assert [k for k, _ in c.STAGES] == ["language", "near_duplicates", "passages", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    now = docs
    for name, stage in c.STAGES[:-1]:
        now = stage(spark, now, data_dir).cache()
        assert now.columns == docs.columns, name
    after = {r.doc_id: r.text for r in now.collect()}
    classes = jaccard_brute(before)
    assert set(after) <= {i for i, (k, _) in classes.items() if k == i}
    assert decontaminate.report(now, spark.read.parquet(f"{data_dir}/benchmark.parquet")).where("contaminated").count() == 0
    out = c.run(spark, data_dir)
    assert {i for r in out.select("doc_ids").collect() for i in r.doc_ids} <= set(after) and out.count() > 0
    for _, stage in c.STAGES:
        stage(spark, docs.limit(0), data_dir).count()


def test_long_words(spark):
    """What a word says beyond 65,536 bytes counts."""
    import pyarrow as pa

    a, b = "a" * 65536 + "b" * 65536, "b" * 65536 + "a" * 65536
    h = tokens.words_of(*tokens.text_bytes(pa.array([a, b, a]))).hashes
    assert h[0] == h[2] and h[0] != h[1]
    docs = table(spark, [(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_join.keep_one(docs).collect()) == [1, 2]


def test_components_of_a_chain(spark):
    links = table(spark, [(i, i + 1) for i in range(3000)], "a long, b long")
    got = components.components(links).collect()
    assert len(got) == 3001 and {r.root for r in got} == {0}


def test_repeated_ids(spark):
    one, two = prose(random.Random(1), 40), prose(random.Random(2), 40)
    docs = table(spark, [(1, one), (1, two), (1, two), (2, two), (None, one)], "doc_id long, text string")
    assert sorted(r.text for r in jaccard_join.keep_one(docs).where("doc_id is not null").collect()) == sorted((one, two))
    assert jaccard_join.keep_one(docs).where("doc_id is null").count() == 1


def test_passage_recall(spark):
    """Exact passages and those of changed words, some with frequent lines in them, against brute force."""
    rng = random.Random(5)
    lines = [" ".join(f"l{k}x{i}" for i in range(rng.randrange(8, 36))) for k in range(6)]
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    docs, exact, near = {}, set(), set()
    for k in range(300):
        n = rng.choice([50, 52, 60, 75, 100])
        p = fresh(n)
        if rng.random() < 0.7:
            at = rng.randrange(n)
            p = (p[:at] + rng.choice(lines).split() + p[at:])[:n]
        q = list(p)
        for _ in range(rng.choice([0, 1, 1, 2])):
            q[rng.choice([rng.randrange(n), rng.randrange(4), n - 1 - rng.randrange(4)])] = "changed"
        x, y = ({tuple(z[i : i + 5]) for i in range(n - 4)} for z in (p, q))
        docs[k], docs[1000 + k] = (" ".join(fresh(rng.randrange(20, 60)) + z + fresh(30)) for z in (p, q))
        if len(x & y) >= 0.8 * len(x | y):
            (exact if p == q else near).add(1000 + k)
    docs |= {2000 + k: " ".join(fresh(60) + lines[k % 6].split() + fresh(60)) for k in range(200)}
    got = {r.doc_id: r.n_spans for r in passages.report(table(spark, [(i, t, "en", "a", 1) for i, t in docs.items()])).collect()}
    assert all(got[i] for i in exact) and sum(got[i] > 0 for i in near) >= 0.97 * len(near) and len(near) > 100
    assert not any(got[i] for i in docs if i >= 2000 or i < 1000)


def test_long_passage(spark):
    """A passage of more than 65,536 shingles is one."""
    words_ = [f"w{i * 7919 % 100003}" for i in range(70000)]
    rows = [(1, " ".join(words_)), (2, "x y z " + " ".join(words_) + " end")]
    got = {r.doc_id: r for r in passages.report(table(spark, rows, "doc_id long, text string")).collect()}
    assert got[2].spans == "3-70003" and got[1].n_spans == 0


BSD = "\n\n".join(["BSD 2-Clause License", "Copyright (c) 2020, A. Author. All rights reserved.", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution."])


def test_licence_files(spark):
    by = {}
    for licence, text in licences.TEMPLATES:
        by.setdefault(licence, []).append(text)
    disclaimer = by["BSD-2-Clause"][1][by["BSD-2-Clause"][1].index("THIS SOFTWARE") :]
    mit = by["MIT"][0]
    at = [0, mit.index("The above copyright"), mit.index("THE SOFTWARE IS PROVIDED"), len(mit)]
    parts = [mit[a:b].strip() for a, b in zip(at, at[1:])]
    before, after = "An ordinary paragraph about software and its users.", "What follows has nothing to do with it."
    texts = {
        1: (f"{BSD}\n\n{disclaimer}", "BSD-2-Clause"),
        2: ("\n\n".join([before, "Copyright (c) 2020 A. Author", *parts, after]), "MIT"),
        3: (f"A long line that tells a story. Released under the MIT License. {before}", "MIT"),
        4: (f"ISC License\n\nCopyright (c) 2020, A. Author\n\n{by['ISC'][0]}\n\n{by['ISC'][1][len(by['ISC'][0]) :]}", "ISC"),
        5: (f"Copyright 2020 A. Author\n\n{by['Apache-2.0'][0]}".replace(" You may", "\n\nYou may").replace(" Unless", "\n\nUnless"), "Apache-2.0"),
        6: (f"                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n\n   {by['Apache-2.0'][-1]}", "Apache-2.0"),
        7: (by["GPL-2.0"][0], "GPL-2.0"),
        8: (by["GPL-3.0"][0], "GPL-3.0"),
        9: (by["LGPL-3.0"][0], "LGPL-3.0"),
        10: (by["AGPL-3.0"][0], "AGPL-3.0"),
        11: (by["CC-BY-4.0"][0], "CC-BY-4.0"),
        12: (by["CC-BY-SA-4.0"][0], "CC-BY-SA-4.0"),
        13: (by["CC-BY-NC-4.0"][0], "CC-BY-NC-4.0"),
        14: (by["CC-BY-NC-SA-4.0"][0], "CC-BY-NC-SA-4.0"),
        15: (by["BSD-3-Clause"][1], "BSD-3-Clause"),
        16: (by["GPL-3.0"][0].replace("version 3", "version 4"), ""),
        17: ("\n".join(["Released under the MIT License.", "something else", "Licensed under CC BY-SA 4.0."]), "CC-BY-SA-4.0,MIT"),
    }
    got = {r.doc_id: r for r in licences.report(table(spark, [(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")).collect()}
    found = {i: ",".join(x for x in got[i].licences.split(",") if x != "Proprietary") for i in texts}
    assert found == {i: x for i, (_, x) in texts.items()}
    assert all(r.n_tied == 0 for r in got.values()) and got[2].n_matches == 1 and got[17].n_matches == 2


def test_licence_anchors():
    """No text that reaches the threshold is without an anchor, or with fewer long words than are asked for."""
    anchors = set(licences.anchors(licences.TEMPLATES))
    many, least = licences.long_words(licences.TEMPLATES)
    rng = random.Random(0)
    assert least >= 3
    for _, text in licences.TEMPLATES:
        pairs = licences._pairs(text)
        if len(pairs) < licences.LONG:
            bare = [p for p in pairs if not anchors & set(p)]
            assert 2 * len(bare) < 0.8 * (len(bare) + len(pairs))
        else:
            for _ in range(50):
                words_ = set(licences._words(text))
                while True:
                    w = rng.choice(sorted(words_, key=lambda w: (w not in many, w))[: rng.randrange(1, 30)])
                    left = {p for p in pairs if set(p) <= words_ - {w}}
                    if 2 * len(left) < 0.8 * (len(left) + len(pairs)):
                        break
                    words_.discard(w)
                assert len(words_ & set(many)) >= least


def test_token_runs(spark):
    """Very long runs of blanks, letters and punctuation, and counts after edits."""
    by = token_counts.counter(token_counts.VOCABULARY)
    runs = [" " * 1_000_000, "a" * 300_000, "!?" * 200_000, "x" + " " * 70_000 + "y", "\n" * 50_000]
    rows = [(i, t) for i, t in enumerate(runs)] + [(100 + i, t) for i, t, *_ in ODD]
    for r in token_counts.report(table(spark, rows, "doc_id long, text string")).collect():
        t = dict(rows)[r.doc_id] or ""
        n = len(t)
        for start, length, new in ((n // 3, 5, ""), (n // 2, 0, t[:20]), (n * 2 // 3, 10, "(edited)")):
            t = t[:start] + new + t[start + length :]
        pieces = by.pattern.findall(t)
        assert (r.n_chars_after, r.n_pretokens_after, r.n_tokens_after) == (len(t), len(pieces), sum(map(by.count, pieces)))
        assert r.n_encoded <= len(pieces) + 20
    small = " ".join(runs[0][:40]) + "aaaa" * 20
    assert sum(map(by.count, by.pattern.findall(small))) == len(by.encoding.encode_ordinary(small))


def box(kind, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def test_media_damaged():
    """Damaged files give null or other tracks, whatever their counts and nesting say."""
    file = bytearray(media.wrap(bytes(range(192)) * 40))
    at = {k: file.index(k) + 4 for k in (b"stss", b"stsz", b"stsc", b"stco", b"stts")}
    for kind, offset, value in ((b"stss", 8, 5000), (b"stsz", 8, 2**32 - 1), (b"stsz", 4, 2**31), (b"stsc", 4, 2**32 - 1), (b"stsc", 12, 2**32 - 1), (b"stco", 4, 2**32 - 1), (b"stco", 8, 2**31), (b"stts", 4, 2**32 - 1)):
        bad = bytearray(file)
        bad[at[kind] + offset : at[kind] + offset + 4] = value.to_bytes(4, "big")
        found = media.tracks(bytes(bad))
        assert found == [] or (kind, offset) == (b"stsc", 12)
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    assert media.tracks(deep) == []
    rng = random.Random(0)
    for _ in range(300):
        bad = bytearray(file)
        for _ in range(rng.randrange(1, 20)):
            bad[rng.randrange(len(bad) - 700, len(bad))] = rng.randrange(256)
        for t in media.tracks(bytes(bad)):
            assert (t.offset + t.size <= len(bad)).all()


def test_media_tracks(spark):
    """Two tracks, sizes of four bits, an edit list and fragments."""
    n4, n2 = (lambda x: x.to_bytes(4, "big")), (lambda x: x.to_bytes(2, "big"))
    full = lambda kind, *parts, flags=0: box(kind, n4(flags), *parts)

    def trak(number, handler, codec, sizes, offset, edit=b""):
        table_ = [full(b"stsd", n4(1), box(codec, bytes(8))), full(b"stts", n4(1), n4(len(sizes)), n4(10)), full(b"stsc", n4(1), n4(1), n4(max(len(sizes), 1)), n4(1)) if sizes else full(b"stsc", n4(0)), full(b"stz2", n4(4), n4(len(sizes)), bytes(a << 4 | b for a, b in zip([*sizes, 0][::2], [*sizes, 0][1::2]))), full(b"stco", n4(1), n4(offset)) if sizes else full(b"stco", n4(0))]
        return box(b"trak", full(b"tkhd", n4(0), n4(0), n4(number)), edit, box(b"mdia", full(b"mdhd", n4(0), n4(0), n4(100), n4(0), n2(0), n2(0)), full(b"hdlr", n4(0), handler), box(b"minf", box(b"stbl", *table_))))

    head = box(b"ftyp", b"isom")
    data = box(b"mdat", bytes(range(30)))
    edit = box(b"edts", full(b"elst", n4(1), n4(500), n4(0), n4(1 << 16)))
    movie = box(b"moov", full(b"mvhd", n4(0), n4(0), n4(1000)), trak(1, b"vide", b"avc1", [3, 4, 5], len(head) + 8, edit), trak(2, b"soun", b"mp4a", [], 0), box(b"mvex", full(b"trex", n4(2), n4(1), n4(7), n4(2), n4(0))))
    base = len(head) + len(data) + len(movie)
    fragment = lambda offset: box(b"moof", box(b"traf", full(b"tfhd", n4(2)), full(b"trun", n4(4), n4(offset), flags=1)))
    moof = fragment(len(fragment(0)) + 8)
    file = head + data + movie + moof + box(b"mdat", b"abcdefgh")
    got = media.tracks(file)
    assert [(t.codec, t.kind, t.size.tolist(), t.seconds, t.shown) for t in got] == [("avc1", "vide", [3, 4, 5], 0.3, 0.5), ("mp4a", "soun", [2, 2, 2, 2], 0.28, None)]
    assert media.payload(file, got[0]) == bytes(range(12)) and media.payload(file, got[1]) == b"abcdefgh" and got[1].offset[0] == base + len(moof) + 8
    # Fragments without an offset go on where the one before them in the moof ends, whatever its track, unless they count from the moof.
    three = lambda offset, flags=0: box(b"moof", box(b"traf", full(b"tfhd", n4(2)), full(b"trun", n4(2), n4(offset), flags=1), full(b"trun", n4(1))), box(b"traf", full(b"tfhd", n4(1), n4(3), flags=16), full(b"trun", n4(1))), box(b"traf", full(b"tfhd", n4(2), flags=flags), full(b"trun", n4(1), n4(offset if flags else 0), flags=1)))
    for flags, last in ((0, b"jk"), (0x20000, b"ab")):
        moof = three(len(three(0)) + 8, flags)
        more = head + data + movie + moof + box(b"mdat", b"abcdefghijkl")
        got = media.tracks(more)
        assert media.payload(more, got[1]) == b"abcdef" + last and media.payload(more, got[0]) == bytes(range(12)) + b"ghi"
    torn = more.replace(moof, box(b"moof", box(b"traf", full(b"tfhd", n4(2)), full(b"trun", n4(9**9))), box(b"traf", full(b"tfhd", n4(1)), full(b"trun", n4(0)))))
    assert media.tracks(torn) == []
    row = media.describe(table(spark, [(1, file), (2, None), (3, file[:50])], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert [t.codec for t in row[0].tracks] == ["avc1", "mp4a"] and row[0].codec == "avc1" and row[1].tracks is None and row[2].tracks is None


def test_warc_lost_added_swapped(spark, tmp_path):
    html = lambda i: f"<p>{i}</p>\r\n\r\nWARC/1.1 é " * (i % 7)
    pages = table(spark, [(i, f"http://h/{i}", html(i)) for i in range(5000)] + [(7, "http://h/again", None), (None, None, None)] + [(9, f"u{i}", "x" * 50000 if i == 0 else "") for i in range(40)], "page_id long, url string, html string").withColumns({"rid": F.lit(1), "hash": F.lit("h")})
    a = warc.records(pages)
    lost = pages.where("page_id is null or page_id <> 4000").where("url is null or url <> 'u3'")
    changed = lost.withColumn("w", F.when(F.col("page_id") == 12, F.lit(html(13))).when(F.col("page_id") == 13, F.lit(html(12))).otherwise(F.col("html"))).unionByName(table(spark, [(4096, "new", "z", "z")], "page_id long, url string, html string, w string"), allowMissingColumns=True)
    bad, seen = warc.audit(a, warc.records(changed, "w"))
    rows = sorted((r.page_id, r.left_sha256 is None, r.right_sha256 is None, r.offset is None) for r in bad.collect())
    assert rows == [(9, False, True, False), (12, False, False, False), (13, False, False, False), (4000, False, True, False), (4096, True, False, True)]
    assert all(r.differ <= 5 for r in seen.collect()) and sum(r.compared for r in seen.collect()) < 200
    path = str(tmp_path / "warc")
    warc.write_files(pages, path)
    back = warc.read_files(spark, path)
    same = ["page_id", "url", "html"]
    assert sorted(map(repr, back.select(*same).collect())) == sorted(map(repr, pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).collect()))
    one = back.where("page_id = 123").first()
    import glob

    content = next(open(f, "rb").read() for f in glob.glob(f"{path}/*/*/*.txt") if one.name.endswith(f))
    assert content[one.offset : one.offset + one.length].startswith(b"WARC/1.1") and one.length == a.where("page_id = 123").first().length
    assert list(warc._parsed(content[: one.offset + one.length - 9]))[-1][4] < one.offset


def test_warc_copies_and_places(spark, tmp_path):
    """A lost copy is a difference, and every place that is named is that of the record in the written files, whatever gaps the ids have."""
    import glob
    import re as _re

    rows = [(2 * i, f"http://h/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(6000)] + [(8, "same", "z" * 99)] * 9000 + [(i * 100, f"two{i}", "t") for i in range(20)] * 2 + [(None, None, None)] * 3
    pages = table(spark, rows, "page_id long, url string, html string").repartition(7)
    once = pages.where("url like 'two%'").distinct().unionByName(pages.where("url is null or url not like 'two%'"))
    a = warc.records(pages)
    assert warc.audit(a, warc.records(pages.repartition(3)))[0].count() == 0
    bad = warc.audit(a, warc.records(once.where("page_id is null or page_id <> 4444")))[0].collect()
    assert sorted((r.page_id, r.left_copies, r.right_copies) for r in bad) == sorted([(i * 100, 2, 1) for i in range(20)] + [(4444, 1, None)])
    path = str(tmp_path / "warc")
    warc.write_files(pages, path)
    files = {tuple(map(int, _re.search("file=(-?[0-9]+)/part=([0-9]+)/", f).groups())): open(f, "rb").read() for f in glob.glob(f"{path}/*/*/*.txt")}
    placed = a.collect()
    assert sum(r.copies for r in placed) == len(rows) and sum(r.copies * r.length for r in placed) == sum(map(len, files.values()))
    for r in placed:
        record = files[r.file, r.part][r.offset : r.offset + r.length]
        assert record == files[r.file, r.part][r.offset + (r.copies - 1) * r.length :][: r.length]
        assert list(warc._parsed(record))[0][:2] == (r.page_id, r.url or "") and list(warc._parsed(record))[0][5] == r.length
    assert max(sum(r.copies for r in placed if (r.file, r.part) == k) for k in files) < 2 * warc.FILE
    back = warc.read_files(spark, path)
    assert back.count() == len(rows) and {(r.file, r.part) for r in back.select("file", "part").distinct().collect()} == set(files)


def test_mixing_by_document(spark):
    """Every source has its target to the word, whatever its size; what is taken of a document is what the mix holds of it."""
    rng = random.Random(8)
    for sizes in ([("a", 145), ("b", 100), ("c", 1)], [("a", 200), ("b", 3), ("c", 5000), ("d", 128), ("e", 256)], [("a", 40)], [("a", 0), ("b", 129)]):
        rows, k = [], 0
        for source, n in sizes:
            while n > 0 or k == 0:
                part = min(n, rng.randrange(1, 70))
                rows.append((k, " ".join(f"d{k}" for _ in range(part)), "en", source, 1))
                n, k = n - part, k + 1
        docs = table(spark, rows)
        r = mixing.report(docs).toPandas()
        by = r.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(target=("target", "max"), taken=("taken", "sum"))
        assert ((by.taken - by.target).abs() <= 0.5).all(), by
        m = mixing.mix(docs).toPandas()
        held = Counter(w for t in m.text for w in t.split())
        assert {f"d{i}": n for i, n in zip(r.doc_id, r.taken) if n} == dict(held)
        assert all(list(ids) == list(dict.fromkeys(int(w[1:]) for w in t.split())) for ids, t in zip(m.doc_ids, m.text))


def test_mixing_draws(spark):
    """Shards' counts are drawn: they vary as multinomial ones do, and add up to the targets."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 400), "en", "abcdefgh"[min(i % 16, 7)], 1) for i in range(4000)]
    by = mixing.targets(mixing.sizes(table(spark, rows).withColumn("__tie", F.lit(0)))).cache()
    drawn = mixing.draws(by).toPandas()
    want = {r["__key"]: r.slots for r in by.collect()}
    assert drawn.groupby("__key").n.sum().to_dict() == want
    total, shards = sum(want.values()), drawn.shard.nunique()
    per = drawn.groupby("shard").n.sum()
    assert shards == -(-total // mixing.SHARD) and set(per[:-1]) == {mixing.SHARD} and per.sum() == total
    wide = drawn.pivot_table(index="shard", columns="__key", values="n", fill_value=0).iloc[:-3]
    p = np.array([want[k] / total for k in wide.columns])
    chi = ((wide - mixing.SHARD * p) ** 2 / (mixing.SHARD * p)).sum(axis=1)
    assert 0.5 * (len(p) - 1) < chi.mean() < 1.6 * (len(p) - 1)
    taken = mixing.slots(by).groupBy("__key").agg(F.count("*").alias("n")).toPandas().set_index("__key").n.to_dict()
    assert taken == want and mixing.draws(by, 1).toPandas().sort_values(["shard", "__key"]).n.tolist() != drawn.sort_values(["shard", "__key"]).n.tolist()


CLASHES = ("Score", "score", "lang_pred", "__hit", "__items", "__n_words", "__spans", "spans", "__sum", "__n", "__key", "__size", "h", "at", "p", "l", "w", "lo", "hi", "key", "c", "r", "Media")


def clashing(spark):
    return odd(spark).drop(*[c for c in odd(spark).columns if c.lower() in {x.lower() for x in CLASHES}]).select("*", *[F.lit("x").alias(c) for c in CLASHES if c != "score"], F.lit("y").alias("Shingles"))


@pytest.mark.parametrize("name", ["language", "near_duplicates", "passages", "decontamination", "mixing"])
def test_stage_on_clashing_columns(name, spark, data_dir):
    import corpus_pipeline as c

    docs = clashing(spark)
    out = dict(c.STAGES)[name](spark, docs, data_dir)
    assert out.count() > 0
    if name != "mixing":
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]


def test_operators_on_clashing_columns(spark):
    docs = clashing(spark)
    labels = table(spark, [(4, 1, 1), (5, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    for report in (language.report, licences.report, token_counts.report, jaccard_join.near_classes, passages.report, media.report, mixing.report, lambda d: toxicity.report(d, labels), lambda d: decontaminate.report(d, table(spark, [(1, "long long")], "item_id long, text string"))):
        assert report(docs).count() >= len({i for i, *_ in ODD})
    assert language.report(table(spark, [(None, "text", "en", "a", 1)])).first().held_out is False


def kneser_ney_brute(texts):
    """{(class, letters): probability of the last letter after those before it} by the recursion itself, for groups of LOW letters and more."""
    high, low, d = toxicity.HIGH, toxicity.LOW, toxicity.DISCOUNT
    full = Counter()
    for t, c in texts:
        for w in words(t):
            for i in range(len(w)):
                full[c, ("^" * high + w[: i + 1])[-high:]] += 1
    number = {high: full}
    for m in range(high - 1, low - 2, -1):
        number[m] = Counter((c, g[1:]) for (c, g) in number[m + 1])

    def p(c, g):
        m = len(g)
        if m == low - 1:
            every = Counter()
            for (_, k), n in number[m].items():
                every[k] += n
            mine = {k: n for k, n in every.items() if k[:-1] == g[:-1]}
            total = sum(mine.values())
            return (max(every[g] - d, 0) + d * len(mine) / toxicity.CODES) / total
        mine = {k: n for (x, k), n in number[m].items() if x == c and k[:-1] == g[:-1]}
        total = sum(mine.values())
        if not total:
            return p(c, g[1:])
        freed = sum(min(n, d) for n in mine.values()) / total
        return max(mine.get(g, 0) - d, 0) / total + freed * p(c, g[1:])

    return {(c, k): p(c, k) for m in range(low, high + 1) for _, k in number[m] for c in (0, 1)}


def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(9)
    texts = [("".join(rng.choice("abcé  ") for _ in range(40)), i % 3 == 0) for i in range(30)]
    rows = table(spark, [(i, t, int(c)) for i, (t, c) in enumerate(texts)], "doc_id long, text string, toxic int")
    letters = toxicity.alphabet(rows)
    many = Counter(x for t, _ in texts for x in t if x != " ")
    assert [letters[ord(x)] for x, _ in sorted(many.items(), key=lambda kv: (-kv[1], kv[0]))] == [1, 2, 3, 4] and letters.sum() == 10
    got = toxicity.model_table(toxicity.counts(rows, letters)).where("own").toPandas()
    want = kneser_ney_brute([(t, int(c)) for t, c in texts])

    def key(g):
        out = 0
        for ch in g:
            out = out << toxicity.BITS | (0 if ch == "^" else int(letters[ord(ch)]))
        return out

    assert (got.v0 == got.v1).all()
    have = {(r.m, r.k): r.v0 for r in got.itertuples()}
    groups = {k for _, k in want}
    assert len(have) == len({(len(g), key(g)) for g in groups})
    for g in groups:
        assert have[len(g), key(g)] == pytest.approx(np.log(want[1, g] / want[0, g])), g
    # a text's evidence is the sum over its letters, of whichever order has seen them
    one = texts[3][0]
    model = toxicity.evidence(table(spark, [(1, one), (2, None)], "doc_id long, text string"), toxicity._of(toxicity.model_table(toxicity.counts(rows, letters)), 0), letters).toPandas().set_index("doc_id")
    half = toxicity.model_table(toxicity.counts(rows.withColumn("apart", F.expr("cast(doc_id % 2 = 1 as int)")), letters)).orderBy("m", "k", "own")
    alone = toxicity.model_table(toxicity.counts(rows.where("doc_id % 2 = 0"), letters)).orderBy("m", "k", "own")
    a, b = (toxicity._of(x, i).toPandas() for x, i in ((half, 1), (alone, 0)))
    assert a[["m", "k", "own"]].equals(b[["m", "k", "own"]]) and np.allclose(a.v, b.v)
    total = sum(np.log(want[1, g] / want[0, g]) for w in words(one) for i in range(len(w)) for g in [("^" * toxicity.HIGH + w[: i + 1])[-toxicity.HIGH :]])
    assert model["__sum"][1] == pytest.approx(total) and model["__n"][1] == sum(map(len, words(one))) and model["__n"][2] == 0


def test_toxicity_letters(spark):
    """No two letters share codes, and a word of any script can be told from its groups."""
    learned = toxicity.alphabet(table(spark, [(1, "жжж да ABBA", 1), (2, None, 0), (3, "", 0), (4, "a-a.", 1)], "doc_id long, text string, toxic int"))
    assert {chr(u): int(learned[u]) for u in np.flatnonzero(learned)} == {"a": 1, "ж": 2, "b": 3, "а": 4, "д": 5}
    back = {int(learned[u]): int(u) for u in np.flatnonzero(learned)}
    signs = [chr(x) for x in (*range(0x61, 0x7B), *range(0x430, 0x450), *range(0x4E00, 0x5600), *range(0x1F600, 0x1F640), 0x10FFFF)]
    for words_ in (signs, ["жук", "日本語", "aжb", "é😀"]):
        data, offsets = tokens.text_bytes(pa.array(words_))
        w = tokens.words_of(data, offsets)
        code, grams, word = toxicity._word_grams(w, learned)
        spelled = {}
        for g, k in zip(grams.tolist(), word.tolist(), strict=True):
            spelled.setdefault(k, []).append(g & 1023)
        for sign, k in zip(words_, code.tolist(), strict=True):
            units, rest = [], iter(spelled[k])
            for x in rest:
                units.append(back[x] if x <= toxicity.DIRECT else (x - toxicity.DIRECT - 1) * 256 + next(rest) - toxicity.DIRECT - 257)
            assert np.array(units, np.uint16).tobytes().decode("utf-16-le") == sign
    assert toxicity.alphabet(table(spark, [], "doc_id long, text string, toxic int")).sum() == 0


def test_language_predictions_against_brute_force(spark):
    rng = random.Random(8)
    alphabets = {"aa": "abcd ", "bb": "bcde ", "cc": "xyzé "}
    text = lambda a: "".join(rng.choice(a) for _ in range(rng.randrange(5, 200)))
    train = [(lang, text(a)) for lang, a in alphabets.items() for _ in range(8)]
    docs = [text(rng.choice([*alphabets.values(), "abxyé ", ".,! "])) for _ in range(60)]

    def ranked(texts):
        c = Counter()
        for t in texts:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                q = f" {w} "
                c.update(w)
                c.update(q[i : i + 2] for i in range(len(q) - 1))
                c.update(q[i : i + 3] for i in range(len(q) - 2))
        # ties are by the keys of the n-grams: letters in the order of code points, blanks before them, shorter ones filled with nothing
        fill = lambda g: [(-1 if ch == " " else ord(ch)) for ch in g] + [-2] * (3 - len(g))
        return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], fill(x[0])))][: language.PROFILE]

    profiles = {lang: {g: i for i, g in enumerate(ranked([t for x, t in train if x == lang]))} for lang in alphabets}
    model = language.fit(table(spark, [(i, t, lang, "s", 1) for i, (lang, t) in enumerate(train)]))
    got = language.identify(table(spark, [(i, t) for i, t in enumerate(docs)], "doc_id long, text string"), model).collect()
    some = language.fit(table(spark, [(i, t, lang, "s", 1) for i, (lang, t) in enumerate(train)]), most=2)
    assert len(some) == 2 and sorted(map(tuple, language.identify(table(spark, [(i, t) for i, t in enumerate(docs)], "doc_id long, text string"), some).collect())) == sorted(map(tuple, got))
    for r in got:
        mine = ranked([docs[r.doc_id]])
        if not mine:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        apart = {lang: sum(abs(p[g] - i) if g in p else language.PROFILE for i, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 - apart[best] / (len(mine) * language.PROFILE))


def test_pipeline_on_odd_rows(spark, tmp_path):
    """All stages together on nulls, empty and repeated texts, clashing names and very long texts."""
    import corpus_pipeline as c

    rng = random.Random(3)
    long = prose(rng, 40000, 10**6)
    rows = [*ODD, (20, prose(rng, 300, 10**6), "en", "a", 1), (21, long, "en", "b", 1), (22, long + " tail", "en", "b", 1), (None, "some words here", "en", None, None)]
    docs = table(spark, rows).withColumns({x: F.lit("x") for x in CLASHES if x != "Score"})
    folder = str(tmp_path)
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    table(spark, [(1, "nothing that is in them at all but these very many words of its own")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = c.run(spark, folder).collect()
    ids = {i for r in out for i in r.doc_ids}
    assert {4, 6, 20, 21} <= ids <= {4, 6, 7, 20, 21, None} and all(r.n_words <= mixing.BLOCK for r in out)
