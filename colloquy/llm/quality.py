"""Quality rules, lines first.

Lines (split at ``\\n``) are judged on their own and the failing ones go; a document that loses too much of its text
with them is rejected.  A line without a word says nothing and stays.  A line fails

* by **punctuation** if symbols (``#*$%&|<>``) come to more than a tenth of its words; if it has no end of a sentence at
  all; or if, in three words or more, more than half the words end a sentence;
* as **navigation** if it has two separators or more (words that are ``|``, ``>``, ``>>``, ``/``, ``-``, ``*``, ``»``, ``›``, ``•`` or ``·``)
  and these come to a fifth of its words, or if it has at most six words and all of them, but for separators, are names of pages;
* as **boilerplate** if it has at most 40 words and holds a set phrase (rights, cookies, terms, subscriptions, placeholders), or
  if it equals an earlier line of the text.

A document is rejected if its base fails (fewer than 50 words, or more than half the words in three-word windows that
occur twice) or if the lines that went held more than ``LOSS`` of the letters of its words.

Everything is computed per Arrow batch, in pieces of bounded size, in one narrow pass; words and lines are numbered by exact
dictionaries, so nothing rests on hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import tokens as T
from .session import positional

#: Share of a text's word characters that may go with the failing lines.
LOSS = 0.4
LEAST_WORDS, MOST_REPEATED = 50, 50
SHORT_LINE, MENU = 40, 6
# What ends a sentence, what parts the entries of a menu, names of pages, set phrases.
ENDS = r"[.!?…。！？][\"'’”»)\]]*$"
SEPARATOR = r"^([|>/*»›•·-]|>>)$"
PAGES = (
    "home|menu|login|logout|register|search|sitemap|contact|about|faq|help|next|previous|back|top|share|print|start|startseite|anmelden|suche|kontakt|impressum|"
    "hilfe|weiter|zurück|accueil|connexion|recherche|aide|suivant|précédent|retour|inicio|buscar|contacto|ayuda|siguiente|anterior|volver"
)
PAGE = rf"(?i)^({PAGES})[.:]?$"
PHRASES = (
    "all rights reserved|cookie policy|uses cookies|use of cookies|accept cookies|privacy policy|terms of use|terms of service|terms and conditions|lorem ipsum|enable javascript|"
    "click here|read more|sign up|subscribe to|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|tous droits réservés|politique de confidentialité|"
    "todos los derechos reservados|política de privacidad"
)
PHRASE = f"(?i)({PHRASES})"

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
REPORT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_lines_removed long, chars_removed long, kept boolean"


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each substring among the different ones, and those.  Bytes between the substrings are skipped."""
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    # every other entry of an array over all bytes between two bounds: the substrings, and what lies between them
    bounds = np.empty(2 * len(start), np.int64)
    bounds[0::2], bounds[1::2] = start, end
    every = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = every.take(pa.array(np.arange(0, len(bounds), 2))).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_string())


def _matching(strings: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(strings, pattern).to_numpy(zero_copy_only=False).astype(bool)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the entries first[i] to first[i + 1]."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def _repeated(ids: np.ndarray, first: np.ndarray, kinds: int) -> np.ndarray:
    """For each text the words inside three-word windows that it holds twice or more."""
    out = np.zeros(len(first) - 1, np.int64)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b - a < 4:
            continue
        w = ids[a:b]
        if kinds >= 1 << 21:  # numbers of three words would not fit one key
            w = np.unique(w, return_inverse=True)[1]
        if kinds < 1 << 21 or w.max() < 1 << 21:
            key = w[:-2] << 42 | w[1:-1] << 21 | w[2:]
        else:
            two = np.unique(w[:-1] * (int(w.max()) + 1) + w[1:], return_inverse=True)[1]
            key = two[:-1] * (int(w.max()) + 1) + w[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key) + 2, np.int64)
        twice[order[1:][same]] = 1
        twice[order[:-1][same]] = 1
        hit = twice.copy()
        hit[1:] |= twice[:-1]
        hit[2:] |= twice[:-2]
        out[i] = hit.sum()
    return out


def judge(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The report's columns for a run of texts, and of their lines: how many each text has, start, end, and which fail."""
    n = len(offsets) - 1
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    begins[at] = inside[at]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = inside[last]
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    ids, kinds = _strings(data, start, end)
    letters = np.concatenate(([0], np.cumsum(inside & ((data & 0xC0) != 0x80), dtype=np.int64)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data], dtype=np.int64)))

    breaks = np.flatnonzero(data == 10)
    per = 1 + np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=n)
    line_first = np.concatenate(([0], np.cumsum(per)))
    owner = np.repeat(np.arange(n), per)
    low, high = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
    opening, closing = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    opening[line_first[:-1]] = closing[line_first[1:] - 1] = True
    low[opening], low[~opening], high[closing], high[~closing] = offsets[:-1], breaks + 1, offsets[1:], breaks
    line_ids, lines = _strings(data, low, high)

    word_of_line = np.append(np.searchsorted(start, low), len(start))
    words = word_of_line[1:] - word_of_line[:-1]
    of = lambda pattern: _matching(kinds, pattern)[ids] if len(ids) else np.zeros(0, bool)
    per_line = lambda flags: _sums(flags, word_of_line)
    stops, parts = per_line(of(ENDS)), of(SEPARATOR)
    named = per_line(of(PAGE) | parts)
    parts = per_line(parts)
    marks = symbols[high] - symbols[low]
    has = words > 0
    order = np.lexsort((line_ids, owner))
    again = np.zeros(len(low), bool)
    again[order[1:]] = (line_ids[order[1:]] == line_ids[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    again &= has
    phrase = _matching(lines, PHRASE)[line_ids] if len(lines) else np.zeros(len(low), bool)

    punctuation = (10 * marks > words) | (stops == 0) | ((words >= 3) & (2 * stops > words))
    navigation = ((parts >= 2) & (5 * parts >= words)) | ((words <= MENU) & (named == words) & (named > parts))
    boilerplate = again | ((words <= SHORT_LINE) & phrase)
    gone = has & (punctuation | navigation | boilerplate)
    chars = letters[high] - letters[low]
    n_words, repeated = np.diff(first), _repeated(ids, first, len(kinds))
    word_chars, removed = letters[offsets[1:]] - letters[offsets[:-1]], _sums(np.where(gone, chars, 0), line_first)
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": _sums(again, line_first),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "n_lines": _sums(has, line_first),
        "n_lines_removed": _sums(gone, line_first),
        "chars_removed": removed,
        "kept": ~failed & (removed <= LOSS * word_chars),
    }
    return out, per, low, high, gone


def _report(batches):
    for batch in batches:
        for rows, data, offsets in T.pieces(batch):
            out = judge(data, offsets)[0]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, out.values())], names=["doc_id", *out])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and what the line rules did
    (n_lines, n_lines_removed, chars_removed): a row for each row of docs.

    A null text is an empty one: no words, so its base fails.  Repeated rows and null ids each have their row; an empty table
    gives none; a text of any length is judged whole; other columns are ignored."""
    rows, new, _ = positional(docs, "doc_id", "text")
    given = rows.select(*[rows[v].alias(k) for k, v in new.items()])
    return given.mapInArrow(_report, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, {REPORT}")


def _cleaned(text: str):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in T.pieces(batch, text):
                out, per, low, high, gone = judge(data, offsets)
                body, at, texts = data.tobytes(), 0, []
                for n, kept in zip(per.tolist(), out["kept"], strict=True):
                    lines = zip(low[at : at + n].tolist(), high[at : at + n].tolist(), gone[at : at + n], strict=True)
                    texts.append(b"\n".join(body[a:b] for a, b, x in lines if not x).decode() if kept else None)
                    at += n
                columns = [pa.array(texts, pa.string()) if name == text else column for name, column in zip(rows.schema.names, rows.columns, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names).filter(pa.array(out["kept"]))

    return run


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without the lines that failed; columns as they were.

    Null and empty texts go, as those of fewer than 50 words do.  Repeated rows stay repeated."""
    rows, new, names = positional(docs, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_cleaned(new["text"]), fields).toDF(*names)
