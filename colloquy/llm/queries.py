"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, decontaminate, jaccard_join, language, licences, media, mixing, passages, quality, token_counts, toxicity, warc, whitening
from .session import table


def op1_language(spark, d):
    return language.report(table(spark, d, "documents"))


def op2_decontaminate(spark, d):
    return decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op3_licences(spark, d):
    return licences.report(table(spark, d, "documents"))


def op4_token_counts(spark, d):
    return token_counts.report(table(spark, d, "documents"))


def op5_jaccard_join(spark, d):
    return jaccard_join.near_classes(table(spark, d, "documents"))


def op6_passages(spark, d):
    return passages.report(table(spark, d, "documents"))


def op7_media(spark, d):
    return media.report(table(spark, d, "documents"))


def op8_warc(spark, d):
    """Audits a replica of all pages that has one character overwritten in some of them, has lost others, and holds some once more, as they are or under another url."""
    pages = table(spark, d, "pages")
    every = lambda a, m, r: F.coalesce(F.col("page_id") * a % m == r, F.lit(False))
    half = "cast(floor(length(html) / 2) as int)"
    worn = F.when(every(7919, 101, 3) & (F.length("html") > 1), F.concat(F.expr(f"substring(html, 1, {half})"), F.lit("\u007f"), F.expr(f"substring(html, {half} + 2)"))).otherwise(F.col("html"))
    again = pages.where(every(1, 89, 7)).withColumn("url", F.concat(F.coalesce("url", F.lit("")), F.lit("#again")))
    twice = pages.where(every(1, 83, 11))
    replica = pages.where(~every(31, 97, 5)).unionByName(again).unionByName(twice).withColumn("worn", worn)
    return warc.audit(warc.records(pages), warc.records(replica, "worn"))[0]


def op9_toxicity(spark, d):
    return toxicity.report(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_mixing(spark, d):
    return mixing.report(table(spark, d, "documents"))


def op11_whitening(spark, d):
    return whitening.report(table(spark, d, "embeddings"))


def op12_alignment(spark, d):
    return alignment.report(table(spark, d, "documents"))


def op13_quality(spark, d):
    return quality.report(table(spark, d, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bl AS (SELECT id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""

def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_GRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_MOST = licences.most_words(licences.TEMPLATES)


def _best_sql(name: str, of: str, by: str) -> str:
    mine = "(score, dice, -lo, hi)"
    return f"""{name} AS (SELECT * FROM {of} a WHERE NOT EXISTS (SELECT 1 FROM
  (SELECT DISTINCT doc_id, lo, hi FROM (SELECT *, {mine} < max({mine}) OVER (PARTITION BY doc_id, pos{by}) AS lost FROM (SELECT *, unnest(range(lo, hi + 1)) AS pos FROM {of}) x) y WHERE lost) b
  WHERE a.doc_id = b.doc_id AND a.lo = b.lo AND a.hi = b.hi))"""


OP3_SQL = rf"""
WITH t AS (SELECT licence, telling, {_GRAMS.format("w")} AS grams FROM (SELECT licence, telling, string_split({_NORM.format("text")}, ' ') AS w
  FROM (VALUES {", ".join(f"({_sql(a)}, {_sql(b)}, {x or 'CAST([] AS VARCHAR[])'})" for (a, b), x in zip(licences.TEMPLATES, licences.telling(licences.TEMPLATES), strict=True))}) v(licence, text, telling))),
k AS (SELECT list(DISTINCT g) AS known FROM (SELECT unnest(grams) AS g FROM t)),
pp AS (SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) AS p FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS x FROM documents WHERE text IS NOT NULL)),
ll AS (SELECT doc_id, p, unnest(x) AS x, generate_subscripts(x, 1) AS l FROM (SELECT doc_id, p, string_split(x, chr(10)) AS x FROM pp)),
ss AS (SELECT doc_id, p, l, unnest(x) AS x, generate_subscripts(x, 1) AS s FROM (SELECT doc_id, p, l, regexp_split_to_array(x, '[.!?;]+\s+') AS x FROM ll)),
a0 AS (SELECT doc_id, p, l, s, string_split({_NORM.format("x")}, ' ') AS w FROM ss),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, l, s) - 1 AS pos FROM a0 WHERE w[1] <> ''),
ln AS (SELECT doc_id, min(pos) AS lo, max(pos) AS hi, flatten(list(w ORDER BY pos)) AS w FROM a GROUP BY doc_id, p, l HAVING max(pos) > min(pos)),
pg AS (SELECT * FROM (SELECT doc_id, p, min(pos) AS lo, max(pos) AS hi, flatten(list(w ORDER BY pos)) AS w, count(DISTINCT l) AS lines FROM a GROUP BY doc_id, p) WHERE len(w) <= {_MOST}),
pe AS (SELECT *, list_has_any({_GRAMS.format("w")}, known) AS edge, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM pg, k),
rr AS (SELECT x.doc_id, x.p, x.lo, y.p AS q, y.hi, x.upto - len(x.w) AS n0, y.upto FROM pe x JOIN pe y ON x.doc_id = y.doc_id AND y.p > x.p AND y.upto - x.upto + len(x.w) <= {_MOST} WHERE x.edge AND y.edge),
ru AS (SELECT r.doc_id, r.lo, r.hi, flatten(list(z.w ORDER BY z.p)) AS w FROM rr r JOIN pe z ON z.doc_id = r.doc_id AND z.p BETWEEN r.p AND r.q GROUP BY r.doc_id, r.p, r.q, r.lo, r.hi HAVING count(*) = r.q - r.p + 1),
u AS (SELECT doc_id, pos AS lo, pos AS hi, w FROM a UNION ALL SELECT * FROM ln UNION ALL SELECT doc_id, lo, hi, w FROM pg WHERE lines > 1 UNION ALL SELECT * FROM ru),
g AS (SELECT doc_id, lo, hi, w, {_GRAMS.format("w")} AS have FROM u WHERE len(w) > 1 AND len(w) <= {_MOST}),
c AS (SELECT doc_id, lo, hi, licence, len(list_intersect(have, grams)) AS b, len(have) + len(grams) AS n FROM g, t
  WHERE len(have) <= 1.5 * len(grams) + 1 AND len(grams) <= 1.5 * len(have) + 1 AND list_has_all(w, telling)),
d AS (SELECT doc_id, lo, hi, licence, 2.0::DOUBLE * b / n AS dice, CAST(3 * b AS BIGINT) - CAST(n AS BIGINT) AS score FROM c WHERE 2.0::DOUBLE * b / n >= {licences.THRESHOLD}),
m AS (SELECT doc_id, lo, hi, dice, max(score) AS score, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id, lo, hi) AS top FROM d) WHERE dice = top GROUP BY doc_id, lo, hi, dice),
{_best_sql("m1", "m", ", licences")},
{_best_sql("m2", "m1", "")},
e AS (SELECT doc_id, unnest(string_split(licences, ',')) AS licence FROM m2),
r AS (SELECT m2.doc_id, count(*) AS n_matches, count(*) FILTER (contains(licences, ',')) AS n_tied, max(dice) AS best_dice FROM m2 GROUP BY doc_id),
f AS (SELECT doc_id, count(DISTINCT licence) AS n_licences, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM e GROUP BY doc_id)
SELECT o.doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(n_tied, 0) AS n_tied, coalesce(n_licences, 0) AS n_licences, coalesce(licences, '') AS licences, coalesce(best_dice, 0.0::DOUBLE) AS best_dice
FROM (SELECT DISTINCT doc_id FROM documents) o LEFT JOIN r ON o.doc_id = r.doc_id LEFT JOIN f ON o.doc_id = f.doc_id
"""

_END = "chr(13) || chr(10)"
_HEAD = f"""'WARC/1.1' || {_END} || 'WARC-Type: resource' || {_END} || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || ':' || left(d, 32) || '>' || {_END}
  || 'WARC-Date: {warc.DATE}' || {_END} || 'WARC-Target-URI: ' || coalesce(url, '') || {_END} || 'WARC-Payload-Digest: sha256:' || d || {_END} || 'Content-Type: text/html' || {_END} || 'Content-Length: ' || bytes || {_END} || {_END}"""
OP8_SQL = f"""
WITH q AS (SELECT page_id, url, html, true AS mine, coalesce(page_id * 31 % 97 <> 5, true) AS other FROM pages
  UNION ALL SELECT page_id, coalesce(url, '') || '#again', html, false, true FROM pages WHERE page_id % 89 = 7
  UNION ALL SELECT page_id, url, html, false, true FROM pages WHERE page_id % 83 = 11),
p AS (SELECT page_id, url, mine, other, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS d,
  sha256(coalesce(CASE WHEN page_id * 7919 % 101 = 3 AND length(html) > 1 THEN substr(html, 1, length(html) // 2) || chr(127) || substr(html, length(html) // 2 + 2) ELSE html END, '')) AS s FROM q),
r AS (SELECT page_id, coalesce(page_id // {warc.FILE}, -1) AS file, coalesce(page_id % {warc.FILE}, 0) AS slot, mine, other, strlen({_HEAD}) + bytes + 4 AS length, sha256({_HEAD}) AS rid, sha256({_HEAD} || d) AS a, sha256({_HEAD} || s) AS b FROM p),
l AS (SELECT *, sum(length * left_copies) OVER w - length * left_copies AS "offset" FROM (SELECT page_id, file, slot, length, rid, a, count(*) AS left_copies FROM r WHERE mine GROUP BY ALL) WINDOW w AS (PARTITION BY file ORDER BY slot, rid ROWS UNBOUNDED PRECEDING)),
o AS (SELECT page_id, file, slot, rid, b, count(*) AS right_copies FROM r WHERE other GROUP BY ALL)
SELECT file, CAST(slot AS INTEGER) AS slot, coalesce(l.page_id, o.page_id) AS page_id, CASE WHEN a IS NOT NULL THEN CAST(0 AS INTEGER) END AS part, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
  left_copies, right_copies, a AS left_sha256, b AS right_sha256
FROM l FULL JOIN o USING (file, slot, rid) WHERE a IS DISTINCT FROM b OR left_copies IS DISTINCT FROM right_copies
"""

_SPLIT = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_CHARS = r"length(regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g'))"
_SYMBOLS = "len(regexp_extract_all({}, '[#*$%&|<>]'))"
_LIKE = "len(list_filter(w, lambda x: regexp_matches(x, {})))"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, {_SPLIT.format("t")} AS w FROM d),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 3)) AS p FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1) GROUP BY k),
l0 AS (SELECT k, unnest(x) AS l, generate_subscripts(x, 1) AS p FROM (SELECT k, string_split(t, chr(10)) AS x FROM d)),
l1 AS (SELECT *, row_number() OVER (PARTITION BY k, l ORDER BY p) > 1 AS again, {_SPLIT.format("l")} AS w FROM l0),
l2 AS (SELECT k, l, again, {_CHARS.format("l")} AS chars, len(w) AS n, {_SYMBOLS.format("l")} AS marks, {_LIKE.format(_sql(quality.ENDS))} AS stops, {_LIKE.format(_sql(quality.SEPARATOR))} AS parts,
  {_LIKE.format(_sql(quality.PAGE))} AS pages, regexp_matches(l, {_sql(quality.PHRASE)}) AS phrase FROM l1 WHERE len(w) > 0),
l3 AS (SELECT *, 10 * marks > n OR stops = 0 OR (n >= 3 AND 2 * stops > n) OR (parts >= 2 AND 5 * parts >= n) OR (n <= {quality.MENU} AND pages > 0 AND pages + parts = n)
  OR again OR (n <= {quality.SHORT_LINE} AND phrase) AS gone FROM l2),
s AS (SELECT k, count(*) AS n_lines, count(*) FILTER (gone) AS n_lines_removed, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (gone), 0) AS chars_removed FROM l3 GROUP BY k),
a AS (SELECT k, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({_CHARS.format("t")} AS BIGINT) AS word_chars, CAST({_SYMBOLS.format("t")} AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, CAST(coalesce(chars_removed, 0) AS BIGINT) AS chars_removed
  FROM d JOIN w USING (k) LEFT JOIN r USING (k) LEFT JOIN s USING (k)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM a)
SELECT * EXCLUDE (k), NOT base_failed AND chars_removed <= {quality.LOSS}::DOUBLE * word_chars AS kept FROM b
"""

QUERIES = {
    "op1_language": op1_language,
    "op2_decontaminate": op2_decontaminate,
    "op3_licences": op3_licences,
    "op4_token_counts": op4_token_counts,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_passages": op6_passages,
    "op7_media": op7_media,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_alignment": op12_alignment,
    "op13_quality": op13_quality,
}
ORACLE = {"op2_decontaminate": OP2_SQL, "op3_licences": OP3_SQL, "op8_warc": OP8_SQL, "op13_quality": OP13_SQL}
