"""Patch and edit collections: validation, pairing, deduplication and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, if_few, numbered
from ..functions.text import issues, references, strip
from .splits import balanced_no

# Operations that edits may have, and other names for some of them.
OPS = ("insert_after", "insert_before", "append_to_section", "replace_in_section", "add_section", "delete_section", "create", "delete_file")
ALIASES = {"create_file": "create", "createFile": "create", "deleteFile": "delete_file"}
MAIN = "SKILL.md"
PATCH = "reasoning string, edits array<struct<file:string,op:string,content:string>>, changelog_entries array<string>"
FIELDS = ("Target File", "Edit Intent", "Location Hint", "Change Instruction")


def canonical_ops(edits: DataFrame) -> DataFrame:
    """edits with aliases of operations rewritten, unknown operations gone."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return edits.withColumn("op", F.coalesce(F.try_element_at(names, F.col("op")), F.col("op"))).where(F.col("op").isin(*OPS))


def payload_issues(payload) -> Column:
    """What is wrong with a patch payload (JSON text): missing fields, fields that are no lists, edits without file or op."""
    p = F.col(payload) if isinstance(payload, str) else payload
    whole = F.from_json(p, "map<string,string>")
    has = lambda k: F.coalesce(F.map_contains_key(whole, k), F.lit(False))
    is_list = lambda k: F.coalesce(F.try_element_at(whole, F.lit(k)).startswith("["), F.lit(False))
    edits = F.coalesce(F.from_json(F.try_element_at(whole, F.lit("edits")), "array<string>"), F.array().cast("array<string>"))
    # The messages, here and below.
    said = lambda i, text: F.concat(F.lit("Edit #"), (i + 1).cast("string"), F.lit(text))

    def each_issue(text: Column, i: Column) -> Column:
        edit = F.from_json(F.when(text.startswith("{"), text), "map<string,string>")
        blank = lambda k: F.coalesce(F.try_element_at(edit, F.lit(k)), F.lit("")) == ""
        lacks = F.array(*[F.when(blank(k), said(i, f" is missing required field: {k}")) for k in ("file", "op")])
        return F.when(edit.isNull(), F.array(said(i, " must be an object"))).otherwise(lacks)

    top = issues(
        (whole.isNull(), "Top-level JSON must be an object."),
        (whole.isNotNull() & ~has("reasoning"), "Missing top-level field: reasoning"),
        (whole.isNotNull() & ~has("edits"), "Missing top-level field: edits"),
        (has("edits") & ~is_list("edits"), "Top-level field 'edits' must be a list"),
        (whole.isNotNull() & ~has("changelog_entries"), "Missing top-level field: changelog_entries"),
        (has("changelog_entries") & ~is_list("changelog_entries"), "Top-level field 'changelog_entries' must be a list"),
    )
    each = F.filter(F.flatten(F.transform(edits, each_issue)), lambda x: x.isNotNull())
    return F.concat(top, each)


def _missing(edits: DataFrame, existing: DataFrame, *by: str) -> DataFrame:
    """Edits that are no creations, with ``ord`` and a reference that neither exists nor is created in the same patch."""
    created = edits.where("op = 'create'").select(*by, F.col("file").alias("ref")).distinct()
    refs = edits.where("op <> 'create'").select(*by, "ord", F.explode(references("content")).alias("ref"))
    return refs.join(existing.select(F.col("file").alias("ref")).distinct(), "ref", "left_anti").join(created, [*by, "ref"], "left_anti").select(*by, "ord").distinct()


def paired(edits: DataFrame, existing: DataFrame, by: str = "batch_index") -> DataFrame:
    """Per patch: creations that another edit of the patch links to, and other edits all of whose new references are
    created in the patch.  References to existing(file) count as neither."""
    links = edits.where("op <> 'create'").select(by, F.explode(references("content")).alias("file")).distinct()
    links = links.join(existing.select("file").distinct(), "file", "left_anti")
    creations = edits.where("op = 'create'").join(links, [by, "file"], "left_semi")
    others = edits.where("op <> 'create'").join(_missing(edits, existing, by), [by, "ord"], "left_anti")
    return creations.unionByName(others.select(*creations.columns))


def sanitized(edits: DataFrame, existing: DataFrame, by: str = "batch_index") -> DataFrame:
    """The same over final patches: first main-file edits with references that nobody creates go, then creations of
    reference files that no main-file edit still there links to."""
    edits = canonical_ops(edits)
    main = (F.col("file") == MAIN) & (F.col("op") != "delete_file")
    created = edits.where((F.col("op") == "create") & F.startswith("file", F.lit("references/"))).select(by, F.col("file").alias("ref")).distinct()
    refs = edits.where(main).select(by, "ord", F.explode(references("content")).alias("ref"))
    bad = refs.join(existing.select(F.col("file").alias("ref")).distinct(), "ref", "left_anti").join(created, [by, "ref"], "left_anti").select(by, "ord").distinct()
    kept = edits.join(bad.withColumn("__bad", F.lit(True)), [by, "ord"], "left").where(F.col("__bad").isNull() | ~main).drop("__bad")
    links = kept.where(main).select(by, F.explode(references("content")).alias("file")).distinct().withColumn("__hit", F.lit(True))
    new = (F.col("op") == "create") & F.startswith("file", F.lit("references/"))
    return kept.join(links, [by, "file"], "left").where(~new | F.col("__hit").isNotNull()).drop("__hit").select(*edits.columns)


def longest(edits: DataFrame, *key: str) -> DataFrame:
    """Of edits of the same key the one of the longest content (of equal ones the earlier), at the first one's place ``ord``.

    An aggregation, so that each task sends one edit a key, however many edits a key has; a content that is null is the shortest."""
    rest = [c for c in edits.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(F.length("content"), -F.col("ord"))).alias("__best")
    rows = edits.groupBy(*key).agg(best, F.min("ord").alias("__first"))
    value = {**{c: F.col(f"__best.{c}") for c in rest}, "ord": F.col("__first")}
    return rows.select(*[value[c].alias(c) if c in value else F.col(c) for c in edits.columns])


KINDS = ("reasoning", "edits", "changelog")


def patch_parts(patches: DataFrame, *by: str) -> DataFrame:
    """(by, kind, pos, body): a row for each part of patches(by, reasoning, edits, changelog): the reasoning, if it is not blank, and each edit and entry
    of the changelog with its place from 0; what is no text is JSON."""
    lists = {k: F.filter(F.array(k), lambda r: r.isNotNull() & (r != "")) if k == "reasoning" else F.col(k) for k in KINDS}
    text = lambda k: "body" if k == "reasoning" or patches.schema[k].dataType.elementType.typeName() == "string" else F.to_json("body").alias("body")
    each = [patches.select(*by, F.posexplode(x).alias("pos", "body")).select(*by, F.lit(k).alias("kind"), F.col("pos").cast("long").alias("pos"), text(k)) for k, x in lists.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


def coalesced(patches: DataFrame, *by: str) -> DataFrame:
    """(by, kind, pos, body): the patches(by, ord, reasoning, edits, changelog) of a group as one, as its parts: those of its patches one after the other.

    All parts are numbered at once, in the order of groups, kinds and patches, and count from the first of their group and kind: no row
    or task has all of a group, however large it is."""
    rows = numbered(patch_parts(patches, *by, "ord"), *by, "kind", "ord", "pos")
    first = cut(rows.groupBy(*by, "kind").agg(F.min("__i").alias("__first")))
    return rows.join(if_few(first), [*by, "kind"]).select(*by, "kind", (F.col("__i") - F.col("__first")).alias("pos"), "body")


def patch_text(parts: DataFrame, *by: str) -> DataFrame:
    """(by, reasoning, edits, changelog): parts put together, for a sink: reasoning with an empty line between, the others as lists."""
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "body")))), lambda x: x["body"])
    return parts.groupBy(*by).agg(F.array_join(of("reasoning"), "\n\n").alias("reasoning"), of("edits").alias("edits"), of("changelog").alias("changelog"))


def merged(patches: DataFrame, size: int, max_levels: int = 10) -> DataFrame:
    """(kind, pos, body, levels): all patches(ord, reasoning, edits, changelog) as one, merged level by level in balanced groups of ``size``, as its parts.

    A group has at most 1.5 times ``size`` members and the loop at most ``max_levels`` + 1 rounds; the last one takes all that is left.  Only numbers are
    merged: each level has how many parts its patches have and, by sums over the members before, where a member begins in
    its group.  From the last level down, these sums say where every patch begins in the whole, and its parts are renumbered: two
    tables of a row a patch and a row a part, and no text is moved before a sink wants it."""
    given = cut(numbered(patches, "ord").drop("__n", "ord").withColumnRenamed("__i", "id"))
    count = {"reasoning": (F.coalesce("reasoning", F.lit("")) != "").cast("long"), "edits": F.greatest(F.size("edits"), F.lit(0)).cast("long"), "changelog": F.greatest(F.size("changelog"), F.lit(0)).cast("long")}
    now, levels = cut(given.select("id", *[c.alias(k) for k, c in count.items()])), []
    while (n := now.count()) > 1:
        forced = len(levels) == max_levels
        no = F.lit(0) if forced else balanced_no(F.col("__i"), F.lit(n), size)
        place = numbered(now, "id").withColumn("group", no.cast("long"))
        before = Window.partitionBy("group").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        inside = {f"from_{k}": F.coalesce(F.sum(k).over(before), F.lit(0)) for k in KINDS}
        levels.append(cut(place.select("id", F.min("id").over(Window.partitionBy("group")).alias("up"), *KINDS, *[c.alias(k) for k, c in inside.items()])))
        now = cut(levels[-1].groupBy(F.col("up").alias("id")).agg(*[F.sum(k).alias(k) for k in KINDS]))
    starts = [f"from_{k}" for k in KINDS]
    base = now.select("id", *[F.lit(0).cast("long").alias(c) for c in starts])
    for level in reversed(levels):
        whole = base.select(F.col("id").alias("up"), *[F.col(c).alias(f"up_{c}") for c in starts])
        base = cut(level.join(whole, "up").select("id", *[(F.col(c) + F.col(f"up_{c}")).alias(c) for c in starts]))
    start = F.when(F.col("kind") == "reasoning", F.col("from_reasoning")).when(F.col("kind") == "edits", F.col("from_edits")).otherwise(F.col("from_changelog"))
    return patch_parts(given, "id").join(base, "id").select("kind", (start + F.col("pos")).alias("pos"), "body", F.lit(len(levels)).alias("levels"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, removed, changed or same, for the files (path, content) of either snapshot."""
    a, b = before.select("path", F.col("content").alias("a"), F.lit(1).alias("x")), after.select("path", F.col("content").alias("b"), F.lit(1).alias("y"))
    rows = a.join(b, "path", "full")
    return rows.select("path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed").alias("change"))


def semantic_blocks(text) -> Column:
    """array<struct(reasoning, items, issues)> of the marked patch blocks of a response.

    Items have four fields; one that lacks some is left out and noted.  Field names may have underscores."""
    t = F.col(text) if isinstance(text, str) else text
    blocks = F.regexp_extract_all(t, F.lit(r"(?s)===== PATCH START =====\s*(.*?)\s*===== PATCH END ====="), F.lit(1))
    label = lambda f: f.replace(" ", "[ _]")
    stop = "|".join(label(f) for f in FIELDS)
    field = lambda body, f: strip(F.regexp_extract(body, rf"(?ms)^\s*{label(f)}:\s*(.*?)(?=^\s*(?:{stop}):|\z)", 1))

    def block(b: Column) -> Column:
        bodies = F.regexp_extract_all(b, F.lit(r"(?s)\[ITEM_(\d+)_START\]\s*(.*?)\s*\[ITEM_\1_END\]"), F.lit(2))
        items = F.transform(bodies, lambda x: F.struct(*[field(x, f).alias(f.lower().replace(" ", "_")) for f in FIELDS]))
        whole = lambda i: (i["target_file"] != "") & (i["edit_intent"] != "") & (i["location_hint"] != "") & (i["change_instruction"] != "")
        good = F.filter(items, whole)
        reasoning = strip(F.regexp_extract(b, r"(?ms)^\s*Reasoning:\s*(.*?)(?=^\s*(?:Changelog:|Items:)\s*$|^\s*\[ITEM_|\z)", 1))
        notes = issues(
            (F.size(good) < F.size(items), "item missing required field(s)"),
            (~b.rlike(r"(?m)^\s*Reasoning:"), "missing Reasoning section"),
            (~b.rlike(r"(?m)^\s*Changelog:\s*$"), "missing Changelog section"),
            (~b.rlike(r"(?m)^\s*Items:\s*$") & (F.size(items) == 0), "missing Items section"),
            (reasoning == "", "Reasoning section is empty"),
            (F.size(good) == 0, "no valid items found"),
        )
        return F.struct(reasoning.alias("reasoning"), good.alias("items"), notes.alias("issues"))

    return F.transform(blocks, block)
