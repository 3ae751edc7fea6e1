"""WARC files and Merkle fixity audits.

``records`` turns pages into WARC records (header and payload), placed in files of
bounded length with their byte offsets; ``write_files`` and ``read_files`` are the files themselves.
``tree`` hashes records, the slots of page ids, and then ordered ranges of ``FAN`` neighbours, level by level,
up to one root a file.  ``audit`` compares the roots of two replicas and descends only below
nodes that differ, to name the records at fault.

A record's place in the tree comes from its id alone: file ``page_id div FILE``, slot ``page_id mod FILE``.  So a
record that a replica has lost leaves a hole, one that it has besides fills its own slot, and no other
record moves.  A node's hash holds the hashes and the ordered byte ranges of what is below it, as lengths, so that one lost record does
not change every hash behind it; each node names the range of bytes that its records have in the files of the first replica.
``write_files`` writes the very files that ``records`` describes: ``file=F/part=P``, with each record at its offset.

Everything is SHA-2 and grouping in the engine.  A slot may hold any number of records (one id for a third of
all rows): its hash is the hash of their number, bytes and of the sums of four parts of their hashes, which
combine before the shuffle.  Copies of a record are counted before anything is shuffled and dealt over the parts of their file.  Above it a group has at most ``FAN`` children.  Only hashes move, never payloads.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import Stored, cut

FILE, FAN = 4096, 16
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def header(page_id, url, length, digest):
    """The WARC header of a record, with its closing empty line."""
    lines = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(":"),
        F.left(digest, F.lit(32)),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        digest,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        length.cast("string"),
        F.lit(END),
    ]
    return F.concat(*lines)


def _sha(c):
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


def place(page_id):
    """(file, slot) of an id; a null one has file -1."""
    return F.coalesce(F.floor(page_id / FILE), F.lit(-1)).cast("long"), F.coalesce(F.pmod(page_id, F.lit(FILE)), F.lit(0)).cast("int")


def _archived(pages: DataFrame, stored: str = "html", *more) -> DataFrame:
    """The different records of pages with their header ``h`` and how many there are of each (``copies``)."""
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"), _sha(F.col("html")).alias("d"), _sha(F.col(stored)).alias("s"), *more)
    h = header(F.col("page_id"), F.col("url"), F.col("bytes"), F.col("d"))
    file, slot = place(F.col("page_id"))
    names = [c for c in given.columns if c not in ("bytes", "d", "s", "page_id", "url")]
    rows = given.select("page_id", "url", (F.octet_length(h) + F.col("bytes") + 4).cast("long").alias("length"), _sha(h).alias("rid"), _sha(F.concat(h, "s")).alias("sha256"), file.alias("file"), slot.alias("slot"), *names)
    return rows.groupBy("file", "slot", "page_id", "url", "length", "rid", "sha256").agg(F.count("*").alias("copies"), *[F.first(n).alias(n) for n in names])


def _dealt(rows: DataFrame) -> DataFrame:
    """Records by part: a file of more than ``FILE`` records, copies counted, has several, and copies of one are dealt over them evenly."""
    per = rows.groupBy("file").agg(F.ceil(F.sum("copies") / FILE).cast("long").alias("parts"))
    rows = rows.join(per, "file").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least("copies", "parts") - 1)))
    share = F.floor(F.col("copies") / F.col("parts")) + F.when(F.col("k") < F.col("copies") % F.col("parts"), 1).otherwise(0)
    return rows.withColumns({"part": F.pmod(F.xxhash64("rid") + F.col("k"), F.col("parts")).cast("int"), "copies": share}).drop("k", "parts")


_ORDER = ("slot", "rid", "sha256")


def records(pages: DataFrame, stored: str = "html") -> DataFrame:
    """(file, slot, rid, part, page_id, url, copies, offset, length, sha256): a row for each different record in each part that holds it.

    Inside a part records stand in the order of (slot, rid), one after the other, copies of one side by side.  ``length`` counts header, payload
    and the closing two line ends of one copy.  ``rid`` is the hash of the header (which holds the digest of the payload as it was archived), ``sha256``
    that of the header and of what the column ``stored`` holds now.  Null urls and payloads count as empty, null ids go to file -1; other columns are
    ignored; an empty table has no records."""
    rows = _dealt(_archived(pages, stored))
    size = F.col("length") * F.col("copies")
    order = Window.partitionBy("file", "part").orderBy(*_ORDER)
    offset = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    return rows.select("file", "slot", "rid", "part", "page_id", "url", "copies", offset.alias("offset"), "length", "sha256")


def write_files(pages: DataFrame, path: str) -> None:
    """Writes the pages as the WARC files that ``records`` places them in, a file for each ``file=F/part=P``.

    A record ends with two line ends, which are the rows' separator here.  Nulls and repeated rows are as in ``records``; a page of any length is
    one row, and a task holds one of them at a time; an empty table writes no file."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    h = header(F.col("page_id").cast("long"), F.col("url"), F.octet_length(payload), _sha(payload))
    rows = _dealt(_archived(pages, "html", F.concat(h, payload).alias("value")))
    rows = rows.repartition("file", "part").sortWithinPartitions("file", "part", *_ORDER)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rows.select("value", "file", "part").write.partitionBy("file", "part").option("lineSep", END).text(path)


def _parsed(content: bytes):
    """(page_id, url, html, digest, offset, length) of each whole record; a record that is cut short, or bytes that
    are none, end the file."""
    at, end = 0, END.encode()
    while at < len(content):
        body = content.find(end, at)
        lines = content[at:body].decode("utf-8", "replace").split("\r\n") if body >= 0 else []
        field = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        size = field.get("Content-Length", "")
        if not lines or not lines[0].startswith("WARC/") or not size.isdigit() or body + len(end) + int(size) > len(content):
            return
        low = body + len(end)
        page = field.get("WARC-Record-ID", "").removeprefix("<urn:page:").split(":")[0]
        html = content[low : low + int(size)].decode("utf-8", "replace")
        after = low + int(size) + len(end)
        yield int(page) if page.removeprefix("-").isdigit() else None, field.get("WARC-Target-URI"), html, field.get("WARC-Payload-Digest", "").removeprefix("sha256:"), at, after - at
        at = after


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html, digest, file, part, name, offset, length) of the records of WARC files; a file is read by one task, as one value
    (of up to 2 GB).  What is cut short at the end of a file, and whatever follows bytes that are no record, is left out."""
    fields = "page_id long, url string, html string, digest string, offset long, length long, name string"

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = list(_parsed(content))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], pa.array([name] * len(rows), pa.string())], names=[f.split()[0] for f in fields.split(", ")])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, fields)
    number = lambda k, kind: F.nullif(F.regexp_extract("name", f"/{k}=(-?[0-9]+)/", 1), F.lit("")).cast(kind).alias(k)
    return rows.select("page_id", "url", "html", "digest", number("file", "long"), number("part", "int"), "name", "offset", "length")


def tree(rows: DataFrame) -> DataFrame:
    """(file, level, i, low, high, bytes, hash): level 0 are the slots of ids, with the byte range [low, high) of their records (in a file
    of several parts, of their offsets in any) and how many bytes they are; node i of level k + 1 is the ordered range of nodes FAN i to
    FAN i + FAN - 1 of level k; the last level is the root."""
    size = F.col("length") * F.col("copies")
    parts = [F.sum(F.conv(F.substring("sha256", 1 + 15 * k, 15), 16, 10).cast("decimal(19,0)") * F.col("copies").cast("decimal(12,0)")).cast("string") for k in range(4)]
    text = F.concat_ws(" ", F.sum("copies").cast("string"), F.sum(size).cast("string"), *parts)
    level = rows.groupBy("file", F.col("slot").cast("long").alias("i")).agg(F.min("offset").alias("low"), F.max(F.col("offset") + size).alias("high"), F.sum(size).alias("bytes"), F.sha2(text.cast("binary"), 256).alias("hash"))
    level = cut(level.select("file", F.lit(0).alias("level"), "i", "low", "high", "bytes", "hash"))
    out, width, k = level, FILE, 0
    while width > 1:
        width, k = -(-width // FAN), k + 1
        kids = F.array_sort(F.collect_list(F.struct("i", "bytes", "hash")))
        level = level.groupBy("file", F.floor(F.col("i") / FAN).alias("up")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("bytes").alias("bytes"), kids.alias("k"))
        text = F.array_join(F.transform("k", lambda x: F.concat_ws(" ", x["i"].cast("string"), x["bytes"].cast("string"), x["hash"])), "\n")
        level = cut(level.select("file", F.lit(k).alias("level"), F.col("up").alias("i"), "low", "high", "bytes", F.sha2(text.cast("binary"), 256).alias("hash")))
        out = out.unionByName(level)
    return out


def audit(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(differing records, visited nodes) of two replicas, as given by ``records``.

    Records: file, slot, page_id, part, offset, length and copies of the first replica (null where it has not got the record; of copies in several
    parts the first), the copies of the second, and the hash of either side (null where it has none): a record that is lost, or there only
    in the second, is one row, and so is one of other content or one that either side has more often.
    Visited: level and how many nodes were compared and differed there.  Equal replicas, empty ones too, give no rows."""
    one, two = Stored(left), Stored(right)
    left, right = one.df, two.df
    a, b = tree(left), tree(right)
    top = 0
    while FAN**top < FILE:
        top += 1
    below, visited = None, None
    for k in range(top, -1, -1):
        x = a.where(F.col("level") == k).select("file", "i", F.col("hash").alias("ha"))
        y = b.where(F.col("level") == k).select("file", "i", F.col("hash").alias("hb"))
        if below is not None:
            up = F.floor(F.col("i") / FAN).alias("up")
            x, y = (z.select("*", up).join(below, ["file", "up"], "left_semi").drop("up") for z in (x, y))
        both = cut(x.join(y, ["file", "i"], "full").withColumn("bad", ~F.col("ha").eqNullSafe(F.col("hb"))))
        seen = both.agg(F.count("*").alias("compared"), F.sum(F.col("bad").cast("long")).alias("differ")).select(F.lit(k).alias("level"), "compared", "differ")
        visited = seen if visited is None else visited.unionByName(seen)
        below = both.where("bad").select("file", F.col("i").alias("up"))
    bad = below.select("file", F.col("up").cast("int").alias("slot"))
    keys = ["file", "slot", "rid"]

    def side(rows: DataFrame, name: str, *more) -> DataFrame:
        each = rows.join(bad, ["file", "slot"], "left_semi").groupBy(*keys, "page_id", "length", "sha256").agg(F.sum("copies").alias("copies"), F.min(F.struct("part", "offset")).alias("at"))
        kinds = F.array_sort(F.collect_list(F.struct("sha256", "copies")))
        each = each.groupBy(*keys, "page_id", "length").agg(F.min("at").alias("at"), F.sum("copies").alias(f"{name}_copies"), kinds.alias(name))
        return each.withColumn(f"{name}_sha256", F.array_join(F.transform(name, lambda x: x["sha256"]), ","))

    mine, other = side(left, "left"), side(right, "right").select(*keys, F.col("page_id").alias("p2"), "right", "right_copies", "right_sha256")
    out = mine.join(other, keys, "full").where(~F.col("left").eqNullSafe(F.col("right")))
    out = cut(out.select("file", "slot", F.coalesce("page_id", "p2").alias("page_id"), "at.part", "at.offset", "length", "left_copies", "right_copies", "left_sha256", "right_sha256"))
    one.drop()
    two.drop()
    return out, visited
