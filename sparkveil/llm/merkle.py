"""Merkle fixity audit of WARC replicas, in DataFrame operations.

Records are serialised as WARC 1.1 and dealt into files; a manifest lists each record's file, place, offset range
and SHA-256. Over a manifest stands a tree: leaves hash (offset, length, digest) in offset order, nodes hash their
children in order, first within each file, then over the files to one root. An audit compares roots and then,
level by level, only the children of nodes that differ.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkveil.llm._common import stored

#: Records in a WARC file, about; and children of a node.
FILE_RECORDS, FANOUT = 256, 16


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record. A null id, URL or body is written as empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def file_count(records: DataFrame) -> int:
    return max(1, ceil(records.count() / FILE_RECORDS))


def manifest(records: DataFrame, files: int, spread: DataFrame, *, key: str = "page_id", record: str = "record") -> DataFrame:
    """(key, file_id, seq, offset, length, digest): each record in its file's order, which is by key, nulls first, then
    digest. A record's file follows from its key alone, so replicas deal alike; but records of the keys in `spread`
    (name, the key as text), which repeat so often that they would overfill a file, are dealt by key and digest. Equal
    records are entries of their own. Only hashes and lengths are shuffled, never records."""
    at = records.select(
        F.col(f"`{key}`"),
        _name(key).alias("name"),
        F.octet_length(F.col(f"`{record}`")).cast("bigint").alias("length"),
        F.sha2(F.col(f"`{record}`").cast("binary"), 256).alias("digest"),
    )
    at = at.join(F.broadcast(spread.withColumn("often", F.lit(True))), "name", "left")
    dealt = F.md5(F.when(F.col("often"), F.concat("name", F.coalesce("digest", F.lit("")))).otherwise(F.expr("substring(name, 2)")).cast("binary"))
    at = at.select(F.col(f"`{key}`"), F.pmod(F.conv(F.substring(dealt, 1, 8), 16, 10).cast("bigint"), F.lit(files)).cast("bigint").alias("file_id"), "length", "digest")
    order = Window.partitionBy("file_id").orderBy(F.col(f"`{key}`").asc_nulls_first(), "digest")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.select(F.col(f"`{key}`"), "file_id", (F.row_number().over(order) - 1).cast("bigint").alias("seq"), before.cast("bigint").alias("offset"), "length", "digest")


def _name(key: str) -> Column:
    """A key as text, null apart from all others."""
    return F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.lit("n"))


def often(records: DataFrame, *, key: str = "page_id") -> DataFrame:
    """(name) of keys that more records share than a file has; one key at most for each file of records."""
    return records.groupBy(_name(key).alias("name")).count().where(F.col("count") > FILE_RECORDS).select("name")


@dataclass
class Trees:
    """Nodes of all replicas by level, (replica, file_id, place, hash), each level stored: level 0 has the leaves,
    levels up to `within` are of files, the rest of the collection, whose file_id is -1."""

    levels: list[DataFrame]
    within: int


def _up(level: DataFrame, file_id: Column, place: Column) -> DataFrame:
    children = F.sort_array(F.collect_list(F.struct("place", "hash")))
    joined = F.array_join(F.transform(children, lambda c: c["hash"]), "")
    up = level.groupBy("replica", file_id.alias("file_id"), place.alias("parent")).agg(F.sha2(joined, 256).alias("hash"))
    return stored(up.select("replica", "file_id", F.col("parent").alias("place"), "hash"), "level")


def trees(entries: DataFrame, files: int, longest: int) -> Trees:
    """The trees over manifests (with a column `replica`) of `files` files of at most `longest` records. A node
    gathers FANOUT children at most. An empty manifest has no nodes on any level."""
    leaf = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256)
    levels = [entries.select("replica", "file_id", F.col("seq").alias("place"), leaf.alias("hash"))]
    parent, size = F.floor(F.col("place") / FANOUT), longest
    while size > 1 or len(levels) == 1:
        levels.append(_up(levels[-1], F.col("file_id"), parent))
        size = ceil(size / FANOUT)
    within, size = len(levels) - 1, files
    below = levels[-1].select("replica", F.lit(-1).cast("bigint").alias("file_id"), F.col("file_id").alias("place"), "hash")
    while size > 1 or len(levels) == within + 1:
        levels.append(_up(below, F.col("file_id"), parent))
        below, size = levels[-1], ceil(size / FANOUT)
    return Trees(levels, within)


def differing(found_in: Trees) -> DataFrame:
    """(file_id, place) of the leaves on which replicas 0 and 1 differ or that one lacks, reached from the roots
    through differing nodes alone."""
    wrong: DataFrame | None = None
    for k in range(len(found_in.levels) - 1, -1, -1):
        level = found_in.levels[k]
        if wrong is not None:
            children = F.explode(F.sequence(F.col("place") * FANOUT, F.col("place") * FANOUT + (FANOUT - 1)))
            # From the collection's tree down to the files' own roots, a place is the number of a file.
            on = ["file_id"] if k == found_in.within else ["file_id", "place"]
            below = wrong.select(children.alias("file_id")) if k == found_in.within else wrong.select("file_id", children.alias("place"))
            level = level.join(below.hint("merge"), on, "left_semi")
        sides = [F.max(F.when(F.col("replica") == r, F.col("hash"))) for r in (0, 1)]
        wrong = level.groupBy("file_id", "place").agg(sides[0].alias("a"), sides[1].alias("b")).where("NOT (a <=> b)").select("file_id", "place")
    return wrong


def audit(primary: DataFrame, replica: DataFrame, *, key: str = "page_id", record: str = "record") -> DataFrame:
    """Every record of either replica with what the audit says of it: (key, file_id, seq, offset, length, digest,
    replica_seq, replica_offset, replica_digest, status).

    Trees tell which places differ; the entries of those places are then matched within their file, first by key and
    digest, then by key. Status is intact (the same bytes at the same place), moved (the same bytes at another place,
    as records before it came, went or changed their length), altered (the key has other bytes), missing (only the
    primary has it) or extra (only the replica has it, whose place and length are then given). Of a key that repeats
    more often than a file has records, a record with other bytes is a missing and an extra one.

    Both inputs have the key and the record's bytes; further columns are not read. Null keys are a key; repeated
    records are matched one for one.
    """
    files = file_count(primary)
    spread = stored(often(primary, key=key), "often")
    sides = [manifest(side, files, spread, key=key, record=record).withColumn("replica", F.lit(i)) for i, side in enumerate((primary, replica))]
    entries = stored(sides[0].unionByName(sides[1]), "manifest")
    longest = entries.agg(F.max("seq")).first()[0] or 0
    wrong = stored(differing(trees(entries, files, longest + 1)), "differing").select("file_id", F.col("place").alias("seq"))
    left, right = (entries.where(F.col("replica") == i).drop("replica") for i in (0, 1))
    intact = left.join(wrong.hint("merge"), ["file_id", "seq"], "left_anti").select(F.col(f"`{key}`"), "file_id", "seq", "offset", "length", "digest", F.col("seq").alias("replica_seq"), F.col("offset").alias("replica_offset"), F.col("digest").alias("replica_digest"), F.lit("intact").alias("status"))

    def ordinal(side: DataFrame, by: list[str], name: str) -> DataFrame:
        return side.withColumn(name, F.row_number().over(Window.partitionBy("file_id", *by).orderBy("seq")))

    mine, theirs = (ordinal(side.join(wrong.hint("merge"), ["file_id", "seq"], "left_semi").withColumn("name", _name(key)), ["name", "digest"], "nth") for side in (left, right))
    theirs = theirs.select("file_id", "name", "digest", "nth", F.col(f"`{key}`").alias("other_key"), F.col("seq").alias("replica_seq"), F.col("offset").alias("replica_offset"), F.col("length").alias("other_length"))
    same = stored(mine.join(theirs.hint("merge"), ["file_id", "name", "digest", "nth"], "full"), "same")
    moved = same.where("seq IS NOT NULL AND replica_seq IS NOT NULL").withColumn("replica_digest", F.col("digest")).withColumn("status", F.lit("moved"))
    one = ordinal(same.where("replica_seq IS NULL").select(F.col(f"`{key}`"), "file_id", "name", "seq", "offset", "length", "digest"), ["name"], "nth")
    two = same.where("seq IS NULL").select("file_id", "name", "other_key", "other_length", F.col("digest").alias("replica_digest"), "replica_seq", "replica_offset")
    two = two.withColumn("nth", F.row_number().over(Window.partitionBy("file_id", "name").orderBy("replica_seq")))
    rest = one.join(two, ["file_id", "name", "nth"], "full").withColumn("status", F.when(F.col("replica_seq").isNull(), "missing").when(F.col("seq").isNull(), "extra").otherwise("altered"))
    shown = [F.when(F.col("seq").isNull(), F.col("other_key")).otherwise(F.col(f"`{key}`")).alias(key), "file_id", "seq", "offset", F.coalesce("length", "other_length").alias("length"), "digest", "replica_seq", "replica_offset", "replica_digest", "status"]
    return intact.unionByName(moved.select(*shown)).unionByName(rest.select(*shown))
