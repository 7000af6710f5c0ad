"""WARC fixity: Merkle trees over archive records, compared between replicas to locate damage.

Pages become WARC records, laid out in files: a file's records stand in order of their page, each at the offset where
the one before ends.  A leaf hashes a record's file, offset, length and content digest; a node hashes its up to
``FANOUT`` children in order and covers their range of offsets.  A file owns ``FANOUT ** k`` leaf places, so one tree
spans all files of a replica.  Two replicas are equal if their roots are; else only the children of nodes that differ
are compared, level by level, down to the records.

All of it is DataFrame operations; no node has more than ``FANOUT`` children, and a file is chosen by a digest of the
record, so neither a hot host nor a hot page gathers in one task (equal rows, copies of one record, share a file).
Null ids, addresses and pages count as empty.  Empty replicas have no nodes; against one, every record is missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import dropped, parts_of, written

FANOUT, FILE_RECORDS = 16, 512


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The WARC record of a page."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame) -> DataFrame:
    """``page_id, file, seq, start_offset, length, record`` of pages laid out in archive files."""
    n_files = max(1, math.ceil(pages.count() / FILE_RECORDS))
    made = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    filed = made.withColumn("file", F.conv(F.substring(F.md5("record"), 1, 8), 16, 10).cast("long") % n_files)
    order = Window.partitionBy("file").orderBy("page_id", "record")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    length = F.octet_length("record").cast("long")
    return filed.select(
        "page_id",
        "file",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.coalesce(F.sum(length).over(before), F.lit(0).cast("long")).alias("start_offset"),
        length.alias("length"),
        "record",
    )


def leaves(records: DataFrame, places: int) -> DataFrame:
    """Level 0 of a tree: ``level, node, hash, file, from_offset, to_offset``; *places* is a file's number of leaves."""
    content = F.sha2("record", 256)
    told = F.concat_ws(":", F.lit("leaf"), "file", "start_offset", "length", content)
    return records.select(
        F.lit(0).alias("level"),
        (F.col("file") * places + F.col("seq")).alias("node"),
        F.sha2(told, 256).alias("hash"),
        F.col("start_offset").alias("from_offset"),
        (F.col("start_offset") + F.col("length")).alias("to_offset"),
    )


#: Rows of a part of an inner level.
LEVEL_ROWS = 200_000


def tree(records: DataFrame, places: int, levels: int) -> list[DataFrame]:
    """The levels of a replica's tree, leaves first, *levels* above them; each is a table."""
    level = written(leaves(records, places), "merkle-level", parts_of(records))
    out, rows = [level], level.count()
    for k in range(1, levels + 1):
        level = level.groupBy(F.expr(f"node div {FANOUT}").alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("below"),
            F.min("from_offset").alias("from_offset"),
            F.max("to_offset").alias("to_offset"),
        )
        told = F.array_join(F.transform("below", lambda x: F.concat_ws("=", x["node"] % FANOUT, x["hash"])), ":")
        level = written(
            level.select(
                F.lit(k).alias("level"), F.col("up").alias("node"), F.sha2(F.concat(F.lit("node:"), told), 256).alias("hash"), "from_offset", "to_offset"
            ),
            "merkle-level",
            rows // (FANOUT**k * LEVEL_ROWS) + 1,
        )
        out.append(level)
    return out


def shape(*replicas: DataFrame) -> tuple[int, int]:
    """``(places, levels)`` that fit all replicas: leaf places of a file, and levels above the leaves."""
    found = [r.agg(F.max("seq").alias("s"), F.max("file").alias("f")).head() for r in replicas]
    most, last = max((x.s or 0) for x in found), max((x.f or 0) for x in found)
    places = FANOUT
    while places <= most:
        places *= FANOUT
    levels, span = 1, FANOUT
    while span < places * (last + 1):
        levels, span = levels + 1, span * FANOUT
    return places, levels


def differing(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """``node, kind`` of leaves that differ: ``changed``, ``missing`` (in *other*) or ``added``.

    Each level reads the children of the differing nodes above alone; where none differ, as between equal roots,
    the descent ends.
    """

    def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
        hashes = lambda nodes, name: nodes.select("node", F.col("hash").alias(name))
        return hashes(a, "ha").join(hashes(b, "hb"), "node", "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb")))

    found = written(unequal(one[-1], other[-1]), "merkle-differing", 1)
    for a, b in zip(one[-2::-1], other[-2::-1], strict=True):
        if found.isEmpty():
            break
        above = found.select(F.col("node").alias("up"))
        down = lambda nodes: nodes.join(above, F.expr(f"node div {FANOUT}") == F.col("up"), "left_semi")  # noqa: B023, E731
        # A level's few differing nodes are written: the next level refers to them twice.
        below = written(unequal(down(a), down(b)), "merkle-differing")
        dropped(found)
        found = below
    kind = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "added").otherwise("changed")
    return found.select("node", kind.alias("kind"))


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """``page_id, file, seq, start_offset, length, record_sha256, status`` of every record of the first replica, and of those only the other holds (``added``)."""
    places, levels = shape(records, replica)
    one, other = tree(records, places, levels), tree(replica, places, levels)
    bad = differing(one, other)
    dropped(*one, *other)
    told = ["page_id", "file", "seq", "start_offset", "length", "record_sha256"]

    def every(held: DataFrame) -> DataFrame:
        node = (F.col("file") * places + F.col("seq")).alias("node")
        return held.select(*told[:-1], F.sha2("record", 256).alias("record_sha256"), node)

    own = every(records).join(bad, "node", "left").select(*told, F.coalesce("kind", F.lit("intact")).alias("status"))
    added = every(replica).join(bad.where(F.col("kind") == "added"), "node").select(*told, F.col("kind").alias("status"))
    return own.unionByName(added)


def damaged(records: DataFrame) -> DataFrame:
    """A replica of *records* that lost about one record in fifty and holds as many with a wrong last byte."""
    key = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    lot = F.conv(F.substring(key, 1, 6), 16, 10).cast("long") % 50
    wrong = F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.lit("X"))
    return records.where(lot != 8).withColumn("record", F.when(lot == 7, wrong).otherwise(F.col("record")))


def sql() -> str:
    """DuckDB SQL for the audit of pages against :func:`damaged`, by comparing all records."""
    c = lambda x: f"coalesce(CAST({x} AS VARCHAR), '')"
    nl = "chr(13) || chr(10)"
    rec = (
        f"'WARC/1.1' || {nl} || 'WARC-Type: resource' || {nl} || 'WARC-Record-ID: <urn:page:' || {c('page_id')} || '>' || {nl}"
        f" || 'WARC-Target-URI: ' || {c('url')} || {nl} || 'Content-Type: text/html' || {nl} || 'Content-Length: '"
        f" || strlen({c('html')}) || {nl} || {nl} || {c('html')} || {nl} || {nl}"
    )
    lot = f"CAST('0x' || substr(md5({c('page_id')}), 1, 6) AS BIGINT) % 50"
    return f"""
        WITH made AS (SELECT page_id, {rec} AS record FROM pages),
        filed AS (
            SELECT *, CAST('0x' || substr(md5(record), 1, 8) AS BIGINT)
                      % greatest(1, CAST(ceil((SELECT count(*) FROM pages) / {FILE_RECORDS}.0) AS BIGINT)) AS file
            FROM made
        )
        SELECT page_id, file,
               row_number() OVER w - 1 AS seq,
               CAST(coalesce(sum(strlen(record)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset,
               strlen(record) AS length,
               sha256(record) AS record_sha256,
               CASE {lot} WHEN 7 THEN 'changed' WHEN 8 THEN 'missing' ELSE 'intact' END AS status
        FROM filed
        WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, record)
    """
