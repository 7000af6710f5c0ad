"""Sinks: JSON documents, JSON lines, CSV, the itemset report, cluster assignments and timings."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def document(path: str, content: dict) -> None:
    """One small JSON document (a handful of report values) on the driver's disk."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump(content, out)


def review_report(counts: DataFrame, users: DataFrame, words: DataFrame) -> dict:
    """The report of review statistics under its keys A to E, from top-k frames."""
    c = counts.head()
    return {
        "A": c.n_reviews,
        "B": c.n_in_year,
        "C": c.n_users,
        "D": [[str(r[0]), r[1]] for r in users.collect()],
        "E": [r[0] for r in words.collect()],
    }


def write_itemset_report(path: str, candidates: DataFrame, frequent: DataFrame) -> None:
    """A text file of two sections: a title, then a line for each size with its sets in order, such as ``('a'),('b')``.

    Lines are parted by CRLF.  Sets are sorted in Spark and come to the driver partition by partition.
    """
    with open(path, "w", encoding="utf-8", newline="") as out:
        for title, sets in (("Candidates:", candidates), ("\r\nFrequent Itemsets:", frequent)):
            out.write(title)
            size = 0
            for r in sets.select("items").orderBy(F.size("items"), "items").toLocalIterator():
                out.write("," if len(r[0]) == size else "\r\n")
                size = len(r[0])
                out.write(f"({r[0][0]!r})" if size == 1 else repr(tuple(r[0])))


def write_assignment(path: str, assigned: DataFrame) -> None:
    """``{"point": cluster, ...}`` as one JSON file in order of points, which come partition by partition."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("{")
        for i, r in enumerate(assigned.select("point_id", "cluster_id").orderBy("point_id").toLocalIterator()):
            out.write(f'{", " if i else ""}{json.dumps(str(r[0]))}: {json.dumps(r[1])}')
        out.write("}")


@contextmanager
def timed(report: dict, step: str) -> Iterator[None]:
    """Put the seconds of what is done inside into *report* under *step*, and log them."""
    began = time.perf_counter()
    try:
        yield
    finally:
        report[step] = time.perf_counter() - began
        logging.getLogger("tessera").info("%s: %.3f s", step, report[step])
