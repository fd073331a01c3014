"""Removal of repeated lines by overlapping windows of three lines.

Every three consecutive lines of a document form a window.  Windows are
grouped by 96 hash bits over the whole corpus; in each group the first
occurrence, by doc_id and position, stays, and the lines that later ones
cover are removed.  Covered positions of a document are merged before that,
so overlapping windows remove a line once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

WIDTH = 3


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, i, k, m): hash of the text, position and two hashes of each window that isn't blank."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("t"), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= WIDTH)

    def window(i):
        own = [F.get("lines", i + d) for d in range(WIDTH)]
        return F.struct(i.alias("i"), F.xxhash64(*own).alias("k"), F.hash(*own).alias("m"), F.concat(*own).rlike(r"\S").alias("solid"))

    all_ = rows.select("doc_id", "t", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - WIDTH), window)).alias("w"))
    return all_.where("w.solid").select("doc_id", "t", "w.i", "w.k", "w.m")


def drop_repeated_lines(docs: DataFrame, removed: str = "lines_removed") -> DataFrame:
    """``docs`` with repeated lines removed from text, and their number as column ``removed``.

    Documents of one or two lines have no window and never change; nor do rows
    with null id or null text, whose windows don't count either.  A text all
    of whose lines are repeats becomes ''.  Windows of blank lines alone don't
    count.  Rows with the same id and text are one document; with the same id
    and other texts, the lesser text hash comes first, so there are no ties.
    Texts of any length are read whole; an empty table gives an empty one.
    Other columns stay as they are, whatever their names, but one called
    ``removed`` gives way to the number.
    """
    docs = docs.drop(removed)
    w = windows(docs)
    first = w.groupBy("k", "m").agg(F.min(F.struct("doc_id", "t", "i")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = w.join(first, ["k", "m"]).where(F.struct("doc_id", "t", "i") != F.col("first"))
    id_, t, at = fresh(docs, "_id", "_t", "_at")
    gone = later.groupBy(F.col("doc_id").alias(id_), F.col("t").alias(t)).agg(F.collect_set("i").alias(at))
    on = (docs["doc_id"] == gone[id_]) & (F.xxhash64(docs["text"]) == gone[t])
    both = docs.join(gone.hint("shuffle_hash"), on, "left")
    lines = F.split("text", "\n", -1)
    covered = F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(*[p + d for d in range(WIDTH)]))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return both.select(*[text.alias(c) if c.lower() == "text" else docs[c] for c in docs.columns], F.coalesce(F.size(covered), F.lit(0)).alias(removed))


SQL = r"""
WITH l AS (
    SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), w AS (
    SELECT doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS k
    FROM l, unnest(range(greatest(len(ls) - 2, 0))) AS p(i)
), later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM w WHERE regexp_matches(k, '\S'))
    WHERE nth > 1
), covered AS (
    SELECT DISTINCT doc_id, i + d AS i FROM later, (VALUES (0), (1), (2)) AS v(d)
), kept AS (
    SELECT u.doc_id, string_agg(u.line, chr(10) ORDER BY u.i) AS text
    FROM (SELECT doc_id, i, ls[i + 1] AS line FROM l, unnest(range(len(ls))) AS p(i)) u ANTI JOIN covered c ON u.doc_id = c.doc_id AND u.i = c.i
    GROUP BY u.doc_id
), gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
"""
