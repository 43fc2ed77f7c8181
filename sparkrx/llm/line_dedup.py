"""Line deduplication: lines that occur in many documents are dropped from all of them.

Explode normalised lines, hash them, count distinct documents per hash, drop the lines over the threshold and put the rest together
by position. Only hashes and positions are shuffled with the lines; a text moves once, to meet its positions.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, packed, spread_join, unpacked, written


def line_key(line):
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _cleaned(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """__row (all columns), clean_text, n_lines, n_dropped of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    # two chained 64-bit hashes: 128 bits tell all lines of a corpus apart
    keys = F.transform(lines, lambda x: F.when(F.char_length(line_key(x)) >= min_chars, line_key(x)))
    hashed = docs.select(
        F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(3), text).alias("__t2"), keys.alias("__keys")
    ).withColumn("__h", F.transform("__keys", lambda k: F.when(k.isNotNull(), F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2")))))
    hashed = written(hashed.select("__id", "__t1", "__t2", "__h"), "lines")
    seen = hashed.select("__id", F.explode(F.array_distinct("__h")).alias("__x")).where("__x is not null").select("__id", "__x.h1", "__x.h2")
    # first one row per line and document, then a count per line: both steps combine before they shuffle
    seen = seen.groupBy("h1", "h2", "__id").agg(F.lit(1).alias("one"))
    common = written(seen.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"), "common-lines")
    places = hashed.select("__id", "__t1", "__t2", F.posexplode("__h").alias("pos", "__x")).where("__x is not null")
    places = places.select("__id", "__t1", "__t2", "pos", F.col("__x.h1").alias("g1"), F.col("__x.h2").alias("g2"))
    # a line that a third of all documents hold is dealt out by document
    hits = spread_join(places, common, [("g1", "h1"), ("g2", "h2")], F.col("__t1"), "inner")
    hits = hits.groupBy("__id", "__t1", "__t2").agg(F.collect_set("pos").alias("__drop"))
    rows = packed(docs, F.col("doc_id").alias("__d"), F.xxhash64(text).alias("__u1"), F.xxhash64(F.lit(3), text).alias("__u2"))
    same = F.col("__d").eqNullSafe(F.col("__id")) & (F.col("__u1") == F.col("__t1")) & (F.col("__u2") == F.col("__t2"))
    rows = rows.join(hits, same, "left").withColumn("__lines", F.split(F.coalesce(F.col("__row.text"), F.lit("")), "\n"))
    rows = rows.withColumn("__kept", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__drop", F.array().cast("array<int>"))))
    clean = F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n")
    n = F.size("__lines").cast("long")
    return rows.select("__row", clean.alias("clean_text"), n.alias("n_lines"), (n - F.size("__kept")).alias("n_dropped"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Adds ``clean_text``, ``n_lines`` and ``n_dropped`` to the rows of ``docs`` (doc_id, text, others).

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least ``min_chars`` code points found in
    at least ``min_docs`` documents lose all their lines. A null or empty text is one empty line. Documents are told apart by doc_id:
    rows that share one count once, rows with a null one count together as one document; each row is cleaned and returned, repeats
    included. An empty table gives an empty table. Extra columns are kept; columns named like the three added ones are replaced.
    """
    return unpacked(_cleaned(docs.drop("clean_text", "n_lines", "n_dropped"), min_docs, min_chars), "clean_text", "n_lines", "n_dropped")


def without_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` cleaned as by ``drop_repeated_lines``; a null text stays null. A column ``n_chars`` follows the text where lines went."""
    rows = _cleaned(docs, min_docs, min_chars)
    own = {c: F.col("__row").getField(c) for c in docs.columns}
    own["text"] = F.when(own["text"].isNotNull(), F.col("clean_text"))
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*[x.alias(c) for c, x in own.items()])
