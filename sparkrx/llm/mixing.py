"""Mixing sources to target weights by systematic sampling.

Each document expects target / size-of-its-source copies. The expected copies are prefix-summed within the source, documents ordered
by size, one random offset a source is added, and a document is emitted once for each integer boundary its interval crosses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SIDE, SPACE, packed, prefix_sums, spread_join, unpacked, written

#: Expected copies are held as integers with so many fractional bits, so that sums are exact and the same in any partitioning.
BITS = 24
WEIGHTS = (3, 1, 2)


def size_of(text):
    """Words of a text; null has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def drawn(text, digits: int):
    """A reproducible pseudo-random number of so many hexadecimal digits."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def targets_of(totals: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``totals`` (__source, source_size) with ``target``: words that share ``share`` of all by weight, none above ``most`` times its source's.

    Sources are taken by code point with null last and weigh ``weights``, repeating. The excess of a source that would pass its limit
    goes to the others by weight, until none passes it: in the order of size by weight, sources are full up to some place, from which
    on the rest is shared by weight. Prefix sums find that place; neither the driver nor a task holds all sources.
    """
    rows = totals.withColumn("__last", F.col("__source").isNull()).withColumn("__one", F.lit(1).cast("long"))
    rows = prefix_sums(rows, [], ["__last", "__source"], {"__one": "__nth"}, "source-order")
    rows = rows.withColumn("__w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("__nth") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("__ratio", F.col("source_size") / F.col("__w"))
    rows = written(prefix_sums(rows, [], ["__ratio", "source_size", "__w"], {"source_size": "__before", "__w": "__wbefore"}, "source-ratios"), "sources")
    words, weight = rows.agg(F.sum("source_size"), F.sum("__w")).first()
    rest = (F.lit(share) * F.lit(words or 0) - F.lit(most) * F.col("__before")) / (F.lit(weight or 1) - F.col("__wbefore"))
    full = F.lit(most) * F.col("source_size")
    level = rows.agg(F.max(F.when(rest * F.col("__w") < full, rest))).first()[0]
    return rows.select("__source", "source_size", (F.least(full, F.lit(level) * F.col("__w")) if level is not None else full).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, seed: int = 42, label: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of ``docs`` (doc_id, text, source), and the columns ``keep``.

    A null text has size 0; a null source is a source of its own, the last. A document without words is taken as often as its place
    says, which takes no words. Repeated rows are documents of their own; rows that tie in source, size and id are interchangeable.
    No document is taken more than twice. An empty table gives no rows. Reruns agree, however the rows are partitioned.
    """
    rows = docs.select(F.col("doc_id"), F.col("source").alias("__source"), size_of(F.col("text")).alias("size"), *keep)
    rows = written(rows, f"{label}-sizes")
    sheet = targets_of(rows.groupBy("__source").agg(F.sum("size").alias("source_size")), weights, share)
    step = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * (1 << BITS)).cast("long"), F.lit(2 << BITS))).otherwise(F.lit(0))
    off = drawn(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("__source")), F.lit("n"))), BITS // 4)
    sheet = written(sheet.select(F.col("__source").alias("__s"), "source_size", "target", step.cast("long").alias("__step"), off.alias("__off")), f"{label}-sheet")
    rows = rows.withColumn("__r", drawn(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), 12)).withColumn("__one", F.lit(1).cast("long"))
    ranked = prefix_sums(rows, ["__source"], ["size", "__r", "doc_id"], {"__one": "__rank"}, label)
    ranked = spread_join(ranked, sheet, [("__source", "__s")], F.col("__r"), "inner")
    copies = F.expr(f"(__off + (__rank + 1) * __step) div {1 << BITS} - (__off + __rank * __step) div {1 << BITS}")
    return ranked.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "size", "source_size", "target", "copies", "taken", *keep)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with ``copy`` counting from 1 (a column of that name is replaced).

    Rows that agree in doc_id, source and text are emitted together by one of them, so their copies stay whole.
    """
    docs = docs.drop("copy")
    key = F.xxhash64(F.col("text"), F.col("source"))
    picks = mix(docs.select("doc_id", "text", "source", key.alias("__key")), keep=("__key",), **options)
    picks = picks.groupBy("doc_id", "__key").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__n")).where("__copies > 0")
    picks = written(picks.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__k"), "__copies", "__n"), "picks")
    hold = F.broadcast if picks.count() <= SMALL_SIDE else (lambda x: x)
    rows = packed(docs, F.col("doc_id").alias("__d"), key.alias("__h")).join(hold(picks), F.col("__d").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__k")))
    if picks.where("__n > 1").limit(1).count():  # repeated rows
        rows = rows.where("__n = 1").unionByName(rows.where("__n > 1").dropDuplicates(["__id", "__k"]))
    return unpacked(rows, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy"))
