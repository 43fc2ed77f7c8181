"""Helpers shared by the training-data operators.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``; Python's ``bytes.split()`` cuts at exactly these six
characters, which is why the operators work on UTF-8 bytes wherever they can.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
#: Rows of a table that go through Python at once are cut so that a batch holds at most about so many bytes of text.
BATCH_BYTES = 2 << 20
#: Tables of up to so many short rows (some 20 MB) are broadcast; into how many tasks a hot key is dealt beyond that.
SMALL_SIDE, SALTS = 200_000, 16
#: Bits of the table that tells which rows a long list may hold: for each of its rows, and at most (8 MB). Spark's bitmaps are cut at 2^15 bits.
SIFT_BITS, MOST_BITS, BITMAP = 16, 1 << 26, 15


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of its own, others an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sparkrx-")
    return _own[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which Hadoop deletes when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read back: lineage ends here and Spark knows its true size."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a table of ``written`` that nothing reads any more, as those of earlier rounds of a loop."""
    path = getattr(df, "written_at", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` beside a struct ``__row`` of all that ``df`` has: no name of its columns can clash with an inner one. ``unpacked`` undoes it."""
    return df.select(F.struct("*").alias("__row"), *columns)


def unpacked(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select("__row.*", *columns)


def spread_join(big: DataFrame, small: DataFrame, on: list[tuple[str, str]], by: Column, how: str = "left", cells: Column | None = None, grows: bool = False) -> DataFrame:
    """``big`` joined to ``small`` on null-safe pairs of columns, some of which many rows of ``big`` may share.

    A small side of at most SMALL_SIDE rows (of short columns; ``cells`` counts the elements of long ones, eight to a row) is broadcast. Beyond that each of its rows is repeated SALTS times and the rows of ``big`` are
    dealt by ``by``, so that a key that a third of them holds lands in SALTS tasks. A small side that ``grows`` with the big one is never
    broadcast, so that the plan is the same at every size.
    """
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in on])
    if not grows:
        n, more = small.agg(F.count("*"), F.sum(cells if cells is not None else F.lit(0))).first()
        if n + (more or 0) // 8 <= SMALL_SIDE:
            return big.join(F.broadcast(small), same, how)
    small = small.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    big = big.withColumn("__salt1", F.pmod(F.xxhash64(F.lit(29), by), F.lit(SALTS)).cast("int"))
    small = small.hint("merge") if grows else small
    return big.join(small, same & (F.col("__salt1") == F.col("__salt2")), how).drop("__salt1", "__salt2")


def sifted_join(rows: DataFrame, listed: DataFrame, on: list[tuple[str, str]], how: str) -> DataFrame:
    """``rows`` joined (inner, left_semi or left_anti) to a long list on null-safe pairs of columns of equal types.

    The driver never holds the list, only a table of bits of MOST_BITS at most: a row whose bit is not set is not listed. The others are
    shuffled and joined by the columns themselves, so keys that share a bit cost a move of some rows more but change no result.
    """
    bits, n = 1 << BITMAP, listed.count()
    while bits < min(n * SIFT_BITS, MOST_BITS):
        bits *= 2

    def place(*columns: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(31), *columns), F.lit(bits))

    def within(at: Column) -> Column:
        return at.bitwiseAND(F.lit((1 << BITMAP) - 1))

    at = place(*[y for _, y in on])
    marks = listed.select(F.shiftright(at, BITMAP).alias("__bitmap"), within(at).alias("__bit"))
    marks = F.broadcast(marks.groupBy("__bitmap").agg(F.bitmap_construct_agg("__bit").alias("__bits")))
    at = place(*[x for x, _ in on])
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(within(at), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    looked = rows.join(marks, F.shiftright(at, BITMAP) == F.col("__bitmap"), "left")
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in on])
    out = looked.where(may).select(*rows.columns).join(listed.hint("merge"), same, how)
    return looked.where(~may).select(*rows.columns).unionByName(out) if how == "left_anti" else out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text is divisible by five. A null id counts as the text ``null``."""
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % 5 == 0


def held_out_col(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def spread(col: Column, mod: int = 1 << 20) -> Column:
    """A reproducible pseudo-random number below ``mod`` for each value."""
    return F.pmod(F.xxhash64(F.lit(17), col), F.lit(mod))


def sliced(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cuts batches at about BATCH_BYTES of the column ``text``; a longer single text is a batch of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy()
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > BATCH_BYTES:
                yield b.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield b.slice(begin)


def text_map(df: DataFrame, fn: Callable, schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` with memory bounded by BATCH_BYTES plus the longest text. fn: RecordBatch to RecordBatch."""

    def run(batches):
        for b in sliced(batches, text):
            yield fn(b)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes) -> bool:
    """Whether the text has a character of a letter category."""
    return bool(_ASCII_LETTER.search(raw)) or not raw.isascii() and any(map(str.isalpha, raw.decode("utf-8", "replace")))


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], label: str) -> DataFrame:
    """Adds, for each long column and name in ``sums``, the exclusive prefix sum of the column within ``keys`` in the order ``order``.

    No group is gathered in one task: rows are range-partitioned by keys and order, each partition is summed by key, the few sums
    are accumulated, and each partition's rows then add their own offsets. Integer sums make the outcome independent of the cut.
    Rows that tie in ``order`` should be interchangeable.
    """
    dealt = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    dealt = written(dealt.withColumn("__pid", F.spark_partition_id()), label)
    parts = dealt.groupBy("__pid", *keys).agg(*[F.sum(w).alias(f"__sum{i}") for i, w in enumerate(sums)])
    before = W.partitionBy(*keys).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        F.col("__pid").alias("__p2"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"__sum{i}").over(before), F.lit(0)).alias(f"__base{i}") for i in range(len(sums))]
    )
    same = F.col("__pid") == F.col("__p2")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    own = W.partitionBy("__pid", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    dealt = dealt.select("*", *[F.coalesce(F.sum(w).over(own), F.lit(0)).alias(f"__own{i}") for i, w in enumerate(sums)])
    out = dealt.join(parts, same, "left").withColumns({name: F.col(f"__own{i}") + F.col(f"__base{i}") for i, name in enumerate(sums.values())})
    return out.select(*df.columns, *sums.values())
