"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are lower-cased runs of letters, marks and digits. Fixed masks hash some of up to twelve consecutive words and ignore the others,
so a substituted word spoils only the seeds that look at it. Seeds of test items and of documents are joined; every diagonal (item,
shift) with a hit is then verified word by word on the document.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, written

#: Positions that the seeds of long items look at, at every shift; all masks begin with two adjacent words, which are looked up first.
MASKS = ((0, 1, 3, 5, 6, 8), (0, 1, 2, 5, 7, 9), (0, 1, 4, 6, 9, 10), (0, 1, 3, 4, 8, 10))
SPAN = 12
#: Items of fewer words are too common as passages; they are found only where a document consists of nothing else.
SHORTEST = 5
#: Words of a text that are laid out side by side at a time.
CHUNK = 4096
#: Test sets of up to so many seeds, items of so many words in all and lists of so many documents (each some 30 MB) are broadcast.
SMALL_SEEDS, SMALL_WORDS, SMALL_IDS = 500_000, 4_000_000, 1_000_000


def hashed_words(text):
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def wrong_of(n: int, similarity: float) -> int:
    """How many of n words may differ."""
    return n - math.ceil(similarity * n - 1e-9)


def block_masks(n: int, wrong: int) -> list[tuple[int, ...]]:
    """Masks over an item of n words: it is cut into ``wrong`` + 2 blocks and each mask leaves out ``wrong`` of them.

    So many substituted words lie in so many blocks at most: one mask looks at none of them.
    """
    cuts = [-(-n * k // (wrong + 2)) for k in range(wrong + 3)]
    return [tuple(i for k in range(wrong + 2) if k not in out for i in range(cuts[k], cuts[k + 1])) for out in combinations(range(wrong + 2), wrong)]


def _seed(number: int, mask: tuple[int, ...]):
    """The seed at a row of columns w0, w1, ...; null where the text ends within it."""
    return F.when(F.col(f"w{mask[-1]}").isNotNull(), F.xxhash64(F.lit(number), *[F.col(f"w{o}") for o in mask]))


def _places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each word of ``h``: its position, the number of words and the SPAN words from it on, null beyond the end.

    Long texts are laid out CHUNK words at a time.
    """
    n = F.size("h")
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.struct((c * CHUNK).alias("base"), F.slice("h", c * CHUNK + 1, F.lit(CHUNK + SPAN - 1)).alias("part")))
    rows = rows.where(n > 0).select(*keys, n.alias("n"), F.inline(parts))
    size = F.least(F.size("part"), F.lit(CHUNK))
    shifted = [F.slice("part", o + 1, size).alias(f"w{o}") for o in range(SPAN)]
    return rows.select(*keys, "n", F.inline(F.arrays_zip(F.sequence(F.col("base"), F.col("base") + size - 1).alias("at"), *shifted)))


def contaminated(docs: DataFrame, tests: DataFrame, overlap: int = 13, similarity: float = 0.8) -> DataFrame:
    """doc_id, th, item, n_aligned, n_equal for each document that holds a passage of a test item; th and item are hashes of text and words.

    A document (doc_id, text) holds a passage of an item (item_id, text) if, at some shift, ``overlap`` consecutive words (all words of
    a shorter item) agree in a share of ``similarity`` or more. At the defaults the masks lose none: of an item of 5 to 12 words a block
    mask looks at no substituted word, and every two substituted words of 13 leave a seed of MASKS whole. n_aligned and n_equal are of
    the best such shift: words of the item that lie on the document, and those that agree. Items of fewer than SHORTEST words (also a
    text in a script without spaces, which is one word) are held by documents whose words are just these. Items without words are held
    by none, as are any by null and empty texts. Items of equal words are one item; repeated documents count once. Null ids are ids
    like others. Empty tables give no rows. Further columns are not read.
    """
    items = written(_items(tests).select("item", "h").dropDuplicates(["item"]), "items")
    n_words = items.agg(F.sum(F.size("h"))).first()[0] or 0
    short = sorted(r[0] for r in items.where(F.size("h") < overlap).select(F.size("h")).distinct().collect())  # below ``overlap`` numbers
    numbers: dict[tuple[int, ...], int] = {m: k for k, m in enumerate(MASKS)}
    own = []  # (size of item, where the mask begins, its number, positions in the item)
    for n in (n for n in short if n >= SHORTEST):
        for m in block_masks(n, wrong_of(n, similarity)):
            own.append((n, m[0], numbers.setdefault(tuple(i - m[0] for i in m), len(numbers)), m))
    whole = [n for n in short if n < SHORTEST]
    own += [(n, 0, 1000 + n, tuple(range(n))) for n in whole]
    seed = "struct<j:int,two:bigint,seed:bigint>"

    def made(j, number, words):
        return F.struct(j.cast("int").alias("j"), F.xxhash64(words[0], words[1]).alias("two"), F.xxhash64(F.lit(number), *words[2:]).alias("seed"))

    fixed = [F.when(F.size("h") == n, made(F.lit(j), k, [F.get("h", F.lit(j)), F.get("h", F.lit(j + 1)), *[F.get("h", F.lit(i)) for i in m]])) for n, j, k, m in own]
    sliding = F.array(*[F.when(F.col(f"w{m[-1]}").isNotNull(), made(F.col("at"), k, [F.col(f"w{i}") for i in (0, 1, *m)])) for k, m in enumerate(MASKS)])
    seeds = _places(items.where(F.size("h") >= overlap), ["item"]).select("item", F.inline(F.filter(sliding, lambda x: x.isNotNull())))
    if fixed:
        seeds = seeds.union(items.select("item", F.inline(F.filter(F.array(*fixed).cast(f"array<{seed}>"), lambda x: x.isNotNull()))))
    seeds = written(seeds, "seeds")
    small = seeds.count() <= SMALL_SEEDS
    hold = F.broadcast if small else (lambda x: x)

    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))
    places = _places(rows.select("doc_id", "th", hashed_words(F.col("text")).alias("h")), ["doc_id", "th"]).withColumn("pair", F.xxhash64("w0", "w1"))
    if small and all(m[1:2] in ((), (1,)) for m in numbers):  # most places end here
        places = places.join(hold(seeds.select(F.col("two").alias("pair")).distinct()), "pair", "left_semi")
    looks = [_seed(k, m) for m, k in numbers.items()] + [F.when(F.col("n") == n, _seed(1000 + n, tuple(range(n)))) for n in whole]
    found = places.select("doc_id", "th", "at", F.explode(F.array(*looks)).alias("seed")).where("seed is not null")
    hits = found.join(hold(seeds.select(F.col("seed").alias("s"), "item", "j")), F.col("seed") == F.col("s"))
    # one row per diagonal, combined before it is shuffled
    lines = hits.groupBy("doc_id", "th", "item", (F.col("at") - F.col("j")).alias("shift")).agg(F.collect_set("j").alias("js"))
    lines = written(lines, "diagonals").select(F.col("doc_id").alias("id"), F.col("th").alias("t"), "item", "shift", "js")
    words = items.select(F.col("item").alias("it"), F.col("h").alias("b"))
    lines = lines.join(F.broadcast(words) if n_words <= SMALL_WORDS else words, F.col("item") == F.col("it")).drop("it")
    # only documents with a hit are cut into words again
    ids = written(lines.select(F.xxhash64("id", "t").alias("one")).distinct(), "hit-documents")
    rows = rows.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, F.xxhash64("doc_id", "th") == F.col("one"), "left_semi")
    rows = rows.select("doc_id", "th", hashed_words(F.col("text")).alias("h"))
    line = rows.join(lines, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("th").eqNullSafe(F.col("t")))
    line = line.withColumn("low", F.greatest(F.lit(0), -F.col("shift"))).withColumn("high", F.least(F.size("b"), F.size("h") - F.col("shift")))
    line = line.withColumn("w", F.least(F.lit(overlap), F.size("b"))).withColumn("last", F.col("high") - F.col("low") - F.col("w")).where("last >= 0")
    line = line.where((F.size("b") >= SHORTEST) | (F.size("b") == F.size("h")))
    line = line.withColumn("same", F.transform(F.sequence("low", F.greatest("low", F.col("high") - 1)), lambda k: (F.get("h", k + F.col("shift")) == F.get("b", k)).cast("int")))
    need = F.ceil(F.lit(similarity) * F.col("w") - F.lit(1e-9))

    def total(cells):
        return F.aggregate(cells, F.lit(0), lambda a, x: a + x)

    # the windows of w words around each hit
    def windows(j):  # never empty nor backwards, also on rows that another filter drops
        first = F.greatest(F.lit(0), j - F.col("low") - F.col("w") + 1)
        return F.sequence(first, F.greatest(first, F.least(F.col("last"), j - F.col("low") + SPAN - 1)))

    around = F.exists("js", lambda j: F.exists(windows(j), lambda s: total(F.slice("same", s + 1, F.col("w"))) >= need))
    best = F.max(F.struct(total(F.col("same")).alias("n_equal"), F.size("same").alias("n_aligned"))).alias("best")
    return line.where(around).groupBy("doc_id", "th", "item").agg(best).select("doc_id", "th", "item", F.col("best.n_aligned").alias("n_aligned"), F.col("best.n_equal").alias("n_equal"))


def _items(tests: DataFrame) -> DataFrame:
    """(item_id, item, h) of the items with words; item names the words."""
    rows = tests.select("item_id", hashed_words(F.col("text")).alias("h")).where(F.size("h") > 0)
    return rows.select("item_id", F.xxhash64("h").alias("item"), "h")


def found_passages(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_aligned, n_equal: one row for each doc_id and item_id of ``contaminated``."""
    found = contaminated(docs, tests, **options).withColumnRenamed("item", "held")
    ids = _items(tests).select("item_id", "item").distinct()
    best = F.max(F.struct("n_equal", "n_aligned")).alias("best")
    return found.join(ids, F.col("held") == F.col("item")).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_aligned", "best.n_equal")


def without_contaminated(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no passage of a test item, with all their columns."""
    bad = written(contaminated(docs, tests, **options).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct(), "contaminated")
    rows = packed(docs, F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__xx"))
    hold = F.broadcast if bad.count() <= SMALL_IDS else (lambda x: x)
    return unpacked(rows.join(hold(bad), F.col("__d").eqNullSafe(F.col("__id")) & (F.col("__xx") == F.col("__th")), "left_anti"))
