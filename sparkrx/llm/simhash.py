"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each read as a word of the binary Golay code [23, 12, 7]. The code
is perfect: every word lies within 3 bits of exactly one codeword, whose index is the word's *centre*. A word at the full 3 bits also
*touches* the five codewords at 4 bits (the weight-7 words of the code that hold its three errors). Then

* words within 1 bit: the centre of either is among the centre and touched codewords of the other;
* words within 2 bits: their sets of centre and touched codewords meet.

Fingerprints with 3 or fewer differing bits spread these over the three segments, so one of the following holds, each of them a key of
28 bits or more (numbered as the families below): a segment is equal and another is within 1 bit (R: families 0 and 1) or within
2 bits (P, Q: 2 and 3); or every segment has exactly one wrong bit, which leaves one equal half in each (4 to 11). Candidates that share
a key are verified on all 64 bits.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_BYTES, discard, packed, sifted_join, sliced, spread_join, text_map, texts, unpacked, written
from .xxh import xxh64_slices

GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, which generates the Golay code
NEAR = 3
#: Keys that more fingerprints share than this are not compared in one task; their fingerprints take the finer keys of ``masked``.
LARGE = 4096
#: Fingerprints of parts that a text gets for each level of its size.
PARTS = 32
#: Candidates of up to so many shingles in all are compared in one task; more are dealt into blocks, every two of which meet.
BLOCK = 1 << 20
#: Lists of up to so many rows are broadcast; longer ones are joined by shuffle, and the driver does not hold them.
SMALL_LIST = 2_000


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """error: the error pattern of each of the 2048 syndromes. seven: for each syndrome, the five codewords that touch it, else 0."""

    def rest(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    single = [rest(1 << i) for i in range(23)]
    error = np.zeros(2048, dtype=np.int64)
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            s = e = 0
            for b in bits:
                s ^= single[b]
                e |= 1 << b
            error[s] = e
    codewords = (i << 11 ^ rest(i << 11) for i in range(4096))
    sevens = np.array([c for c in codewords if c.bit_count() == 7])
    touched = np.zeros((2048, 5), dtype=np.int64)
    for s in range(2048):
        if int(error[s]).bit_count() == 3:
            touched[s] = sevens[sevens & error[s] == error[s]]
    return error, touched


@cache
def rests() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 and of the lower 11 bits; a word's syndrome is their sum."""
    high = np.zeros(4096, dtype=np.int64)
    for i in range(4096):
        w = i << 11
        for b in range(22, 10, -1):
            if w >> b & 1:
                w ^= GENERATOR << (b - 11)
        high[i] = w
    return high, np.arange(2048)


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of 23 bits: the index of the centre, n x 6 indices of all codewords within reach (the centre first), which of them count."""
    error, touched = golay()
    high, low = rests()
    words = words.astype(np.int64)
    s = high[words >> 11] ^ low[words & 2047]
    centre = words ^ error[s]
    more = centre[:, None] ^ touched[s]
    return centre >> 11, np.concatenate([centre[:, None], more], axis=1) >> 11, np.concatenate([np.ones((len(words), 1), bool), touched[s] > 0], axis=1)


SPACES = np.zeros(256, bool)
SPACES[list(b" \t\n\x0b\x0c\r")] = True


def shingle_hashes(batch: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of the texts, one after the other, and how many each text has.

    A-Z are lower-cased. A text of fewer words than a shingle is one shingle, one without words none. All texts are cut and hashed together.
    """
    buffer = b"\n".join(batch).lower() + b"\n"
    stops = np.cumsum([len(t) + 1 for t in batch]) - 1
    raw = np.frombuffer(buffer, np.uint8)
    space = SPACES[raw]
    gap = space.copy()
    gap[0] = False
    gap[1:] &= ~space[:-1]  # the first space after each word
    norm = raw[~space | gap]
    norm = np.where(SPACES[norm], np.uint8(32), norm)  # words, each with one space behind it
    ends = np.flatnonzero(norm == 32)
    if not len(ends):
        return np.zeros(0, np.uint64), np.zeros(len(batch), np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.bincount(np.searchsorted(stops, np.flatnonzero(gap)), minlength=len(batch))
    firsts = np.cumsum(counts) - counts
    per_text = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    words = np.minimum(counts, shingle)
    first_word = np.repeat(firsts, per_text) + np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return xxh64_slices(norm.tobytes() + bytes(8), starts[first_word], ends[first_word + np.repeat(words, per_text) - 1]), per_text


def majority(hashes: np.ndarray) -> np.uint64:
    """The SimHash of one or more hashes: a bit is 1 if more than half of them have it."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(batch: list[bytes], shingle: int = 3) -> np.ndarray:
    """SimHash of each text's shingles; no words: 0."""
    hashes, per_text = shingle_hashes(batch, shingle)
    out, begin = np.zeros(len(batch), np.uint64), 0
    for i, n in enumerate(per_text.tolist()):
        if n:
            out[i] = majority(hashes[begin : begin + n])
        begin += n
    return out


def with_fingerprints(rows: DataFrame, keep: list[str], shingle: int = 3) -> DataFrame:
    """``keep`` of each row, and the fingerprint of its text as a signed 64-bit number."""

    def run(batches):
        for b in sliced(batches, "__text"):
            fps = fingerprints(texts(b, "__text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(fps)], names=[*keep, "fp"])

    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def _mixed(family: int, *parts: np.ndarray) -> np.ndarray:
    """One 64-bit key of a family's parts, each below 2^24."""
    key = np.full(len(parts[0]), 0x9E3779B97F4A7C15 * (family + 1) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for p in parts:
        key = (key ^ p.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    key *= np.uint64(0x94D049BB133111EB)
    return (key ^ key >> np.uint64(32)).view(np.int64)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every fingerprint; two of them within NEAR bits share one at least."""
    x = fps.view(np.uint64)
    p, q, r = (x & np.uint64((1 << 22) - 1)).astype(np.int64), (x >> np.uint64(22) & np.uint64((1 << 21) - 1)).astype(np.int64), (x >> np.uint64(43)).astype(np.int64)
    (cp, ap, mp), (cq, aq, mq) = indices(p), indices(q)
    rows, keys, n = [], [], np.arange(len(fps))
    for family, whole, near, use in ((0, r, ap, mp), (1, r, aq, mq), (2, p, aq, mq), (3, q, ap, mp)):
        for j in range(6):
            at = n[use[:, j]]
            rows.append(at)
            keys.append(_mixed(family, whole[at], near[at, j]))
    halves = [(v & (1 << h) - 1, v >> h) for v, h in ((p, 11), (q, 10), (r, 10))]
    for f in range(8):
        rows.append(n)
        keys.append(_mixed(4 + f, *[half[f >> i & 1] for i, half in enumerate(halves)]))
    return np.concatenate(rows), np.concatenate(keys)


def masked_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that leave out 3 of 16 blocks of 4 bits: exact for NEAR bits too, and at most 4096 different fingerprints can share one."""
    x, rows, keys, n = fps.view(np.uint64), [], [], np.arange(len(fps))
    for f, out in enumerate(combinations(range(16), NEAR)):
        y = x & np.uint64(~sum(15 << 4 * b for b in out) & 0xFFFFFFFFFFFFFFFF)
        rows.append(n)
        keys.append(_mixed(100 + f, y & np.uint64(0xFFFFFF), y >> np.uint64(24) & np.uint64(0xFFFFFF), y >> np.uint64(48)))
    return np.concatenate(rows), np.concatenate(keys)


def keyed(fps: DataFrame, maker) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                v = b.column("fp").slice(i, 2048).to_numpy(zero_copy_only=False)
                rows, keys = maker(v)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(v[rows])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def forest(fps: np.ndarray, near: int = NEAR) -> list[tuple[int, int]]:
    """Links that connect what pairs within ``near`` bits connect: verified pairs, fewer than there are fingerprints."""
    x, links = fps.view(np.uint64), []
    left = np.arange(len(x))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            a = todo.pop()
            close = np.bitwise_count(x[left] ^ x[a]) <= near
            found = left[close]
            links += [(int(fps[a]), int(fps[b])) for b in found]
            todo += found.tolist()
            left = left[~close]
    return links


def bucket_links(keyed_fps: DataFrame) -> DataFrame:
    """Verified links (a, b) within the fingerprints that share a key; each key has at most LARGE of them."""
    groups = keyed_fps.groupBy("key").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches):
        for b in batches:
            out = [x for v in b.column("fps") for x in forest(v.values.to_numpy(zero_copy_only=False).astype(np.int64))]
            pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def links_of(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """Links (a, b), a != b, of the distinct fingerprints ``fps`` (fp): they connect exactly what all pairs within NEAR bits connect."""
    keys = written(keyed(fps, golay_keys), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes, "golay-buckets")
    if not sizes.where(F.col("n") > large).limit(1).count():
        shared = keys.join(sizes.select("key"), "key", "left_semi")
        return written(bucket_links(shared), "links")
    small = bucket_links(keys.join(sizes.where(F.col("n") <= large).select("key"), "key", "left_semi"))
    crowded = keys.join(sizes.where(F.col("n") > large).select("key"), "key", "left_semi").select("fp").distinct()
    fine = bucket_links(keyed(crowded, masked_keys))
    return written(small.union(fine).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the graph of ``links`` (a, b): root is one node of the component, the same for all of it.

    Alternates large-star and small-star steps until the links are stars. The links of one node are never gathered: its smallest
    neighbour is a combined minimum that is joined back, with the links of a star's centre dealt out.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, first = None, True
    while True:
        # large-star: each node hands its smallest neighbour (itself included) to its larger neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "lows")
        large = spread_join(both.where("v > u"), low, [("u", "w")], F.col("v"), "inner")
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        discard(low)
        if not first:
            discard(edges)
        # small-star: each node joins its smaller neighbours to the smallest of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m"), "lows")
        moved = spread_join(large, low, [("u", "w")], F.col("v"), "inner").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, first = written(low.select(F.col("w").alias("u"), F.col("m").alias("v")).union(moved).distinct(), "small-star"), False
        discard(large)
        discard(low)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, fingerprint, component_id for every row of ``docs`` (doc_id, text).

    Fingerprints link at NEAR or fewer differing bits; component_id is the smallest doc_id that links reach, the row's own included.
    A null or blank text has fingerprint zero, linked like any other. Null ids are passed over for component_id, which is null only
    where the whole component has no id. Repeated rows come back as often as they came. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").alias("__text"))
    prints = written(with_fingerprints(rows, ["doc_id", "text_hash"], shingle), "fingerprints")
    # exact copies meet here first, combined before they shuffle: all that follows sees each fingerprint once
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("text_hash").alias("th")))
    nodes = written(prints.groupBy("fp").agg(least.alias("first")), "nodes")
    comp = components(links_of(nodes.select("fp")))
    named = nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    named = named.select(F.col("fp").alias("__fp"), F.col("root").alias("__root")).join(best, F.col("__root") == F.col("root"))
    named = written(named.select("__fp", "best"), "classes")
    out = prints.join(named, F.col("fp") == F.col("__fp"))
    return out.select("doc_id", "text_hash", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.id").alias("component_id"), F.col("best").alias("__best"))


def without_near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of each component of ``docs``, all columns kept: the one with the smallest doc_id (rows without one last)."""
    found = near_duplicates(docs, shingle)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("__best.id")) & (F.col("text_hash") == F.col("__best.th")))
    stay = written(stay.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).agg(F.count("*").alias("__n")), "stay")
    rows = packed(docs, F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__xx"))
    rows = rows.join(_listed(stay), F.col("__d").eqNullSafe(F.col("__id")) & (F.col("__xx") == F.col("__th")))
    if stay.where("__n > 1").limit(1).count():  # repeated rows
        rows = rows.where("__n = 1").unionByName(rows.where("__n > 1").dropDuplicates(["__id", "__th"]))
    return unpacked(rows)


def shingle_sets(batch: list[bytes], shingle: int) -> list[np.ndarray]:
    """The different shingles of each text, sorted; about BATCH_BYTES of text are hashed at a time."""
    out, begin, size = [], 0, 0
    for i, text in enumerate(batch):
        size += len(text)
        if size >= BATCH_BYTES or i == len(batch) - 1:
            hashes, per_text = shingle_hashes(batch[begin : i + 1], shingle)
            ends = np.cumsum(per_text)
            out += [np.unique(hashes[e - n : e]) for e, n in zip(ends.tolist(), per_text.tolist())]
            begin, size = i + 1, 0
    return out


def levels(n: int) -> list[int]:
    """Logarithms of the numbers of parts for n shingles. Sets of Jaccard similarity 0.8 or more have sizes within a factor of 1.25, so share one."""
    return sorted({max(2, (k // 4).bit_length() - 1) for k in (n, n * 5 // 4)}) if n >= 4 else []


def part_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set of shingles: SimHashes of PARTS parts of it, of 4 to 8 shingles each in all but the smallest sets.

    The shingles alone say which part they fall into, so two sets agree in all parts without a shingle that only one of them has. At
    similarity 0.8 that holds for a quarter of the parts or more; small sets are dealt out several times, with PARTS parts altogether.
    Sets of fewer than four shingles are 0.8 similar only if they are equal, and have no keys.
    """
    out = []
    for level in levels(len(hashes)):
        for deal in range(max(1, PARTS >> level)):
            mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (deal + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            part = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - level)
            at = np.flatnonzero(part < PARTS)
            if not len(at):
                continue
            at = at[np.argsort(part[at], kind="stable")]
            part = part[at].astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            n = np.diff(np.append(begin, len(at)))
            ones = np.add.reduceat(np.unpackbits(hashes[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), begin, axis=0, dtype=np.int64)
            fps = np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
            low, high = fps & np.uint64(0xFFFFFFFF), fps >> np.uint64(32)
            out.append(_mixed(1000 + level, low, high, part[begin] | deal << 8, np.minimum(n, 0xFFFFFF)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def similar_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (positions in ``sets``) that connect what all pairs of Jaccard similarity 0.8 or more connect."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = ids.ravel()
    holders = owner[np.argsort(ids, kind="stable")]
    counts = np.bincount(ids)
    firsts, begins = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
    links, left = [], np.ones(len(sets), bool)
    for first in range(len(sets)):
        todo, left[first] = [first] if left[first] else [], False
        while todo and left.any():
            a = todo.pop()
            own = ids[begins[a] : begins[a] + sizes[a]]
            n = counts[own]
            at = np.repeat(firsts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(holders[at], minlength=len(sets))
            found = np.flatnonzero(left & (9 * common >= 4 * (sizes + sizes[a])))  # common / (size + size - common) >= 4 / 5
            links += [(a, b) for b in found.tolist()]
            left[found] = False
            todo += found.tolist()
    return links


def _listed(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SMALL_LIST else rows


def _rows_of(docs: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """``docs`` (with their id ``__d`` and the hash ``__xx`` of their text) joined to a list of rows (__id, __th)."""
    if listed.count() > SMALL_LIST:
        return sifted_join(docs, listed, [("__d", "__id"), ("__xx", "__th")], how)
    return docs.join(F.broadcast(listed), F.col("__d").eqNullSafe(F.col("__id")) & (F.col("__xx") == F.col("__th")), how)


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, root) of the sets in ``nodes`` (set, fp, keys) that may be similar: components of equal keys and of fingerprints within NEAR."""
    keys = written(nodes.select("set", F.explode("keys").alias("key")), "part-keys")
    low = keys.groupBy("key").agg(F.min("set").alias("b"), F.max("set").alias("c")).where("b < c").select(F.col("key").alias("k"), "b")
    parts = keys.join(low, F.col("key") == F.col("k")).where("set != b").select(F.col("set").alias("a"), "b").distinct()
    whole = links_of(nodes.select("fp").distinct())
    several = nodes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    several = several.union(whole.select("a")).union(whole.select("b")).distinct()
    # fingerprints are nodes of their own, through which the sets that have them are linked
    named = nodes.join(several.withColumnRenamed("fp", "b"), F.col("fp") == F.col("b")).where("set != b").select(F.col("set").alias("a"), "b")
    return components(written(parts.union(whole).union(named), "candidates"))


def similar_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, text_hash, set, __best for every row of ``docs`` (doc_id, text): the component of its set of shingles and that one's first row.

    Sets link at Jaccard similarity 0.8 or more, which is computed on the sets themselves. Candidates come from SimHashes of the whole
    set (within NEAR bits) and of parts of it (equal); a pair at 0.8 shares none with a probability of about 2 in 10,000, one at 0.85 or
    more practically never. Texts without words have the empty set, which is similar to itself only.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").alias("__text"))

    def run(b):
        sets = shingle_sets(texts(b, "__text"), shingle)
        names = [xxhash.xxh64_intdigest(x.tobytes(), 7) - (1 << 63) for x in sets]
        fps = np.array([majority(x) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
        keys = [part_keys(x) for x in sets]
        keys = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)], dtype=np.int32), np.concatenate(keys))
        cells = [pa.array(names, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps), keys]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *cells], names=["doc_id", "text_hash", "set", "size", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = written(text_map(rows, run, f"doc_id {kind}, text_hash long, set long, size long, fp long, keys array<long>", "__text"), "shingle-sets")
    # copies meet here first: all that follows sees each set once
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("text_hash").alias("th")))
    nodes = written(prints.groupBy("set").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), least.alias("first")), "sets")
    found = nodes.where("size > 0").join(candidates(nodes.where("size > 0")), F.col("set") == F.col("node")).select("set", "root", "size", "first")
    found = written(found, "found")
    total = found.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
    found = found.join(total, F.col("root") == F.col("r")).withColumn("blocks", F.ceil(F.col("total") / BLOCK))
    found = found.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "set"), "blocks"))
    found = written(found.select(F.col("first.id").alias("__id"), F.col("first.th").alias("__th"), "set", "root", "blocks", "block"), "members")
    near = _rows_of(rows.withColumnsRenamed({"doc_id": "__d", "text_hash": "__xx"}), found, "inner")
    # blocks (i, j), i <= j; where there is more than one, i < j is enough
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.col("block"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.col("block"))))
    near = near.select("root", "set", "block", other.alias("other"), "__text").select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set", "__text")

    def compare(group):
        named = {n: t for n, t in zip(group.column("set").to_pylist(), group.column("__text").cast(pa.binary()).to_pylist())}
        names = list(named)
        out = similar_links(shingle_sets(list(named.values()), shingle)) if len(names) > 1 else []
        return pa.table({"a": pa.array([names[a] for a, _ in out], pa.int64()), "b": pa.array([names[b] for _, b in out], pa.int64())})

    links = written(near.groupBy("root", "i", "j").applyInArrow(compare, "a long, b long"), "similar")
    comp = components(links)
    named = nodes.select("set", "first").join(comp, F.col("set") == F.col("node")).select(F.col("set").alias("s"), "root", "first")
    best = named.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least"))
    named = named.join(best, F.col("root") == F.col("r")).select("s", "least")
    nodes = written(nodes.select("set", "first").join(named, F.col("set") == F.col("s"), "left").select(F.col("set").alias("s"), F.coalesce("least", "first").alias("__best")), "classes")
    return prints.select("doc_id", "text_hash", "set").join(nodes, F.col("set") == F.col("s")).drop("s")


def without_similar(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of each component of ``similar_sets``, all columns kept: the one with the smallest doc_id (rows without one last)."""
    found = similar_sets(docs, shingle)
    named = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).agg(F.count("*").alias("__n"), F.first("__best").alias("__best"))
    first = F.col("__id").eqNullSafe(F.col("__best.id")) & (F.col("__th") == F.col("__best.th"))
    named = written(named.select("__id", "__th", "__n", first.alias("__first")).where("not __first or __n > 1"), "surplus")
    rows = packed(docs, F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__xx"))
    kept = _rows_of(rows, named.where("not __first").select("__id", "__th"), "left_anti")
    repeated = named.where("__first").select("__id", "__th")
    if repeated.limit(1).count():  # repeated rows
        once = _rows_of(kept, repeated, "inner").dropDuplicates(["__id", "__th"]).select(*kept.columns)
        kept = _rows_of(kept, repeated, "left_anti").unionByName(once)
    return unpacked(kept)
