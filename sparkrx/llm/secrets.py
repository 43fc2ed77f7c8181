"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. A ledger says which rules, by version, have read which blob and
what they found; only pairs that it lacks are scanned, once each, and findings are joined back to every row that holds the blob.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, spread_join, texts, written

# fixed values: the kinds in the order in which they are listed, patterns with the versions by which the ledger knows them
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MORE = {
    "github": (b"gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}", re.A)),
    "slack": (b"xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}", re.A)),
    "google": (b"AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}", re.A)),
    "stripe": (b"k_live_", re.compile(r"\b[rs]k_live_[A-Za-z0-9]{16,}", re.A)),
    "jwt": (b"eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.A)),
    "pem": (b"PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    "urlauth": (b"://", re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:([^\s/:@]{4,128})@", re.A)),
}
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", *MORE)
BASE = KINDS[:3]
VERSIONS = {kind: f"{kind}@1" for kind in KINDS}
_HEX_DIGIT = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))


def findings(raw: bytes, kinds: set[str] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret, in code points, end exclusive, in order. A long blob is read whole."""
    want = set(KINDS) if kinds is None else kinds
    todo = []
    if "assign" in want and any(w in low for low in [raw.lower()] for w in WORDS):
        todo.append(0)
    if "access" in want and b"AKIA" in raw:
        todo.append(1)
    if "hex" in want and b"\1" * 24 in raw.translate(_HEX_DIGIT):
        todo.append(2)
    todo += [k for k, kind in enumerate(KINDS) if kind in MORE and kind in want and MORE[kind][0] in raw]
    if not todo:
        return []
    text, out = raw.decode("utf-8", "replace"), []
    for k in todo:
        if k == 0:
            out += [(m.start(), k, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        elif k == 1:
            out += [(m.start(), k, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        else:
            out += [(m.start(), k, m.end()) for m in (HEX if k == 2 else MORE[KINDS[k]][1]).finditer(text)]
    return sorted(out)


LEDGER = "blob string, done array<string>, found array<struct<start:int,kind:int,end:int>>"


class Ledger:
    """A ledger in a folder that all executors share: each scan adds files, none is written again.

    A row says that the rules ``done`` (by version) have read ``blob`` and what they found. Files of a scan that failed half-way are not
    seen, as Spark commits a write as a whole; a scan that is run twice adds pairs twice, which readers merge.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def add(self, fresh: DataFrame) -> None:
        fresh.write.mode("append").parquet(self.path)

    def scan(self, docs: DataFrame, versions: dict[str, str] = VERSIONS) -> DataFrame:
        """``paths_with_findings`` of ``docs`` after the pairs that the ledger lacks were scanned and added to it."""
        paths = paths_of(docs)
        self.add(unseen(docs, paths, self.rows(), versions))
        return paths_with_findings(paths, self.rows(), versions)


def blob_of(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def paths_of(docs: DataFrame) -> DataFrame:
    """(doc_id, blob) of every row: the paths by which blobs are known."""
    return written(docs.select("doc_id", blob_of(F.col("text")).alias("blob")), "paths")


def unseen(docs: DataFrame, paths: DataFrame, ledger: DataFrame, versions: dict[str, str] = VERSIONS) -> DataFrame:
    """Ledger rows of the (blob, rule version) pairs of ``docs`` that ``ledger`` lacks; each blob is scanned once."""
    wanted = F.array(*[F.lit(versions[k]) for k in KINDS if k in versions])
    # the row with the smallest id holds the blob; a count says whether that row is repeated
    held = paths.groupBy("blob", "doc_id").agg(F.count("*").alias("n")).groupBy("blob").agg(F.min(F.struct("doc_id", "n")).alias("low"))
    done = ledger.groupBy(F.col("blob").alias("__b")).agg(F.array_distinct(F.flatten(F.collect_list("done"))).alias("__done"))
    todo = held.join(done, F.col("blob") == F.col("__b"), "left").select(
        F.col("blob").alias("__blob"), F.col("low.doc_id").alias("__first"), F.col("low.n").alias("__n"), F.array_except(wanted, F.coalesce("__done", F.array().cast("array<string>"))).alias("__lacks")
    )
    todo = written(todo.where(F.size("__lacks") > 0), "unseen")
    rows = docs.select("doc_id", "text", blob_of(F.col("text")).alias("blob"))
    # the small side is hashed, texts are not sorted
    rows = rows.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("__blob")) & F.col("doc_id").eqNullSafe(F.col("__first")))
    if todo.where("__n > 1").limit(1).count():  # rows that repeat both id and text
        rows = rows.where("__n = 1").unionByName(rows.where("__n > 1").dropDuplicates(["blob"]))
    by_version = {v: k for k, v in versions.items()}

    def run(batches):
        for b in sliced(batches, "text"):
            lacks = b.column("__lacks").to_pylist()
            found = [findings(t, {by_version[v] for v in want}) for t, want in zip(texts(b), lacks)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            cells = pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(lacks, pa.list_(pa.string())), cells], names=["blob", "done", "found"])

    return rows.select("blob", "text", "__lacks").mapInArrow(run, LEDGER)


def paths_with_findings(paths: DataFrame, ledger: DataFrame, versions: dict[str, str] = VERSIONS) -> DataFrame:
    """(doc_id, blob, found): every path with all that the rules, at these versions, have found in its blob."""
    known = ledger.where(F.size("found") > 0).select("blob", F.explode("found").alias("f"), "done")
    label = F.get(F.array(*[F.lit(versions.get(k, "")) for k in KINDS]), F.col("f.kind"))
    known = known.where(F.array_contains("done", label))
    known = written(known.groupBy(F.col("blob").alias("__b")).agg(F.array_sort(F.collect_set("f")).alias("__f")), "findings")
    out = spread_join(paths, known, [("blob", "__b")], F.col("doc_id"), cells=F.size("__f") * 2)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return out.select("doc_id", "blob", F.coalesce("__f", empty).alias("found"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, versions: dict[str, str] = VERSIONS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, found) for every row of ``docs`` (doc_id, text), and the new rows of the ledger.

    A null text is the empty blob. Rows with equal texts share a blob, which is scanned once; repeated rows come back as often as they
    came. The ledger may hold several rows of a blob, of different rules or versions; findings of versions not asked for are left out.
    Null ids are kept. An empty table gives no rows and adds nothing to the ledger. Further columns are not read.
    """
    spark = docs.sparkSession
    old = ledger.select("blob", "done", "found") if ledger is not None else spark.createDataFrame([], LEDGER)
    paths = paths_of(docs)
    fresh = written(unseen(docs, paths, old, versions), "ledger")
    return paths_with_findings(paths, old.unionByName(fresh), versions), fresh


def as_text(found):
    """``kind:start:end`` of findings, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redacted(docs: DataFrame, ledger: DataFrame | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark``; overlapping findings are replaced together. All columns are kept."""

    def run(batches):
        for b in sliced(batches, "text"):
            out = []
            for raw, cell in zip(b.column("text").to_pylist(), texts(b)):
                spans, text, parts, at = findings(cell), raw, [], 0
                for s, _, e in spans:
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]) if spans else raw)
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)
