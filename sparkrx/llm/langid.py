"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes. Two gated recurrent units read each window, one from either side, and a
softmax labels every byte; a document's probabilities are the mean of those of all its bytes. Training is backpropagation through
time over a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import has_letter, held_out_col, sliced, spread, texts

WINDOW = 64
HIDDEN = 8
#: Gates are piecewise linear sigmoids of this slope.
SLOPE = 0.2
#: The model is fit on at most so many documents of each language and so many windows of each document.
TRAIN_DOCS, TRAIN_WINDOWS = 300, 6


class ByteTagger:
    """weights: w (2, 3H, 256) input gates of each byte with bias, u (2, 3H, H) recurrent, v (L, 2H) and c (L) output. Gates: z, r, n."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        self.w = rng.normal(0, 0.3, (2, 3 * hidden, 256)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (2, 3 * hidden, hidden)).astype(np.float32)
        self.v = rng.normal(0, 0.3, (len(labels), 2 * hidden)).astype(np.float32)
        self.c = np.zeros((len(labels), 1), np.float32)

    def states(self, x: np.ndarray, side: int, trace: list | None = None) -> np.ndarray:
        """x: (WINDOW, B) bytes. Hidden states (WINDOW, H, B) of one direction."""
        h, t_max = self.h, len(x)
        # gates are clip(a / 5 + 1/2, 0, 1); the line's slope and offset are put into the weights once
        slope = np.repeat(np.float32([SLOPE, SLOPE, 1]), h)[:, None]
        w, u = self.w[side] * slope + np.repeat(np.float32([0.5, 0.5, 0]), h)[:, None], self.u[side] * slope
        out = np.empty((t_max, h, x.shape[1]), np.float32)
        state = np.zeros((h, x.shape[1]), np.float32)
        a, g = np.empty((3 * h, x.shape[1]), np.float32), np.empty((3 * h, x.shape[1]), np.float32)
        for t in range(t_max - 1, -1, -1) if side else range(t_max):
            np.take(w, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=g)
            zr = a[: 2 * h]
            zr += g[: 2 * h]
            np.maximum(zr, 0, out=zr)
            np.minimum(zr, 1, out=zr)
            z, r, n, gn = a[:h], a[h : 2 * h], a[2 * h :], g[2 * h :]
            if trace is not None:
                trace.append((t, state.copy(), z.copy(), r.copy(), gn.copy()))
            gn *= r
            n += gn
            np.tanh(n, out=n)
            if trace is not None:
                trace[-1] += (n.copy(),)
            state -= n
            state *= z
            state += n
            out[t] = state
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(L, WINDOW, B) label probabilities of every byte."""
        y = np.concatenate([self.states(x, 0), self.states(x, 1)], axis=1)  # (T, 2H, B)
        s = np.matmul(self.v, y) + self.c  # (T, L, B)
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=1, keepdims=True)
        return s.transpose(1, 0, 2)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss of windows x with labels y, each byte labelled, and the gradients of w, u, v, c."""
        h, traces = self.h, ([], [])
        both = np.concatenate([self.states(x, 0, traces[0]), self.states(x, 1, traces[1])], axis=1)
        s = np.matmul(self.v, both) + self.c
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        n = x.size
        loss = -np.log(p[:, y, np.arange(len(y))] + 1e-9).mean()
        p[:, y, np.arange(len(y))] -= 1
        p /= n
        dv = np.einsum("tlb,thb->lh", p, both)
        dc = p.sum(axis=(0, 2))[:, None]
        dboth = np.einsum("lh,tlb->thb", self.v, p)
        dw, du = np.zeros_like(self.w), np.zeros_like(self.u)
        for side in (0, 1):
            back = np.zeros((h, x.shape[1]), np.float32)
            u = self.u[side]
            for t, before, z, r, gn, cand in reversed(traces[side]):
                d = dboth[t, side * h : side * h + h] + back
                da_z = d * (before - cand) * (SLOPE * ((z > 0) & (z < 1)))
                dn = d * (1 - z) * (1 - cand * cand)
                da_r = dn * gn * (SLOPE * ((r > 0) & (r < 1)))
                rec = np.concatenate([da_z, da_r, dn * r])
                back = d * z + u.T @ rec
                du[side] += rec @ before.T
                inp = np.concatenate([da_z, da_r, dn])
                onehot = np.zeros((256, x.shape[1]), np.float32)
                onehot[x[t], np.arange(x.shape[1])] = 1
                dw[side] += inp @ onehot.T
        return float(loss), [dw, du, dv, dc]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 42) -> ByteTagger:
        rng = np.random.default_rng(seed)
        weights = [self.w, self.u, self.v, self.c]
        m, q = [np.zeros_like(a) for a in weights], [np.zeros_like(a) for a in weights]
        for k in range(1, steps + 1):
            at = rng.choice(len(x), min(batch, len(x)), replace=False)
            _, grads = self.step(np.ascontiguousarray(x[at].T), y[at])
            slow = rate * min(1.0, 2 * (1 - k / (steps + 1)))
            for a, g, mm, qq in zip(weights, grads, m, q):
                np.clip(g, -1, 1, out=g)
                mm += 0.1 * (g - mm)
                qq += 0.01 * (g * g - qq)
                a -= slow * (mm / (1 - 0.9**k)) / (np.sqrt(qq / (1 - 0.99**k)) + 1e-6)
        return self

    def pooled(self, batch: list[bytes], width: int = 4096) -> np.ndarray:
        """(documents, L): the mean of the probabilities of all bytes of each text."""
        sizes = np.array([len(t) for t in batch])
        rows = -(-sizes // WINDOW)
        buffer = np.frombuffer(b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(batch, rows)), np.uint8).reshape(-1, WINDOW)
        owner = np.repeat(np.arange(len(batch)), rows)
        real = np.full(len(owner), WINDOW)
        last = np.cumsum(rows) - 1
        real[last[rows > 0]] = sizes[rows > 0] - (rows[rows > 0] - 1) * WINDOW
        total = np.zeros((len(batch), len(self.labels)))
        for i in range(0, len(buffer), width):
            x = np.ascontiguousarray(buffer[i : i + width].T)
            p = self.probabilities(x)
            n = real[i : i + width]
            if (n < WINDOW).any():
                p = p * (np.arange(WINDOW)[:, None] < n)
            np.add.at(total, owner[i : i + width], p.sum(axis=1).T)
        return total / np.maximum(sizes, 1)[:, None]


def windows_of(text: bytes, doc_seed: int, most: int = TRAIN_WINDOWS) -> list[bytes]:
    """Some of a text's windows, drawn from all over it."""
    n = -(-len(text) // WINDOW)
    rng = np.random.default_rng(doc_seed & 0x7FFFFFFF)
    at = range(n) if n <= most else sorted(rng.choice(n, most, replace=False).tolist())
    return [text[i * WINDOW : (i + 1) * WINDOW].ljust(WINDOW, b"\0") for i in at]


def train(labelled: DataFrame, docs_per_label: int = TRAIN_DOCS, seed: int = 42) -> ByteTagger | None:
    """A tagger fit on (doc_id, text, lang). The sample: up to about ``docs_per_label`` documents a language, chosen by a hash of the id."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1 << 20, (docs_per_label << 20) // n + 1)).otherwise(share)
    picked = labelled.withColumn("__r", spread(F.col("doc_id"))).where(F.col("__r") < share)

    def run(batches):
        for b in sliced(batches, "text"):
            rows = [(lang, x) for t, r, lang in zip(texts(b), b.column("__r").to_pylist(), b.column("lang").to_pylist()) for x in windows_of(t, r)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.binary())], names=["lang", "x"])

    found = picked.mapInArrow(run, "lang string, x binary").orderBy(F.xxhash64("lang", "x"), "lang", "x").limit(2 * docs_per_label * TRAIN_WINDOWS * len(counts)).collect()
    labels = sorted(counts)
    x = np.frombuffer(b"".join(r[1] for r in found), np.uint8).reshape(-1, WINDOW)
    y = np.array([labels.index(r[0]) for r in found])
    model = ByteTagger(labels, seed=seed)
    return model.fit(x, y, seed=seed) if len(x) else model


def judge(model: ByteTagger | None, batch: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``und`` and 0 where it has no letter or no language was learned."""
    if model is None:
        return ["und"] * len(batch), [0.0] * len(batch)
    p = model.pooled(batch)
    best = p.argmax(axis=1)
    known = [has_letter(t) for t in batch]
    return [model.labels[k] if ok else "und" for k, ok in zip(best, known)], [min(1.0, max(0.0, float(p[i, k]))) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, known))]


def with_language(docs: DataFrame, model: ByteTagger | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) added or replaced. Only ``text`` is read.

    Null, empty and letterless texts are ``und`` with score 0. Whole texts are read, however long. Repeated rows get equal results.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in sliced(batches, "text"):
            langs, scores = judge(model, texts(b))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out_col(F.col("doc_id")))


def keep_identified(docs: DataFrame, model: ByteTagger, least: float) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose language is told with a score of at least ``least``."""

    def run(batches):
        for b in sliced(batches, "text"):
            langs, scores = judge(model, texts(b))
            yield b.filter(pa.array([lang != "und" and s >= least for lang, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
