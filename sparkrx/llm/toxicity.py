"""Toxicity by a convolutional text classifier in numpy.

Words are hashed to embeddings; filters of several widths run over them and each keeps its maximum over the whole text; the maxima
feed a logistic unit. Thresholds are calibrated for each language, which is told from the text itself, by words; a score is moved so
that its language's threshold lies at 0.5.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, spread, texts

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
#: The model is fit on at most about so many labelled documents of either label.
TRAIN_DOCS = 4000
_cache: dict[bytes, int] = {}


def bucket(word: bytes) -> int:
    """Bucket 1.. of a word, A-Z lower-cased, ASCII punctuation at its ends taken off. 0 is kept for padding."""
    k = _cache.get(word)
    if k is None:
        core = word.lower().strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        k = 1 + xxhash.xxh64_intdigest(core, 7) % (BUCKETS - 1)
        if len(_cache) < 1 << 18 and len(word) <= 64:  # bounded; a miss is only slower
            _cache[word] = k
    return k


def ids_of(raw: bytes) -> np.ndarray:
    words = raw.split()
    return np.fromiter(map(bucket, words), np.int32, len(words))


def distinct_texts(docs: list[np.ndarray]) -> list[int]:
    """Positions of documents, one of each group of copies, exact or near: those that agree in the smallest scrambled words."""
    seen, out = set(), []
    for i, d in enumerate(docs):
        low = np.sort(np.unique(d).astype(np.uint32) * np.uint32(2654435761))[:3]
        if (key := low.tobytes()) not in seen:
            seen.add(key)
            out.append(i)
    return out


class TextCNN:
    def __init__(self, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.e[0] = 0
        self.f = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.o = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = np.float32(-1)
        self.languages: list[str] = []
        self.lang = np.zeros((0, BUCKETS), np.float32)
        self.cut: dict[int, float] = {}
        self.fallback = 0.0

    def pooled(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maxima (documents, filters) over each text, where they were found, and the padded words."""
        pad = max(WIDTHS) - 1
        flat = np.concatenate([x for d in docs for x in (d, np.zeros(pad, np.int32))])
        sizes = np.array([len(d) + pad for d in docs])
        starts = np.cumsum(sizes) - sizes
        x = self.e[flat]
        best, where = [], []
        for w, f, b in zip(WIDTHS, self.f, self.b):
            n = len(flat) - w + 1
            y = x[:n] @ f[:DIM]
            for i in range(1, w):
                y += x[i : i + n] @ f[i * DIM : (i + 1) * DIM]
            y += b
            np.maximum(y, 0, out=y)
            y = np.concatenate([y, np.zeros((w - 1, FILTERS), np.float32)])
            for i in range(1, w):
                y[starts + sizes - i] = 0  # windows that would reach into the next text
            best.append(np.maximum.reduceat(y, starts, axis=0))
            if docs and self.training:
                where.append(np.stack([starts[k] + y[starts[k] : starts[k] + sizes[k]].argmax(axis=0) for k in range(len(docs))]))
        return np.concatenate(best, axis=1), np.concatenate(where, axis=1) if where else np.zeros((0, 0), int), flat

    training = False

    def logits(self, docs: list[np.ndarray], words: int = 1 << 16) -> np.ndarray:
        """Logits of whole texts, taken together up to about ``words`` words at a time; longer texts are read piece by piece."""
        out, part, n = [np.zeros((0, len(self.o)), np.float32)], [], 0
        for i, d in enumerate([*docs, None]):
            if part and (d is None or n + len(d) > words):
                out.append(self.pooled(part)[0])
                part, n = [], 0
            if d is not None and len(d) > words:
                out.append(self.long(d, words))
            elif d is not None:
                part.append(d)
                n += len(d)
        return np.concatenate(out) @ self.o + self.c

    def long(self, d: np.ndarray, words: int) -> np.ndarray:
        """Maxima over one text, ``words`` windows at a time."""
        d = np.concatenate([d, np.zeros(max(WIDTHS) - 1, np.int32)])
        best = np.zeros((1, len(self.o)), np.float32)
        for i in range(0, len(d), words):
            x = self.e[d[i : i + words + max(WIDTHS) - 1]]
            for k, (w, f, b) in enumerate(zip(WIDTHS, self.f, self.b)):
                n = min(words, len(x) - w + 1)
                if n > 0:
                    y = sum(x[j : j + n] @ f[j * DIM : (j + 1) * DIM] for j in range(w)) + b
                    cell = best[0, k * FILTERS : (k + 1) * FILTERS]
                    np.maximum(cell, y.max(axis=0), out=cell)
        return best

    def start(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """The first dimension of each word: its log-odds of being in a toxic document, shrunk where few documents have it."""
        seen = np.zeros((2, BUCKETS), np.float32)
        for d, t in zip(docs, y):
            seen[int(t), np.unique(d)] += 1
        n = np.maximum([(y == 0).sum(), (y == 1).sum()], 1)
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        self.e[:, 0] = np.clip(odds, -4, 4) * np.maximum(seen.sum(axis=0) - 1, 0) / (seen.sum(axis=0) + 8)
        self.e[0] = 0
        for f in self.f:
            f[::DIM, : FILTERS // 2] = np.abs(f[::DIM, : FILTERS // 2]) + 0.3
        self.o[:] = np.abs(self.o) * np.tile(np.repeat([1, -0.2], FILTERS // 2), len(WIDTHS)) * 0.5

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 15, batch: int = 64, rate: float = 0.05, seed: int = 42) -> TextCNN:
        """Words start from one half of the documents and the network learns on the other, so that it isn't led by words it has by heart."""
        rng = np.random.default_rng(seed)
        half = np.zeros(len(y), bool)
        for t in (0, 1):
            half[np.flatnonzero(y == t)[::2]] = True
        if min((y[half] == 1).sum(), (y[~half] == 1).sum()) >= 5:
            self.start([d for d, h in zip(docs, half) if h], y[half])
            docs, y = [d for d, h in zip(docs, half) if not h], y[~half]
        heavy = np.float32(min(5.0, max(1.0, (y == 0).sum() / max((y == 1).sum(), 1))))
        self.training = True
        seen = {id(a): np.full(a.shape, 1e-3, np.float32) for a in (self.e, *self.f, *self.b, self.o)}
        c_seen = 1e-3

        def move(a, g, at=slice(None)):  # Adagrad
            s = seen[id(a)]
            s[at] += g * g
            a[at] -= rate * g / np.sqrt(s[at])

        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                part = [docs[k] for k in at]
                m, where, flat = self.pooled(part)
                p = 1 / (1 + np.exp(-np.clip(m @ self.o + self.c, -30, 30)))
                d = ((p - y[at]) * np.where(y[at] == 1, heavy, 1) / len(at)).astype(np.float32)
                dm = d[:, None] * self.o * (m > 0)
                move(self.o, m.T @ d)
                c_seen += float(d.sum()) ** 2
                self.c = np.float32(self.c - rate * d.sum() / math.sqrt(c_seen))
                words, grads = [], []
                for k, w in enumerate(WIDTHS):
                    g, at_w = dm[:, k * FILTERS : (k + 1) * FILTERS], where[:, k * FILTERS : (k + 1) * FILTERS]
                    df = np.zeros_like(self.f[k])
                    for j in range(w):
                        ids = flat[np.minimum(at_w + j, len(flat) - 1)]
                        rows = slice(j * DIM, (j + 1) * DIM)
                        df[rows] = np.einsum("nfd,nf->df", self.e[ids], g)
                        words.append(ids.ravel())
                        grads.append((g[:, :, None] * self.f[k][rows].T[None]).reshape(-1, DIM))
                    move(self.f[k], df)
                    move(self.b[k], g.sum(axis=0))
                ids, inverse = np.unique(np.concatenate(words), return_inverse=True)
                total = np.zeros((len(ids), DIM), np.float32)
                np.add.at(total, inverse, np.concatenate(grads))
                total[ids == 0] = 0
                move(self.e, total, ids)
        self.training = False
        return self

    def learn_languages(self, docs: list[np.ndarray], langs: list[str | None]) -> None:
        """Log-probabilities of words in each language, by which a text's language is told."""
        self.languages = sorted({x for x in langs if x is not None})
        counts = np.full((len(self.languages), BUCKETS), 0.1, np.float32)
        for d, x in zip(docs, langs):
            if x is not None:
                ids, n = np.unique(d, return_counts=True)
                counts[self.languages.index(x), ids] += np.minimum(n, 5)
        self.lang = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
        self.lang -= self.lang.mean(axis=0)

    def language(self, docs: list[np.ndarray]) -> list[int]:
        if not self.languages:
            return [0] * len(docs)
        return [int(sum(self.lang[:, d[i : i + (1 << 16)]].sum(axis=1, dtype=np.float64) for i in range(0, len(d), 1 << 16)).argmax()) if len(d) else 0 for d in docs]

    def calibrate(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """For each language the logit that separates its labels with the fewest errors; languages with one label take the overall one."""

        def best(z, t):
            order = np.argsort(z)
            z, t = z[order], t[order]
            wrong = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
            ties = np.flatnonzero(wrong == wrong.min())
            k = int(ties[len(ties) // 2])
            return float((z[max(k - 1, 0)] + z[min(k, len(z) - 1)]) / 2)

        z, lang = self.logits(docs), np.array(self.language(docs))
        self.fallback = best(z, y) if 0 < y.sum() < len(y) else 0.0
        self.cut = {k: best(z[lang == k], y[lang == k]) for k in set(lang.tolist()) if 0 < y[lang == k].sum() < (lang == k).sum()}

    def scores(self, raws: list[bytes]) -> np.ndarray:
        docs = [ids_of(r) for r in raws]
        z = self.logits(docs).astype(np.float64)
        cut = np.array([self.cut.get(k, self.fallback) for k in self.language(docs)])
        return 1 / (1 + np.exp(-np.clip(z - cut, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS, seed: int = 42) -> TextCNN | None:
    """A classifier fit on ``docs`` (doc_id, text, lang) by ``labels`` (doc_id, toxic); lang only tells languages apart.

    The sample, about ``per_label`` labels of either kind and never more than four times that, is drawn from the labels alone by a hash of
    the id, so texts are not shuffled: the sample's ids are few enough to broadcast. Four in five of the sample fit the network, the rest its
    thresholds. None if nothing is labelled. Null ids join nothing; a document that repeats is taken as often as it comes.
    """
    labels = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    if not counts:
        return None
    share = F.lit(0)
    for label, n in sorted(counts.items()):
        share = F.when(F.col("toxic") == label, min(1 << 20, (per_label << 20) // n + 1)).otherwise(share)
    chosen = labels.withColumn("__r", spread(F.col("__id"))).where(F.col("__r") < share).orderBy("__r", "__id", "toxic").limit(4 * per_label)
    picked = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))

    def run(batches):
        for b in sliced(batches, "text"):
            ids = [ids_of(t).tobytes() for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("__r"), b.column("lang"), b.column("toxic").cast(pa.int32()), pa.array(ids, pa.binary())], names=["r", "lang", "toxic", "ids"])

    found = picked.mapInArrow(run, "r long, lang string, toxic int, ids binary").orderBy("r", "ids").limit(4 * per_label).collect()
    docs, y = [np.frombuffer(r[3], np.int32) for r in found], np.array([r[2] for r in found], np.float32)
    model = TextCNN(seed)
    if not len(docs):
        return None
    single = distinct_texts(docs)
    docs, y, found = [docs[i] for i in single], y[single], [found[i] for i in single]
    model.learn_languages(docs, [r[1] for r in found])
    aside = np.arange(len(docs)) % 5 == 4
    fit = [d for d, a in zip(docs, aside) if not a]
    model.fit(fit, y[~aside], seed=seed)
    model.calibrate([d for d, a in zip(docs, aside) if a] or fit, y[aside] if aside.any() else y)
    return model


def with_scores(docs: DataFrame, model: TextCNN | None) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs``; only ``text`` is read for them.

    A null or blank text is scored as the empty one. Whole texts are scored, however long. Without a model, as when nothing is labelled,
    every score is 0. Repeated rows get equal scores; ids may be null; an empty table gives no rows.
    """
    holder = docs.sparkSession.sparkContext.broadcast(model)  # some 12 MB and one more for each language; neither grows with the documents

    def run(batches):
        model = holder.value
        for b in sliced(batches, "text"):
            s = np.zeros(b.num_rows) if model is None else model.scores(texts(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
