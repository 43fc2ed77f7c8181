"""Quality rules as a short-circuit cascade.

Every rule's cost and selectivity are measured on a sample; rules then run in the order of rejections per cost, and a document leaves at
the first rule that rejects it. The verdict is the same in any order, so measured times never change a result.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import has_letter, sliced, spread, texts

SYMBOLS = b"#*$%&|<>"
#: About so many documents, chosen by a hash of their ids, measure the rules.
SAMPLE = 2000
BULLETS = (b"-", b"*", b"\xe2\x80\xa2", b"\xe2\x80\xa3")
ELLIPSES = (b"...", b"\xe2\x80\xa6")


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, first ones included."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    counts, mark = Counter(grams), bytearray(len(words))
    for i, g in enumerate(grams):
        if counts[g] > 1:
            mark[i : i + 3] = b"\1\1\1"
    return sum(mark)


class Text:
    """A text and what the rules ask of it."""

    def __init__(self, raw: bytes):
        self.raw, self.words = raw, raw.split()
        self.n = len(self.words)
        self.lines = [x for x in raw.split(b"\n") if x.strip()]
        self.word_chars = len(b"".join(self.words).decode("utf-8", "replace"))
        self.symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        self.dup_lines = len(self.lines) - len(set(self.lines))
        self.repeated = repeated_words(self.words)

    @property
    def base_failed(self) -> bool:
        return self.n < 50 or 100 * self.repeated > 50 * self.n


def few_letters(t: Text) -> bool:
    kinds = Counter(t.words)
    return sum(n for w, n in kinds.items() if has_letter(w)) * 10 < 7 * t.n


#: name: whether the rule rejects a text of at least one word
RULES: dict[str, Callable[[Text], bool]] = {
    "word_length": lambda t: not 2 * t.n <= t.word_chars <= 15 * t.n,
    "symbols": lambda t: 10 * t.symbols > t.n,
    "repeated_lines": lambda t: 2 * t.dup_lines > len(t.lines),
    "few_letters": few_letters,
    "bullets": lambda t: sum(x.lstrip().startswith(BULLETS) for x in t.lines) * 10 > 9 * len(t.lines),
    "ellipses": lambda t: sum(x.rstrip().endswith(ELLIPSES) for x in t.lines) * 10 > 3 * len(t.lines),
    "one_word": lambda t: max(Counter(t.words).values()) * 10 > 4 * t.n,
}


def measured(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES, sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) of each rule on a sample, the most rejections per second first."""
    n = docs.count()
    picked = docs.select("doc_id", "text").where(spread(F.col("doc_id")) < min(1 << 20, (sample << 20) // max(n, 1) + 1))

    def run(batches):
        for b in sliced(batches, "text"):
            rows = []
            todo = [t for t in map(Text, texts(b)) if not t.base_failed]
            for name, rule in rules.items():
                t0 = time.perf_counter()
                gone = sum(map(rule, todo))
                rows.append((name, len(todo), gone, time.perf_counter() - t0))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["rule", "n", "gone", "s"])

    seen = picked.mapInArrow(run, "rule string, n long, gone long, s double").groupBy("rule").agg(F.sum("n"), F.sum("gone"), F.sum("s")).collect()  # a row a rule
    found = {r[0]: (r[3] / max(r[1], 1), r[2] / max(r[1], 1)) for r in seen}
    costs = [(name, *found.get(name, (0.0, 0.0))) for name in rules]
    return sorted(costs, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1], x[0]))


def judged(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES, order: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of ``docs``.

    A null or blank text has no words and fails the base. Whole texts are judged. Repeated rows get equal results; ids may be null.
    An empty table gives no rows. Further columns of ``docs`` are not read.
    """
    order = order or [name for name, _, _ in measured(docs, rules)]
    cascade = [rules[name] for name in order]

    def run(batches):
        for b in sliced(batches, "text"):
            seen = list(map(Text, texts(b)))
            failed = [t.base_failed for t in seen]
            kept = [not bad and not any(rule(t) for rule in cascade) for bad, t in zip(failed, seen)]
            ints = [pa.array([getattr(t, k) for t in seen], pa.int64()) for k in ("n", "word_chars", "symbols", "dup_lines", "repeated")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *ints, pa.array(failed), pa.array(kept)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
