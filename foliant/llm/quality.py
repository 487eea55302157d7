"""Operator 5: quality by compression.

Two zstandard dictionaries are built from good and from bad labelled texts.  A
text is compressed in blocks of 4 KiB with each and with none; the difference of
the two sizes, over the size with none, tells which kind it is like.  A logistic
calibration, fitted on labelled texts that the dictionaries have not seen, turns
this and the plain compression rate into the probability that the label is 1.

Labels are read only from rows whose crc32(doc_id) mod 5 is not 0.  Null and empty
texts get the base rate of the sample.  Without rows of both labels the score is
that base rate (0.5 with none) for all.  Repeated ids give a row each.  Other
columns than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import id_and_text
from foliant.llm.learn import as_bytes, fold, labelled_sample, logistic, probability

BLOCK, DICTIONARY, LEVEL = 4096, 48 << 10, 3
#: Bounds of the labelled sample: rows of each label, bytes of a row.
PER_CLASS, MOST_BYTES = 2400, 16 << 10
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray | None
    base: float

    @cached_property
    def _compressors(self):
        import zstandard

        own = lambda d: {"dict_data": zstandard.ZstdCompressionDict(d)} if d else {}
        return [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **own(d)) for d in (self.good, self.bad, b"")]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def features(self, text: str | bytes) -> tuple[float, ...]:
        raw = as_bytes(text)
        good, bad, plain = (sum(len(c.compress(raw[k : k + BLOCK])) for k in range(0, len(raw), BLOCK)) for c in self._compressors)
        return (bad - good) / plain, plain / len(raw), np.log(len(raw)), (bad - good) / plain * min(np.log(len(raw)), 9.0)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.base)
        if self.weights is not None and (own := [k for k, t in enumerate(texts) if t]):
            out[own] = probability(np.array([self.features(texts[k]) for k in own]), self.weights)
        return out


def _dictionary(texts: list[str | bytes]) -> bytes:
    import zstandard

    samples = [raw[k : k + BLOCK] for raw in map(as_bytes, texts) for k in range(0, len(raw), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few: the texts themselves serve as content
        return b"".join(samples)[:DICTIONARY]


def fit(sample: list[tuple[str | bytes, int]]) -> Model:
    """From texts and labels; every other row builds the dictionaries, the rest calibrates."""
    sample = [(t, y) for t, y in sample if t]
    if not sample:
        return Model(b"", b"", None, 0.5)
    base = sum(y for _, y in sample) / len(sample)
    by = {y: [t for t, z in sample if z == y] for y in (0, 1)}
    if min(len(by[0]), len(by[1])) < 4:
        return Model(b"", b"", None, base)
    model = Model(_dictionary(by[1][::2]), _dictionary(by[0][::2]), None, base)
    held = [(t, 1) for t in by[1][1::2]] + [(t, 0) for t in by[0][1::2]]
    model.weights = logistic(np.array([model.features(t) for t, _ in held]), np.array([y for _, y in held], float))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Model:
    return fit(labelled_sample(docs, labels, "quality", per_class, most_bytes))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.scores(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = id_and_text(docs, id_col, text_col).mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose text scores at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(model.scores(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
