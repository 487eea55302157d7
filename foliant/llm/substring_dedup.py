"""Operator 10: removal of repeated passages by relative Lempel-Ziv parsing.

Words are runs of other characters than ASCII white space.  A window is 35
consecutive words; each word covered by a window whose words also start elsewhere
(in any document, the same included) goes.

Reference blocks.  The least hash among the 8-word phrases of a window is its
anchor; consecutive windows with one anchor form a block, so every document is cut
into blocks at places that its words alone decide, and equal passages are cut alike
but for their ends.  All blocks of all documents are indexed, by anchor phrase and
by the hash of the block's words, with the places (row, word) of the first and of the
last block of each kind: these are the references that a parse may copy from.

Parsing.  A document is parsed from left to right into factors.  A factor begins at the
leftmost window that no factor holds yet and can be copied from a reference other than
itself; of the references kept for that place the one is taken from which most words
can be copied without a gap, over as many blocks as agree.  What no factor covers is
literal.  At factor boundaries, where a block's words agree only in part with those of
other blocks around the same anchor, windows are compared one by one, so a factor
reaches exactly as far as the words agree; and a window that crosses a boundary and can
be copied from elsewhere begins a factor of its own, which overlaps the one before it.  A
factor has whole windows, so at least 35 words, and factors are the duplicate spans.

Blocks and windows count as equal if phrase and word-sequence hashes, 64 bits each
and independent, both agree.

Shuffled are the index (a row a block, about 14 windows) for counting, with partial
sums, and for finding the blocks whose anchor occurs twice; single windows at factor
boundaries; and texts twice, to find those windows and to rebuild what is kept.  Keys that
hold more than a thousandth of the rows are joined by broadcast (there are fewer than
a thousand), so no group of occurrences meets in one task.

Rows are numbered once, in a staged frame that all uses read, so an input whose
partitions are planned anew between jobs gives the same result.

Null text has no words.  Texts of fewer than 35 words lose nothing.  Very long texts are
parsed whole, a document at a time.  Repeated rows are occurrences of their own: their
passages repeat.  An empty table gives no rows.  ``dedup`` reads no other columns;
``clean`` returns them as they are, whatever their names (but ``__rid`` and ``__runs``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import id_and_text, join_counted, staged
from foliant.llm.near_dedup import WordHash, _mix

WINDOW, PHRASE = 35, 8
_PHRASE_FACTOR, _FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
_hash = WordHash()


def phrases(own: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = own[: len(own) - size + 1].copy()
        for k in range(1, size):
            out = out * _PHRASE_FACTOR + own[k : len(own) - size + 1 + k]
        return _mix(out)


def leftmost_least(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the least value of each window of ``size``, the first of equals."""
    best, span = np.arange(len(values)), 1
    while span < size:
        step = min(span, size - span)  # windows of span + step from two of span
        a, b = best[:-step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        span += step
    return best


class Sequences:
    """Hashes of any word sequences of one text, from sums of powers."""

    def __init__(self, own: np.ndarray):
        with np.errstate(over="ignore"):
            n = len(own)
            powers = np.concatenate([[np.uint64(1)], np.full(n, _FACTOR)])
            self._inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)
            self._sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(own) * np.cumprod(powers, dtype=np.uint64)[:n], dtype=np.uint64)])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


def blocks(words: list[bytes], window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, ...]:
    """Of each block: anchor phrase, hash of its words, first window, windows, anchor's place."""
    own = _hash(words)
    values = phrases(own, phrase)
    anchor = leftmost_least(values, window - phrase + 1)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    count = np.diff(first, append=len(anchor))
    whole = Sequences(own).hashes(first, first + count - 1 + window)
    return values[anchor[first]], whole, first, count, anchor[first]


_SIGNED = np.int64


def _index(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[], [], [], [], []]
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.encode().split()
                if len(words) >= window:
                    anchor, whole, first, count, _ = blocks(words, window, phrase)
                    for k, x in enumerate((anchor.view(_SIGNED), whole.view(_SIGNED), np.full(len(first), rid), first, count)):
                        columns[k].append(x)
            arrays = [np.concatenate(c) if c else np.array([], _SIGNED) for c in columns]
            yield pa.record_batch([pa.array(a.astype(t)) for a, t in zip(arrays, (_SIGNED, _SIGNED, _SIGNED, np.int32, np.int16), strict=True)], names=["anchor", "whole", "rid", "first", "windows"])

    return run


def _windows(window: int, phrase: int):
    """Single windows of the blocks in ``ends`` (their first windows), with whether the
    block occurs once as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[], [], [], [], []]
            for rid, text, ends in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "ends")), strict=True):
                words = text.encode().split()
                own = _hash(words)
                values, wanted = phrases(own, phrase), np.zeros(len(words) - window + 1, np.int8)
                anchor = leftmost_least(values, window - phrase + 1)
                for end in ends:
                    wanted[end["first"] : end["first"] + end["windows"]] = 2 if end["once"] else 1
                at = np.flatnonzero(wanted)
                own_hashes = Sequences(own).hashes(at, at + window)
                for k, x in enumerate((values[anchor[at]].view(_SIGNED), own_hashes.view(_SIGNED), np.full(len(at), rid), at, wanted[at] == 2)):
                    columns[k].append(x)
            arrays = [np.concatenate(c) if c else np.array([], _SIGNED) for c in columns]
            yield pa.record_batch([pa.array(a.astype(t)) for a, t in zip(arrays, (_SIGNED, _SIGNED, _SIGNED, np.int32, np.bool_), strict=True)], names=["anchor", "words", "rid", "at", "once"])

    return run


_COPY = ["rid", "first", "windows", "rid_1", "first_1", "rid_2", "first_2"]


def _ends_of(*place: str) -> list[Column]:
    """Number of rows, and the first and the last place, of a group."""
    return [F.count("*").alias("n"), F.min(F.struct(*place)).alias("one"), F.max(F.struct(*place)).alias("last")]


def copies(texts: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """rid, first, windows: runs of windows of ``texts`` (rid, text) that occur elsewhere
    too, each once, with the two references (rid, first) kept for them; one may be the run itself."""
    index = staged(texts.mapInArrow(_index(window, phrase), "anchor long, whole long, rid long, first int, windows short"), "blocks")
    anchors = staged(index.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")).where("n > 1"), "anchors")
    # blocks whose anchor occurs once are done with
    blocks_ = staged(join_counted(index, anchors, ["anchor"]).drop("n"), "repeated")
    kinds = staged(blocks_.groupBy("anchor", "whole", "mixed").agg(*_ends_of("rid", "first", "windows")), "kinds")
    known = kinds.where("n > 1").select("anchor", "whole", "n", *_references("first"))
    copied = join_counted(blocks_.drop("mixed"), known, ["anchor", "whole"]).select(*_COPY)
    # one block of every kind around a mixed anchor gives its windows
    ends = kinds.where("mixed").select("one.rid", F.struct("one.first", "one.windows", (F.col("n") == 1).alias("once")).alias("end")).groupBy("rid").agg(F.collect_list("end").alias("ends"))
    windows = staged(texts.join(ends, "rid").select("rid", "text", "ends").mapInArrow(_windows(window, phrase), "anchor long, words long, rid long, at int, once boolean"), "windows")
    repeated = staged(windows.groupBy("anchor", "words").agg(*_ends_of("rid", "at")).where("n > 1").select("anchor", "words", "n", *_references("at")), "repeated-windows")
    # a block that occurs twice as a whole is copied already
    single = join_counted(windows, repeated, ["anchor", "words"]).where("once").select("rid", F.col("at").alias("first"), F.lit(1).cast("short").alias("windows"), *_COPY[3:])
    return copied.unionByName(single)


def _references(place: str) -> list[Column]:
    return [F.col(f"{end}.{name}").alias(f"{to}_{k}") for k, end in ((1, "one"), (2, "last")) for name, to in (("rid", "rid"), (place, "first"))]


def parse(rid: int, runs: tuple[list[int], ...], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(first word, words, reference row, its first word) of the factors of one document.

    runs: its rows of :func:`copies`, a list a column but the first one, in order of place.
    """
    first, windows = runs[0], runs[1]
    sources = [[r for r in {a, b} if r != (rid, f)] for f, a, b in zip(first, zip(runs[2], runs[3], strict=True), zip(runs[4], runs[5], strict=True), strict=True)]
    out, k, n = [], 0, len(first)
    while k < n:
        longest = None
        for row, at in sorted(sources[k]):
            end, place, reach = k, first[k], at
            while end < n and first[end] == place and (row, reach) in sources[end]:
                place, reach, end = place + windows[end], reach + windows[end], end + 1
            if longest is None or end > longest[0]:
                longest = end, place, row, at
        end, place, row, at = longest
        out.append((first[k], place - first[k] + window - 1, row, at))
        k = end
    return out


def _parsed(batch: pa.RecordBatch, rids: str, runs: str, window: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """The factors of each row's document."""
    lists = batch.column(runs)
    fields = [f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten()]  # columns of all runs of the batch
    sizes = [n or 0 for n in pc.list_value_length(lists).to_pylist()]
    at = 0
    for rid, n in zip(batch.column(rids).to_pylist(), sizes, strict=True):
        if n:
            order = np.argsort(fields[0][at : at + n], kind="stable")
            yield parse(rid, tuple(f[at : at + n][order].tolist() for f in fields), window)
        else:
            yield []
        at += n


def _runs(texts: DataFrame, window: int, phrase: int, name: str) -> DataFrame:
    """rid and the runs of its text that can be copied; as many as it has blocks and windows at most."""
    return copies(texts, window, phrase).groupBy("rid").agg(F.collect_list(F.struct(*_COPY[1:])).alias(name))


def factors(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ref_rid, ref_start, rid: a row a factor, places in words."""
    texts = _numbered(docs, id_col, text_col)
    runs = _runs(texts.select("rid", "text"), window, phrase, "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, rid, *f) for i, rid, own in zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), _parsed(batch, "rid", "runs", window), strict=True) for f in own]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 6)], names=["doc_id", "rid", "start", "length", "ref_rid", "ref_start"])

    return texts.drop("text").join(runs, "rid").select("doc_id", "rid", "runs").mapInArrow(run, "doc_id long, rid long, start long, length long, ref_rid long, ref_start long")


def _cover(own: list[tuple[int, int, int, int]], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for first, length, _, _ in own:
        edge[first] += 1
        edge[first + length] -= 1
    return np.cumsum(edge[:n]) > 0


def _kept(words: list[bytes], own: list[tuple[int, int, int, int]]) -> list[bytes]:
    if not own:
        return words
    return [w for w, gone in zip(words, _cover(own, len(words)).tolist(), strict=True) if not gone]


def _rebuild(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), _parsed(batch, "rid", "runs", window), strict=True):
                words = text.encode().split()
                kept = _kept(words, own)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return staged(id_and_text(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "numbered")


def dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row a document."""
    texts = _numbered(docs, id_col, text_col)
    runs = _runs(texts.select("rid", "text"), window, phrase, "runs")
    return texts.join(runs, "rid", "left").select("rid", "doc_id", "text", "runs").mapInArrow(_rebuild(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, their texts without repeated passages: as they were where
    nothing went, else the words kept, joined by one space."""
    numbered = staged(docs.withColumn("__rid", F.monotonically_increasing_id()), "numbered")
    own = numbered.select(F.col("__rid").alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    runs = _runs(own, window, phrase, "__runs").withColumnRenamed("rid", "__rid")

    columns, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(text_col).to_pylist(), _parsed(batch, "__rid", "__runs", window), strict=True):
                texts.append(b" ".join(_kept(text.encode().split(), found)).decode() if found else text)
            yield batch.select(columns).set_column(at, pa.field(text_col, pa.string()), pa.array(texts, pa.string()))

    return numbered.join(runs, "__rid", "left").select(*columns, "__rid", "__runs").mapInArrow(run, docs.schema)
