"""Operator 3: near duplicates by DartMinHash.

Words are runs without white space, in lower case; a text's elements are its
shingles of five words with their counts as weights (a shorter text is one
shingle).  Similarity is weighted Jaccard; two texts are linked from 0.8 on.

Signatures.  An element's weight axis is cut into the regions [0,1), [1,2), [2,4),
[4,8)...; in each, darts arrive as a Poisson process over rank whose rate is the
region's width.  Number, rank, height and coordinate of a dart depend only on the
element, the region and the dart's number, so texts that share an element share
its darts.  A text throws the darts of its elements up to a rank at which about
k ln k + 2k are expected, drops those above the element's weight, and keeps the
earliest for each of k coordinates; should one stay empty, the rank bound doubles.
Two texts agree in a coordinate with the probability of their similarity.

Candidates.  240 coordinates make 40 bands of 6: a pair of similarity 0.8 misses
all with probability 5e-6, one of 0.85 with 1e-8.  Exact copies are one class from
the start; only one of them goes on.  In a bucket, the text that shares the most
leads: the bucket's others are compared with it, not with each other.  Texts linked
to the leader are in its class.  Two others, one of them apart from the leader, can
be linked in two ways only.  Either they share shingles beyond the leader's (more of
them than it has), as many as sizes and common parts leave lacking: such pairs come
from an index of leaders and shared shingles, in which a text takes part only with
as many shared entries as any link of it lacks.  Or one is smaller than the leader,
and sizes and common parts leave room for a link as they are: such pairs are few.  (A text apart from the
leader has less than 4/9 of both sizes in common with it; what it has in common with
a text at least as large as the leader must exceed that.)  Every comparison is exact,
so no pair that shares a bucket and could join two classes is left out.

Result: doc_id, class_id (least doc_id of its class), class_size, copy_of (least
doc_id with the same words).  Null text counts as empty; all empty texts are
copies of each other.  Rows that repeat an id give a row each, and a link of one is a
link of that id.  A null id is no one's class; it has that of a text it copies, if any.
class_size counts rows, null for a null class.  Texts are read whole; an empty table
gives no rows.  Other columns are not read, but ``keep_one`` returns them (a column
``__rid`` is not allowed).

Large groups.  Keys that may hold any share of the rows (a bucket, a class, the copies
of one text, a leader's followers) are joined by broadcast of fewer than a thousand keys,
or dealt over as many parts as they hold thousandths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import id_and_text, join_counted, join_salted, staged
from foliant.llm.components import components

WORDS, THRESHOLD = 5, 0.8
COORDINATES, BAND = 240, 6
_M = np.uint64(0x9E3779B97F4A7C15)
_LIMIT = 250_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit hashes of words, kept for words met before."""

    def __init__(self):
        self._memo: dict = {}

    def __call__(self, words: list) -> np.ndarray:
        import xxhash

        memo = self._memo
        found = list(map(memo.get, words))
        if None in found:
            if len(memo) > _LIMIT:
                memo.clear()
            for k, h in enumerate(found):
                if h is None:
                    word = words[k]
                    if (h := memo.get(word)) is None:
                        h = memo[word] = xxhash.xxh3_64_intdigest(word)
                    found[k] = h
        return np.array(found, np.uint64)


_hash = WordHash()


def shingles(text: str, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's shingles, sorted, and their counts."""
    words = text.lower().split()
    if not words:
        return np.array([], np.uint64), np.array([], np.int64)
    own, size = _hash(words), min(size, len(words))
    with np.errstate(over="ignore"):
        out = own[: len(own) - size + 1].copy()
        for k in range(1, size):
            out = _mix(out * _M + own[k : len(own) - size + 1 + k])
    return np.unique(out, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard."""
    total = int(a[1].sum() + b[1].sum())
    if total == 0:
        return 1.0
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][at_a], b[1][at_b]).sum())
    return common / (total - common)


def _unit(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def _darts(seed: np.ndarray, low: np.ndarray, width: np.ndarray, weight: np.ndarray, bound: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(owner, rank, hash) of the darts up to the bound and below the weight.

    The n-th dart of a region hangs on its seed and n; regions are thrown for in
    groups by how many darts they expect, those that need more go round again.
    """
    number, rank = np.zeros(len(seed), np.uint64), np.zeros(len(seed))
    while len(seed):
        expected = np.maximum((bound - rank) * width, 0)
        block = np.where(expected < 0.5, 0, np.ceil(np.log2(expected + 3 * np.sqrt(expected) + 1))).astype(np.int64)
        more = []
        for size in np.unique(block):
            for part in np.array_split(own := np.flatnonzero(block == size), max(1, (len(own) << int(size)) >> 20)):
                n = number[part][:, None] + np.arange(1 << int(size), dtype=np.uint64)
                h = _mix(seed[part][:, None] + n * _M)
                ranks = rank[part][:, None] + np.cumsum(-np.log(_unit(h)), 1) / width[part][:, None]
                dart = _mix(h ^ np.uint64(0xD6E8FEB86659FD93))
                height = low[part][:, None] + _unit(_mix(dart)) * width[part][:, None]
                row, at = np.nonzero((ranks <= bound[part][:, None]) & (height <= weight[part][:, None]))
                yield owner[part][row], ranks[row, at], dart[row, at]
                go = ranks[:, -1] <= bound[part]
                rank[part], number[part] = ranks[:, -1], number[part] + np.uint64(1 << int(size))
                more.append(part[go])
        left = np.concatenate(more)
        seed, low, width, weight, bound, owner, number, rank = (x[left] for x in (seed, low, width, weight, bound, owner, number, rank))


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """A row of k dart hashes for each weighted set; an empty set's row is zero."""
    out = np.zeros((len(texts), k), np.uint64)
    open_ = [i for i, (e, _) in enumerate(texts) if len(e)]
    darts = k * np.log(k) + 2 * k
    while open_:
        owner = np.repeat(np.array(open_), [len(texts[i][0]) for i in open_])
        element = np.concatenate([texts[i][0] for i in open_])
        weight = np.concatenate([texts[i][1] for i in open_])
        bound = darts / np.array([texts[i][1].sum() for i in open_], np.float64)
        bound = np.repeat(bound, [len(texts[i][0]) for i in open_])
        # regions: number 0 is [0,1), number n is [2^(n-1), 2^n)
        regions = np.where(weight > 1, np.ceil(np.log2(weight)).astype(np.int64), 0) + 1
        rows = np.repeat(np.arange(len(element)), regions)
        region = np.arange(len(rows)) - np.repeat(np.cumsum(regions) - regions, regions)
        low = np.where(region > 0, 2.0 ** (region - 1), 0.0)
        width = np.where(region > 0, low, 1.0)
        owner, weight, bound = owner[rows], weight[rows], bound[rows]
        with np.errstate(over="ignore"):
            found = list(_darts(_mix(element[rows] + region.astype(np.uint64) * _M), low, width, weight, bound, owner))
        owner, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        place = owner * k + (dart % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, place))
        first = order[np.flatnonzero(np.diff(place[order], prepend=-1))]
        out[place[first] // k, place[first] % k] = dart[first] | np.uint64(1)
        open_ = [i for i in open_ if not out[i].all()]
        out[open_] = 0
        darts *= 2
    return out


def bands(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit key for each band of each row; the band's number is part of it."""
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(signature.shape[1] // band, dtype=np.uint64), (len(signature), 1))
        for k in range(band):
            key = _mix(key * _M + signature[:, k::band][:, : key.shape[1]])
    return key.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("words_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        sets = [shingles(t) for t in texts]
        keys = [hashlib.md5(" ".join(t.lower().split()).encode()).digest() for t in texts]
        own = []
        for first in range(0, len(sets), 128):
            part = sets[first : first + 128]
            own += [row.tolist() if len(s[0]) else [] for row, s in zip(bands(signatures(part)), part, strict=True)]
        yield pa.record_batch([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(own, pa.list_(pa.int64()))], schema=_SIGNED)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, own = None, None
    for batch in batches:
        rows = []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            if x != last:  # rows come sorted by a
                last, own = x, shingles(x)
            other = shingles(y)
            n_a, n_b = int(own[1].sum()), int(other[1].sum())
            _, at_a, at_b = np.intersect1d(own[0], other[0], assume_unique=True, return_indices=True)
            common = int(np.minimum(own[1][at_a], other[1][at_b]).sum())
            more = other[1].copy()
            more[at_b] = np.maximum(other[1][at_b] - own[1][at_a], 0)
            # an element as often as b has it beyond a, each time under a name of its own
            times = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
            with np.errstate(over="ignore"):
                beyond = _mix(np.repeat(other[0], more) + times.astype(np.uint64) * _M)
            rows.append((a, b, common / max(1, n_a + n_b - common), n_a, n_b, common, beyond.view(np.int64)))
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _MET.types, strict=True)] if rows else [pa.array([], t) for t in _MET.types], schema=_MET)


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("common", pa.int64()), ("beyond", pa.list_(pa.int64()))])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, their exact similarity, sizes, common part, and what b has beyond a."""
    of = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"))
    pairs = staged(pairs, "pairs")
    # one text may lead a large share of all
    joined = join_salted(pairs.join(of("b"), "b"), of("a"), "a", "b", pairs).sortWithinPartitions("a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_compare, "a long, b long, sim double, n_a long, n_b long, common long, beyond array<long>")


#: A link needs a common part of this share of both sizes together.
_SHARE = THRESHOLD / (1 + THRESHOLD)
_STEP = 1.03  # between bins of sizes


def _led(buckets: DataFrame) -> DataFrame:
    """key, leader, doc_id of a bucket's others; the member that shares most leads.

    buckets: key, doc_id, n (members of the bucket).
    """
    fame = buckets.groupBy("doc_id").agg(F.sum("n").alias("fame"))
    top = buckets.join(fame, "doc_id").groupBy("key").agg(F.max(F.struct("fame", (-F.col("doc_id")).alias("less"))).alias("top"), F.count("*").alias("n"))
    leaders = staged(top.select("key", "n", (-F.col("top.less")).alias("leader")), "leaders")
    return join_counted(buckets.select("key", "doc_id"), leaders, ["key"]).where("doc_id <> leader").select("key", "leader", "doc_id")


def _smaller(rows: DataFrame) -> DataFrame:
    """Pairs under one leader that could be linked without sharing anything beyond it:
    one is apart from the leader and the other is smaller than the leader."""
    bin_of = lambda n: F.floor(F.log(n) / float(np.log(_STEP))).cast("int")
    most = F.least(F.col("n_a") - 1, F.floor(F.col("common") / _SHARE + 1e-6) - F.col("n_b"))
    left = rows.where("apart").withColumn("least", F.floor(THRESHOLD * F.col("n_b"))).withColumn("most", most).where("most >= least and least > 0")
    left = left.select("a", *(F.col(c).alias(f"{c}_x") for c in ("b", "sim", "n_b", "common", "root")), "least", "most", F.explode(F.sequence(bin_of("least"), bin_of("most"))).alias("bin"))
    right = rows.where("n_b < n_a").select("a", *(F.col(c).alias(f"{c}_y") for c in ("b", "sim", "n_b", "common", "root", "apart")), F.col("n_a").alias("n_lead"), bin_of("n_b").alias("bin"))
    pair = left.join(right, ["a", "bin"]).where(
        (F.col("root_x") != F.col("root_y"))
        & F.col("n_b_y").between(F.col("least"), F.col("most"))
        & (F.least("common_x", "common_y") >= _SHARE * (F.col("n_b_x") + F.col("n_b_y")) - 1e-6)
        & (F.abs(F.col("sim_x") - F.col("sim_y")) <= 1 - THRESHOLD + 1e-6)
        & (~F.col("apart_y") | ((F.col("n_b_x") < F.col("n_lead")) & (F.col("b_x") < F.col("b_y"))))
    )
    return pair.select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct()


def _beyond(rows: DataFrame) -> DataFrame:
    """Pairs under one leader that share as much beyond it as a link of them lacks."""
    lacks = F.ceil(_SHARE * (F.col("n_b") + F.least("n_a", F.floor(THRESHOLD * F.col("n_b")))) - F.col("common") - 1e-6)
    each = rows.select("a", "b", "sim", "n_b", "common", "root", "apart", F.greatest(F.lit(1), lacks).alias("need"), F.explode("beyond").alias("e")).withColumn("key", F.xxhash64("a", "e")).drop("e")
    keys = each.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("apart").alias("any"), F.min("root").alias("low"), F.max("root").alias("high")).where("any and low <> high")
    shared = staged(each.join(keys.select("key"), "key"), "beyond")
    # k: how much of what a text has beyond the leader any other has too
    shared = shared.join(shared.groupBy("a", "b").agg(F.count("*").alias("k")), ["a", "b"]).where("not apart or k >= need")
    x = shared.where("apart").select("key", *(F.col(c).alias(f"{c}_x") for c in ("a", "b", "sim", "n_b", "common", "root", "k")))
    y = shared.select("key", *(F.col(c).alias(f"{c}_y") for c in ("b", "sim", "n_b", "common", "root", "k")))
    lacking = _SHARE * (F.col("n_b_x") + F.col("n_b_y")) - F.least("common_x", "common_y") - 1e-6
    pair = x.join(y, "key").where((F.col("root_x") != F.col("root_y")) & (F.abs(F.col("sim_x") - F.col("sim_y")) <= 1 - THRESHOLD + 1e-6) & (F.least("k_x", "k_y") >= lacking))
    counted = pair.groupBy("a_x", "b_x", "b_y").agg(F.count("*").alias("k"), F.first(lacking).alias("lacking")).where("k >= lacking")
    return counted.select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct()


def links(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of linked texts: enough of them to join every class.

    reps: doc_id and its bands, one row for each different text.
    """
    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = staged(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    buckets = staged(join_counted(rows, shared, ["key"]), "buckets")
    # only texts that share a bucket are compared: the rest does not move again
    texts = staged(texts.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"), "candidates")
    led = _led(buckets).select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    met = staged(compared(led, texts), "met")
    linked = lambda met: met.where(F.col("sim") >= THRESHOLD).select("a", "b")
    rooted = _rooted(met, linked(met))
    others = _smaller(rooted).unionAll(_beyond(rooted)).distinct().join(met.select("a", "b"), ["a", "b"], "left_anti")
    return linked(met).unionAll(linked(compared(others, texts)))


def _rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the class of b so far, and whether b is apart from its leader a."""
    roots = components(found)
    with_b = rows.join(roots.select(F.col("id").alias("b"), "root"), "b", "left")
    with_a = with_b.join(roots.select(F.col("id").alias("a"), F.col("root").alias("root_a")), "a", "left")
    root, root_a = F.coalesce("root", "b"), F.coalesce("root_a", "a")
    return staged(with_a.withColumn("apart", root != root_a).withColumn("root", root).drop("root_a"), "rooted")


def _classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, class_id, class_size, copy_of: one row a document."""
    texts = id_and_text(docs, id_col, text_col)
    signed = staged(texts.mapInArrow(_sign, "doc_id long, words_key binary, bands array<long>"), "signed")
    reps = staged(signed.groupBy("words_key").agg(F.min("doc_id").alias("doc_id"), F.max("bands").alias("bands"), F.count("*").alias("n")), "different")
    roots = components(links(reps.select("doc_id", "bands"), texts))
    own = reps.select("words_key", "n", F.col("doc_id").alias("copy_of")).join(roots.select(F.col("id").alias("copy_of"), F.col("root").alias("class_id")), "copy_of", "left")
    own = staged(own.withColumn("class_id", F.coalesce("class_id", "copy_of")), "kinds")
    # both a class of near copies and one text's copies may be a large share of all
    sizes = staged(own.groupBy("class_id").agg(F.sum("n").alias("class_size"), F.count("*").alias("n")), "sizes")
    sized = join_counted(own.withColumnRenamed("n", "copies"), sizes, ["class_id"]).drop("n").withColumnRenamed("copies", "n")
    nameless = own.where("class_id is null").withColumn("class_size", F.lit(None).cast("long"))
    own = staged(sized.unionByName(nameless), "classed")
    found = join_counted(signed.select("doc_id", "words_key"), own, ["words_key"])
    return found.select("doc_id", "class_id", "class_size", "copy_of")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size, copy_of: one row a document."""
    return _classed(docs, id_col, text_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class: that of its least id, of these the first by place.

    Rows are numbered in a staged frame and classed by number, so repeated ids and null
    ids are rows of their own.  A null id stands only for a class that has no other.
    """
    numbered = staged(docs.withColumn("__rid", F.monotonically_increasing_id()), "numbered")
    found = _classed(numbered, "__rid", text_col).select(F.col("doc_id").alias("__rid"), "class_id")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("__rid"))
    kept = found.join(numbered.select("__rid", id_col), "__rid").groupBy("class_id").agg(F.min(order).alias("least"))
    return numbered.join(kept.select("least.__rid"), "__rid", "left_semi").select(*docs.columns)
