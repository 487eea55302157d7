"""Operator 9: exact top-k inner products, score at a time over an impact-ordered index.

Components become integers, floor(256 x).  Vectors are dealt into tiles of some
thousand rows, and the index of a tile is stored as a row of a table: its posting
segments, each the places of all vectors whose component in one dimension has one
quantised impact (the component over ``STEP``, towards minus infinity), in the order
of descending absolute impact over all dimensions; and after each of a few
checkpoints in that order, by vector, the length of what the segments up to there
leave of it.

A block of queries is scored in the order of the segments: every vector of a segment gains
query component x middle of the impact.  The segments up to a checkpoint are added at once, as
a product of the matrix of their postings with the queries.  What is still missing from a score is at
most the query's length times the length left of the vector (Cauchy-Schwarz), so at a
checkpoint each score has a lower and an upper bound.  The k-th largest lower bound,
or the k-th best score of the tiles that the task has done before if that is larger,
is a threshold that members must reach.  Processing stops once at most ``FEW`` vectors a
query can still reach it, and that is proven by the bounds alone.  Those are scored
exactly, ties to the smaller id.

Queries meet the index through an equi-join on groups of tiles: both sides are dealt
out by a hash, no side is broadcast, and tiles and blocks have a bounded number of
rows.  A tile is sent once for each block of queries, so blocks are as large as a task can hold
(``QUERY_VALUES`` components), and what is sent is packed: small integers as 16 bits.  Of each query and group k rows leave the task.

Vectors that are null, hold null, NaN or infinite components (256 x included), or have
another length than the query, take no part (with that query); nor does a null id.
Rows that repeat an id are queries and candidates of their own: only the query's own
row is left out, and each such query has its k rows under that id.  Scores are exact
for components of any size; one beyond 64 bits is given as the nearest long.  An empty
table gives no rows.  Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import staged

STEP, FEW = 4, 64
#: Rows of a tile, components of a block of queries, tiles that one task takes in a row, queries scored together.
TILE_ROWS, QUERY_VALUES, GROUP, TOGETHER = 2048, 1 << 19, 4, 256
#: Shares of the postings after which bounds are looked at.
CHECKPOINTS = (0.4, 0.6, 0.75, 0.9, 1.0)
#: Below this, sums of products of doubles that are integers are exact.
_EXACT = 2.0**52
_LONG = 2**63


@dataclass
class Segments:
    """The index of one tile: posting segments by descending absolute impact."""

    dims: np.ndarray  # of each segment
    middles: np.ndarray  # the middle of its impact
    starts: np.ndarray  # its first posting; one more at the end
    places: np.ndarray  # the vectors, segment by segment
    stops: np.ndarray  # segments done at each checkpoint
    left: np.ndarray  # checkpoint by vector: length of what is left

    @classmethod
    def of(cls, vectors: np.ndarray) -> Segments:
        rows, width = vectors.shape
        impacts = np.floor(vectors / STEP)
        middles = impacts * STEP + (STEP - 1) / 2
        size = np.abs(middles)
        place, dim = (x.ravel() for x in np.meshgrid(np.arange(rows), np.arange(width), indexing="ij"))
        order = np.lexsort((place, impacts.ravel(), dim, -size.ravel()))
        dim, impact, own = dim[order], impacts.ravel()[order], size.ravel()[order]
        first = np.flatnonzero(np.diff(dim, prepend=-1) | (np.diff(impact, prepend=np.nan) != 0))
        stops, left, n = [], [], rows * width
        for share in CHECKPOINTS:
            low = own[min(n - 1, int(share * n))] if share < 1 else -1.0
            done = size > low
            stops.append(int(np.searchsorted(first, done.sum())))
            with np.errstate(over="ignore"):  # such tiles are scored exactly throughout
                left.append(np.sqrt(np.square(np.where(done, vectors - middles, vectors)).sum(1)))
        return cls(dim[first].astype(np.int32), middles.ravel()[order][first], np.append(first, n).astype(np.int32), place[order].astype(np.int32), np.array(stops, np.int32), np.array(left))

    def parts(self, width: int) -> Iterator[np.ndarray]:
        """Vector by dimension: the middles of the postings between checkpoints; made when first asked for."""
        made, rows = self.__dict__.setdefault("_parts", []), self.left.shape[1]
        for k, stop in enumerate(self.stops.tolist()):
            if k == len(made):
                segments = slice(self.stops[k - 1] if k else 0, stop)
                lengths = np.diff(self.starts[segments.start : stop + 1])
                places = self.places[self.starts[segments.start] : self.starts[stop]]
                made.append(np.zeros((rows, width)))
                made[k][places, np.repeat(self.dims[segments], lengths)] = np.repeat(self.middles[segments], lengths)
            yield made[k]


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles; Python's integers where doubles can't hold them."""
    most = np.abs(query).max(initial=0) * np.abs(vectors).max(initial=0) * len(query)
    if most < _EXACT:
        return (vectors @ query).astype(np.int64)
    own = [int(x) for x in query]
    sums = (sum(a * int(b) for a, b in zip(own, row, strict=True)) for row in vectors.tolist())
    return np.array([min(max(s, -_LONG), _LONG - 1) for s in sums], np.int64)


def candidates(index: Segments, vectors: np.ndarray, queries: np.ndarray, is_own: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """vector by query: whether it can be among the k best, or reach ``least`` at all."""
    members = ~is_own
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if not most < _EXACT or len(vectors) <= k:
        return members
    # by query, as its scores then lie side by side
    scores, weights, lengths, own = np.zeros(is_own.T.shape), np.ascontiguousarray(queries), np.sqrt(np.square(queries).sum(1)), np.ascontiguousarray(is_own.T)
    for part, left in zip(index.parts(queries.shape[1]), index.left, strict=True):
        scores += weights @ part.T
        # rounding of sums is far below one unit
        room = lengths[:, None] * left * (1 + 1e-9) + 1
        lower = scores - room
        lower[own] = -np.inf
        threshold = np.maximum(np.partition(lower, len(vectors) - k, 1)[:, len(vectors) - k], least)
        members = (scores + room >= threshold[:, None]) & ~own
        if members.sum(1).max(initial=0) <= FEW:
            break
    return members.T


class Best:
    """The k best so far of each query of a block: score, then the smaller id."""

    def __init__(self, numbers: np.ndarray, k: int):
        self.k, self.found = k, {int(n): [] for n in numbers}

    def least(self, numbers: np.ndarray) -> np.ndarray:
        """Score that a further member must reach."""
        own = [self.found[int(n)] for n in numbers]
        return np.array([float(-x[-1][0]) if len(x) == self.k else -np.inf for x in own])

    def add(self, number: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            own = self.found[int(number)]
            # Python integers: the least long has no opposite
            self.found[int(number)] = sorted(own + [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)])[: self.k]


_BLOCK = "width int, rids binary, ids binary, vectors binary"
_TILE = f"tile int, {_BLOCK}, dims binary, middles binary, starts binary, places binary, stops binary, left binary"


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.sort_by("rid").combine_chunks()
    width = table["width"][0].as_py()
    flat = pa.concat_arrays([c.flatten() for c in table["v"].chunks]).to_numpy(zero_copy_only=False)
    return table["rid"].to_numpy(), table["vec_id"].to_numpy(), flat.reshape(-1, width)


def _packed(values: np.ndarray) -> np.ndarray:
    """Integers held as doubles or 32 bits, in 16 bits if all fit: ``_unpacked`` tells by the length."""
    return values.astype("<i2") if np.abs(values).max(initial=0) < 2**15 else values


def _unpacked(raw: bytes, n: int, wide: str) -> np.ndarray:
    return np.frombuffer(raw, "<i2").astype(wide) if len(raw) == 2 * n else np.frombuffer(raw, wide)


def _row(schema: list[str], values: list) -> pa.Table:
    return pa.table({name: pa.array([x.tobytes()], pa.binary()) if isinstance(x, np.ndarray) else pa.array([x], pa.int32()) for name, x in zip(schema, values, strict=True)})


def _tile(table: pa.Table) -> pa.Table:
    rids, ids, vectors = _rows(table)
    index = Segments.of(vectors)
    names = [x.split()[0] for x in _TILE.split(", ")]
    return _row(names, [table["tile"][0].as_py(), vectors.shape[1], rids, ids, _packed(vectors), index.dims, index.middles, index.starts, _packed(index.places), index.stops, index.left])


def _block(table: pa.Table) -> pa.Table:
    rids, ids, vectors = _rows(table)
    return _row(["block", "width", "rids", "ids", "vectors"], [table["block"][0].as_py(), vectors.shape[1], rids, ids, _packed(vectors)])


def _read(batch: pa.RecordBatch, row: int, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_py(), kind)


_FOUND = pa.schema([("rid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    """Rows (a block of queries and a tile) come sorted by width, block and group."""

    def give(best: Best, ids: dict[int, int]) -> pa.RecordBatch:
        rows = [(rid, ids[rid], vec_id, -less) for rid, own in best.found.items() for less, vec_id in own]
        return pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 4)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best, ids_of = None, None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                width, key = batch.column("width")[row].as_py(), tuple(batch.column(c)[row].as_py() for c in ("width", "block", "grp"))
                own, own_ids, queries = _read(batch, row, "q_rids", "<i8"), _read(batch, row, "q_ids", "<i8"), _unpacked(batch.column("q_vectors")[row].as_py(), batch.column("q_rids")[row].as_buffer().size // 8 * width, "<f8").reshape(-1, width)
                if key != last:
                    if best:
                        yield give(best, ids_of)
                    last, best, ids_of = key, Best(own, k), dict(zip(own.tolist(), own_ids.tolist(), strict=True))
                rids, ids, vectors = _read(batch, row, "rids", "<i8"), _read(batch, row, "ids", "<i8"), _unpacked(batch.column("vectors")[row].as_py(), batch.column("rids")[row].as_buffer().size // 8 * width, "<f8").reshape(-1, width)
                places = _unpacked(batch.column("places")[row].as_py(), vectors.size, "<i4")
                dims, middles, starts, stops = (_read(batch, row, c, t) for c, t in (("dims", "<i4"), ("middles", "<f8"), ("starts", "<i4"), ("stops", "<i4")))
                index = Segments(dims, middles, starts, places, stops, _read(batch, row, "left", "<f8").reshape(len(CHECKPOINTS), -1))
                for first in range(0, len(own), TOGETHER):
                    part, numbers = queries[first : first + TOGETHER], own[first : first + TOGETHER]
                    members = candidates(index, vectors, part, rids[:, None] == numbers[None, :], best.least(numbers), k)
                    for column, number in enumerate(numbers):
                        at = np.flatnonzero(members[:, column])
                        best.add(number, ids[at], exact(part[column], vectors[at]))
        if best:
            yield give(best, ids_of)

    return run


def _floor(x: Column) -> Column:
    """As a double: floor() would give longs and cut large ones."""
    whole = x - x % 1.0
    return F.when(whole > x, whole - 1.0).otherwise(whole)


def build_index(vectors: DataFrame, tiles: int) -> DataFrame:
    """The staged index: a row a tile (and length of its vectors)."""
    dealt = vectors.withColumn("tile", F.pmod(F.xxhash64("rid"), F.lit(tiles)).cast("int"))
    return staged(dealt.groupBy("tile", "width").applyInArrow(_tile, _TILE), "impact-index")


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, tile_rows: int = TILE_ROWS, query_rows: int | None = None, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``every``
    the k best of all others (all, if fewer)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(256 * x) != float("inf")))
    vectors = (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
        .where(F.coalesce(finite, F.lit(False)))
        .select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.size("embedding").alias("width"), F.transform("embedding", lambda x: _floor(256 * x)).alias("v"))
    )
    vectors = staged(vectors, "vectors")
    n = vectors.select(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"), F.max("width").alias("width")).first()
    query_rows = query_rows or max(1, QUERY_VALUES // (n["width"] or 1))
    tiles, blocks = max(1, -(-n["n"] // tile_rows)), max(1, -(-(n["q"] or 0) // query_rows))
    groups = -(-tiles // group)
    index = build_index(vectors, tiles).withColumn("grp", F.expr(f"tile div {group}").cast("int"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = vectors.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(blocks)).cast("int"))
    queries = queries.groupBy("block", "width").applyInArrow(_block, f"block int, {_BLOCK}").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = queries.select("width", "block", "grp", *(F.col(c).alias(f"q_{c}") for c in ("rids", "ids", "vectors")))
    found = index.join(queries, ["width", "block", "grp"]).sortWithinPartitions("width", "block", "grp", "tile").mapInArrow(_search(k), "rid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same over the embeddings table, for DuckDB.
TOP_K_SQL = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.r as r, q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.r <> c.r
  where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by r order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
