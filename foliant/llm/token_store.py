"""Operator 4: token ids in a content-addressed store.

File format, all Parquet in one folder of the shared store:

``packs/``  one row a document, in ascending order of the document id within and
    across packs: ``doc_id, rid, pack, seq, n_tokens, local_start, addrs`` (the
    recipe: 16-byte BLAKE2b addresses of its chunks), ``lens`` (ids per chunk),
    ``held`` (positions of the chunks whose ids are stored in this row),
    ``shared`` (those of them that other rows name too),
    ``data`` (those ids, little-endian, ``width`` bytes each), ``root`` (Merkle
    root of the recipe).
``manifest/``  a row for each node of the Merkle tree above the documents: blocks
    of 1024 documents, packs, and the top.

A rolling hash over 16 ids cuts each stream, so equal passages give equal chunks
wherever they stand.  The ids of a chunk are stored once, in the row of its owner (least
row number) at its first place there; every other occurrence is a 16-byte address.  Only addresses are shuffled to find owners, the ids themselves
move once, to their range of document ids.  Reading back checks the manifest against
the packs and every chunk held against its address, resolves every address and folds chunk CRCs into document
CRCs, so no ids move then.

Null text counts as empty: a stream of the end id alone.  Rows that repeat a
document id are each kept (ordered by an internal row number).  Null ids come first.
Columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b
from itertools import accumulate, pairwise
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import id_and_text, join_counted, new_path, parallelism, staged
from foliant.llm.tokens import encoder, forget, forget_everywhere, gathered

#: Chunks of 64 to 1024 ids, 256 or so on average.
LEAST, MASK, MOST = 64, np.uint64(0xFF), 1024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1024


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Places where a rolling hash of the 16 ids before them says that a chunk may end.

    For streams in a row: the first 16 ids of each see ids of the one before, but no chunk ends there.
    """
    with np.errstate(over="ignore"):
        value = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        value ^= value >> np.uint64(29)
        factor = _MULTIPLIER
        for step in (1, 2, 4, 8):  # after this a hash of the last 16 ids
            rolled = value.copy()
            rolled[step:] += value[:-step] * factor
            value, factor = rolled, factor * factor
    return np.flatnonzero((value >> np.uint64(48)) & MASK == 0) + 1


def chunk_ends(points: list[int], first: int, last: int) -> list[int]:
    """Ends of the content-defined chunks of one stream, counted from its ``first`` id; points: those within it."""
    ends, at, n = [], 0, last - first
    for point in points:
        point -= first
        while point - at > MOST:
            at += MOST
            ends.append(at)
        if point - at >= LEAST and point < n:
            ends.append(point)
            at = point
    while n - at > MOST:
        at += MOST
        ends.append(at)
    return [*ends, n]


def address(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def split_addresses(joined: bytes) -> list[bytes]:
    return [joined[k : k + 16] for k in range(0, len(joined), 16)]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over addresses; an odd node moves up as it is."""
    level = leaves or [address(b"")]
    while len(level) > 1:
        pairs = [address(b"\1" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


@cache
def _shift(n_bytes: int) -> tuple[int, ...]:
    """The linear map that appending n zero bytes is on a CRC-32, as its 32 columns."""
    zeros = bytes(n_bytes)
    none = zlib.crc32(zeros, 0)
    return tuple(zlib.crc32(zeros, 1 << bit) ^ none for bit in range(32))


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation, from (CRC-32, bytes) of its parts."""
    total = 0
    for crc, n_bytes in parts:
        moved, columns, bit = 0, _shift(n_bytes), 0
        while total:
            if total & 1:
                moved ^= columns[bit]
            total >>= 1
            bit += 1
        total = moved ^ crc
    return total


@dataclass(frozen=True)
class Layout:
    vocabulary: str
    keeps_space: bool
    end_id: int
    #: Bytes of an id in the files: 2 while the vocabulary allows.
    width: int = 2

    @property
    def dtype(self) -> str:
        return f"<u{self.width}"


_STAGED = "doc_id long, rid long, n_tokens long, addrs binary, lens binary, data binary"
_PACKED = "doc_id long, rid long, pack int, seq long, n_tokens long, local_start long, addrs binary, lens binary, held array<int>, shared array<int>, data binary, root binary"
_READ = "doc_id long, rid long, pack int, seq long, n_tokens long, local_start long, addrs binary, lens binary, shared array<int>, crcs array<long>, whole long, root binary"


def _types(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _encode(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, schema, width = encoder(layout.vocabulary, layout.keeps_space).encode_batch, _types(_STAGED), layout.width
        for batch in gathered(batches):
            ids, ends = encode(batch.column("text").to_pylist())
            ids = np.insert(ids, ends, layout.end_id).astype("<u4")
            bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
            raw = memoryview(ids.astype(layout.dtype).tobytes())
            addrs, lens, data = [], [], []
            points = cut_points(ids)
            within = np.searchsorted(points, bounds).tolist()
            points = points.tolist()
            for (a, b), (p, q) in zip(pairwise(bounds.tolist()), pairwise(within), strict=True):
                stops = chunk_ends(points[p:q], a, b)
                own, starts = raw[width * a : width * b], [0, *stops[:-1]]
                addrs.append(b"".join([address(own[width * x : width * y]) for x, y in zip(starts, stops, strict=True)]))
                lens.append(array("H", map(sub, stops, starts)).tobytes())
                data.append(own)
            yield pa.record_batch([batch.column("doc_id"), batch.column("rid"), *(pa.array(x, k) for x, k in zip((np.diff(bounds), addrs, lens, data), schema.types[2:], strict=True))], schema=schema)

    return run


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _pack(layout: Layout):
    """Rows come in order, a document's list of chunks owned elsewhere just before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, pack, seq, start, width = _types(_PACKED), TaskContext.get().partitionId(), 0, 0, layout.width
        elsewhere, named, owner = (), (), None
        forget()
        for batch in batches:
            place, seqs, starts, held, shared, kept, roots = [], [], [], [], [], [], []
            for k, (rid, n_tokens, addrs, lens, data, other, common) in enumerate(_columns(batch, "rid", "n_tokens", "addrs", "lens", "data", "elsewhere", "shared")):
                if addrs is None:
                    elsewhere, named, owner = other, common, rid
                    continue
                sizes, chunks = array("H", lens), split_addresses(addrs)
                own = list(range(len(chunks)))
                if len(set(chunks)) < len(chunks):  # first places only
                    own = sorted({c: n for n, c in reversed(list(enumerate(chunks)))}.values())
                if owner == rid:
                    skip = set(elsewhere)
                    own = [n for n in own if n not in skip]
                if len(own) < len(chunks):
                    ends = [0, *accumulate(sizes)]
                    data = b"".join([data[width * ends[n] : width * ends[n + 1]] for n in own])
                place.append(k)
                seqs.append(seq)
                starts.append(start)
                # a chunk that stands in this document again is named by it
                again = set(own) if len(set(chunks)) < len(chunks) else ()
                shared.append(sorted({*again, *(set(own).intersection(named) if owner == rid else ())}))
                held.append(own)
                kept.append(data)
                roots.append(merkle(chunks))
                seq, start = seq + 1, start + n_tokens
            rows = batch.take(pa.array(place, pa.int64()))
            made = {"pack": [pack] * len(place), "seq": seqs, "local_start": starts, "held": held, "shared": shared, "data": kept, "root": roots}
            yield pa.record_batch([pa.array(made[f.name], f.type) if f.name in made else rows.column(f.name) for f in schema], schema=schema)

    return run


#: In place of a chunk's CRC-32 that nothing asks for.
UNASKED = -1


def _check_held(layout: Layout):
    """Reads packs: every chunk held is checked against its address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, width, crc32 = _types(_READ), layout.width, zlib.crc32
        forget()
        for batch in batches:
            crcs, wholes = [], []
            for doc_id, addrs, lens, held, common, data, root in _columns(batch, "doc_id", "addrs", "lens", "held", "shared", "data", "root"):
                chunks, sizes = split_addresses(addrs), array("H", lens)
                if merkle(chunks) != root:
                    raise ValueError(f"document {doc_id}: its recipe does not match its root")
                # a document that holds all its chunks has its sum at once; of these only shared ones need their own
                complete, at = held == list(range(len(chunks))), 0
                own, wanted = [UNASKED if complete else None] * len(chunks), set(common if complete else held)
                wide, data = memoryview(np.frombuffer(data, layout.dtype).astype("<u4").tobytes()), memoryview(data)
                for k in held:
                    end = at + sizes[k]
                    if address(data[width * at : width * end]) != chunks[k]:
                        raise ValueError(f"document {doc_id}: chunk {k} does not match its address")
                    if k in wanted:
                        own[k] = crc32(wide[4 * at : 4 * end])
                    at = end
                crcs.append(own)
                wholes.append(crc32(wide[: 4 * at]) if complete else None)
            made = {"crcs": crcs, "whole": wholes}
            yield pa.record_batch([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema], schema=schema)

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for own, lens, rest, whole in _columns(batch, "crcs", "lens", "rest", "whole"):
            if whole is not None:
                crcs.append(whole)
                continue
            for x in rest or ():
                own[x["pos"]] = x["crc"]
            if None in own:
                raise ValueError("a recipe names a chunk that no row shares")
            crcs.append(crc32_joined([(c, 4 * n) for c, n in zip(own, array("H", lens), strict=True)]))
        yield pa.record_batch([*(batch.column(k) for k in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64()), batch.column("n_chunks"), batch.column("n_elsewhere")], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "n_elsewhere"])


def _recipe(addrs: str = "addrs") -> Column:
    """The array of addresses in their joined form."""
    return F.transform(F.sequence(F.lit(0), F.expr(f"cast(length({addrs}) / 16 as int) - 1")), lambda k: F.substring(F.col(addrs), k * 16 + 1, F.lit(16)))


def write_store(docs: DataFrame, layout: Layout, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode ``docs`` and write the store; returns its path."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    source = id_and_text(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    streams = staged(source.mapInArrow(_encode(layout), _STAGED), "token-streams")
    forget_everywhere(spark)
    refs = streams.select("doc_id", "rid", F.posexplode(_recipe()).alias("pos", "addr"))
    owners = refs.groupBy("addr").agg(F.min("rid").alias("owner"), F.max("rid").alias("last"), F.count("*").alias("n")).where("owner <> last")
    owners = staged(owners.drop("last"), "owners")
    known = join_counted(refs, owners, ["addr"])
    places = lambda condition: F.collect_list(F.when(F.expr(condition), F.col("pos")))  # noqa: E731  (at most the chunks of one document)
    others = known.groupBy("doc_id", "rid").agg(places("rid <> owner").alias("elsewhere"), places("rid = owner").alias("shared"))
    none = F.lit(None).cast("array<int>")
    rows = streams.withColumn("elsewhere", none).withColumn("shared", none).unionByName(others, allowMissingColumns=True)
    packs = (
        rows.repartitionByRange(parallelism(spark), "doc_id", "rid")
        .sortWithinPartitions("doc_id", "rid", F.col("addrs").isNotNull())
        .mapInArrow(_pack(layout), _PACKED)
    )
    packs.write.option("compression", "zstd").parquet(f"{path}/packs")
    write_manifest(spark, path)
    return path


def packs_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_PACKED).parquet(f"{path}/packs")


def _nodes(leaves: DataFrame) -> DataFrame:
    """Merkle nodes over document roots: blocks of documents, packs, the top."""
    def over(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct(order, "root"))), lambda x: F.hex(x["root"]))
        return df.groupBy(*keys).agg(F.sum("n_tokens").alias("n_tokens"), F.unhex(F.sha2(F.array_join(in_order, ""), 256)).alias("root"))

    blocks = over(leaves.withColumn("block", F.expr(f"seq div {BLOCK}")), ["pack", "block"], "seq")
    of_packs = over(blocks, ["pack"], "block")
    top = over(of_packs.withColumn("all", F.lit(0)), ["all"], "pack")
    level = lambda df, name: df.select(F.lit(name).alias("level"), *(F.col(k).cast("long") if k in df.columns else F.lit(None).cast("long").alias(k) for k in ("pack", "block")), "n_tokens", "root")
    return level(blocks, "block").unionByName(level(of_packs, "pack")).unionByName(level(top, "top"))


def write_manifest(spark: SparkSession, path: str) -> None:
    _nodes(packs_of(spark, path).select("pack", "seq", "n_tokens", "root")).write.parquet(f"{path}/manifest")


def manifest_breaks(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the manifest that the packs do not reproduce (none, if intact)."""
    return _breaks(spark, path, packs_of(spark, path))


def _breaks(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    stored = spark.read.parquet(f"{path}/manifest").withColumn("times", F.lit(1))
    again = _nodes(rows.select("pack", "seq", "n_tokens", "root")).withColumn("times", F.lit(-1))
    nodes = stored.unionByName(again).groupBy("level", "pack", "block", "n_tokens", "root").agg(F.sum("times").alias("times"))
    return nodes.where("times <> 0").drop("times")


def read_store(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """Per document, from the files: start, n_tokens and the CRC-32 of its ids as
    unsigned 32-bit integers, with the chunks of its recipe and how many of them
    another document holds.  Fails if a node of the manifest is not what the packs give."""
    read = staged(packs_of(spark, path).mapInArrow(_check_held(layout), _READ), "store-read")
    broken = _breaks(spark, path, read).select("level", "pack", "block").take(3)
    if broken:
        raise ValueError(f"the packs do not match the manifest: {[tuple(r) for r in broken]}")
    addr = F.substring(F.col("addrs"), F.col("pos") * 16 + 1, F.lit(16))
    known = read.select("addrs", "crcs", F.explode("shared").alias("pos")).select(addr.alias("addr"), F.get("crcs", "pos").alias("crc"))
    missing = F.filter(F.transform("crcs", lambda c, k: F.when(c.isNull(), k)), lambda k: k.isNotNull())
    named = read.select("rid", "addrs", F.explode(missing).alias("pos")).select("rid", "pos", addr.alias("addr"))
    rest = named.join(known, "addr").groupBy("rid").agg(F.collect_list(F.struct("pos", "crc")).alias("rest"))
    before = Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    # one row a pack: as many as the writing job had tasks
    offsets = read.groupBy("pack").agg(F.sum("n_tokens").alias("n")).select("pack", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (
        read.drop("addrs", "root")
        .join(offsets, "pack")
        .join(rest, "rid", "left")
        .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", F.when(F.col("whole").isNull(), F.col("crcs")).alias("crcs"), "lens", "rest", "whole", F.size("crcs").alias("n_chunks"), F.greatest(F.size("rest"), F.lit(0)).alias("n_elsewhere"))
        .mapInArrow(_fold, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int, n_elsewhere int")
    )


def read_ids(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """The documents' ids themselves (doc_id, rid, ids), put together from the chunks."""
    packs = packs_of(spark, path)

    def pieces(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                at = 0
                for k in row["held"]:
                    n = array("H", row["lens"])[k] * layout.width
                    rows.append({"addr": row["addrs"][16 * k : 16 * k + 16], "piece": row["data"][at : at + n]})
                    at += n
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("addr", pa.binary()), ("piece", pa.binary())]))

    chunks = packs.mapInArrow(pieces, "addr binary, piece binary")
    recipe = packs.select("doc_id", "rid", F.posexplode(_recipe()).alias("pos", "addr"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"])
    joined = recipe.join(chunks, "addr").groupBy("doc_id", "rid").agg(F.aggregate(in_order, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("raw"))

    def numbers(batches):
        for batch in batches:
            ids = [np.frombuffer(x, layout.dtype).astype("int64") for x in batch.column("raw").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("rid"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "rid", "ids"])

    return joined.mapInArrow(numbers, "doc_id long, rid long, ids array<long>")
