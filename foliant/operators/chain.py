"""Hash-chained operation logs: sealing and checking.

Sealing folds over a log in order, since each hash holds the one before.  Checking
does not: the recorded hash is the predecessor, so one window suffices.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import _c


def json_string(x) -> Column:
    """Canonical JSON of text; null as null.  Control characters are written as JSON wants them."""
    out = _c(x)
    named = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    for plain, escaped in named.items():
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    rest = out
    for code in range(32):
        if chr(code) not in named:
            rest = F.replace(rest, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    out = F.when(out.rlike(r"[\x00-\x1f]"), rest).otherwise(out)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def json_object(**fields: Column) -> Column:
    """A JSON object with its keys in order, nulls included."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def chain_hash(prev, payload) -> Column:
    """Digest of a record's canonical JSON after its predecessor's hash (none: empty)."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.coalesce(_c(prev), F.lit("")), _c(payload)), 256))


def seal(ops: DataFrame, key: str, genesis: str | None = None) -> DataFrame:
    """key, seq, payload, prev_hash, hash: each log sealed in the order of its ``seq``.

    A log goes through one task, as each hash holds the one before, but as a stream of
    sorted rows: time is in proportion to its length and only its last hash is held.
    genesis: a column with the first record's predecessor.
    """
    start = F.lit(None).cast("string") if genesis is None else F.col(genesis)
    source = ops.select(F.col(key).alias("key"), F.col("seq").cast("long").alias("seq"), F.col("payload").cast("string").alias("payload"), start.cast("string").alias("genesis"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, prev = object(), None
        for batch in batches:
            before, own = [], []
            for k, payload, first in zip(*(batch.column(c).to_pylist() for c in ("key", "payload", "genesis")), strict=True):
                if k != last:
                    last, prev = k, first
                before.append(prev)
                prev = "sha256:" + sha256(((prev or "") + (payload or "")).encode("utf-8", "surrogatepass")).hexdigest()
                own.append(prev)
            yield pa.record_batch([batch.column("key"), batch.column("seq"), batch.column("payload"), pa.array(before, pa.string()), pa.array(own, pa.string())], names=["key", "seq", "payload", "prev_hash", "hash"])

    in_order = source.repartition("key").sortWithinPartitions("key", "seq")
    return in_order.mapInArrow(run, f"key {kind}, seq long, payload string, prev_hash string, hash string").withColumnRenamed("key", key)


def first_break(sealed: DataFrame, key: str, genesis=None) -> DataFrame:
    """key, break_seq: the least seq whose link or hash fails, null for whole chains."""
    w = Window.partitionBy(key).orderBy("seq")
    start = F.lit(None).cast("string") if genesis is None else _c(genesis)
    expected = F.when(F.row_number().over(w) == 1, start).otherwise(F.lag("hash").over(w))
    checked = sealed.withColumn("expected", expected)
    broken = ~F.col("prev_hash").eqNullSafe(F.col("expected")) | ~F.col("hash").eqNullSafe(chain_hash("prev_hash", "payload"))
    return checked.groupBy(key).agg(F.min(F.when(broken, F.col("seq"))).alias("break_seq"))


def contiguity(ops: DataFrame, key: str, position: str) -> DataFrame:
    """key, contiguous: whether ``seq`` counts from 1 without a gap in the order of ``position``."""
    w = Window.partitionBy(key).orderBy(position)
    return ops.withColumn("n", F.row_number().over(w)).groupBy(key).agg(F.bool_and(F.col("n") == F.col("seq")).alias("contiguous"))
