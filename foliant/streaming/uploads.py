"""Chunked uploads as a stateful stream: chunks in offset order, all others refused; and their assembly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MS, MOST_BYTES = 3_600_000, 25 << 20
_OUT = "upload_id string, arrival long, name string, offset long, size long, received long, chunks int, accepted boolean, final boolean, sha256 string, reason string"
_STATE = "name string, received long, chunks int, ended boolean"


def _reason(r, name: str | None, received: int, ended: bool, most: int) -> str | None:
    if ended:
        return "no such upload: it has ended"
    if name is None and r.offset != 0:
        return "no such upload: the first chunk starts at 0"
    if name is not None and r.name != name:
        return f"the upload was begun for {name!r}"
    if r.offset != received:
        return f"the next chunk starts at {received}"
    if received + r.bytes > most:
        return "too large: what was received is thrown away"
    if r.final and not isinstance(r.sha256, str):
        return "the last chunk must carry the sha256 of the whole"
    return None


def accept_chunks(chunks: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Each chunk with what was received after it, and whether and why it is refused.

    chunks: upload_id, arrival, name, offset, size, final, sha256 (of the whole file, with the last chunk).
    A chunk whose offset is not the number of bytes received is refused, not reordered.  A last
    one ends the upload: whatever comes after it is refused, in the same batch too.  An upload
    that is idle for an hour is forgotten.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name, received, n, ended = state.get if state.exists else (None, 0, 0, False)
        rows = []
        for r in pd.concat(list(batches)).sort_values("arrival").itertuples():
            reason = _reason(r, name, received, ended, most)
            if reason is None:
                name, received, n, ended = r.name, received + int(r.bytes), n + 1, bool(r.final)
            elif reason.startswith("too large"):
                received, ended = 0, True
            rows.append((key[0], r.arrival, r.name, r.offset, int(r.bytes), received, n, reason is None, bool(r.final) and reason is None, r.sha256 if isinstance(r.sha256, str) else None, reason))
        state.update((name, received, n, ended))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    named = chunks.select("upload_id", "arrival", "name", "offset", chunks["size"].alias("bytes"), "final", "sha256")
    return named.groupBy("upload_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def assembled(accepted: DataFrame, data: DataFrame) -> DataFrame:
    """upload_id, name, content, chunks, sha256, reason of uploads that have their last chunk.

    accepted: rows of :func:`accept_chunks`.  data: upload_id, arrival, data.  An upload is at most as many bytes as are accepted.
    """
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("offset", "data"))), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["data"]))
    kept = accepted.where("accepted").join(data, ["upload_id", "arrival"]).groupBy("upload_id").agg(F.first("name").alias("name"), whole.alias("content"), F.max("chunks").alias("chunks"), F.max(F.when(F.col("final"), F.col("sha256"))).alias("asked"), F.bool_or("final").alias("ended"))
    sha = F.concat(F.lit("sha256:"), F.sha2("content", 256))
    bare = F.regexp_replace(F.lower(F.trim("asked")), "^sha256:", "")
    return kept.where("ended").select("upload_id", "name", "content", "chunks", sha.alias("sha256"), F.when(F.concat(F.lit("sha256:"), bare) != sha, "sha256 mismatch").alias("reason"))
