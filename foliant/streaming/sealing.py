"""Sealing of operation logs as a stream: each record's hash holds the one before."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "log string, seq long, payload string, prev_hash string, hash string"


def _step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, prev = state.get if state.exists else (0, None)
    rows = []
    for payload in pd.concat(list(batches)).sort_values("arrival", kind="stable")["payload"]:
        digest = "sha256:" + sha256(((prev or "") + payload).encode()).hexdigest()
        seq += 1
        rows.append((key[0], seq, payload, prev, digest))
        prev = digest
    state.update((seq, prev))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])


def seal_stream(ops: DataFrame) -> DataFrame:
    """ops: log, arrival, payload.  Records get the next ``seq`` of their log in order
    of arrival; the hashes equal those of ``chain.seal``.  Null payloads are left to
    the journal's reader, which refuses them, and go here."""
    named = ops.where("payload is not null").select("log", "arrival", "payload")
    return named.groupBy("log").applyInPandasWithState(_step, _OUT, "seq long, prev string", "append", GroupStateTimeout.NoTimeout)
