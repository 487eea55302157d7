"""Editing sessions as rows: leases, drift, resuming, closing; and their journals.

A session keeps what its document was when it was opened, and the operations since.  What
is on disk is compared with that on every use, and a session that no longer accounts for its
document is refused, never repaired.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.functions.text import LEAST_TTL, MOST_TTL, SESSION_ID, TTL, _c, bounded
from foliant.kernels import records

META = records.record(
    session_id=records.text, document=records.text, name=records.text, kind=records.one_of("docx", "pptx", "xlsx"), canon=records.text, baseline_digest=records.text,
    baseline_parts=records.map_of(records.text), document_size=records.whole, document_mtime_ns=records.whole, created=records.text, expires=records.text, tool=records.text,
    provenance=(records.null_or(records.provenance), None),
)
_META = pa.schema([("path", pa.string()), ("session_id", pa.string()), ("document", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("canon", pa.string()), ("baseline_digest", pa.string()), ("baseline_parts", pa.map_(pa.string(), pa.string())), ("document_size", pa.int64()), ("document_mtime_ns", pa.int64()), ("created", pa.string()), ("expires", pa.string()), ("tool", pa.string()), ("genesis", pa.string()), ("meta_state", pa.string())])
_META_DDL = "path string, session_id string, document string, name string, kind string, canon string, baseline_digest string, baseline_parts map<string,string>, document_size long, document_mtime_ns long, created string, expires string, tool string, genesis string, meta_state string"


def read_meta(files: DataFrame) -> DataFrame:
    """Sessions from their meta files (path, value; null value: none), with meta_state: ok, absent or unreadable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                try:
                    own = META(json.loads(value), "session") if value is not None else None
                except (records.RecordError, json.JSONDecodeError, RecursionError):
                    rows.append({"path": path, "meta_state": "unreadable"})
                    continue
                if own is None:
                    rows.append({"path": path, "meta_state": "absent"})
                else:
                    block = own.pop("provenance")
                    rows.append(own | {"path": path, "baseline_parts": list(own["baseline_parts"].items()), "genesis": block and block["hash"], "meta_state": "ok"})
            yield pa.RecordBatch.from_pylist(rows, _META)

    return files.select("path", "value").mapInArrow(run, _META_DDL)


def utc_text(moment) -> Column:
    """A time as it is recorded: UTC, whole seconds, with a Z."""
    return F.date_format(F.to_utc_timestamp(_c(moment), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_now() -> Column:
    return utc_text(F.current_timestamp())


def moment(recorded) -> Column:
    return F.try_to_timestamp(_c(recorded), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def is_over(until, now) -> Column:
    """A lease ends at its time, that moment included; both are times, to the microsecond."""
    return _c(until) <= _c(now)


def is_expired(expires, now) -> Column:
    """The same of a lease as it is recorded."""
    return is_over(moment(expires), now)


def renewed(sessions: DataFrame, now, ttl=None) -> DataFrame:
    """Leases from now on, nothing else changed; a time to live out of bounds leaves the lease as it is."""
    seconds = bounded(F.lit(ttl).cast("int"), LEAST_TTL, MOST_TTL, TTL)
    until = utc_text(F.timestamp_seconds(F.unix_seconds(_c(now)) + seconds))
    return sessions.withColumn("expires", F.coalesce(until, F.col("expires")))


def drift(sessions: DataFrame, manifest: DataFrame) -> DataFrame:
    """session_id, drifted (how many parts of the working copy are not what was recorded) and the first five of their names."""
    want = sessions.select("session_id", F.explode("baseline_parts").alias("part", "want"))
    got = manifest.select("session_id", "part", F.col("part_digest").alias("got"))
    other = want.join(got, ["session_id", "part"], "full_outer").where(~F.col("want").eqNullSafe(F.col("got")))
    found = other.groupBy("session_id").agg(F.count("*").alias("drifted"), F.slice(F.array_sort(F.collect_list("part")), 1, 5).alias("first_parts"))  # of one package
    return sessions.select("session_id").join(found, "session_id", "left").select("session_id", F.coalesce("drifted", F.lit(0)).alias("drifted"), F.coalesce("first_parts", F.array().cast("array<string>")).alias("first_parts"))


def loaded(sessions: DataFrame, drifts: DataFrame, now, raw: bool = False) -> DataFrame:
    """Sessions with the reason why one can't be used: no meta data, another id than its folder's, expired, or (not ``raw``) drifted."""
    folder = F.regexp_extract("path", r"([^/]*)/?\z", 1)
    joined = sessions.join(drifts, "session_id", "left")
    reason = (
        F.when(~folder.rlike(SESSION_ID), "no session id").when(F.col("meta_state") != "ok", F.concat(F.lit("its meta data are "), F.col("meta_state"))).when(F.col("session_id") != folder, "its meta data are another session's")
        .when(is_expired("expires", now), "expired").when(F.lit(not raw) & (F.col("drifted") > 0), F.concat(F.col("drifted").cast("string"), F.lit(" part(s) of its copy changed: "), F.array_join("first_parts", ", ")))
    )
    return joined.withColumn("reason", reason)


def may_have_changed(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """session_id and whether its document's size or time is not what it was (or it is gone); files: document, length, mtime_ns."""
    now = files.select("document", "length", "mtime_ns")
    changed = F.col("length").isNull() | (F.col("length") != F.col("document_size")) | (F.col("mtime_ns") != F.col("document_mtime_ns"))
    return sessions.join(now, "document", "left").select("session_id", changed.alias("document_may_have_changed"))


def operation_counts(journal: DataFrame) -> DataFrame:
    """key, operations: how many a journal holds, null where it can't be read."""
    return journal.groupBy("key").agg(F.when(F.count("reason") == 0, F.count("line")).alias("operations"))


def resumable(docs: DataFrame, sessions: DataFrame) -> DataFrame:
    """doc, session_id, refused: the first session, by id, that a document goes on with, or why opening it is refused.

    docs: doc, digest.  sessions: document, session_id, drifted, operations (null: unreadable),
    replayed_digest (of its journal on its baseline; null: can't be replayed).  Drifted sessions and
    idle ones that don't match are passed over; one with an unreadable journal or operations
    that don't lead to the document refuses, if it comes before a match.
    """
    pair = docs.join(sessions, docs["doc"] == sessions["document"]).where("coalesce(drifted, 0) = 0")
    state = F.when(F.col("operations").isNull(), "unreadable").when(F.col("replayed_digest").eqNullSafe(F.col("digest")), "match").when(F.col("operations") > 0, "stale")
    first = pair.withColumn("state", state).where("state is not null").groupBy("doc").agg(F.min(F.struct("session_id", "state")).alias("first"))
    refused = F.when(F.col("first.state") == "unreadable", "its journal can't be read").when(F.col("first.state") == "stale", "it holds operations that do not lead to the document as it is")
    return docs.select("doc").join(first, "doc", "left").select("doc", F.when(F.col("first.state") == "match", F.col("first.session_id")).alias("session_id"), F.when(refused.isNotNull(), F.concat(F.lit("session "), F.col("first.session_id"), F.lit(": "), refused)).alias("refused"))


def closed(sessions: DataFrame, counts: DataFrame, discard: bool = False) -> DataFrame:
    """session_id, closed, operations_discarded, reason: operations that no receipt holds keep a session open unless they are thrown away."""
    joined = sessions.join(counts.withColumnRenamed("key", "session_id"), "session_id", "left").withColumn("known", F.col("session_id").isNotNull())
    empty = F.coalesce(F.col("operations") == 0, F.lit(False))
    can = empty | F.lit(discard)
    return joined.select("session_id", can.alias("closed"), F.when(can, F.col("operations")).alias("operations_discarded"), F.when(~can, F.when(F.col("operations").isNull(), "its journal can't be read").otherwise(F.concat(F.lit("it holds "), F.col("operations").cast("string"), F.lit(" operation(s)")))).alias("reason"))


_EXPIRY = "session_id string, event string, touched long"


def _expire(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        touched = state.get[0]
        state.remove()
        yield pd.DataFrame([(key[0], "expired", touched)], columns=["session_id", "event", "touched"])
        return
    new, last = not state.exists, max((int(b["at"].max()) for b in batches if len(b)), default=0)
    ttl = TTL
    state.update((max(last, state.get[0] if state.exists else 0),))
    state.setTimeoutDuration(ttl * 1000)
    yield pd.DataFrame([(key[0], "opened" if new else "renewed", last)], columns=["session_id", "event", "touched"])


def expiry_stream(touches: DataFrame) -> DataFrame:
    """session_id, event (opened, renewed, expired), touched: leases over a stream of uses (session_id, at in
    seconds); one that is not used for its time to live expires by the clock of the job."""
    return touches.select("session_id", F.col("at").cast("long").alias("at")).groupBy("session_id").applyInPandasWithState(_expire, _EXPIRY, "touched long", "append", GroupStateTimeout.ProcessingTimeTimeout)
