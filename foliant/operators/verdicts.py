"""Verdicts, the gate and attestations over rows.

Null is a third value throughout: unknown, never false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import MOST_TTL, _c
from foliant.operators.digests import is_editable_part, is_tracked_part

#: Fixed value: how the note of a direct change begins that says what it is.
DISCLOSURE = "direct-mode edit in a revision-capable part"
MOST_ID = 2**31 - 1


def outcome(has_receipt, readable, canon_ok, t1, t2, t3, gate, forced) -> Column:
    """'verified', 'unknown' or 'failed'; a missing baseline (t3 null) is no failure."""
    checks = _c(t1) & _c(t2) & F.coalesce(_c(t3), F.lit(True)) & (_c(gate) == "passed") & ~_c(forced)
    return F.when(_c(has_receipt) & ~_c(readable), "failed").when(~_c(has_receipt), "unknown").when(~_c(canon_ok), "failed").when(checks, "verified").otherwise("failed")


def exit_code(outcome_col) -> Column:
    return F.when(_c(outcome_col) == "verified", 0).otherwise(1)


def gate_ok(accountability, visibility, structural) -> Column:
    no = lambda x: F.coalesce(~_c(x), F.lit(False))
    return _c(accountability) & ~no(visibility) & ~no(structural)


def owes_disclosure(mode, part) -> Column:
    """Direct changes of any kind, in parts where a reader could expect to see them."""
    return F.coalesce((_c(mode) == "direct") & (is_tracked_part(part) | is_editable_part(part)), F.lit(False))


def silent_operations(ops: DataFrame, key: str) -> DataFrame:
    """key, silent: numbers of operations (mode, part, note, n) that owe a disclosure and have none, in order."""
    silent = owes_disclosure("mode", "part") & ~F.contains(F.coalesce("note", F.lit("")), F.lit(DISCLOSURE))
    return ops.groupBy(key).agg(F.array_sort(F.collect_list(F.when(silent, F.col("n")))).alias("silent"))


def attestation(ok, force, silent) -> Column:
    """gate, forced, refused: an operation that owes a disclosure and has none refuses, even under force; a note
    on another operation does not make up for it."""
    return F.struct(
        F.when(_c(ok), "passed").otherwise("failed").alias("gate"),
        (~_c(ok) & _c(force)).alias("forced"),
        ((F.size(silent) > 0) | (~_c(ok) & ~_c(force))).alias("refused"),
    )


def earliest(records: DataFrame, key: str, at: str, intact) -> DataFrame:
    """The earliest intact record of each key; ties to the least row."""
    rest = [c for c in records.columns if c not in (key, at)]
    return records.where(_c(intact)).groupBy(key).agg(F.min(F.struct(at, *rest)).alias("r")).select(key, "r.*")


def model_diff(want: DataFrame, got: DataFrame) -> DataFrame:
    """doc, want_n, got_n, first_diff: count mismatch, else the first place where texts differ."""
    a, b = want.select("doc", "idx", F.col("text").alias("want")), got.select("doc", "idx", F.col("text").alias("got"))
    pair = a.join(b, ["doc", "idx"], "full_outer")
    return pair.groupBy("doc").agg(F.count("want").alias("want_n"), F.count("got").alias("got_n"), F.min(F.when(~F.col("want").eqNullSafe(F.col("got")), F.col("idx"))).alias("first_diff")).where("first_diff is not null")


def unaddressable(ops: DataFrame, key: str) -> DataFrame:
    """Direct operations whose place can't be found once earlier tracked inserts of
    the same part are left out: key, n, pivot.

    ops: key, part, n, op, mode, at_index, para_id, para_index.
    """
    shift = F.when((F.col("mode") == "tracked") & (F.col("op") == "paragraph_insert"), F.coalesce("at_index", F.lit(-1)))
    w = Window.partitionBy(key, "part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    stays = F.when(F.col("op") == "paragraph_insert", F.coalesce("at_index", F.lit(-1)) <= F.col("pivot")).otherwise((F.coalesce("para_id", F.lit("")) != "") | F.coalesce(F.col("para_index") < F.col("pivot"), F.lit(False)))
    return ops.where("part is not null").withColumn("pivot", F.min(shift).over(w)).where((F.col("mode") == "direct") & F.col("pivot").isNotNull() & ~stays).select(key, "n", "pivot")


def batch_outcomes(edits: DataFrame, key: str, n: str, failed) -> DataFrame:
    """All or nothing: edits before the first failure are discarded, later ones not attempted."""
    first = F.min(F.when(_c(failed), F.col(n))).over(Window.partitionBy(key))
    return edits.withColumn("first_failed", first).withColumn("result", F.when(F.col("first_failed").isNull(), "applied").when(F.col(n) < F.col("first_failed"), "discarded").when(F.col(n) == F.col("first_failed"), "failed").otherwise("not attempted"))


def sweep_class(is_link, is_session, meta_state, age_s, held, expired, journal_ops, young_s: int = MOST_TTL) -> Column:
    """What a sweep does with a session directory; the first rule that holds.  A directory without meta
    data is kept while it could still be a live session's: as long as the longest lease."""
    return (
        F.when(_c(is_link), "kept: a link")
        .when(~_c(is_session), "kept: no session")
        .when(_c(meta_state) == "unreadable", "kept: unreadable")
        .when(_c(meta_state) == "absent", F.when(_c(age_s).isNull() | _c(held) | (_c(age_s) < young_s), "kept: young or held").otherwise("removed"))
        .when(~_c(expired), "kept: live")
        .when(_c(held), "kept: held")
        .when(_c(journal_ops).isNull() | (_c(journal_ops) > 0), "kept: unsealed operations")
        .otherwise("removed")
    )


def continuity(chunks: DataFrame, key: str, order: str, offset: str, size: str) -> DataFrame:
    """Chunks with the bytes received before them and whether each goes on there."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("received", F.coalesce(F.sum(size).over(w), F.lit(0))).withColumn("accepted", F.col(offset) == F.col("received"))


def allocate(ops: DataFrame, key: str, n: str, needed: str, base: str) -> DataFrame:
    """The first and last id that each operation takes, in order, above ``base``, and whether they are refused
    as there is none left below 2^31."""
    w = Window.partitionBy(key).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    out = ops.withColumn("last_id", F.col(base) + F.sum(needed).over(w)).withColumn("first_id", F.col("last_id") - F.col(needed) + 1)
    return out.withColumn("refused", F.col("last_id") > MOST_ID)


def outermost(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that no other span holds: those from the running greatest end on."""
    w = Window.partitionBy(*keys).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.coalesce(F.max("end").over(w), F.lit(-1))).where("start >= reach").drop("reach")


def rejected_texts(segments: DataFrame, keys: list[str], order: str, text_col: str, revision, own) -> DataFrame:
    """keys, text of paragraphs as if revisions had been rejected: inserted text of one's own goes, deleted text stays."""
    goes = (_c(revision) == "ins") & _c(own)
    kept = F.array_sort(F.collect_list(F.when(~F.coalesce(goes, F.lit(False)), F.struct(F.col(order), F.col(text_col)))))  # the segments of one paragraph
    return segments.groupBy(*keys).agg(F.array_join(F.transform(kept, lambda x: x[text_col]), "").alias("text"))
