"""The store of receipts, baselines and imports as tables, and verification against it.

A store is files by content: ``receipts/sha256-<hex>.json``, ``baselines/sha256-<hex>.<suffix>`` and
``imports/sha256-<hex>.json``.  Looking something up is a join on a digest; writing is
appending what is not there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import _c
from foliant.kernels import records
from foliant.kernels.edits import DISCLOSURE

RECEIPT_NAME = r"^sha256-([0-9a-f]{64})\.json\z"
BLOB_NAME = r"^sha256-([0-9a-f]{64})\.[^/]*\z"
IMPORTED = "imported document: its first bytes arrived through a call and not as a file"


def digest_of_name(name, pattern: str = RECEIPT_NAME) -> Column:
    """The digest that a file's name claims, null for other names."""
    found = F.regexp_extract(_c(name), pattern, 1)
    return F.when(found != "", F.concat(F.lit("sha256:"), found))


def name_of_digest(digest, suffix: str = ".json") -> Column:
    return F.concat(F.replace(_c(digest), F.lit(":"), F.lit("-")), F.lit(suffix))


def scan(files: DataFrame) -> DataFrame:
    """Receipt files (name, value) as rows; ``skipped`` says why one does not count: a bad
    name, unreadable, or another digest than its name claims."""
    claimed = digest_of_name("name")
    skipped = F.when(claimed.isNull(), "no receipt's name").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("result_digest") != claimed, F.concat(F.lit("its name claims "), claimed, F.lit(", it records "), F.col("result_digest")))
    return records.receipt_rows(files).withColumn("skipped", skipped)


def find(docs: DataFrame, files: DataFrame) -> DataFrame:
    """doc, digest with the receipt stored under the digest (by its name alone); columns of
    :func:`scan`, null where there is none."""
    stored = records.receipt_rows(files).withColumn("stored_digest", digest_of_name("name")).where("stored_digest is not null")
    return docs.join(stored, docs["digest"] == stored["stored_digest"], "left")


def put(receipts: DataFrame) -> DataFrame:
    """name, value of receipts given as (digest, receipt JSON): the last of each digest by its place, checked and with keys in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [records.receipt(r) for r in batch.column("receipt").to_pylist()]
            yield pa.record_batch([pa.array([r["result"]["digest"].replace(":", "-") + ".json" for r in own], pa.string()), pa.array([records.serialised(r) for r in own], pa.string())], names=["name", "value"])

    last = receipts.groupBy("digest").agg(F.max_by("receipt", "n").alias("receipt")) if "n" in receipts.columns else receipts
    return last.select("receipt").mapInArrow(run, "name string, value string")


def publish_new(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet, with ``published``; of equal new keys one."""
    first = rows.dropDuplicates([key])
    known = there.select(F.col(key)).distinct().withColumn("known", F.lit(True))
    return first.join(known, key, "left").withColumn("published", F.col("known").isNull()).drop("known")


def baselines(files: DataFrame) -> DataFrame:
    """digest, name: the first stored baseline, by name, of each digest; other names are left out."""
    own = files.select(F.col("name"), digest_of_name("name", BLOB_NAME).alias("digest")).where("digest is not null")
    return own.groupBy("digest").agg(F.min("name").alias("name"))


def new_baselines(docs: DataFrame, files: DataFrame) -> DataFrame:
    """doc, digest, name under which each baseline that is not stored yet belongs; docs: doc, digest, suffix."""
    wanted = docs.join(baselines(files).select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    return wanted.select("doc", "digest", F.concat(F.replace("digest", F.lit(":"), F.lit("-")), F.lower("suffix")).alias("name"))


_IMPORTS = pa.schema([("name", pa.string()), ("digest", pa.string()), ("imported_at", pa.string()), ("provenance", pa.string()), ("reason", pa.string())])


def imports(files: DataFrame) -> DataFrame:
    """digest, imported_at, provenance of import records (name, value) that are readable, intact and under
    their own digest; the earliest of each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                try:
                    own = records.provenance(json.loads(value or ""))
                    rows.append({"name": name, "digest": own["digest"], "imported_at": own["imported_at"], "provenance": records.canonical(own), "reason": None if records.is_intact(own) else "its hash does not hold"})
                except (records.RecordError, json.JSONDecodeError, RecursionError) as bad:
                    rows.append({"name": name, "reason": str(bad)})
            yield pa.RecordBatch.from_pylist(rows, _IMPORTS)

    read = files.select("name", "value").mapInArrow(run, "name string, digest string, imported_at string, provenance string, reason string")
    good = read.where(F.col("reason").isNull() & (F.col("digest") == digest_of_name("name")))
    return good.groupBy("digest").agg(F.min(F.struct("imported_at", "provenance")).alias("first")).select("digest", "first.imported_at", "first.provenance")


def provenance_for(docs: DataFrame, import_files: DataFrame, receipt_files: DataFrame) -> DataFrame:
    """doc, digest, provenance: from the import of this digest, else from an intact block of its receipt."""
    of_receipt = scan(receipt_files).where("skipped is null and provenance_intact").select(F.col("result_digest").alias("digest"), F.col("provenance").alias("of_receipt"))
    of_import = imports(import_files).select("digest", F.col("provenance").alias("of_import"))
    joined = docs.select("doc", "digest").join(of_import, "digest", "left").join(of_receipt, "digest", "left")
    return joined.select("doc", "digest", F.coalesce("of_import", "of_receipt").alias("provenance"))


def divergence(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """doc, diverged, added, removed: names of parts, in order, where a receipt's recorded parts and the
    document's differ; all null where the receipt records none.

    manifest: doc, part, part_digest.  found: doc, result_parts.
    """
    known = found.where("result_parts is not null").select("doc", F.explode("result_parts").alias("part", "want"))
    with_record = found.where("result_parts is not null").select("doc")
    got = manifest.join(with_record, "doc", "left_semi").select("doc", "part", F.col("part_digest").alias("got"))
    both = known.join(got, ["doc", "part"], "full_outer").where(~F.col("want").eqNullSafe(F.col("got")))
    names = lambda condition: F.array_sort(F.collect_list(F.when(condition, F.col("part"))))
    diff = both.groupBy("doc").agg(names(F.col("want").isNotNull() & F.col("got").isNotNull()).alias("diverged"), names(F.col("want").isNull()).alias("added"), names(F.col("got").isNull()).alias("removed"))
    none = F.array().cast("array<string>")
    return found.select("doc", F.col("result_parts").isNotNull().alias("has_parts")).join(diff, "doc", "left").select("doc", *(F.when(F.col("has_parts"), F.coalesce(c, none)).alias(c) for c in ("diverged", "added", "removed")))


def verify(found: DataFrame, canon: str = "canon", differences: DataFrame | None = None) -> DataFrame:
    """doc, digest, outcome, exit_code, t1, t2, t3, baseline_checked, reasons, disclosures, provenance.

    found: doc and digest with the columns of its receipt (:func:`find`; reason where it can't be
    read), and baseline_digest_found: the digest of the original supplied, else of the stored
    baseline, with baseline_unreadable (why it has none) - both null where there is no
    baseline, which is no failure.
    """
    col = F.col
    has = col("name").isNotNull()
    readable = has & col("reason").isNull()
    right = readable & col("canon").eqNullSafe(F.lit(canon))
    t1 = F.when(right, col("digest") == col("result_digest"))
    sound = col("break_seq").isNull()
    intact = F.coalesce(col("provenance_intact"), F.lit(True))
    t3 = F.when(right, F.when(col("baseline_unreadable").isNotNull(), F.lit(False)).otherwise(col("baseline_digest_found") == col("baseline_digest")))
    detail = F.lit("")
    if differences is not None:
        found = found.join(differences, "doc", "left")
        said = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
        pieces = F.array_compact(F.array(said("diverged", "diverged: "), said("added", "added since: "), said("removed", "removed since: ")))
        detail = F.when(col("diverged").isNull(), "; it records no parts").when(F.size(pieces) == 0, "; its recorded parts do not explain it").otherwise(F.concat(F.lit("; "), F.array_join(pieces, "; ")))
    failed = F.concat(F.lit(": "), F.array_join("gate_failures", "; "))
    reasons = F.array(
        F.when(~has, "no receipt matches this digest: never processed, or changed afterwards"),
        F.when(has & ~readable, F.concat(F.lit("its receipt can't be read, which is not the same as having none: "), col("reason"))),
        F.when(readable & ~right, F.concat(F.lit("its receipt uses the canonical form "), F.coalesce("canon", F.lit("none")), F.lit(f" and not {canon}"))),
        F.when(right & ~t1, F.concat(F.lit("T1: the document's digest is not the receipt's"), detail)),
        F.when(right & ~sound, F.concat(F.lit("T2: the chain of operations breaks at "), col("break_seq").cast("string"))),
        F.when(right & ~intact, "T2: the provenance's hash does not hold"),
        F.when(right & col("baseline_unreadable").isNotNull(), F.concat(F.lit("T3: the baseline can't be read: "), col("baseline_unreadable"))),
        F.when(right & col("baseline_unreadable").isNull() & ~t3, F.concat(F.lit("T3: the baseline digests to "), col("baseline_digest_found"))),
        F.when(right & (col("gate") != "passed"), F.concat(F.lit("the writing tool's own gate failed"), failed)),
        F.when(right & col("forced"), F.concat(F.lit("the receipt was forced"), failed)),
    )
    t2 = F.when(right, sound & intact)
    good = right & t1 & t2 & F.coalesce(t3, F.lit(True)) & (col("gate") == "passed") & ~col("forced")
    outcome = F.when(~has, "unknown").when(good, "verified").otherwise("failed")
    notes = F.filter("notes", lambda n: F.contains(n, F.lit(DISCLOSURE)))
    told = F.when(right, F.concat(F.when(col("provenance").isNotNull(), F.array(F.lit(IMPORTED))).otherwise(F.array().cast("array<string>")), notes)).otherwise(F.array().cast("array<string>"))
    return found.select(
        "doc", "digest", outcome.alias("outcome"), F.when(outcome == "verified", 0).otherwise(1).alias("exit_code"), t1.alias("t1"), t2.alias("t2"), t3.alias("t3"), t3.alias("baseline_checked"),
        F.array_compact(reasons).alias("reasons"), told.alias("disclosures"), F.when(right, col("provenance")).alias("provenance"),
    )


def with_baselines(found: DataFrame, stored: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """What :func:`verify` needs of baselines; stored: digest, found_digest, unreadable of the store's; supplied: doc,
    found_digest, unreadable, which takes precedence."""
    own = stored.select(F.col("digest").alias("baseline_digest"), F.col("found_digest").alias("stored_digest_found"), F.col("unreadable").alias("stored_unreadable"))
    out = found.join(own, "baseline_digest", "left")
    if supplied is None:
        return out.withColumnsRenamed({"stored_digest_found": "baseline_digest_found", "stored_unreadable": "baseline_unreadable"})
    given = supplied.select("doc", F.col("found_digest").alias("given_digest"), F.col("unreadable").alias("given_unreadable"), F.lit(True).alias("given"))
    out = out.join(given, "doc", "left")
    pick = lambda a, b: F.when(F.col("given"), F.col(a)).otherwise(F.col(b))
    return out.withColumn("baseline_digest_found", pick("given_digest", "stored_digest_found")).withColumn("baseline_unreadable", pick("given_unreadable", "stored_unreadable"))


def catalog(docs: DataFrame, files: DataFrame) -> DataFrame:
    """doc with every receipt of its store, whether it matches the document as it is, and what was skipped.

    docs: doc, digest, store.  files: store, name, value.
    """
    rows = scan(files.select(F.concat_ws("\n", "store", "name").alias("place"), "name", "value").select("place", "value").withColumnRenamed("place", "name"))
    split = rows.withColumn("store", F.regexp_extract("name", r"^(.*)\n", 1)).withColumn("name", F.regexp_extract("name", r"\n(.*)\z", 1))
    claimed = digest_of_name("name")
    skipped = F.when(claimed.isNull(), "no receipt's name").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("result_digest") != claimed, "its name claims another digest")
    own = split.withColumn("skipped", skipped)
    joined = docs.select("doc", "digest", "store").join(own, "store", "left")
    keep = ("result_digest", "baseline_digest", "document_name", "kind", "operations", "gate", "forced", "created", "tool", "signed", "schema_version", "provenance")
    return joined.select("doc", "name", "skipped", *(F.when(F.col("skipped").isNull(), F.col(c)).alias(c) for c in keep), F.when(F.col("skipped").isNull(), F.col("result_digest") == F.col("digest")).alias("matches_this_document"))


def appended(journal: DataFrame, ops: DataFrame) -> DataFrame:
    """Journal lines (key, n, line, reason, truncated) with batches of raw operations (key, n, raw as JSON) sealed behind
    them: key, n, line of what is new, or a reason; a batch goes in whole or not at all, and not behind a torn line."""
    ddl = "key string, n long, line string, reason string"

    def run(key, own, new):
        import pandas as pd

        refuse = lambda why: pd.DataFrame([(key[0], None, None, why)], columns=["key", "n", "line", "reason"])
        if not len(new):
            return pd.DataFrame([], columns=["key", "n", "line", "reason"])
        if len(own) and bool(own["truncated"].any()):
            return refuse("the journal ends in a torn line")
        if len(own) and own["reason"].notna().any():
            return refuse(str(own["reason"].dropna().iloc[0]))
        lines = [x for x in own.sort_values("n")["line"] if x is not None] if len(own) else []
        genesis = new["genesis"].iloc[0] if "genesis" in new and new["genesis"].notna().any() else None
        try:
            last = records.operation(json.loads(lines[-1]))["hash"] if lines else genesis
            sealed = records.seal([json.loads(x) for x in new.sort_values("n")["raw"]], last, len(lines))
        except (records.RecordError, json.JSONDecodeError) as bad:
            return refuse(str(bad))
        return pd.DataFrame([(key[0], op["seq"], json.dumps(op, sort_keys=True), None) for op in sealed], columns=["key", "n", "line", "reason"])

    left = journal.select(F.col("key").cast("string").alias("key"), F.col("n").cast("long").alias("n"), "line", "reason", "truncated")
    wanted = [c for c in ("n", "raw", "genesis") if c in ops.columns]
    return left.groupBy("key").cogroup(ops.select(F.col("key").cast("string").alias("key"), *wanted).groupBy("key")).applyInPandas(run, ddl)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
