"""The command surface over whole fleets: every call takes rows and gives rows.

A :class:`Fleet` is a frame of containers (path, content).  Calls put the operators together; what a
call refuses is a row with a reason, so one bad document never fails the others.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import config
from foliant.functions.text import kind_of
from foliant.kernels import packages, records
from foliant.kernels.edits import By
from foliant.kernels.markup import MarkupError
from foliant.operators import outline, receipts, transfers
from foliant.sources.containers import read_parts, write_containers


@dataclass
class Fleet:
    """Documents, with the files of their store: receipts and imports (name, value), baselines (name, content)."""

    containers: DataFrame
    receipt_files: DataFrame | None = None
    import_files: DataFrame | None = None
    baseline_files: DataFrame | None = None
    canon: str = "canon"
    schema: str = "receipt"
    tool: str = "foliant"

    @property
    def spark(self) -> SparkSession:
        return self.containers.sparkSession

    def _files(self, frame: DataFrame | None) -> DataFrame:
        return self.spark.createDataFrame([], "name string, value string") if frame is None else frame

    @property
    def parts(self) -> DataFrame:
        """doc, kind, part, data of the containers that can be read."""
        return read_parts(self.containers).where("reason is null").select("doc", kind_of("doc").alias("kind"), "part", "data")

    def server_info(self, only_reading: bool = False) -> dict:
        return {"tool": self.tool, "canon": self.canon, "suffixes": config.supported_suffixes(), "tools": config.offered(only_reading)}

    def digest(self, include_parts: bool = False) -> DataFrame:
        """doc, kind, digest, reason (and parts)."""
        out = transfers.digests_of_containers(self.containers, self.canon)
        return out if include_parts else out.drop("parts")

    def verify(self, supplied_receipts: DataFrame | None = None, originals: DataFrame | None = None) -> DataFrame:
        """A verdict a document.  supplied_receipts: doc, value (JSON), taken instead of the store's.  originals: doc,
        content, taken instead of the stored baseline."""
        own = transfers.digests_of_containers(self.containers, self.canon)
        docs = own.where("reason is null").select("doc", "digest")
        if supplied_receipts is None:
            found = receipts.find(docs, self._files(self.receipt_files))
        else:
            given = records.receipt_rows(supplied_receipts, "doc").withColumnRenamed("name", "for_doc").withColumn("name", F.col("for_doc"))
            found = docs.join(given, docs["doc"] == given["for_doc"], "left")
        if self.baseline_files is None:
            stored = self.spark.createDataFrame([], "digest string, found_digest string, unreadable string")
        else:
            first = receipts.baselines(self.baseline_files)
            read = transfers.digests_of_containers(self.baseline_files.join(first.select("name"), "name").select(F.col("name").alias("path"), "content"), self.canon)
            stored = first.join(read, first["name"] == read["doc"]).select(first["digest"], read["digest"].alias("found_digest"), read["reason"].alias("unreadable"))
        supplied = None
        if originals is not None:
            names = originals.join(self.containers.select(F.col("path").alias("doc")), "doc").select(F.col("doc").alias("path"), originals["content"])
            supplied = transfers.digests_of_containers(names, self.canon).select("doc", F.col("digest").alias("found_digest"), F.col("reason").alias("unreadable"))
        manifest = own.where("reason is null").select("doc", F.explode("parts").alias("part", "part_digest"))
        changed = receipts.divergence(manifest, found.where("result_digest is not null and result_digest <> digest").select("doc", "result_parts"))
        verdict = receipts.verify(receipts.with_baselines(found, stored, supplied), self.canon, changed)
        unread = own.where("reason is not null").select("doc", F.lit("failed").alias("outcome"), F.lit(1).alias("exit_code"), F.array(F.concat(F.lit("the document can't be read: "), F.col("reason"))).alias("reasons"))
        return verdict.unionByName(unread, allowMissingColumns=True)

    def list_receipts(self) -> DataFrame:
        docs = self.digest().where("reason is null").select("doc", "digest", F.lit("").alias("store"))
        return receipts.catalog(docs, self._files(self.receipt_files).select(F.lit("").alias("store"), "name", "value"))

    def export_receipt(self) -> DataFrame:
        """doc, name, value of the sidecar of each document that has a receipt for what it is; else a reason."""
        docs = self.digest().where("reason is null").select("doc", "digest")
        found = receipts.scan(self._files(self.receipt_files)).where("skipped is null").select(F.col("result_digest").alias("digest"), "receipt")
        j = docs.join(found, "digest", "left")
        return j.select("doc", F.concat(F.col("doc"), F.lit(".receipt.json")).alias("name"), F.col("receipt").alias("value"), F.when(F.col("receipt").isNull(), "no receipt matches it as it is").alias("reason"))

    def describe_structure(self, kind: str) -> DataFrame:
        return outline.describe(self.parts.where(F.col("kind") == kind), kind)

    def find_text(self, kind: str, query: str, part: str | None = None, limit: int = 50) -> DataFrame:
        if not query or "\0" in query or len(query) > 512:
            raise ValueError("a query has 1 to 512 characters, none of them NUL")
        if not 1 <= limit <= 500:
            raise ValueError("a limit is between 1 and 500")
        return outline.find_text(self.parts.where(F.col("kind") == kind), kind, query, part, limit)

    def preview_edits(self, requests: DataFrame, author: str, at: str, tracked: bool = True) -> DataFrame:
        """Outcomes of edit requests (doc, n, request as JSON) that are not written."""
        return packages.applied(self.parts, requests, author, at, tracked)[1]

    def apply_edits(self, requests: DataFrame, author: str, at: str, tracked: bool = True) -> tuple[DataFrame, DataFrame]:
        """Containers after edits, all or none of a document's, and the outcomes with operations."""
        parts, outcomes = packages.applied(self.parts, requests, author, at, tracked)
        return write_containers(parts), outcomes

    def _change_paragraphs(self, requests: DataFrame, author: str, at: str, tracked: bool, change) -> tuple[DataFrame, DataFrame]:
        parts_ddl, done_ddl = "doc string, part string, data binary", "doc string, n long, operation string, reason string"

        def work(own, log):
            package, kind = packages._grouped(own), own["kind"].iloc[0] if len(own) else "docx"
            rows, ids = [], None
            for n, raw in log.sort_values("n")[["n", "request"]].itertuples(index=False):
                try:
                    ids = ids or packages.new_ids(package)
                    rows.append((n, packages.canonical(change(package, kind, json.loads(raw), By(author, at, tracked, ids))), None))
                except MarkupError as bad:
                    rows.append((n, None, str(bad)))
            return package, rows

        def after(key, own, log):
            return pd.DataFrame([(key[0], p, d) for p, d in work(own, log)[0].items()], columns=["doc", "part", "data"])

        def done(key, own, log):
            return pd.DataFrame([(key[0], *r) for r in work(own, log)[1]], columns=["doc", "n", "operation", "reason"])

        named = requests.select("doc", "n", "request")
        return write_containers(packages._cogroup(self.parts, named, after, parts_ddl)), packages._cogroup(self.parts, named, done, done_ddl)

    def delete_paragraph(self, requests: DataFrame, author: str, at: str, tracked: bool = True) -> tuple[DataFrame, DataFrame]:
        """request: part and para_id, or para_index with para_hash; note."""
        return self._change_paragraphs(requests, author, at, tracked, lambda p, k, r, by: packages.delete(p, k, r["part"], by, r.get("para_id"), r.get("para_index"), r.get("para_hash"), r.get("note")))

    def insert_paragraph(self, requests: DataFrame, author: str, at: str, tracked: bool = True) -> tuple[DataFrame, DataFrame]:
        """request: part, text and one of after_para_id, before_para_id; note."""

        def change(package, kind, r, by):
            anchor = [x for x in (r.get("after_para_id"), r.get("before_para_id")) if x is not None]
            if len(anchor) != 1:
                raise MarkupError("an insertion has exactly one anchor")
            stream = packages._part(package, r["part"], kind, by.tracked)
            index = stream.at_address(para_id=anchor[0]).index + (r.get("after_para_id") is not None)
            return packages.insert(package, kind, r["part"], index, r["text"], by, r.get("note"))

        return self._change_paragraphs(requests, author, at, tracked, change)

    def commit(self, baselines: DataFrame, ops: DataFrame, created: str, force: bool = False, provenance: DataFrame | None = None) -> DataFrame:
        """doc, result_digest, name and value of the receipt, gate, forced, reason.

        baselines: containers (path, content) by the same paths.  ops: doc, n, operation as JSON, unsealed.  The
        operations are sealed, replayed and held against the documents as they are; what does not pass is
        sealed only under force, and a replay that fails, or a change that does not say what it is, never.
        """
        base = read_parts(baselines).where("reason is null").select("doc", kind_of("doc").alias("kind"), "part", "data")
        verdicts = packages.gated(base, self.parts, ops, force, self.canon)
        before = transfers.digests_of_containers(baselines, self.canon).select("doc", F.col("digest").alias("base_digest"), F.col("parts").alias("base_parts"))
        after = transfers.digests_of_containers(self.containers, self.canon).where("reason is null").select("doc", "kind", "digest", "parts")
        logs = ops.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "operation"))), lambda x: x["operation"]).alias("ops"))  # one session's
        j = after.join(before, "doc").join(verdicts, "doc").join(logs, "doc", "left")
        j = j.join(provenance.select("doc", "provenance"), "doc", "left") if provenance is not None else j.withColumn("provenance", F.lit(None).cast("string"))
        canon, schema, tool = self.canon, self.schema, self.tool

        @F.udf("string")
        def written(refused, doc, kind, base_digest, base_parts, digest, parts, own, gate, forced, failures, block):
            if refused is not None:  # a condition around a call does not keep it from being made
                return None
            block = json.loads(block) if block else None
            sealed = records.seal([json.loads(x) for x in own or []], block["hash"] if block else None)
            receipt = {
                "schema": f"{schema}/{2 if block else 1}", "document": {"name": doc.rsplit("/", 1)[-1], "kind": kind}, "baseline": {"canon": canon, "digest": base_digest, "parts": base_parts}, "operations": sealed,
                "result": {"canon": canon, "digest": digest, "parts": parts}, "attestation": {"tool": tool, "created": created, "gate": gate, "forced": forced, "gate_failures": list(failures or []) if forced else []}, "signature": None, "provenance": block,
            }
            return records.serialised(records.receipt(json.dumps(receipt)))

        reason = F.coalesce("reason", "refused")
        value = written(reason, "doc", "kind", "base_digest", "base_parts", "digest", "parts", "ops", "gate", "forced", "failures", "provenance")
        return j.select("doc", F.col("digest").alias("result_digest"), receipts.name_of_digest("digest").alias("name"), value.alias("value"), "gate", "forced", reason.alias("reason"))

    def import_document(self, requests: DataFrame, inbox: DataFrame, at: str) -> DataFrame:
        there = receipts.imports(self._files(self.import_files))
        return transfers.imported(requests, inbox, there, self.tool, at, self.canon, config.transfer_bytes())

    def export_document(self, require_receipt: bool = True, include_receipt: bool = True) -> DataFrame:
        own = self.digest().where("reason is null").select(F.col("doc"), "digest")
        docs = own.join(self.containers.select(F.col("path").alias("doc"), "content"), "doc").withColumn("name", F.regexp_extract("doc", r"([^/]*)\z", 1))
        found = receipts.scan(self._files(self.receipt_files)).where("skipped is null").select("result_digest", "receipt")
        return transfers.exported(docs, found, require_receipt, include_receipt, config.transfer_bytes())
