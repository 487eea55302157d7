"""Documents in and out of a fleet: uploads in base64, imports with provenance, exports with receipts;
and the rules that requests are held to before anything is read or written."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import _c, as_sha256, illegal_xml_at, import_name_reason, kind_of
from foliant.kernels import packages, records
from foliant.kernels.markup import MarkupError
from foliant.sources.containers import unpack

MOST_BYTES = 25 << 20
# Media types by suffix.
MEDIA_TYPES = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".dotx": "application/vnd.openxmlformats-officedocument.wordprocessingml.template",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".potx": "application/vnd.openxmlformats-officedocument.presentationml.template",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
}


def bare_base64(content) -> Column:
    """Base64 without a ``data:`` head and white space."""
    return F.regexp_replace(F.regexp_replace(F.trim(_c(content)), r"(?i)^data:[^,;]*(;[^,;]*)*;base64,", ""), r"[ \t\r\n]+", "")


def content_reason(content, most: int = MOST_BYTES) -> Column:
    """Why content is refused, before it is decoded."""
    bare = bare_base64(content)
    valid = bare.rlike(r"^[A-Za-z0-9+/]*={0,2}\z") & (F.length(bare) % 4 == 0)
    return F.when(bare.isNull(), "missing").when(bare.rlike(r"[^\x00-\x7f]"), "not ASCII").when(F.length(bare) > -(-most // 3) * 4 + 4, "too large").when(~valid, "not base64")


def decoded(content) -> Column:
    return F.unbase64(bare_base64(content))


_DIGESTS = pa.schema([("doc", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("parts", pa.map_(pa.string(), pa.string())), ("reason", pa.string())])


def digests_of_containers(containers: DataFrame, label: str = "canon") -> DataFrame:
    """doc, kind, digest, parts (name to digest) of containers (path, content); why there is none for one that
    is refused.  A container is one task's work and its parts never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = unpack(path, content or b"")
                row = {"doc": path, "reason": next((r["reason"] for r in found if r.get("reason")), None)}
                if row["reason"] is None:
                    try:
                        parts = packages.manifest({r["part"]: r["data"] for r in found}, label)
                        row |= {"digest": packages.digest_of_manifest(parts), "parts": list(parts.items())}
                    except MarkupError as bad:
                        row["reason"] = str(bad)
                yield pa.RecordBatch.from_pylist([row], _DIGESTS)

    read = containers.select("path", "content").mapInArrow(run, "doc string, kind string, digest string, parts map<string,string>, reason string")
    return read.withColumn("kind", kind_of("doc"))


def imported(requests: DataFrame, inbox: DataFrame, records_there: DataFrame, tool: str, at: str, label: str = "canon", most: int = MOST_BYTES) -> DataFrame:
    """name, kind, digest, sha256, size, chunks, already_present, provenance, content, reason of import requests.

    requests: name, content (base64), sha256 (null: not checked), chunks.  inbox: name, sha256 of what
    is there.  records_there: digest, provenance of import records.  Nothing is overwritten: a
    name with other bytes is refused, one with the same bytes and record is there already.
    """
    r = requests.select("name", "content", as_sha256("sha256").alias("asked"), F.col("sha256").alias("asked_raw"), F.coalesce("chunks", F.lit(1)).alias("chunks"))
    said = F.coalesce(import_name_reason("name"), content_reason("content", most), F.when(F.col("asked_raw").isNotNull() & F.col("asked").isNull(), "not a sha256"))
    r = r.withColumn("reason", said).withColumn("bytes", F.when(F.col("reason").isNull(), decoded("content")))
    r = r.withColumn("sha256", F.concat(F.lit("sha256:"), F.sha2("bytes", 256))).withColumn("size", F.octet_length("bytes").cast("long"))
    late = F.when(F.col("asked") != F.col("sha256"), "sha256 mismatch").when(F.col("size") > most, "too large").when(F.hex(F.substring("bytes", 1, 4)) != "504B0304", "no ZIP container")
    r = r.withColumn("reason", F.coalesce("reason", late))
    own = digests_of_containers(r.where("reason is null").select(F.col("name").alias("path"), F.col("bytes").alias("content")).dropDuplicates(["path", "content"]), label)
    r = r.join(own.select(F.col("doc").alias("name"), "kind", "digest", F.col("reason").alias("broken")).dropDuplicates(["name"]), "name", "left").withColumn("reason", F.coalesce("reason", "broken"))
    there = inbox.select("name", F.col("sha256").alias("there"))
    r = r.join(there, "name", "left").join(records_there.select("digest", F.col("provenance").alias("recorded")), "digest", "left")
    same = (F.col("there") == F.col("sha256")) & (F.get_json_object("recorded", "$.name") == F.col("name")) & (F.get_json_object("recorded", "$.sha256") == F.col("sha256"))
    present = F.col("there").isNotNull() & F.coalesce(same, F.lit(False))
    r = r.withColumn("reason", F.coalesce("reason", F.when(F.col("there").isNotNull() & ~present, "the name is taken by other content"))).withColumn("already_present", present)

    @F.udf("string")
    def block(name, digest, sha, size, chunks):
        body = {"origin": "import", "via": "import_document", "name": name, "imported_at": at, "tool": tool, "digest": digest, "sha256": sha, "size": size, "chunks": chunks}
        return records.canonical(body | {"hash": records.chain_hash(None, body)})

    new = F.when(F.col("reason").isNull(), F.coalesce("recorded", block("name", "digest", "sha256", "size", "chunks")))
    good = F.col("reason").isNull()
    return r.select("name", F.when(good, F.col("kind")).alias("kind"), F.when(good, F.col("digest")).alias("digest"), "sha256", "size", "chunks", (F.col("already_present") & good).alias("already_present"), new.alias("provenance"), F.when(good, F.col("bytes")).alias("content"), "reason")


def exported(docs: DataFrame, receipts: DataFrame, require_receipt: bool = True, include_receipt: bool = True, most: int = MOST_BYTES) -> DataFrame:
    """doc, name, kind, media_type, size, sha256, digest, receipt_found, uri, blob (base64), receipt, reason.

    docs: doc, name, content, digest.  receipts: result_digest, receipt.  A document without a receipt for
    what it is now is refused unless that is not required.
    """
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)\z", 1))
    media = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    j = docs.join(receipts.select(F.col("result_digest").alias("digest"), "receipt"), "digest", "left").withColumn("size", F.octet_length("content").cast("long"))
    found = F.col("receipt").isNotNull()
    reason = F.when(F.col("size") > most, "too large").when(kind_of("name").isNull(), "unsupported container").when(~found & F.lit(require_receipt), "no receipt matches it as it is")
    quoted = F.replace(F.replace(F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    good = F.col("reason").isNull()
    return j.withColumn("reason", reason).select(
        "doc", "name", kind_of("name").alias("kind"), F.try_element_at(media, suffix).alias("media_type"), "size", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), "digest", found.alias("receipt_found"),
        F.when(good, quoted).alias("uri"), F.when(good, F.base64("content")).alias("blob"), F.when(good & F.lit(include_receipt), F.col("receipt")).alias("receipt"), "reason",
    )


def request_reason(kind, mode, author, part, old, new, occurrence, para_id, para_index, para_hash, note) -> Column:
    """Why an edit request is refused before anything is read; the first rule that fails."""
    slides, k = _c(kind) == "pptx", _c
    half = k(para_index).isNull() != k(para_hash).isNull()
    return (
        F.when(k(author).isNull() | (k(author) == ""), "no author").when(illegal_xml_at(author).isNotNull(), "author: not allowed in a document").when(~k(kind).isin("docx", "pptx"), "documents of this kind are not edited")
        .when(slides & (k(mode) == "tracked"), "slides are not tracked").when(k(part).isNull() | (k(part) == ""), "no part").when(k(old).isNull() | (k(old) == ""), "nothing to replace").when(k(new) == k(old), "nothing changes")
        .when(k(occurrence) < 1, "occurrences count from 1").when(slides & k(para_id).isNotNull(), "slides have no paragraph ids").when(slides & half, "half an address")
        .when(~slides & (k(para_index).isNotNull() | k(para_hash).isNotNull()), "documents are addressed by paragraph id").when(illegal_xml_at(note).isNotNull(), "note: not allowed in a document")
    )


def anchor_reason(after_para_id, before_para_id) -> Column:
    """An insertion has exactly one anchor."""
    both, none = _c(after_para_id).isNotNull() & _c(before_para_id).isNotNull(), _c(after_para_id).isNull() & _c(before_para_id).isNull()
    return F.when(both, "two anchors").when(none, "no anchor")


def provenance_block(name: str, digest: str, sha256: str, size: int, chunks: int, tool: str, at: str) -> str:
    body = {"origin": "import", "via": "import_document", "name": name, "imported_at": at, "tool": tool, "digest": digest, "sha256": sha256, "size": size, "chunks": chunks}
    return json.dumps(body | {"hash": records.chain_hash(None, body)}, sort_keys=True)
