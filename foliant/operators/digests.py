"""Part filters, digests, manifests and their differences.

A package is rows (doc, part, data).  Digests of parts make a manifest; the digest
of a manifest is that of its canonical JSON, names in order.  Everything is a
projection or a partial aggregate by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import _c, digest_of

#: Parts that a digest leaves out, and parts whose edits can be tracked.
EXCLUDED = ("docProps/core.xml", "docProps/app.xml", "xl/calcChain.xml")
EXCLUDED_PREFIXES = ("docProps/thumbnail.", "ppt/printerSettings/")
TRACKED_PART = r"^word/(document\.xml|header\d+\.xml|footer\d+\.xml|footnotes\.xml|endnotes\.xml|glossary/document\.xml)\z"
EDITABLE_PART = r"^ppt/(slides/slide\d+\.xml|notesSlides/notesSlide\d+\.xml)\z"
NOTES_PART = r"^ppt/notesSlides/notesSlide\d+\.xml\z"


def is_excluded(part) -> Column:
    out = _c(part).isin(*EXCLUDED)
    for prefix in EXCLUDED_PREFIXES:
        out = out | _c(part).startswith(prefix)
    return out


def is_tracked_part(part) -> Column:
    return _c(part).rlike(TRACKED_PART)


def is_editable_part(part) -> Column:
    return _c(part).rlike(EDITABLE_PART)


def part_digests(parts: DataFrame, normalized="data") -> DataFrame:
    """doc, part, part_digest of included parts."""
    return parts.where(~is_excluded("part")).select("doc", "part", digest_of(normalized).alias("part_digest"))


def canonical_json(entries: Column) -> Column:
    """JSON object of an array of (name, value) structs of plain ASCII names, in order."""
    quoted = lambda s: F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    names = F.array_sort(entries)
    return F.concat(F.lit("{"), F.array_join(F.transform(names, lambda e: F.concat(quoted(e["part"]), F.lit(":"), quoted(e["part_digest"]))), ","), F.lit("}"))


def package_digests(manifest: DataFrame) -> DataFrame:
    """doc, digest, parts: one digest over each document's manifest."""
    return manifest.groupBy("doc").agg(digest_of(canonical_json(F.collect_list(F.struct("part", "part_digest")))).alias("digest"), F.count("*").alias("parts"))


def manifest_diff(want: DataFrame, got: DataFrame) -> DataFrame:
    """doc, part, change ('added', 'removed', 'differs') of two manifests."""
    a = want.select("doc", "part", F.col("part_digest").alias("want"))
    b = got.select("doc", "part", F.col("part_digest").alias("got"))
    change = F.when(F.col("want").isNull(), "added").when(F.col("got").isNull(), "removed").otherwise("differs")
    return a.join(b, ["doc", "part"], "full_outer").where(~F.col("want").eqNullSafe(F.col("got"))).select("doc", "part", change.alias("change"))


def drift(diff: DataFrame, first: int = 5) -> DataFrame:
    """doc, changed, and the first few names of each document's changed parts."""
    return diff.groupBy("doc").agg(F.count("*").alias("changed"), F.array_join(F.slice(F.array_sort(F.collect_list("part")), 1, first), ",").alias("first_parts"))


def search_priority(kind, part, main_part, slide_index) -> Column:
    """Sort key of parts: slides in list order, then notes, then the rest; a Word
    document's main part first."""
    return F.when(_c(kind) == "pptx", F.when(_c(slide_index).isNotNull(), 0).when(_c(part).rlike(NOTES_PART), 1).otherwise(2)).when(_c(kind) == "docx", F.when(_c(part) == _c(main_part), 0).otherwise(1)).otherwise(0)
