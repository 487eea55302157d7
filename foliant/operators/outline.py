"""What a document holds, and where a phrase stands in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import RESULTS
from foliant.kernels.canon import normalized_parts
from foliant.kernels.structure import OFFICE, PRESENTATION, WORKBOOK, listed_rows, relationship_rows, text_rows
from foliant.operators import search
from foliant.operators.digests import NOTES_PART, is_excluded

MAIN = {"docx": "word/document.xml", "pptx": PRESENTATION, "xlsx": WORKBOOK}


def searchable(parts: DataFrame) -> DataFrame:
    """The parts that a search visits: XML that the digest covers and that is not what programs add on their own."""
    xml = parts.where(F.col("part").endswith(".xml") & ~is_excluded("part"))
    notes = normalized_parts(xml.where(F.col("part").isin("word/footnotes.xml", "word/endnotes.xml"))).where("default_content").select("doc", "part")
    return xml.join(notes, ["doc", "part"], "left_anti")


def entries(parts: DataFrame, rel: str) -> DataFrame:
    """doc, ord, name, number, part of slides or sheets, in the order of the list; part is null where no relationship of the kind gives one."""
    listed = listed_rows(parts).where("reason is null")
    rels = relationship_rows(parts).where(F.col("reason").isNull() & (F.col("type") == f"{OFFICE}/{rel}")).select("doc", F.col("source").alias("own"), F.col("id").alias("rel_id"), "target_part")
    joined = listed.join(rels, (listed["doc"] == rels["doc"]) & (listed["rel_id"] == rels["rel_id"]) & (listed["part"] == rels["own"]), "left")
    return joined.select(listed["doc"], "ord", "name", "number", F.col("target_part").alias("part"))


def slides(parts: DataFrame) -> DataFrame:
    return entries(parts.where(~F.col("part").isin(WORKBOOK)), "slide").withColumnRenamed("number", "slide_id").drop("name")


def sheets(parts: DataFrame) -> DataFrame:
    return entries(parts.where(~F.col("part").isin(PRESENTATION)), "worksheet").withColumnRenamed("number", "sheet_id")


def dangling(parts: DataFrame) -> DataFrame:
    """doc, source, id, target_part of internal relationships whose part is not there."""
    rels = relationship_rows(parts).where("reason is null and not external").select("doc", "source", "id", "target_part")
    there = parts.select(F.col("doc").cast("string").alias("doc"), F.col("part").alias("target_part"))
    return rels.join(there, ["doc", "target_part"], "left_anti").select("doc", "source", "id", "target_part")


def describe(parts: DataFrame, kind: str) -> DataFrame:
    """doc, kind, parts, included_parts, excluded_parts, text_parts, paragraphs, slides, sheets of documents of one kind."""
    all_ = parts.groupBy("doc").agg(F.count("*").alias("parts"), F.array_sort(F.collect_list(F.when(is_excluded("part"), F.col("part")))).alias("excluded_parts"))
    included = searchable(parts)
    texts = text_rows(included, kind).where("reason is null").groupBy("doc").agg(F.array_sort(F.collect_set("part")).alias("text_parts"))
    out = all_.join(included.groupBy("doc").agg(F.count("*").alias("included_parts")), "doc", "left").join(texts, "doc", "left")
    none = F.array().cast("array<string>")
    out = out.select("doc", F.lit(kind).alias("kind"), "parts", F.coalesce("included_parts", F.lit(0)).alias("included_parts"), "excluded_parts", F.coalesce("text_parts", none).alias("text_parts"))
    if kind == "docx":
        from foliant.kernels.markup import element_rows

        main = element_rows(parts.where(F.col("part") == MAIN[kind])).where(F.col("name") == "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}p")
        return out.join(main.groupBy("doc").agg(F.count("*").alias("paragraphs")), "doc", "left").withColumn("paragraphs", F.coalesce("paragraphs", F.lit(0)))
    listed = slides(parts) if kind == "pptx" else sheets(parts)
    columns = ["ord", "slide_id", "part"] if kind == "pptx" else ["ord", "name", "sheet_id", "part"]
    own = listed.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("slides" if kind == "pptx" else "sheets"))
    return out.join(own, "doc", "left")


def find_text(parts: DataFrame, kind: str, query: str, part: str | None = None, limit: int = RESULTS, budget: int = search.BYTE_BUDGET) -> DataFrame:
    """Hits of a phrase in documents of one kind, first ``limit`` of each in the order of its content, within a budget of bytes:
    doc, rank, part, text (a window around the hit), text_length, text_truncated, match_offset, start, end, the
    address (para_index, para_id, para_hash, slide_id, sheet, ref, shared_string_index) and truncated (whether there are more)."""
    looked = searchable(parts)
    if part is not None:
        looked = looked.where(F.col("part") == part)
    hits = search.search(text_rows(looked, kind).where("reason is null"), query)
    null = lambda t: F.lit(None).cast(t)
    if kind == "pptx":
        own = slides(parts).where("part is not null").groupBy("doc", "part").agg(F.min("ord").alias("at"), F.min("slide_id").alias("slide_id"))
        hits = hits.join(own, ["doc", "part"], "left").withColumn("sheet", null("string"))
        first = F.when(F.col("at").isNotNull(), 0).when(F.col("part").rlike(NOTES_PART), 1).otherwise(2)
        hits = hits.withColumn("first", first)
    else:
        hits = hits.withColumn("at", null("int")).withColumn("slide_id", null("long")).withColumn("first", F.when(F.col("part") == MAIN["docx"], 0).otherwise(1) if kind == "docx" else F.lit(0))
        if kind == "xlsx":
            own = sheets(parts).where("part is not null").groupBy("doc", "part").agg(F.min("name").alias("sheet"))
            hits = hits.join(own, ["doc", "part"], "left")
        else:
            hits = hits.withColumn("sheet", null("string"))
    paged = search.page(hits, ["doc"], ["first", F.col("at").asc_nulls_last(), "part", "ord"], limit).withColumnRenamed("rank", "place")
    kept = search.within_budget(paged.drop("text").withColumnRenamed("snippet", "text"), ["doc"], ["place"], "text", budget)
    more = F.col("truncated") | (F.max("place").over(_doc()) < F.col("n_found"))
    counted = paged.groupBy("doc").agg(F.count("*").alias("n_found"))
    return kept.join(counted, "doc").withColumn("truncated", more).select("doc", F.col("place").alias("rank"), "part", "text", "text_length", "text_truncated", "match_offset", "start", "end", "para_index", "para_id", "para_hash", "slide_id", "sheet", "ref", "shared_string_index", "truncated")


def _doc():
    from pyspark.sql import Window

    return Window.partitionBy("doc")


def part_reason(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, part, reason of the parts that searches ask for (doc, part): not in the package, or there but not searched."""
    there = parts.select("doc", "part", F.lit(True).alias("there"))
    visited = searchable(parts).select("doc", "part", F.lit(True).alias("visited"))
    j = wanted.select("doc", "part").join(there, ["doc", "part"], "left").join(visited, ["doc", "part"], "left")
    return j.select("doc", "part", F.when(F.col("there").isNull(), "no such part").when(F.col("visited").isNull(), "not searched").alias("reason"))
