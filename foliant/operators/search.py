"""Phrase search over text elements, and matching inside paragraphs.

Search is case-insensitive and gives the first hit of an element; matching, for
edits, is case-sensitive and gives all hits that do not overlap.  Both stay
inside generated code: no element leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import SNIPPET_RADIUS, _c

BYTE_BUDGET = 262_144


def original_offset(text, lowered) -> Column:
    """Where in a text an offset of its lower-case form stands: the first character that reaches beyond it.
    Only texts whose length changes in lower case are looked through."""
    x = _c(text)
    step = lambda acc, c: F.struct((acc["i"] + 1).alias("i"), (acc["at"] + F.length(F.lower(c))).alias("at"), F.when((acc["found"] < 0) & (acc["at"] + F.length(F.lower(c)) > lowered), acc["i"]).otherwise(acc["found"]).alias("found"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(-1).alias("found"))
    through = F.aggregate(F.split(x, ""), start, step, lambda acc: F.when(acc["found"] < 0, F.length(x)).otherwise(acc["found"]))
    return F.when(F.length(F.lower(x)) == F.length(x), lowered).otherwise(through)


def search(elements: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """Elements that hold ``query`` in any case, with match_offset, the text's length and a snippet window."""
    needle = query.lower()
    start, end = F.greatest(F.col("match_offset") - SNIPPET_RADIUS, F.lit(0)), F.least(F.length(text_col), F.col("match_offset") + len(needle) + SNIPPET_RADIUS)
    return (
        elements.where(F.length(text_col) > 0)
        .withColumn("match_offset", F.instr(F.lower(text_col), needle) - 1)
        .where("match_offset >= 0")
        .withColumn("match_offset", original_offset(text_col, F.col("match_offset")))
        .withColumn("text_length", F.length(text_col))
        .withColumn("snippet", F.substring(F.col(text_col), start + 1, end - start))
        .withColumn("text_truncated", (start > 0) | (end < F.length(text_col)))
    )


def page(hits: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` hits by ``order`` within ``keys``, and whether there are more."""
    w = Window.partitionBy(*keys)
    ranked = hits.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= limit + 1)
    return ranked.withColumn("truncated", F.max("rank").over(w) > limit).where(F.col("rank") <= limit)


def within_budget(rows: DataFrame, keys: list[str], order: list, text_col: str, budget: int = BYTE_BUDGET) -> DataFrame:
    """Rows while their texts' bytes together stay within the budget; the first always."""
    w = Window.partitionBy(*keys).orderBy(*order)
    sized = rows.withColumn("bytes", F.sum(F.octet_length(text_col)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w))
    return sized.where((F.col("bytes") <= budget) | (F.col("rank") == 1))


def match_offsets(text, needle: str) -> Column:
    """Offsets of all hits from left to right that do not overlap."""
    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pieces = F.split(_c(text), quoted, -1)
    lengths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p))
    return F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("found")),
        lambda acc, n: F.struct((acc["at"] + n + len(needle)).alias("at"), F.concat(acc["found"], F.array(acc["at"] + n)).alias("found")),
        lambda acc: acc["found"],
    )


def find_matches(paragraphs: DataFrame, needle: str, text_col: str = "text") -> DataFrame:
    """A row a match: the paragraph's columns, n_in_para (from 0) and char_start."""
    if not needle:
        raise ValueError("the needle is empty")
    held = paragraphs.where(F.col(text_col).contains(needle))
    return held.select("*", F.posexplode(match_offsets(text_col, needle)).alias("n_in_para", "char_start")).withColumn("char_end", F.col("char_start") + len(needle))


def kth_match(matches: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k-th match (from 1) of each key in paragraph order."""
    if k < 1:
        raise ValueError("occurrences count from 1")
    order = Window.partitionBy(*keys).orderBy("para_index", "char_start")
    return matches.withColumn("k", F.row_number().over(order)).where(F.col("k") == k).drop("k")


def covering(segments: DataFrame, keys: list[str], order: str, low: str, high: str, text_col: str = "text") -> DataFrame:
    """Segments with their place in the stream (seg_start, seg_end) that overlap [low, high)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = segments.withColumn("seg_end", F.sum(F.length(text_col)).over(w)).withColumn("seg_start", F.col("seg_end") - F.length(text_col))
    return placed.where((F.col("seg_start") < F.col(high)) & (F.col(low) < F.col("seg_end")))


def innermost(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``inner`` (keys, start, end) with the start and end of the smallest row of ``outer`` around each
    (outer_start, outer_end; null where there is none): of those that hold it the one that starts last.

    Both of one part, so a key's rows are bounded by what a part holds."""
    around = outer.select(*keys, F.col("start").alias("outer_start"), F.col("end").alias("outer_end"))
    held = inner.select(*keys, "start", "end").distinct().join(around, keys).where("outer_start <= start and end <= outer_end")
    best = held.groupBy(*keys, "start", "end").agg(F.max(F.struct("outer_start", (-F.col("outer_end")).alias("less"))).alias("best"))
    found = best.select(*keys, "start", "end", "best.outer_start", (-F.col("best.less")).alias("outer_end"))
    return inner.join(found, [*keys, "start", "end"], "left")


def at_address(asked: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Addresses (doc, part, para_id, para_index, para_hash) with the paragraph (idx) they name and a state: resolved,
    no such id, no address, out of range, no hash (an index alone is none) or stale.

    paragraphs: doc, part, idx, para_id, text_hash.  The id comes first; the hash is checked either way."""
    by_id = paragraphs.where("para_id is not null").groupBy("doc", "part", "para_id").agg(F.min(F.struct("idx", "text_hash")).alias("named"))
    by_index = paragraphs.select("doc", "part", F.col("idx").alias("para_index"), F.struct("idx", "text_hash").alias("placed"))
    j = asked.join(by_id, ["doc", "part", "para_id"], "left").join(by_index, ["doc", "part", "para_index"], "left")
    has_id = F.col("para_id").isNotNull()
    found = F.when(has_id, F.col("named")).otherwise(F.col("placed"))
    state = (
        F.when(has_id & F.col("named").isNull(), "no such id").when(~has_id & F.col("para_index").isNull(), "no address").when(~has_id & F.col("placed").isNull(), "out of range")
        .when(~has_id & F.col("para_hash").isNull(), "no hash").when(F.col("para_hash") != found["text_hash"], "stale").otherwise("resolved")
    )
    return j.withColumn("state", state).withColumn("idx", F.when(F.col("state") == "resolved", found["idx"])).drop("named", "placed")


#: Needles of fewer words than this are looked for in every text; so many may be.
KEYED_WORDS, MOST_SHORT = 5, 200


def needles_in(documents: DataFrame, needles: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", needle_col: str = "text") -> DataFrame:
    """item, doc: every document that holds a needle, whole and as it is written.

    A needle's second to fourth word stand as whole words in any text that holds it, so candidates
    share these three; texts are looked at for candidates only and do not move with the words.
    Needles of fewer than five words are looked for in every text, up to a number that is checked.
    """
    words = lambda c: F.split(c, "[ \n]")
    own = needles.select(F.col(item_col).alias("item"), F.col(needle_col).alias("needle")).where("needle <> ''").withColumn("w", words(F.col("needle")))
    keyed = own.where(F.size("w") >= KEYED_WORDS).withColumn("key", F.xxhash64(F.get("w", F.lit(1)), F.get("w", F.lit(2)), F.get("w", F.lit(3))))
    docs = documents.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))
    # the explode keeps the words from being cut anew for each of them
    cut = docs.select("doc", F.explode(F.array(words(F.col("text")))).alias("w"))
    triples = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get("w", i + 1), F.get("w", i + 2)))
    met = cut.select("doc", F.explode(F.array_distinct(triples)).alias("key")).join(keyed.select("item", "key"), "key").select("item", "doc")
    found = met.join(docs, "doc").join(keyed.select("item", "needle"), "item").where(F.contains("text", F.col("needle"))).select("item", "doc")
    short = own.where(F.size("w") < KEYED_WORDS).select("item", "needle").limit(MOST_SHORT + 1).collect()
    if len(short) > MOST_SHORT:
        raise ValueError(f"more than {MOST_SHORT} needles of fewer than {KEYED_WORDS} words")
    if short:
        listed = F.array(*(F.struct(F.lit(r["item"]).alias("item"), F.lit(r["needle"]).alias("needle")) for r in short))
        held = docs.select("doc", F.explode(F.filter(listed, lambda x: F.contains("text", x["needle"]))).alias("x"))
        found = found.unionAll(held.select("x.item", "doc"))
    return found.distinct()
