"""``python -m foliant verify|digest|inspect PATH...``: verdicts, digests or structure of documents.

The exit code is 0 only if every document verifies (or could be read)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliant.api import Fleet
from foliant.functions.text import kind_of


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliant")
    parser.add_argument("command", choices=("verify", "digest", "inspect"))
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--store", help="folder of the receipts, baselines and imports")
    parser.add_argument("--receipt", help="a receipt to check one document against")
    parser.add_argument("--original", help="the original of one document")
    parser.add_argument("--canon", default="canon")
    parser.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    if (args.receipt or args.original) and len(args.paths) > 1:
        parser.error("a receipt or an original is given for one document")
    spark = spark or SparkSession.builder.appName("foliant").getOrCreate()
    files = lambda paths: spark.read.format("binaryFile").load(paths).select("path", "content")
    name = F.regexp_extract("path", r"([^/]*)\z", 1)

    def stored(folder: str, pattern: str):
        read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{args.store}/{folder}")
        return read.select(name.alias("name"), "content")

    texts = lambda folder: stored(folder, "*.json").select("name", F.col("content").cast("string").alias("value"))
    docs = files(args.paths)
    fleet = Fleet(docs, texts("receipts"), None, stored("baselines", "*"), args.canon) if args.store else Fleet(docs, canon=args.canon)
    if args.command == "digest":
        rows = fleet.digest().orderBy("doc").collect()
        code = int(any(r["reason"] for r in rows))
    elif args.command == "inspect":
        kinds = [r[0] for r in docs.select(kind_of("path")).distinct().collect() if r[0]]
        rows = [r for k in kinds for r in fleet.describe_structure(k).orderBy("doc").collect()]
        code = int(len(rows) < len(args.paths))
    else:
        one = docs.select(F.col("path").alias("doc"))
        read = lambda path: bytes(files(path).first()["content"])
        given = one.withColumn("value", F.lit(read(args.receipt).decode("utf-8", "replace"))) if args.receipt else None
        original = spark.createDataFrame([(one.first()["doc"], read(args.original))], "doc string, content binary") if args.original else None
        rows = fleet.verify(given, original).orderBy("doc").collect()
        code = int(any(r["exit_code"] for r in rows))
    for r in rows:
        own = r.asDict(recursive=True)
        print(json.dumps(own, sort_keys=True) if args.json else "  ".join(str(own[k]) for k in own if own[k] not in (None, [], {})))
    return code


if __name__ == "__main__":
    sys.exit(main())
