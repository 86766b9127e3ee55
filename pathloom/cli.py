"""python -m pathloom [options] '<path>' [file ...]

Prints each selected value as JSON on a line. Arguments from the first that begins with $ on are the path, up
to the first that is a file; without files, documents are read from standard input. Ends with 1 if any
document is no JSON, 2 if the path is wrong.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pathloom.operators.select import select
from pathloom.plans.parser import PathSyntaxError, parse_path
from pathloom.sources.readers import FORMATS, from_texts, good_and_bad, read_documents, split_documents


def _arguments(args: list[str]) -> tuple[str, list[str], str, bool]:
    form, index = "concatenated", False
    while args and not args[0].startswith("$"):
        option = args.pop(0)
        if option == "--index":
            index = True
        elif option.startswith("--form=") and option[7:] in FORMATS:
            form = option[7:]
        else:
            raise PathSyntaxError(f"no such option: {option}", "", 0)
    path = ""
    while args and (not path or not os.path.exists(args[0])):
        path += args.pop(0)
    return path, args, form, index


def main(args: list[str], out=sys.stdout, err=sys.stderr, spark: SparkSession | None = None, stdin=sys.stdin) -> int:
    try:
        text, files, form, index = _arguments(list(args))
        path = parse_path(text)
    except PathSyntaxError as e:
        print(e, file=err)
        return 2
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    documents = read_documents(spark, files, form) if files else from_texts(spark, split_documents(stdin.read()))
    good, bad = good_and_bad(documents)
    for row in select(good.select("document"), "document", path, include_array_index=index).select(F.to_json("value")).toLocalIterator():
        print(row[0], file=out)
    wrong = bad.select("error", F.substring("text", 1, 80)).take(1)
    if wrong:
        print(f"no JSON: {wrong[0][0]}: {wrong[0][1]}", file=err)
    return 1 if wrong else 0
