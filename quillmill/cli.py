"""Command line: files to Markdown.

    python -m quillmill.cli [-o PATH|-] [-i EXT] FILE...
    python -m quillmill.cli --list-formats

Without -o each file's Markdown is written beside it. ``-`` reads standard input and needs -i. The exit code is 0 if all
went well, 1 if a file is missing or failed, 2 for wrong usage.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import __version__
from .plans.convert import convert
from .sources.files import from_buffer, read_files
from .sources.kinds import formats


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillmill", description="Convert documents to Markdown.")
    out.add_argument("inputs", nargs="*", metavar="FILE")
    out.add_argument("-o", "--output", metavar="PATH", help="write to PATH, or to standard output with -")
    out.add_argument("-i", "--input-extension", metavar="EXT", type=lambda e: e.lower().strip("."), help="extension of standard input")
    out.add_argument("--list-formats", action="store_true", help="list the extensions that can be converted")
    out.add_argument("-v", "--version", action="version", version=__version__)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    reader = parser()
    try:
        given = reader.parse_args(arguments)
    except SystemExit as e:
        return int(e.code or 0)
    standard = given.inputs == ["-"]
    if not given.inputs and not given.list_formats:
        print(reader.format_usage(), file=sys.stderr)
        return 2
    if standard and not given.input_extension:
        print("standard input needs -i EXT", file=sys.stderr)
        return 2
    if len(given.inputs) > 1 and given.output not in (None, "-"):
        print("several inputs take no -o but -o -", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("quillmill").getOrCreate()
    if given.list_formats:
        for row in formats(spark).collect():
            print(row.extension)
        return 0
    return _run(spark, given, standard)


def _run(spark: SparkSession, given: argparse.Namespace, standard: bool) -> int:
    code = 0
    present = []
    for path in given.inputs:
        if not standard and os.path.isfile(path) and not os.path.getsize(path):  # Spark's file source leaves these out
            print(f"{path}: empty input", file=sys.stderr)
            code = 1
        elif standard or os.path.isfile(path):
            present.append(path)
        else:
            print(f"{path}: no such file", file=sys.stderr)
            code = 1
    if not present:
        return code
    if standard:
        files = from_buffer(spark, sys.stdin.buffer.read(), given.input_extension)
    else:
        files = read_files(spark, *present)
    for row in convert(files).collect():  # the files that were named, one by one
        if row.status != "success":
            print(f"{row.path}: {row.message or row.error}", file=sys.stderr)
            code = 1
        elif given.output == "-" or (standard and not given.output):
            sys.stdout.write(row.markdown)
        else:
            target = given.output or os.path.splitext(row.path.removeprefix("file:"))[0] + ".md"
            os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
            with open(target, "w", encoding="utf-8") as out:
                out.write(row.markdown)
    return code


if __name__ == "__main__":
    sys.exit(main())
