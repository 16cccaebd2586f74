"""python -m urlloom.sources.cli: query the URLs of files, of standard input, or one URL.

Files go through Spark. Standard input is a pipe of lines on one machine, so the kernel reads it line by line.
"""

from __future__ import annotations

import argparse
import sys

from ..functions.types import PARTS, getters
from ..kernel.show import diagram, dump
from ..kernel.url import parse


def line(text: str, part: str | None) -> str | None:
    """What is printed for a line of input: one part, or without any only lines that are no URLs."""
    url = parse(text)
    if url is None:
        return f"Invalid URL: {text}"
    return getters(url)[part] if part else None


def arguments(argv: list[str]) -> argparse.Namespace:
    a = argparse.ArgumentParser(prog="urlloom")
    a.add_argument("url", nargs="?", help="one URL")
    a.add_argument("-g", "--get", choices=PARTS, metavar="PART", help="print one part: " + ", ".join(PARTS))
    a.add_argument("-p", "--path", help="a file of lines, or a folder of such files")
    a.add_argument("-o", "--output", help="a folder for the lines that come out")
    a.add_argument("-d", "--diagram", action="store_true", help="print a diagram of one URL's offsets")
    a.add_argument("-b", "--benchmark", action="store_true", help="tell how fast all lines are validated")
    return a.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    if args.path:
        from pyspark.sql import SparkSession

        from .lines import invalid_lines, part_lines, read_lines, throughput, write_lines

        spark = SparkSession.builder.getOrCreate()
        lines = read_lines(spark, args.path)
        values = part_lines(lines, args.get) if args.get else invalid_lines(lines)
        if args.output:
            write_lines(values, args.output)
        elif not args.benchmark:
            for row in values.toLocalIterator():
                print(row.value)
        if args.benchmark:
            print(throughput(lines))
        return 0
    if args.url is None and not sys.stdin.isatty():
        sink = open(args.output, "w") if args.output else sys.stdout
        for text in sys.stdin:
            out = line(text.rstrip("\n"), args.get)
            if out is not None:
                print(out, file=sink)
        if args.output:
            sink.close()
        return 0
    if args.url is None:
        print("a URL or --path is needed", file=sys.stderr)
        return 2
    url = parse(args.url)
    if url is None:
        print("Invalid URL", file=sys.stderr)
        return 1
    print(getters(url)[args.get] if args.get else diagram(url) if args.diagram else dump(url))
    return 0


if __name__ == "__main__":
    sys.exit(main())
