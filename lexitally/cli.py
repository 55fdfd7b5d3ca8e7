"""``python -m lexitally DUMP [K]``: the report of a dump, on standard output."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from lexitally.operators.counting import LARGEST_K
from lexitally.operators.report import progress
from lexitally.plans.word_frequency import analyze


def _count(text: str) -> int:
    if not (text.isascii() and text.isdigit() and int(text) <= LARGEST_K):
        raise argparse.ArgumentTypeError(f"must be a whole number from 0 to {LARGEST_K}")
    return int(text)


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


def main(argv: list[str] | None = None) -> int:
    """0 if the report was printed, 1 on wrong arguments or an input that can't be read.

    A session that wasn't there before is stopped at the end.
    """
    parser = _Parser(prog="lexitally", description=__doc__)
    parser.add_argument("dump", help="file, folder or glob that Spark can read")
    parser.add_argument("k", nargs="?", type=_count, default=100, help="how many words (100)")
    args, _ignored = parser.parse_known_args(argv)
    own = SparkSession.getActiveSession() is None
    spark = SparkSession.builder.appName("lexitally").getOrCreate()
    try:
        with progress(spark, sys.stdout) as articles:
            report = analyze(spark, args.dump, args.k, articles)
    except (PySparkException, OSError) as error:
        print(f"lexitally: can't read {args.dump}: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1
    finally:
        if own:
            spark.stop()
    print(report, end="")
    return 0
