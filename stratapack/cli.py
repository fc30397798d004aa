"""Command line: pack, extract, list, inspect and rename archives."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import scalars as S
from .operators import files as Files
from .sources import container, filetree, sinks


def session() -> SparkSession:
    return SparkSession.builder.appName("stratapack").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def tree(spark: SparkSession, targets: list[str], base: str | None, output: str | None):
    """Files of targets, the first of each path, without the output; and the rows that gave way."""
    files = filetree.scan(spark, targets, base)
    if output:
        files = Files.exclude_output(files, os.path.abspath(output))
    kept, dropped = Files.path_distinct(files, [F.col("target_ord"), F.col("walk_ord")])
    return kept.drop("target_ord", "walk_ord"), dropped


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratapack", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress", aliases=["c", "pack"])
    c.add_argument("targets", nargs="+")
    c.add_argument("-o", "--output")
    c.add_argument("-m", "--mode", choices=list(S.MODE_IDS), default="ultra")
    c.add_argument("-f", "--format", choices=list(S.FORMAT_EXT), default="drk")
    c.add_argument("--base")
    x = sub.add_parser("extract", aliases=["x"])
    x.add_argument("archive")
    x.add_argument("-o", "--output")
    x.add_argument("--only", nargs="*")
    for name, short in (("list", "l"), ("info", "i"), ("test", "t")):
        sub.add_parser(name, aliases=[short]).add_argument("archive")
    sub.add_parser("about")
    r = sub.add_parser("rename", aliases=["r"])
    r.add_argument("archive")
    r.add_argument("pairs", nargs="+", metavar="OLD=NEW")
    return p


def shown(spark: SparkSession, column, value):
    return spark.range(1).select(column(F.lit(value))).first()[0]


def run(args: list[str]) -> int:
    a = parser().parse_args(args)
    if a.command == "about":
        print(f"stratapack {__version__}: deduplicating archives as DataFrames; modes {', '.join(S.MODE_IDS)}; formats {', '.join(S.FORMAT_EXT)}")
        return 0
    spark = session()
    kind = a.command[0] if a.command != "pack" else "c"
    kind = {"extract": "x"}.get(a.command, kind)
    if kind == "c":
        name = a.output or spark.range(1).select(S.default_name(F.lit(a.targets[0]), F.lit(a.format))).first()[0]
        files, dropped = tree(spark, a.targets, a.base, name)
        result = sinks.pack_to(filetree.with_content(files), name, a.format, a.mode)
        print(f"{result['output']}: {result['file_count']} files, {shown(spark, S.humanize_bytes, result['raw_bytes'])} -> {shown(spark, S.humanize_bytes, result['comp_bytes'])}, {result['factor']:.2f}x, {result['saved_percent']:.1f} % saved")
        share = Files.precompressed_share(files).first()["share"]
        note = spark.range(1).select(S.compress_note(F.lit(result["saved_percent"]), F.lit(share))).first()[0]
        lost = dropped.count()
        for line in filter(None, [note, f"{lost} files left out: their path was taken" * bool(lost)]):
            print(line)
        return 0
    made = container.read(spark, a.archive)
    if kind == "x":
        dest = a.output or shown(spark, S.extract_dir_name, a.archive)
        names = spark.createDataFrame([(n,) for n in a.only], "rel_path string") if a.only else None
        n, size = sinks.extract_to(made.extract(names), dest).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        print(f"{dest}: {n} files, {shown(spark, S.humanize_bytes, size)}")
    elif kind == "l":
        for e in made.list().orderBy("file_ord").toLocalIterator():
            print(f"{e['raw_size']:>14} {e['rel_path']}")
    elif kind == "i":
        info = made.info().first().asDict()
        for k in ("file_count", "chunk_count", "block_count", "total_raw", "total_comp"):
            print(f"{k:14} {info[k]}")
        print(f"{'factor':14} {info['factor']:.2f}x\n{'saved':14} {info['saved_percent']:.1f} %")
    elif kind == "t":
        bad = made.extract().where(F.octet_length("content") != F.col("raw_size")).count()
        print("ok" if not bad else f"{bad} damaged entries")
        return int(bool(bad))
    else:
        pairs = [tuple(x.split("=", 1)) for x in a.pairs]
        renamed, report = made.rename(spark.createDataFrame(pairs, "old string, new string"))
        rows = report.collect()
        container.write(renamed, a.archive)
        for row in rows:
            print(f"{row['old']} -> {row['new']}: {row['outcome']}")
    return 0


def main() -> int:
    try:
        return run(sys.argv[1:])
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
