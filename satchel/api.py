"""Create, list, extract and verify, as calls and as a command line."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.operators import manifest
from satchel.operators.patterns import Pattern, mark_unpacked, select
from satchel.sources.archive import read_archive, write_archive
from satchel.sources.files import read_files
from satchel.sources.sinks import contents, extract, write_dump

log = logging.getLogger("satchel")


def create(spark: SparkSession, archive: str, roots: Iterable[str], exclude: Iterable[str | Pattern] = (), unpack: Iterable[str | Pattern] = (), kind: str | None = None, compress: bool = False, integrity: bool = False) -> None:
    """An archive of files and folders; kind by suffix (.asar, .bsar, .baz, .c, .h), else bsar."""
    out: DataFrame | None = None
    for root in roots:
        one = read_files(spark, root, content=True).withColumn("unpacked", F.lit(False))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("nothing to archive")
    found = mark_unpacked(select(out, exclude=exclude), unpack)
    if kind == "cdump" or kind is None and archive.endswith((".c", ".h")):
        order = found.orderBy(F.split("path", "/")).withColumn("ordinal", F.monotonically_increasing_id())
        plain = F.struct(F.lit(0).alias("algorithm"), F.lit(0).cast("long").alias("original_size"))
        if compress:
            from satchel.operators.codec import deflate

            order = order.withColumn("original", F.col("size")).withColumn("content", deflate(F.col("content"))).withColumn("size", F.octet_length("content").cast("long"))
            plain = F.struct(F.lit(1).alias("algorithm"), F.col("original").alias("original_size"))
        write_dump(order.withColumn("compression", plain), archive)
        return
    options = {"kind": kind} if kind else {}
    write_archive(found, archive, compress=str(compress).lower(), integrity=str(integrity).lower(), **options)


def members(spark: SparkSession, archive: str, include: Iterable[str | Pattern] = (), exclude: Iterable[str | Pattern] = (), paths: Iterable[str] = (), content: bool = False) -> DataFrame:
    return select(read_archive(spark, archive, content), include, exclude, paths)


def listing(spark: SparkSession, archive: str, verbose: bool = False, **selection) -> DataFrame:  # noqa: ANN003
    return manifest.listing(members(spark, archive, **selection), verbose)


def extract_to(spark: SparkSession, archive: str, destination: str = ".", keep_existing: bool = False, check: bool = False, **selection) -> DataFrame:  # noqa: ANN003
    found = members(spark, archive, content=True, **selection)
    done = extract(found, destination, keep_existing, check)
    damaged = done.where("action = 'damaged'").count() if check else 0
    if damaged:
        raise ValueError(f"{damaged} members are damaged and were not written")
    return done


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="satchel", description="File archives as tables")
    mode = p.add_mutually_exclusive_group(required=True)
    mode.add_argument("-c", "--create", action="store_true")
    mode.add_argument("-t", "--list", action="store_true")
    mode.add_argument("-x", "--extract", action="store_true")
    p.add_argument("-f", "--file", required=True)
    p.add_argument("-k", "--keep-old-files", action="store_true")
    p.add_argument("-C", "--directory")
    p.add_argument("-O", "--to-stdout", action="store_true")
    p.add_argument("-X", "--exclude-from", action="append", default=[])
    p.add_argument("--include-from", action="append", default=[])
    style = {"anchored": False, "literal": False}

    class Add(argparse.Action):
        def __call__(self, parser, ns, value, option=None):  # noqa: ANN001
            getattr(ns, self.dest).append(Pattern(value, **style))

    class Style(argparse.Action):
        def __call__(self, parser, ns, value, option=None):  # noqa: ANN001
            style.update({"--anchored": {"anchored": True}, "--no-anchored": {"anchored": False}, "--wildcards": {"literal": False}, "--no-wildcards": {"literal": True}}[option])

    for name in ("exclude", "include", "unpack"):
        p.add_argument(f"--{name}", action=Add, default=[])
    for name in ("--anchored", "--no-anchored", "--wildcards", "--no-wildcards"):
        p.add_argument(name, action=Style, nargs=0)
    p.add_argument("-z", dest="compress", action="store_const", const="DEFLATE")
    p.add_argument("--compress", nargs="?", const="DEFLATE", choices=["DEFLATE"])
    p.add_argument("--integrity", nargs="?", const="SHA256", choices=["SHA256"])
    p.add_argument("-b", dest="format", action="store_const", const="bsar")
    p.add_argument("-o", dest="format", action="store_const", const="asar")
    p.add_argument("-d", dest="format", action="store_const", const="cdump")
    p.add_argument("--format", choices=["asar", "bsar", "baz", "cdump"])
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("paths", nargs="*")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.ERROR if a.quiet else logging.INFO)
    if not a.extract and (a.directory or a.to_stdout):
        p.error("-C and -O go with -x")
    if a.create and (a.include or a.include_from):
        p.error("inclusions do not go with -c")
    for files, into in ((a.exclude_from, a.exclude), (a.include_from, a.include)):
        for name in files:
            with open(name) as f:
                into += [Pattern(t, **style) for t in map(str.strip, f) if t and not t.startswith("#")]
    from satchel.session import session

    spark = session()  # the master is spark-submit's, or all cores of this machine
    chosen = {"include": a.include, "exclude": a.exclude, "paths": a.paths}
    try:
        if a.create:
            create(spark, a.file, a.paths, a.exclude, a.unpack, a.format, bool(a.compress), bool(a.integrity))
            if (a.format or "") != "cdump" and not a.file.endswith((".c", ".h")):
                for r in listing(spark, a.file, a.verbose).toLocalIterator():
                    print(r.line)
        elif a.list:
            for r in listing(spark, a.file, a.verbose, **chosen).toLocalIterator():
                print(r.line)
        elif a.to_stdout or a.directory == "-":
            for b in contents(members(spark, a.file, content=True, **chosen)):
                sys.stdout.buffer.write(b)
        else:
            done = extract_to(spark, a.file, a.directory or ".", a.keep_old_files, bool(a.integrity), **chosen)
            for r in done.orderBy("path").toLocalIterator():
                log.info("%s", {"written": r.line if a.verbose else r.path, "kept": f"keeping existing file: {r.path}"}.get(r.action, r.path))
    except (ValueError, OSError) as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
