"""``python -m folioflow clean FOLDER -o OUT`` and ``python -m folioflow export FOLDER -o OUT``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from folioflow.session import cut


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folioflow", description=__doc__)
    kinds = top.add_subparsers(dest="what", required=True)
    clean = kinds.add_parser("clean", help="clean a vault of exported notes")
    export = kinds.add_parser("export", help="render section files as notes")
    for p in (clean, export):
        p.add_argument("source")
        p.add_argument("-o", "--output")
        p.add_argument("--skip", default="", help="steps to leave out, with commas between them")
        p.add_argument("--renames", help="a rename file")
    clean.add_argument("--only", default="")
    clean.add_argument("--in-place", action="store_true")
    clean.add_argument("--dry-run", action="store_true")
    clean.add_argument("--report")
    export.add_argument("--versions", action="store_true")
    export.add_argument("--tidy", action="store_true", help="clean what is exported")
    return top


def wants_clean(a: argparse.Namespace) -> bool:
    """Whether an export is to be cleaned: any option of the clean-up asks for it."""
    return bool(a.tidy or a.skip or a.renames)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("folioflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return clean(spark, a) if a.what == "clean" else export(spark, a)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _options(spark: SparkSession, a: argparse.Namespace, **more):
    from folioflow.plans.cleanup import Options
    from folioflow.sources.notes import read_renames

    names = lambda text: frozenset(x.strip() for x in text.split(",") if x.strip())
    return Options(skip=names(a.skip), only=names(getattr(a, "only", "")), renames=read_renames(spark, a.renames) if a.renames else None, **more)


def clean(spark: SparkSession, a: argparse.Namespace) -> int:
    from folioflow.plans import cleanup as cl
    from folioflow.sources import export as ex

    source = a.source.rstrip("/")
    if a.in_place and a.output:
        print("error: either --in-place or -o", file=sys.stderr)
        return 2
    output = f"{source}.cleaned" if a.in_place else (a.output or f"{source}-tidy").rstrip("/")
    if not ex.exists(spark, source) or f"{output}/".startswith(f"{source}/") or not a.dry_run and ex.exists(spark, output):
        print("error: the source must be a folder, the output outside of it and new", file=sys.stderr)
        return 2
    result = cl.clean_folder(spark, source, _options(spark, a))
    cl.write_report(result, a.report or f"{source if a.in_place else output}-tidy-report")
    if not a.dry_run:
        cl.write(result, source, output)
        if a.in_place:
            print(f"the original is kept as {ex.in_place(spark, source, output)}")
    return 0


def export(spark: SparkSession, a: argparse.Namespace) -> int:
    """Sections of all notebooks below a folder as notes, through a staging folder; with ``--tidy`` only the clean result stays."""
    from folioflow.plans import cleanup as cl
    from folioflow.sources import export as ex
    from folioflow.sources.notebooks import notebook_files

    output = (a.output or "notes").rstrip("/")
    files = cut(notebook_files(spark, a.source, a.versions))
    if files.isEmpty():
        print("no section files found", file=sys.stderr)
        return 1
    if ex.exists(spark, output):
        print(f"error: {output} is there already", file=sys.stderr)
        return 2
    if not wants_clean(a):
        ex.write_files(files, output)
        return 0
    staged = f"{output}.export"
    ex.remove(spark, staged)
    try:
        ex.write_files(files, staged)
        result = cl.clean_folder(spark, staged, _options(spark, a, keep_versions=a.versions))
        cl.write_report(result, f"{output}-tidy-report")
        cl.write(result, staged, output)
    finally:
        ex.remove(spark, staged)
    return 0


if __name__ == "__main__":
    sys.exit(main())
