"""Command line: build, parse, render, inspect, validate. Run as python -m quillmesh.cli."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
from datetime import UTC, datetime

from .plans import graph, pages
from .plans.model import Model, normalize
from .sources import export
from .sources.shred import read_exports
from .sources.store import Store


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quillmesh").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.sparkContext.master.startswith("local"):
        # one export on one machine: small tables
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    return spark


def load(spark, path: str, store: Store | None = None) -> Model:
    """The whole pipeline over a file, folder or glob: records, entities, references, warnings."""
    store = store or Store(spark)
    records = store.keep("records", read_exports(spark, path))
    return graph.analyse(normalize(records, store))


def full_path(path: str) -> str:
    """Environment variables and ~ expanded, made absolute; links stay."""
    return os.path.abspath(os.path.expanduser(os.path.expandvars(path)))


def input_file(path: str) -> str:
    path = full_path(path)
    if not os.path.isfile(path):
        sys.exit(f"Error: input file not found: {path}")
    return path


def output_folder(path: str, force: bool, ask=input) -> str:
    """An empty folder: a missing or empty one is fine, what is in another goes only by consent; the folder itself stays, links in it are only unlinked."""
    path = full_path(path)
    if os.path.exists(path) and not os.path.isdir(path):
        sys.exit(f"Error: output path is a file: {path}")
    held = os.listdir(path) if os.path.isdir(path) else []
    if held and not force and ask(f"{path} isn't empty; overwrite? [y/N] ").strip().lower() not in ("y", "yes"):
        sys.exit("Aborted.")
    for name in held:
        full = os.path.join(path, name)
        if os.path.isdir(full) and not os.path.islink(full):
            shutil.rmtree(full)
        else:
            os.unlink(full)
    os.makedirs(path, exist_ok=True)
    return path


def _now() -> tuple[str, str]:
    t = datetime.now(UTC)
    return t.strftime("%Y-%m-%d %H:%M UTC"), t.isoformat().replace("+00:00", "Z")


def show(model: Model) -> None:
    """Counts and the histogram of warnings."""
    for r in graph.entity_counts(model).collect():
        print(f"{r.entity:24}{r.n:>10}")
    print(f"{'references':24}{model.references.count():>10}")
    for r in graph.warning_histogram(model).collect():
        print(f"  {r.code:30}{r.n:>6}")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillmesh", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="pages and JSON of an export")
    b.add_argument("xml")
    b.add_argument("--out", "-o", default="design-docs")
    b.add_argument("--model-out")
    b.add_argument("--include-json", action=argparse.BooleanOptionalAction, default=True)
    b.add_argument("--strict", action="store_true", help="exit 1 if references are unresolved")
    q = sub.add_parser("parse", help="the model as JSON")
    q.add_argument("xml")
    q.add_argument("--out", "-o", default="build/model.json")
    r = sub.add_parser("render", help="pages from a model's JSON")
    r.add_argument("format", nargs="?", default="markdown")
    r.add_argument("--model", "-m", default="build/model.json")
    r.add_argument("--out", "-o", default="design-docs")
    for c in (b, r):
        c.add_argument("-f", "--force", "-y", "--yes", action="store_true", dest="force")
    for name, what in (("inspect", "counts and warnings"), ("validate", "exit 1 on any warning but unused fields")):
        sub.add_parser(name, help=what).add_argument("xml")
    a = p.parse_args(args)
    shown, exact = _now()

    if a.command == "render":
        source, out = input_file(a.model), output_folder(a.out, a.force)
        if a.format != "markdown":
            print(f"Error: unsupported format: {a.format}", file=sys.stderr)
            return 1
        spark = session()
        model = export.read_documents(spark, f"file://{source}", Store(spark))
        export.write_pages(pages.pages(model, shown), out)
        model.store.drop()
        return 0
    source = input_file(a.xml)
    out = output_folder(a.out, a.force) if a.command == "build" else None
    spark = session()
    model, code = load(spark, f"file://{source}"), 0
    if a.command == "parse":
        export.write_json(export.documents(model, exact), full_path(a.out))
    elif a.command == "build":
        if a.model_out:
            export.write_json(export.documents(model, exact), full_path(a.model_out))
        export.write_pages(pages.pages(model, shown), out)
        if a.include_json:
            export.write_split_json(model, out)
        show(model)
        code = int(a.strict and not model.references.where("confidence = 'unresolved'").isEmpty())
    elif a.command == "inspect":
        show(model)
    else:
        bad = model.warnings.where("code <> 'UNUSED_FIELD_CANDIDATE'")
        for w in bad.orderBy("phase", "place").toLocalIterator():
            print(f"{w.code}: {w.message}")
            code = 1
    model.store.drop()
    return code


if __name__ == "__main__":
    sys.exit(main())
