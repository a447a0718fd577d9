"""python -m coppice COMMAND TREE ...: import, reconcile, append, search, lint, doc-check, compile, apply, forget, split, move, new-root, export, init; and bench, without a tree."""

from __future__ import annotations

import argparse
import json
import sys

from . import api
from .plans import restructure
from .plans.store import Tree
from .sources import trees


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="coppice")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options):
        c = sub.add_parser(name)
        c.add_argument("tree")
        for a in args:
            c.add_argument(a.rstrip("+"), nargs="+" if a.endswith("+") else None)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", **v)

    for name in ("import", "reconcile", "compile", "resume"):
        command(name)
    command("append", "file", "branch", "text")
    command("search", "query", mode={"default": "auto"}, max={"type": int, "default": 25}, files={"nargs": "*"})
    command("doc-check", skip={"nargs": "*", "default": []})
    command("lint", fail_on_warn={"action": "store_true"})
    command("apply", "plan")
    command("forget", "leaf", reason={})
    command("split", "file", "branch", "names+")
    command("move", "source", "target", "branch", "selectors+")
    command("new-root", "name", "source", "branches+")
    command("export", "folder")
    command("init", "name")
    sub.add_parser("bench").add_argument("--leaves", type=int, default=300)
    a = p.parse_args(argv)
    if a.command == "bench":
        from pyspark.sql import SparkSession

        from .plans import recall

        print(json.dumps(recall.measure(SparkSession.builder.getOrCreate(), a.leaves), indent=1))
        return 0
    tree, out, code = Tree(a.tree), None, 0
    if a.command == "init":
        out = sorted(restructure.seed(a.tree, a.name).roots())
    elif a.command in ("search", "lint", "doc-check"):
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
        if a.command == "search":
            found = [r.asDict() for r in api.search(spark, a.tree, a.query, a.mode, a.files, a.max or 25).orderBy("rank").collect()]
            out, code = found, 0 if found else 1
        elif a.command == "doc-check":
            out = [r.asDict() for r in trees.check(spark, a.tree, tuple(a.skip)).orderBy("path", "link").collect()]
            code = 1 if out else 0
        else:
            out = [r.asDict() for r in api.findings(spark, a.tree).orderBy("level", "code", "msg").collect()]
            code = 1 if any(f["level"] == "error" or a.fail_on_warn for f in out) else 0
    elif a.command == "import":
        out = tree.import_()
    elif a.command == "reconcile":
        out = tree.reconcile()
        code = 3 if out["status"] == "conflict" else 0
    elif a.command == "append":
        out = tree.append(a.file, a.branch, a.text)
    elif a.command == "compile":
        out = restructure.compile_plan(tree)
    elif a.command == "apply":
        with open(a.plan) as f:
            out = restructure.apply_plan(tree, json.load(f))
    elif a.command == "forget":
        out = restructure.forget(tree, a.leaf, a.reason)
    elif a.command == "resume":
        out = restructure.resume_forgetting(tree)
    elif a.command == "split":
        out = restructure.split_branch(tree, a.file, a.branch, a.names)
    elif a.command == "move":
        out = restructure.move(tree, a.source, a.target, a.branch, a.selectors)
    elif a.command == "new-root":
        out = restructure.new_root(tree, a.name, a.source, a.branches)
    elif a.command == "export":
        out = tree.export(a.folder)
    print(json.dumps(out, ensure_ascii=False, indent=1, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
