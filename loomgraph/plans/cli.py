"""Command line: python -m loomgraph.plans.cli COMMAND ... Exit codes: 0 done, 1 failed, 2 wrong use, 3 ambiguous, 4 no index."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans.engine import AmbiguousTargetError, Engine, TargetNotFoundError
from loomgraph.render import reports, trees
from loomgraph.sources import files
from loomgraph.sources.store import NoIndexError

WEIGHTS = ("none", "loc", "churn", "hotspot", "fanin", "diff")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--repo", default=".")
    p.add_argument("--depth", type=int, default=3)
    p.add_argument("--min-confidence", type=float, default=0.0)
    p.add_argument("--weight", choices=WEIGHTS, default="none")
    p.add_argument("-o", "--output", choices=("tree", "folded", "json", "html", "mermaid", "dot", "table"), default="tree")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("--no-fence", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index")
    c.add_argument("--full", action="store_true")
    c.add_argument("--no-git", action="store_true")
    c.add_argument("--grammar-path")
    c = sub.add_parser("paths")
    c.add_argument("target")
    c.add_argument("--to")
    c.add_argument("--analyze", action="store_true")
    c = sub.add_parser("callers")
    c.add_argument("target")
    c.add_argument("--coupled", action="store_true")
    sub.add_parser("diff").add_argument("revisions", nargs="*")
    for name in ("branch", "explain-pr"):
        c = sub.add_parser(name)
        c.add_argument("name")
        c.add_argument("--base", default="main")
    sub.add_parser("map").add_argument("--top", type=int, default=50)
    c = sub.add_parser("hotspots")
    c.add_argument("--top", type=int, default=20)
    c.add_argument("--include-tests", action="store_true")
    c = sub.add_parser("coupled")
    c.add_argument("target")
    c.add_argument("--min", type=float, default=0.3)
    c.add_argument("--support", type=int, default=5)
    sub.add_parser("age")
    sub.add_parser("smells")
    sub.add_parser("explain").add_argument("target")
    sub.add_parser("skill")
    return p


def usage() -> str:
    """How a program may use this command line, as Markdown, from the parser itself."""
    p = parser()
    commands = next(a for a in p._actions if isinstance(a, argparse._SubParsersAction)).choices
    lines = ["# loomgraph", "", "Index a repository once (`index`), then ask. Answers are text, or JSON with `-o json`.", ""]
    for name, c in commands.items():
        lines.append(f"- `{' '.join(c.format_usage().removeprefix('usage: ').split())}`" if name != "skill" else "- `loomgraph skill`: this text")
    return "\n".join([*lines, "", __doc__.split("... ", 1)[1].strip()]) + "\n"


def rendered(root: trees.Node, args: argparse.Namespace, command: str, engine: Engine, linear: bool = False) -> str:
    fence = not args.no_fence
    match args.output:
        case "folded":
            return trees.folded([root])
        case "json":
            partners = [r.asDict() for r in engine.coupled(root.file).collect()]
            omitted = 0 if linear else engine.beyond(args.target, args.depth, command == "callers")
            return trees.to_json(command, args.target, args.depth, args.weight, [root], partners, omitted, engine.external_edges())
        case "html":
            return trees.page(f"{command} {root.name}", [root])
        case "mermaid":
            return trees.mermaid_sequence(root, fence) if linear else trees.mermaid_flowchart([root], "BT" if command == "callers" else "TD", fence)
        case "dot":
            return trees.dot_sequence(root, fence) if linear else trees.dot_flowchart([root], fence)
    return trees.tree([root], not args.no_color, args.depth)


def listed(df: DataFrame, args: argparse.Namespace, report: Callable[[list[dict]], str]) -> str:
    rows = [r.asDict() for r in df.collect()]
    return json.dumps(rows, default=str, indent=2) if args.output == "json" else report(rows)


def run(args: argparse.Namespace, engine: Engine) -> str:
    match args.command:
        case "index":
            return json.dumps(engine.index(args.full, not args.no_git, grammar_path=args.grammar_path))
        case "paths" if args.analyze and args.to:
            return listed(engine.signals(args.target, args.to, args.depth), args, reports.signals)
        case "paths" if args.to:
            steps = engine.path_to(args.target, args.to, args.depth, args.min_confidence).join(engine.symbols(), "id").orderBy("step").collect()
            if not steps:
                raise TargetNotFoundError(f"no path from {args.target} to {args.to}")
            below: list[trees.Node] = []
            for r in reversed(steps):
                below = [trees.Node(r["id"], r["name"], r["qualified"], r["path"], (r["span_start"], r["span_end"]), children=below)]
            return rendered(below[0], args, "paths", engine, linear=True)
        case "paths" | "callers":
            root = engine.tree(args.target, args.depth, args.min_confidence, args.command == "callers", args.weight)
            text = rendered(root, args, args.command, engine)
            if args.command == "callers" and args.coupled and args.output == "tree":
                text += reports.coupled([r.asDict() for r in engine.coupled(root.file).collect()])
            return text
        case "diff" | "branch":
            df = engine.diff(*args.revisions) if args.command == "diff" else engine.branch(args.name, args.base)
            nodes = [trees.Node(r["id"], r["name"], r["qualified"], r["path"], weight=r["weight"] if args.weight == "diff" else 0.0, mark=r["mark"]) for r in df.orderBy("qualified").collect()]
            return json.dumps([n.as_dict() for n in nodes]) if args.output == "json" else trees.tree(nodes, not args.no_color)
        case "map":
            df = engine.map(args.top, "churn" if args.weight == "none" else args.weight)
            if args.output == "tree":
                return trees.file_list([(r["path"], r["weight"]) for r in df.collect()])
            return listed(df, args, reports.overview)
        case "hotspots":
            return listed(engine.hotspots(args.top, args.include_tests), args, reports.hotspots)
        case "coupled":
            found = [r.asDict() for r in engine.coupled(args.target, args.min, args.support).collect()]
            if args.output in ("mermaid", "dot"):
                return (trees.mermaid_dependency if args.output == "mermaid" else trees.dot_dependency)(args.target, found, not args.no_fence)
            return json.dumps(found) if args.output == "json" else reports.coupled(found)
        case "age":
            return listed(engine.age(), args, reports.age)
        case "smells":
            df = engine.smells()
            if args.output in ("mermaid", "dot"):
                return (trees.mermaid_class if args.output == "mermaid" else trees.dot_class)([(r["subject"], r["kind"]) for r in df.collect()], not args.no_fence)
            return listed(df, args, reports.smells)
        case "explain":
            found = engine.explain(args.target)
            return json.dumps(found, default=str, indent=2) if args.output == "json" else reports.explain(found)
        case _:
            found = engine.explain_pr(args.name, args.base)
            return json.dumps(found, indent=2) if args.output == "json" else reports.pull_request(args.name, args.base, found)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.weight == "diff" and args.command not in ("diff", "branch"):
        print("--weight diff needs diff or branch", file=sys.stderr)
        return 2
    if args.command == "skill":
        print(usage(), end="")
        return 0
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    try:
        print(run(args, Engine(spark, files.find_repository(args.repo))))
    except AmbiguousTargetError as e:
        print(e, file=sys.stderr)
        return 3
    except NoIndexError as e:
        print(e, file=sys.stderr)
        return 4
    except (TargetNotFoundError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
