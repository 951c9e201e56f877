"""Command line: python -m depmill COMMAND PROJECT ..., one row a line as JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import security, simulate
from .plans.session import Session

#: What each what-if action must be told beside the file.
NEEDED = {"move": ("to",), "delete": (), "rename": ("to",), "split": ("names",), "merge": ("to",)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="depmill", description="Answers questions about a project's code graph.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, told: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=told)
        own.add_argument("project")
        own.add_argument("--exclude", action="append", default=[], metavar="GLOB")
        return own

    command("stats", "counts of files, symbols and references")
    command("search", "symbols by name").add_argument("text")
    impact = command("impact", "what depends on a symbol")
    impact.add_argument("symbol")
    impact.add_argument("--file")
    command("health", "score, grade and dimensions")
    dead = command("dead-code", "symbols that nothing refers to")
    dead.add_argument("--confidence", choices=("high", "medium", "low"), default="low")
    dead.add_argument("--include-tests", action="store_true")
    scan = command("security", "findings, worst first")
    scan.add_argument("--target")
    scan.add_argument("--class", dest="kind")
    scan.add_argument("--fail-on", choices=[k for k in security.RANK if k != "info"], help="exit with 1 on findings as severe")
    what = command("whatif", "what a change of files would change")
    what.add_argument("action", choices=NEEDED)
    what.add_argument("file")
    what.add_argument("--to")
    what.add_argument("--names", type=lambda x: tuple(n.strip() for n in x.split(",") if n.strip()), default=())
    command("docs", "the documents as Markdown")
    return top


def action(args: argparse.Namespace) -> simulate.Action:
    """The action asked for, or ValueError on what it lacks."""
    for name in NEEDED[args.action]:
        if not getattr(args, name):
            raise ValueError(f"{args.action} needs --{name}")
    return simulate.Action(args.action, args.file, args.to, args.names)


def outcome(found: simulate.Outcome) -> dict:
    """The summary of a what-if: sizes before and after, changed edges, broken imports, cycles and health."""
    cycles = {r["change"]: r["count"] for r in found.cycle_changes().groupBy("change").count().collect()}
    return {
        "nodes": [found.before.nodes.count(), found.after.nodes.count()], "edges": [found.before.edges.count(), found.after.edges.count()],
        "added_edges": found.added_edges.count(), "removed_edges": found.removed_edges.count(), "affected_symbols": found.affected_nodes().count(),
        "broken_imports": found.broken_imports.count(), "cycles_introduced": cycles.get("introduced", 0), "cycles_resolved": cycles.get("resolved", 0),
        "health": {r["dimension"]: [r["before"], r["after"]] for r in found.health_changes().collect()},
    }


def shown(rows: DataFrame) -> None:
    for x in rows.toJSON().toLocalIterator():
        print(x)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        change = action(args) if args.command == "whatif" else None
        session = Session(spark or SparkSession.builder.appName("depmill").getOrCreate())
        stats = session.connect(args.project, exclude=tuple(args.exclude))
        if args.command == "stats":
            shown(stats)
        elif args.command == "search":
            shown(session.search(args.text))
        elif args.command == "impact":
            shown(session.impact(args.symbol, args.file))
        elif args.command == "health":
            for rows in session.health():
                shown(rows)
        elif args.command == "dead-code":
            shown(session.dead_code(args.confidence, args.include_tests))
        elif args.command == "security":
            found = session.security(args.target, args.kind)
            shown(found)
            return int(bool(args.fail_on) and security.gate(found, args.fail_on))
        elif args.command == "whatif":
            print(json.dumps(outcome(session.simulate(change))))
        else:
            print("\n\n".join(session.documents().values()))
    except (ValueError, LookupError) as e:
        print(f"depmill: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
