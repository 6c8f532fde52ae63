"""``python -m tarnwell``: run, explain, profile, check a policy, show the environment."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from tarnwell.errors import TarnwellError


def _session():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def _service(args):
    from tarnwell.governance.policy import BASELINE, Subject, load_policy
    from tarnwell.service import Service

    policy = load_policy(args.policy) if args.policy else BASELINE
    subject = Subject(args.user or "anonymous", tuple(args.role or ()))
    return Service(_session(), policy, enforced=not args.unsafe_disable_policy), subject


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("tarnwell", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "explain"):
        p = commands.add_parser(name)
        p.add_argument("pipeline")
        p.add_argument("--policy")
        p.add_argument("--role", action="append")
        p.add_argument("--as", dest="user")
        p.add_argument("--head", type=int, default=20)
        p.add_argument("--json", action="store_true")
        p.add_argument("--quiet", action="store_true")
        p.add_argument("--unsafe-disable-policy", action="store_true", help="no rules, masks or egress checks; for local debugging only")
    p = commands.add_parser("profile")
    p.add_argument("path", help="a file, a folder of Parquet, or sqlite:PATH")
    p.add_argument("--table", help="of a database")
    p.add_argument("--json", action="store_true")
    p = commands.add_parser("policy")
    p.add_argument("path")
    p = commands.add_parser("examples")
    p.add_argument("--show", metavar="NAME")
    p.add_argument("--write", nargs=2, metavar=("NAME", "PATH"))
    p = commands.add_parser("workbench")
    p.add_argument("folder", nargs="?", default=".")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8765)
    p.add_argument("--policy")
    commands.add_parser("engines")
    commands.add_parser("doctor")
    commands.add_parser("version")
    args = parser.parse_args(argv)
    try:
        return _COMMANDS[args.command](args)
    except (TarnwellError, OSError, ValueError, TypeError) as e:
        print(f"{getattr(e, 'kind', type(e).__name__)}: {e}", file=sys.stderr)
        return 1


def _run(args) -> int:
    from tarnwell.plans.nodes import load_pipeline

    service, subject = _service(args)
    result = service.run(load_pipeline(args.pipeline), subject)
    rows = [r.asDict() for r in result.df.limit(args.head).collect()] if not args.quiet else []
    if args.json:
        print(json.dumps({"columns": result.schema.names, "rows": rows, "events": [e["event"] for e in result.events]}, default=str))
    else:
        for r in rows:
            print("\t".join(str(v) for v in r.values()))
    return 0


def _explain(args) -> int:
    from tarnwell.plans.nodes import load_pipeline

    service, subject = _service(args)
    print(service.explain(load_pipeline(args.pipeline), subject))
    return 0


def _profile(args) -> int:
    from tarnwell import profile

    kind = {".csv": "csv", ".json": "json", ".jsonl": "json", ".xlsx": "excel"}.get(os.path.splitext(args.path)[1].lower(), "parquet")
    if args.path.startswith("sqlite:"):
        found = profile.profile_sqlite(args.path.removeprefix("sqlite:"), args.table or "")
    else:
        found = getattr(profile, f"profile_{kind}")(args.path)
    out = {"rows": found.rows, "exact": found.exact, "provenance": found.provenance, "columns": [{"name": c.name, "type": c.type, "nulls": c.nulls} for c in found.columns]}
    print(json.dumps(out) if args.json else "\n".join([f"{found.rows} rows ({found.provenance})", *[f"{c.name}\t{c.type}\tnulls {c.nulls}" for c in found.columns]]))
    return 0


def _policy(args) -> int:
    from tarnwell.governance.policy import load_policy

    print(load_policy(args.path))
    return 0


def _doctor(args) -> int:
    spark = _session()
    print(f"Spark {spark.version}, {spark.sparkContext.defaultParallelism} cores, master {spark.sparkContext.master}")
    return 0


#: Pipelines to begin with: name -> source.
EXAMPLES = {
    "totals": """from tarnwell.plans.expr import count, sum_
from tarnwell.plans.nodes import group_by, parquet, sort


def build():
    orders = parquet("orders.parquet", name="orders")
    return sort(group_by(orders, "o_orderstatus", aggs={"n": count(), "total": sum_("o_totalprice")}), "total desc")
""",
    "clean": """from tarnwell.plans.nodes import csv, deduplicate, handle_nulls, quality_check, write_parquet


def build():
    people = deduplicate(csv("people.csv"), "id", keep="last", order_by=("id",))
    checked = quality_check(handle_nulls(people, "drop", "id"), {"id": ("not_null", "unique")})
    return write_parquet(checked, "people.parquet")
""",
}


def _examples(args) -> int:
    if args.write:
        name, path = args.write
        Path(path).write_text(EXAMPLES[name] if name in EXAMPLES else _no_example(name))
    elif args.show:
        print(EXAMPLES[args.show] if args.show in EXAMPLES else _no_example(args.show))
    else:
        print("\n".join(EXAMPLES))
    return 0


def _no_example(name: str):
    raise ValueError(f"no example {name!r}; there are {', '.join(EXAMPLES)}")


def _workbench(args) -> int:
    from tarnwell.governance.policy import BASELINE, load_policy
    from tarnwell.service import Service
    from tarnwell.workbench import Workbench

    with Workbench(Service(_session(), load_policy(args.policy) if args.policy else BASELINE), args.folder, args.host, args.port) as server:
        print(f"http://{args.host}:{server.server_address[1]}/")
        server.serve_forever()
    return 0


def _engines(args) -> int:
    from tarnwell.sources.readers import READERS

    spark = _session()
    print(f"spark {spark.version}: every plan; sources {', '.join(sorted(READERS))}")
    return 0


def _version(args) -> int:
    from tarnwell import __version__

    print(__version__)
    return 0


_COMMANDS = {"examples": _examples, "workbench": _workbench, "engines": _engines, "run": _run, "explain": _explain, "profile": _profile, "policy": _policy, "doctor": _doctor, "version": _version}
