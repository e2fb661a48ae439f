"""``python -m loomstone``: statements, tasks, queries and the service from a shell."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from loomstone.errors import EngineError
from loomstone.http import Service, plain, server
from loomstone.languages.commands import Session
from loomstone.model import Actor
from loomstone.shipping import ship
from loomstone.sources.jobs import TASKS, Runner
from loomstone.sources.storage import Store


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="loomstone", description=__doc__)
    what = p.add_subparsers(dest="what", required=True)
    run = what.add_parser("run", help="run one statement, or those of standard input, each ended by a line with a semicolon")
    run.add_argument("statement", nargs="?")
    run.add_argument("--tenant", required=True)
    run.add_argument("--user", default="legacy-query")
    task = what.add_parser("task", help="run a maintenance task as a job")
    task.add_argument("name", choices=sorted(TASKS))
    what.add_parser("inspect", help="print the manifest")
    what.add_parser("verify", help="print the ids of segments whose rows are not those that were published")
    serve = what.add_parser("serve", help="serve the catalog under --root")
    serve.add_argument("--port", type=int, default=8080)
    serve.add_argument("--token")
    for each in what.choices.values():
        each.add_argument("--root", required=True, help="folder of the store, or of the catalog to serve")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    spark = ship(spark or SparkSession.builder.appName("loomstone").getOrCreate())
    if a.what == "serve":
        server(Service(spark, a.root, a.token), a.port).serve_forever()
        return 0
    store = Store(spark, a.root)
    try:
        if a.what == "run":
            session = Session(store, Actor(a.tenant, a.user))
            for statement in [a.statement] if a.statement else [s for s in sys.stdin.read().split("\n;\n") if s.strip()]:
                print(json.dumps(plain(session.run(statement))))
        elif a.what == "task":
            print(json.dumps(plain(Runner(store).run(a.name, int(time.time() * 1000)))))
        else:
            print(json.dumps(store.manifest() if a.what == "inspect" else {"damaged": store.verify()}))
    except EngineError as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
