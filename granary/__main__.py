"""python -m granary ingest|search ...: the command line."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from granary.engine import Engine
from granary.operators import paraphrase
from granary.plans import ingest
from granary.server import serve
from granary.session import session
from granary.sources.config import Ingest


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="granary")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest", help="files to tables")
    one.add_argument("--src", nargs="+", required=True)
    one.add_argument("--base", required=True)
    one.add_argument("--config")
    one.add_argument("--only", choices=ingest.STAGES)
    one.add_argument("--paraphrase", action=argparse.BooleanOptionalAction, help="the rewriting stage, whatever the settings say")
    one.add_argument("--style", default="")
    one.add_argument("--rewriter", help="URL of a completion server")
    two = sub.add_parser("search", help="hybrid retrieval")
    two.add_argument("--base", required=True)
    two.add_argument("--top-k", type=int, default=10)
    two.add_argument("query", help="- reads one query a line from standard input")
    three = sub.add_parser("serve", help="HTTP")
    three.add_argument("--base", required=True)
    three.add_argument("--host", default="127.0.0.1")
    three.add_argument("--port", type=int, default=8000)
    args = parser.parse_args(argv)
    engine = Engine(session(), args.base)
    if args.command == "serve":
        serve(engine, args.host, args.port).serve_forever()
    elif args.command == "ingest":
        config = Ingest.load(args.config) if args.config else Ingest()
        if args.paraphrase is not None:
            config = replace(config, enable_paraphrase=args.paraphrase)
        client = paraphrase.http_client(args.rewriter) if args.rewriter else None
        print(json.dumps(engine.ingest(args.src, config=config, only=args.only, style=args.style, client=client)))
    else:
        asked = [x.strip() for x in sys.stdin] if args.query == "-" else [args.query]
        rows = engine.spark.createDataFrame([(i, q) for i, q in enumerate(asked) if q], "qid int, query string")
        for row in engine.retrieve(rows, args.top_k).orderBy("qid", "rank").collect():
            print(f"{row['rank']}. {row['score']:.4f} {row['id']}  {row['text'][:140]!r}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
