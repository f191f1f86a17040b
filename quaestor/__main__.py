"""python -m quaestor list | execute QUERY SF_DIR OUT: runs a registered query and writes it as CSV."""

from __future__ import annotations

import argparse
import time

from quaestor import bindings
from quaestor.session import session
from quaestor.sources.files import write_csv


def main() -> None:
    parser = argparse.ArgumentParser(prog="quaestor")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("execute")
    run.add_argument("query", choices=sorted(bindings.QUERIES))
    run.add_argument("sf_dir")
    run.add_argument("out")
    args = parser.parse_args()
    if args.command == "list":
        print(*sorted(bindings.QUERIES), sep="\n")
        return
    began = time.time()
    write_csv(bindings.QUERIES[args.query](session(), args.sf_dir), args.out)
    print(f"{args.query}: {time.time() - began:.1f} s")


if __name__ == "__main__":
    main()
