"""python -m pitloom QUERY --base DIR [--out DIR] [--limit N]: runs a registered query, writes it or prints its first rows."""

from __future__ import annotations

import argparse

from pitloom.plans import general, reference
from pitloom.session import build_session


def main() -> None:
    queries = general.QUERIES | reference.QUERIES
    args = argparse.ArgumentParser(prog="pitloom")
    args.add_argument("query", choices=sorted(queries))
    args.add_argument("--base", required=True, help="folder with <table>.parquet")
    args.add_argument("--out", help="folder to write parquet to")
    args.add_argument("--limit", type=int, default=20, help="rows to print without --out")
    a = args.parse_args()
    df = queries[a.query](build_session(f"pitloom {a.query}"), a.base)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.limit, truncate=False)


if __name__ == "__main__":
    main()
