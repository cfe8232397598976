"""Command line: python -m matchloom list | run NAME DIR [--out PATH] [--rows N] | stages DIR."""

from __future__ import annotations

import argparse

from matchloom import session
from matchloom.plans import catalog, catalogue_stages


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="matchloom", description=__doc__)
    what = top.add_subparsers(dest="command", required=True)
    what.add_parser("list", help="names of all queries")
    one = what.add_parser("run", help="run a query over a folder of tables")
    one.add_argument("name", choices=sorted(catalog.queries()), metavar="NAME")
    one.add_argument("dir")
    one.add_argument("--out", help="write the whole result there as Parquet instead of showing some of it")
    one.add_argument("--rows", type=int, default=20, help="rows to show")
    what.add_parser("stages", help="run the five stages").add_argument("dir")
    return top


def main(args: list[str] | None = None) -> int:
    asked = parser().parse_args(args)
    if asked.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = session.get_session("matchloom")
    if asked.command == "stages":
        told = catalogue_stages.run(spark, asked.dir).collect()
        print("\n".join(f"{r['stage']}: {r['status']}, {r['rows']} rows" for r in told))
        return int(any(r["status"] != "success" for r in told))
    found = catalog.queries()[asked.name](spark, asked.dir)
    if asked.out:
        found.write.mode("overwrite").parquet(asked.out)
    else:
        found.show(asked.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
