"""Command line: python -m tests.check [-s SF] [name ...]; checks queries against their SQL and prints times."""

from __future__ import annotations

import sys
import time
import traceback


def main() -> None:
    from albumloom.plans import load_all
    from albumloom.session import build_session
    from tests.harness import compare, duck

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["-s"]:
        sf = f"/root/testdata/sf{args[1]}"
        args = args[2:]
    entries = load_all()
    spark = build_session()
    con = duck(sf)
    bad = 0
    for name, e in entries.items():
        if args and not any(a in name or a in e.ids for a in args):
            continue
        t = time.time()
        try:
            if e.sql is None:
                n = len(e.run(spark, sf).collect())
                msg = None if n else "EMPTY RESULT"
                tag = f"rows {n}"
            else:
                msg = compare(spark, con, e, sf)
                tag = "sql"
        except Exception as ex:  # report and go on with the other queries
            msg = "".join(traceback.format_exception_only(ex))[:1500]
            tag = ""
        bad += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {name} {e.ids} {tag} {time.time() - t:.2f}s" + (f"\n   {msg}" if msg else ""), flush=True)
    print("failed", bad)


if __name__ == "__main__":
    main()
