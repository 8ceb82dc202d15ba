"""python -m tests.check [name-part ...]: compares queries with their oracles at sf0.01."""

import sys
import time
import traceback

import __spark_entry__ as entry
from lurewatch.session import local_session
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.01"


def main(parts):
    spark, con = local_session("8"), duck(FOLDER)
    oracles, bad = entry.oracle_sql(), []
    for name, build in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = build(spark, FOLDER)
            problem = difference(df, con, oracles[name]) if name in oracles else None
            note = "" if name in oracles else f"rows only: {df.count()}"
            if name in oracles and problem is None and con.execute(f"select count(*) from ({oracles[name]})").fetchone()[0] == 0:
                note = "EMPTY"
        except Exception:
            problem, note = traceback.format_exc(limit=-1)[-700:], ""
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - started:.1f}s {note} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
