"""python -m checks.run [folder] [query ...]: compare and time the registered queries."""

import sys
import time

from tablewright.session import local_session

from .compare import difference, duck
from .registry import ALL


def main(arguments):
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    chosen = arguments[1:] or list(ALL)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    failed = 0
    for name in chosen:
        build, sql = ALL[name]
        started = time.time()
        try:
            frame = build(spark, folder)
            if sql is None:
                result = f"rows only: {frame.count()}"
            else:
                problem = difference(frame, connection, sql)
                result = problem or "ok"
        except Exception as error:  # report and go on to the next query
            result = f"{type(error).__name__}: {str(error)[:600]}"
        failed += result != "ok" and not result.startswith("rows only")
        print(f"{time.time() - started:6.2f}s {name}: {result}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
