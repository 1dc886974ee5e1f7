"""Compare every named query with its statement: python -m tests.oracle_check DIRECTORY [NAME ...]"""

from __future__ import annotations

import sys
import time

from floorledger.catalogue import QUERIES
from floorledger.session import local_session
from oracle.statements import STATEMENTS
from tests.compare import differences, duck


def main(directory: str, *names: str) -> int:
    spark, connection, wrong = local_session(), duck(directory), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = differences(QUERIES[name](spark, directory), connection, STATEMENTS[name])
        except Exception as error:  # report all queries, not the first failure
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        wrong += bool(problem)
        print(f"{'WRONG' if problem else 'ok':6}{name:28}{time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{wrong} wrong")
    return wrong


if __name__ == "__main__":
    sys.exit(min(main(*sys.argv[1:]), 1))
