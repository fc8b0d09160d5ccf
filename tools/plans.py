"""Plan every registered query and report operators that should not appear, and optionally print one plan.

    python tools/plans.py [--sf 0.01] [name-prefix ...] [--show]
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfline.plans import registry  # noqa: E402
from shelfline.session import local_session  # noqa: E402

SUSPECT = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"]


def plan_text(df, mode: str = "formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.001")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = local_session()
    found = 0
    for n, run in registry.all_queries().items():
        if a.names and not any(n.startswith(p) for p in a.names):
            continue
        text = plan_text(run(spark, f"/root/testdata/sf{a.sf}"))
        hits = [s for s in SUSPECT if s in text]
        scans = len(re.findall(r"^\(\d+\) Scan ", text, re.M))
        shuffles = len(re.findall(r"^\(\d+\) Exchange$", text, re.M))
        single = len(re.findall(r"Arguments: SinglePartition", text))
        print(f"{n}: scans={scans} shuffles={shuffles} single={single} {' '.join(hits)}", flush=True)
        found += bool(hits)
        if a.show:
            print(text)
    print(f"suspect plans: {found}")
    return 1 if found else 0


if __name__ == "__main__":
    sys.exit(main())
