"""Command line: python -m kinweave.plans.cli DATASET, with the search's parameters as options."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from kinweave.functions.scorers import ScoringMethod
from kinweave.operators.ranking import ScoringParams
from kinweave.operators.similarity import SearchParams
from kinweave.plans.pipeline import Analysis, run_transfers
from kinweave.runtime import session

#: Fixed value: the identity that an analysis asks for, unlike a search on its own.
DEFAULTS = {"min_identity": 0.59}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Similarity-network analysis of a dataset folder.")
    p.add_argument("dataset")
    for f in fields(SearchParams):
        p.add_argument(f"--{f.name}", type=type(f.default), default=DEFAULTS.get(f.name, f.default))
    p.add_argument("--method", type=ScoringMethod, choices=list(ScoringMethod), default=ScoringParams().method)
    p.add_argument("--transfers", action="store_true", help="also run the track by taxon pair")
    args = p.parse_args(argv)
    try:
        search = SearchParams(**{f.name: getattr(args, f.name) for f in fields(SearchParams)})
        a = Analysis(session(), args.dataset, search, ScoringParams(method=args.method))
        print(a.report(a.run()))
        if args.transfers:
            run_transfers(a.spark, args.dataset)["breakdown"].show(50, truncate=False)
        a.close()
    except Exception as e:  # the exit code tells callers
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
