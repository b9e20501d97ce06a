"""python -m lociflow --config FILE [--output DIR] [--seed N] [--verbose]"""

from __future__ import annotations

import argparse
import json

from lociflow.plans.pipeline import Config, run
from lociflow.session import get_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("lociflow", description="From variant calls to subtypes.")
    p.add_argument("--config", required=True)
    p.add_argument("--output")
    p.add_argument("--seed", type=int)
    p.add_argument("--verbose", action="store_true")
    a = p.parse_args(argv)
    c = Config.from_yaml(a.config)
    c.output, c.seed = a.output or c.output, c.seed if a.seed is None else a.seed
    spark = get_session()
    if not a.verbose:
        spark.sparkContext.setLogLevel("ERROR")
    print(json.dumps(run(spark, c), indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
