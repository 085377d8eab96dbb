"""What the jobs share: configuration and the command line."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import SparkSession

from kmerloom.session import session

log = logging.getLogger("kmerloom.jobs")


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """The JSON object stored under ``path`` (anywhere Spark reads from) over ``defaults``."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if unknown := given.keys() - defaults.keys():
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | given


def main(run: Callable, defaults: dict, argv: list[str] | None, inputs: tuple[str, ...], about: str) -> None:
    """Parses paths, starts a session, runs the job and stops the session."""
    p = argparse.ArgumentParser(description=about)
    for name in (*inputs, "output"):
        p.add_argument(f"--{name}", required=True, help="path")
    p.add_argument("--config", help="path of a JSON file")
    o = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(f"kmerloom {os.path.basename(about)}")
    try:
        config = read_config(spark, o["config"], defaults) if o["config"] else defaults
        run(spark, *(o[name] for name in inputs), o["output"], config)
    finally:
        spark.stop()
