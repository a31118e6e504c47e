"""What jobs share: configuration, logging and the command line's session."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def load_config(spark: SparkSession, path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """A JSON object over ``defaults``; unknown names are an error. A path is on the driver's machine, a URI anywhere that Spark reads."""
    if "://" in path:
        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    given = json.loads(text)
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | given


def own_config(module_file: str) -> str:
    """The configuration file beside a job."""
    return os.path.abspath(module_file.removesuffix(".py") + ".json")


def run_alone(name: str, work: Callable[[SparkSession], None]) -> None:
    """For command lines only: makes a session, works, and stops it."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        work(spark)
    finally:
        spark.stop()
