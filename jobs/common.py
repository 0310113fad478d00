"""What the jobs share: config files, sessions of the command line, logging, and places of batches."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def config(spark: SparkSession, path: str) -> dict:
    """A small JSON object, read by Spark, so that it may lie where the data do."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def main(name: str, run: Callable, paths: tuple[str, ...], argv: list[str] | None = None) -> None:
    """The command line of a job: a config file, and options that go before its entries. Only this makes and stops a session."""
    top = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    top.add_argument("--config", default=f"jobs/{name}.json", help="JSON object with the arguments of the job")
    for x in paths:
        top.add_argument(f"--{x}")
    given = vars(top.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        settings = config(spark, given.pop("config")) | {k: v for k, v in given.items() if v is not None}
        run(spark, **settings)
    finally:
        spark.stop()
