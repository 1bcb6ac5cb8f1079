"""What the jobs share: configuration files, the command line and the log."""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
import uuid
from collections.abc import Callable, Iterator
from dataclasses import MISSING, fields

from pyspark.sql import DataFrame, SparkSession

from verdigraph.staging import shared_dir

log = logging.getLogger("verdigraph.jobs")


def configured(kind: type, text: str, /, **given):
    """A configuration of a dataclass from JSON; values given beside it win, unknown names raise."""
    values = json.loads(text) | {k: v for k, v in given.items() if v is not None}
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**values)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as __) for a while; what they were before comes back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that nobody else uses."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def main(description: str, kind: type, run: Callable[..., DataFrame]) -> None:
    """The command line of a job: a configuration file, and every plain setting of it as an option."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("config", help="JSON file with the job's settings, local or remote")
    for f in fields(kind):
        if f.default_factory is MISSING:  # tables of values are set in the file alone
            parser.add_argument(f"--{f.name.replace('_', '-')}", type=str if f.default is MISSING else type(f.default))
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(description).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        text = "\n".join(r[0] for r in spark.read.text(given.pop("config"), wholetext=True).collect())
        run(spark, configured(kind, text, **given))
    finally:
        spark.stop()
