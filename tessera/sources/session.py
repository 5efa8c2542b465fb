"""Sessions: where plans run."""

from __future__ import annotations

from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "tessera", **conf: Any) -> SparkSession:
    """The active session, or a new one with adaptive execution on. Keys of conf may have _ for the dots."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k if "." in k else "spark." + k.replace("_", "."), str(v))
    return builder.getOrCreate()


@contextmanager
def Distributed(master: str | None = None, force_new: bool = False, **conf: Any):  # noqa: N802
    """A session for a block of code; an active one is used, and kept, unless force_new asks for one of its own settings
    over the same executors."""
    active = SparkSession.getActiveSession()
    if active is not None and not force_new:
        yield active
        return
    mine = active.newSession() if active is not None else session(master, **conf)
    for k, v in conf.items() if active is not None else ():
        mine.conf.set(k if "." in k else "spark." + k.replace("_", "."), str(v))
    try:
        yield mine
    finally:
        if active is None:
            mine.stop()


@contextmanager
def Serial():  # noqa: N802
    """A block of code in which shuffles have one partition; without an active session, one on a single thread."""
    active = SparkSession.getActiveSession()
    with Distributed(None if active else "local[1]", force_new=True, **{"spark.sql.shuffle.partitions": 1}) as mine:
        yield mine
