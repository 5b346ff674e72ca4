"""Migrations against a ledger on disk: one run at a time, all of it recorded or nothing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.model import TABLES
from lodestone.operators import merge, versions

#: The ledger is a versioned table of one part.
_PART = "ledger"


class Untracked(Exception):
    """There is no ledger, or nothing in it: what has been applied is not known."""


class Locked(Exception):
    """Another run holds the lock."""


def _put(spark: SparkSession, path: str, rows: DataFrame) -> None:
    versions.replace_part(rows.select("name", "checksum", "applied_at", F.lit(_PART).alias("part")), path, _PART, "part")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(name, checksum, applied_at) of what has been applied; without a ledger an error."""
    schema = T.StructType([*TABLES["schema_migrations"].fields, T.StructField("part", T.StringType())])
    if not versions.current(spark, path):
        raise Untracked("migrations are not tracked here yet; check the tables and record a baseline")
    return versions.read(spark, path, schema).drop("part")


def baseline(available: DataFrame, path: str, at: Column | None = None) -> None:
    """Record migrations as applied without running them; a ledger that is there already is an error."""
    spark = available.sparkSession
    if versions.current(spark, path):
        raise ValueError("migrations are tracked here already")
    _put(spark, path, available.select("name", "checksum", (F.current_timestamp() if at is None else at).alias("applied_at")))


def migrate(available: DataFrame, path: str, run: Callable[[str], None], at: Column | None = None, wait: float = 0.0) -> list[str]:
    """Run the migrations the ledger lacks, by name, and record them together; their names.

    One run at a time: the lock is a file that is made if it is not there yet,
    and goes with the run; another run that holds it is waited for `wait`
    seconds. A changed checksum, a file that is missing and an untracked
    database are errors before anything runs. If one migration fails none is
    recorded. Files are few, so the driver goes through them.
    """
    spark, files = available.sparkSession, versions._Files(available.sparkSession, path)
    until = time.monotonic() + wait
    while not files.create("lock"):
        if time.monotonic() >= until:
            raise Locked(f"another run holds {path}/lock; if none does, it died, and the file can go")
        time.sleep(0.05)
    try:
        applied = ledger(spark, path)
        pending = [r["name"] for r in merge.pending_migrations(available, applied).collect()]
        for name in pending:
            run(name)
        if pending:
            fresh = available.where(F.col("name").isin(pending))
            _put(spark, path, merge.record_migrations(applied, fresh, F.current_timestamp() if at is None else at))
        return pending
    finally:
        files.delete("lock")
