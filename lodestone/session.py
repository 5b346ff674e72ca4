"""Session settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}
#: Inheritance and import chains may be long and wide; path guards end cycles.
RECURSION = {"spark.sql.cteRecursionLevelLimit": "10000", "spark.sql.cteRecursionRowLimit": "2000000000"}


def build(app: str = "lodestone", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | RECURSION | settings).getOrCreate()


def allow_recursion(spark: SparkSession) -> SparkSession:
    for key, value in RECURSION.items():
        spark.conf.set(key, value)
    return spark


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package, wherever the driver was started; a cluster ships it."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark
