"""A session with the settings that the engine expects, and the package for its workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def session(name: str = "syntarel", **conf: str) -> SparkSession:
    """Adaptive plans, UTC, Arrow; anything else is the cluster's choice or ``conf`` (dots as double underscores). The workers get the package."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Hands the package to all Python workers of a session, once; not needed where it is installed on every machine."""
    if spark.conf.get("spark.syntarel.shipped", None):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="syntarel-"), "syntarel"), "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("spark.syntarel.shipped", "true")
    return spark
