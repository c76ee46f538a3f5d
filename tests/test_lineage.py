"""A materialised table leaves no shuffle files behind, and the session's setting stays as it was."""

import os
import time

from pyspark.sql import functions as F

from intelspark.session import SHUFFLE_CLEANUP, cut_lineage


def _shuffle_files(spark) -> set[str]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in dirs for _, _, files in os.walk(top.getPath()) for f in files if f.startswith("shuffle_")}


def test_shuffles_go_with_the_checkpoint(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    out = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    end = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert sum(r["n"] for r in out.collect()) == 1000
