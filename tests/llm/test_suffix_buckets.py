"""Anchors are the smallest of many hashes; their buckets must be of like size all the same."""

import random

import numpy as np
from pyspark.sql import functions as F

from intelspark.llm import suffixes


def test_buckets_are_of_like_size(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices("abcdefghij ", k=4000))) for i in range(60)]
    blocks = suffixes._contexts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 16)
    size = [r["n"] for r in blocks.groupBy("bucket").agg(F.sum(F.octet_length("block")).alias("n")).collect()]
    assert len(size) == 16 and max(size) < 1.5 * sum(size) / 16


def test_planes_give_back_the_numbers():
    for kind in (np.uint32, np.int64, np.uint64):
        values = np.array([0, 1, 255, 256, 70000, 2**31 - 1], kind)
        back = suffixes._whole(suffixes._planes(values), kind)
        assert back.dtype == values.dtype and (back == values).all()
