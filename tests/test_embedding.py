"""The stand-in embedding: the vector of a text's hash, without the text in Python."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from intelspark.operators import retrieval


def test_vectors_of_hashes(spark):
    texts = ["one", "zwei é 中", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("t", retrieval.hash_embedding(8)("t").alias("e")).collect():
        values = np.random.default_rng(int(hashlib.sha256((row.t or "").encode()).hexdigest()[:16], 16)).uniform(-1.0, 1.0, 8)
        assert row.e == [float(x) for x in (values / np.linalg.norm(values)).astype("float32")]
    plan = df.select(retrieval.hash_embedding(8)(F.col("t"))).drop("t")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" in plan
