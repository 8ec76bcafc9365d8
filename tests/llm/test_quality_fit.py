"""The forest's threshold is taken over all labelled rows, however many."""

import numpy as np
from pyspark.sql import functions as F

from helixweave.llm import quality


def test_threshold_is_exact_over_all_labelled_rows(spark):
    n = 24_000
    ids = spark.range(n).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()["doc_id"]
    rng = np.random.default_rng(1)
    rows = []
    for k, i in enumerate(ids):  # those of the largest hashes differ from all before
        far = k >= 22_000
        words = int(rng.integers(50, 500))
        rows.append((int(i), words, int(words * rng.uniform(4, 6)), int(rng.integers(0, 5)) + 200 * far, int(rng.integers(0, 3)), 0, int(k % 7 > 0)))
    frame = spark.createDataFrame(rows, ["doc_id", *quality.STATS, "quality"])
    forest = quality.fit(frame.drop("quality"), frame.select("doc_id", "quality"))
    a = np.array(rows, np.int64)
    good = a[a[:, -1] > 0]
    scores = forest.scores(quality.shape(good[:, 1:-1]))
    loss = int(0.002 * len(good))
    assert (scores > forest.threshold).sum() <= loss < (scores >= forest.threshold).sum()
