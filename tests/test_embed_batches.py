"""Texts reach the embedding step in batches that are bounded by bytes."""

from pyspark.sql import functions as F

from tallyweave import staging
from tallyweave.sources import files


def test_batches_hold_bytes_not_rows(spark, tmp_path):
    """4000 texts of 8000 characters in one task: 32 MB, which were one batch."""
    folder = str(tmp_path)

    def encode(texts):
        import os
        import sys

        frame = sys._getframe(1)
        with open(os.path.join(folder, "sizes"), "a") as f:
            f.write(f"{sum(map(len, frame.f_locals['texts']))}\n")
        return [[float(len(t))] for t in texts]

    rows = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 8000).alias("content"))
    assert files.embedded(rows, encode).where("embedding[0] = 8000 and embedding_error is null").count() == 4000
    assert max(map(int, (tmp_path / "sizes").read_text().split())) <= staging.BATCH_BYTES + 8000
