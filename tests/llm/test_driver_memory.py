"""What the driver's Python holds while operators learn."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from arrayflow.llm import common, toxicity


def test_toxicity_is_fitted_outside_the_driver(spark):
    common.tune(spark)
    prose = F.expr("concat_ws(' ', transform(sequence(1, 400), x -> concat('w', pmod(xxhash64(id, x), 5000))))")
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(prose, F.lit(" vilest of words"))).otherwise(prose).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    tracemalloc.start()
    try:
        field = toxicity.fit_field(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # The weights are 2 MB; with texts and features in the driver it was 73 MB.
    assert peak < 12e6
    rows = docs.join(labels, "doc_id").orderBy("doc_id", "text").collect()
    wanted = toxicity.fit([r["text"] for r in rows], [r["toxic"] for r in rows])
    assert wanted.words.any()
    for got, own in zip(field, wanted, strict=True):
        assert np.allclose(got, own, rtol=1e-9, atol=1e-12)
