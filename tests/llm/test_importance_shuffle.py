"""Importance resampling shuffles no texts of the target, and takes off what its filter passes wrongly."""

import random

import numpy as np

from roadloom.llm import importance


def test_target_texts_are_not_shuffled(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join(f"{r.getrandbits(48):x}" for _ in range(400)) for _ in range(1200)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    labels = spark.createDataFrame([(i, int(i < 600)) for i in range(800)], "doc_id long, quality int")
    store, before = spark.sparkContext._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    shuffled = lambda: sum(s.shuffleWriteBytes() for s in _stages(spark, store))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = shuffled()
        got = {x.doc_id: x.log_weight for x in importance.importance_resample(spark.read.parquet(f"{tmp_path}/d"), labels).collect()}
        moved = shuffled() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved < 0.4 * sum(map(len, texts))
    grams = [importance.gram_counts(t) for t in texts]
    share = lambda own: (np.bincount(np.concatenate(own), minlength=importance.BUCKETS) + 1.0) / (sum(map(len, own)) + importance.BUCKETS)
    ratio = np.log(share(grams[:600]) / share(grams))
    assert np.allclose([got[i] for i in range(1200)], [ratio[g].mean() for g in grams])


def _stages(spark, store):
    jvm = spark.sparkContext._jvm
    out = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [out.apply(i) for i in range(out.size())]
