"""Orderings are worked on in rounds: what lies on disk at once doesn't grow with their number."""

import os
import threading
import time

import numpy as np

from orestrata.llm.neighbours import Curves, most_similar
from orestrata.session import scratch_dir


def _frame(spark, n, dims):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, dims))
    x = (centres[rng.integers(0, 200, n)] + 0.5 * rng.standard_normal((n, dims))).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(4)


def _bytes(*folders):
    total = 0
    for f in (os.path.join(at, f) for top in folders for at, _, files in os.walk(top) for f in files):
        try:
            total += os.path.getsize(f)
        except OSError:
            pass  # dropped in the meantime
    return total


def test_disk_of_many_orderings(spark, tmp_path):
    n, dims = 6000, 256
    _frame(spark, n, dims).write.parquet(f"{tmp_path}/vectors")
    df = spark.read.parquet(f"{tmp_path}/vectors")
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [*(d.getPath() for d in blocks), scratch_dir(spark).removeprefix("file://")]
    spark._jvm.System.gc()
    time.sleep(1)
    floor, peak, over = _bytes(*folders), [0], threading.Event()

    def watch():
        while not over.is_set():
            peak[0] = max(peak[0], _bytes(*folders) - floor)
            time.sleep(0.02)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = most_similar(df, "id", "embedding", 5, dims, Curves(orderings=12, window=512, range_rows=512))
        found.write.format("noop").mode("overwrite").save()
    finally:
        over.set()
        watcher.join()
    # The vectors once, and three orderings with their borders; all at once are above 12 copies.
    copies = peak[0] / (n * dims * 2)
    assert 2 < copies < 8, copies


def test_least_leaves_out_only_what_is_below_it(spark):
    df = _frame(spark, 2000, 16)
    curves = Curves(orderings=5, window=256, range_rows=256)
    all_of = {(r.id, r.neighbour, r.rank) for r in most_similar(df, "id", "embedding", 6, 16, curves).where("cosine >= 0.8").collect()}
    assert all_of and all_of == {(r.id, r.neighbour, r.rank) for r in most_similar(df, "id", "embedding", 6, 16, curves, 0.8).collect()}
