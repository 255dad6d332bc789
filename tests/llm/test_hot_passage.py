import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lakeweave.llm import passages


def test_a_passage_of_many_documents_needs_no_memory_by_occurrence(spark):
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefghijklmnop"), 400))
    docs = spark.range(30_000).select("id", F.lit(0).alias("th"), F.lit(passage).alias("text")).coalesce(8)
    held = [(r.n, r.pieces) for r in passages._dealt(docs, 1).collect()]
    total = sum(n for n, _ in held)
    tracemalloc.start()
    spans = list(passages._spans(held))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    covered = {}
    for i, _, a, b in np.concatenate(spans).tolist():
        covered.setdefault(i, []).append((a, b))
    assert 0 not in covered and len(covered) == 29_999 and all(passages._merged(x) == [(0, 400)] for x in covered.values())
    assert total > 300_000 and peak < 200 * total
