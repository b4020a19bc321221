"""Groups of equal texts keep together in shards, as far as quotas let them."""

from collections import Counter

from graincart.llm import sharding


def test_groups_above_and_below_the_quota_keep_together(spark):
    texts = ["above"] * 8000 + ["below"] * 900 + [f"pair {i // 2}" for i in range(8000)] + [f"single {i}" for i in range(7100)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")  # 24,000 rows: quotas of 1,000
    shards = {r.doc_id: r.shard for r in sharding.shard_documents(table).collect()}

    def share(first, last):
        n = last - first
        return sum(c * (c - 1) for c in Counter(shards[i] for i in range(first, last)).values()) / (n * (n - 1))

    above, below = share(0, 8000), share(8000, 8900)
    assert above >= 0.9 * 0.125, above
    assert below >= 0.8, below
