"""What the near-copy stage shuffles: the prefixes of all texts once, most of which meet nothing."""

import numpy as np

from graincart.llm import jaccard


def shuffled_rows(spark):
    nothing = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, nothing, None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_prefixes_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST", 0)  # as on large tables
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *_: pairs)
    rng = np.random.default_rng(4)
    rows = [(int(k), e) for e in range(400) for k in rng.integers(0, 1 << 62, 100)] + [(7, 8), (7, 9)]
    prefixes = spark.createDataFrame(rows, "key long, entry long")
    entries = spark.createDataFrame([(e, e, 500, b"", *[0] * len(jaccard.PARITY)) for e in range(400)], "entry long, _key long, n int, sketch binary, " + ", ".join(f"{p} long" for p in jaccard.PARITY))
    before = shuffled_rows(spark)
    groups = jaccard.link_entries(entries, prefixes, None, "text").collect()
    assert sorted((r.node, r.component) for r in groups) == [(8, 8), (9, 8)]
    assert shuffled_rows(spark) - before < 1.5 * len(rows)


def test_buckets_of_equal_sets_are_one_with_their_number(spark):
    """Sets over several batches and parts, repeats left out."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = [(k, e) for k in (3, 5, -9) for e in range(70_000)] + [(4, 1), (4, 1), (6, 1), (6, 2), (6, 1), (8, 2), (8, 1)]
    dealt = spark.createDataFrame(rows, "key long, entry long").coalesce(1).sortWithinPartitions("key", "entry")
    found = dealt.mapInArrow(jaccard._buckets, "c long, x0 long, x1 long, part int, key long, entries array<long>").collect()
    assert {r.key: r.c for r in found} == {3: 70_000, 5: 70_000, -9: 70_000, 6: 2, 8: 2}
    for key, want in ((3, range(70_000)), (5, range(70_000)), (-9, range(70_000)), (6, (1, 2)), (8, (1, 2))):
        parts = sorted((r.part, r.entries) for r in found if r.key == key)
        assert [e for _, p in parts for e in p] == list(want) and all(len(p) <= jaccard.BLOCK for _, p in parts)
    assert len({(r.c, r.x0, r.x1) for r in found}) == 2
