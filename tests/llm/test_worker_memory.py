"""What Python workers hold: batches bounded by bytes, one operator's objects at a time."""

import weakref

import public_tokenizers
from pyspark.sql import functions as F

from graincart.llm import langid, packing
from graincart.llm.common import BATCH_BYTES, TOKENIZER, configure


def test_batches_of_long_texts_end_by_bytes(spark):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    configure(spark)
    texts = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    found = texts.mapInArrow(sizes, "n long, bytes long").agg(F.sum("n").alias("n"), F.max("bytes").alias("most")).first()
    assert found.n == 300 and found.most <= BATCH_BYTES + 200_000


def test_language_id_frees_the_encoder_of_packing():
    path = str(public_tokenizers.path(TOKENIZER))
    held = weakref.ref(packing.encoder(path))
    assert packing.encoder(path) is held()
    list(langid._gram_counts(3)([]))
    assert held() is None
