"""Helpers shared by the training-data operators.

* ``durable`` cuts lineage with a reliable checkpoint in the folder the cluster names in
  ``spark.checkpoint.dir``; a temporary folder is used only where that is unset (tests).
* ``configure`` bounds the Arrow batches that carry whole texts to Python.
* ``kept`` holds what a Python worker keeps from task to task, one operator's at a time.
* ``read_table`` reads one input table through Spark's own reader, so any store works.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts may be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, about: a batch of long texts, or of pairs of sets, ends before its rows are full.
BATCH_BYTES = 4 << 20
#: The public tokenizer of the registered queries, by name.
TOKENIZER = "word_bpe_49k.json"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], object] = lambda: None) -> object:
    """What this Python worker keeps under ``key`` from task to task.

    Workers outlive the stages of a job, so the first task with another key frees it and hands unused memory back.
    """
    if key not in _kept:
        import pyarrow as pa

        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)
        _kept[key] = make()
    return _kept[key]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graincart-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_remainder(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, mod n; -1 where the id is null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns called like an operator's result columns: the result wins a clash."""
    lowered = {n.lower() for n in names}
    return df.select(*[df[f"`{c.replace('`', '``')}`"] for c in df.columns if c.lower() not in lowered])


def boxed(docs: DataFrame, *replaced: str) -> Column:
    """The row as one struct, without columns that an operator's results of these names replace; ``select("row.*")`` opens it."""
    return F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in fresh(docs, *replaced).columns] or [F.lit(0).alias("_")]).alias("row")


def label_sample(labels: DataFrame, label: str, held: Column, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out fold, taken in the order of a hash of the id.

    Null ids and labels are left out; an id with several labels takes the smallest.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held)
    picked = usable.groupBy(id_col).agg(F.min(F.col(label).cast("int")).alias("label"))
    return picked.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(rows)


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, text) of the sampled ids; ``sample`` is bounded by its caller, so it is broadcast."""
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), F.col("_id") == F.col(id_col)).select("label", "text")
