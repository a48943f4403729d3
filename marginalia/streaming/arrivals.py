"""Papers that keep arriving, each audited once.

The reference lists and labels of a paper need no other paper, so a stream of
whole papers runs through the batch operators, a micro-batch at a time.  A
micro-batch writes a folder of its own number, over what a failed try of it has
left, so a restart repeats nothing and no earlier result is read.  A paper that
arrives again has a later row besides; ``audited`` takes the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import labels_in_text


def write_labels(texts: DataFrame, out: str, batch: int) -> None:
    """(paper, labels_in_text) of a micro-batch in its folder; texts: paper, clean_md."""
    rows = texts.dropDuplicates(["paper"])
    rows.select("paper", labels_in_text(rows["clean_md"]).alias("labels_in_text")).write.mode("overwrite").parquet(f"{out}/batch={batch}")


def audited(spark: SparkSession, out: str) -> DataFrame:
    """One row a paper: that of the first batch that held it."""
    return spark.read.parquet(out).groupBy("paper").agg(F.min_by("labels_in_text", "batch").alias("labels_in_text"))


def audit_stream(texts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run ``write_labels`` on a stream of papers until what is there is done."""
    return texts.writeStream.foreachBatch(lambda batch, n: write_labels(batch, out, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
