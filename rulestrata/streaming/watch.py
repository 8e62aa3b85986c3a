"""An extension: verdicts for diff files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import deterministic, diffs
from ..operators.deterministic import Rule


def watch(spark: SparkSession, folder: str, rules: list[Rule], out: str, checkpoint: str):
    """Each micro-batch appends its verdicts to ``out``; call ``processAllAvailable`` or
    ``awaitTermination`` on the query that is returned."""
    arriving = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.diff").load(folder)
    texts = arriving.select(F.col("_metadata.file_name").alias("change_set"), F.col("value").alias("text"))

    def each(batch, _):
        checked = deterministic.check(diffs.files_added(batch), rules)
        deterministic.verdicts(checked, rules).write.mode("append").parquet(out)

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
