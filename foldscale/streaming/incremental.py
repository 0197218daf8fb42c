"""Incremental featurisation: new structure files become feature rows as they arrive.

Every structure is one file, so no state and no watermark is needed; each micro-batch runs the batch plan.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foldscale.plans.features import features, flat
from foldscale.shared import importable, scratch
from foldscale.sources.canonical import RAW_DDL, canonicalise
from foldscale.sources.scan import _PATTERN, parsed


def feature_stream(spark: SparkSession, source: str, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the features of new files below ``source`` to the Parquet data set ``target``."""
    importable(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", _PATTERN).load(source)

    def write(batch: DataFrame, number: int) -> None:
        raw = batch.select("path", "content").mapInPandas(functools.partial(parsed, errors=False), RAW_DDL)
        # a folder per batch: a batch that runs twice replaces its own rows
        with scratch(spark):
            flat(features(canonicalise(raw))).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()
