"""Micro-batch figure verification of drafts arriving as files.

``readStream`` of a drafts folder (JSON lines or parquet with
``draft_id, context_id, text``) -> ``foreachBatch`` -> :func:`verify_drafts`
against a static facts table -> one parquet folder per micro-batch.

The stream outlives its driver: the checkpoint (which files are in which
batch) lies beside the results, in ``<out>/_checkpoint``, not in a folder of the
application. A batch is written to ``<out>/batch_id=<id>`` with overwrite; a
restarted stream runs the last uncommitted batch again with the same files and
replaces its folder, then goes on with files that are new. So no draft is
verified twice and none is lost. Readers skip names that begin with ``_``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cohortlens.operators.verify import stored_pool, verify_drafts

DRAFT_SCHEMA = "draft_id string, context_id string, text string"


def verify_draft_stream(spark: SparkSession, drafts_dir: str, facts: DataFrame, out_dir: str,
                        name: str = "draft_verification", fmt: str = "json", available_now: bool = True,
                        max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the verification stream, or go on with it where it was left; ``available_now`` processes what is there and stops.

    ``out_dir`` must be shared storage that lasts. The number pool of the facts is written once per start.
    """
    reader = spark.readStream.schema(DRAFT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    drafts = reader.format(fmt).load(drafts_dir)
    pool = stored_pool(facts)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        target = os.path.join(out_dir, f"batch_id={batch_id}")
        verify_drafts(batch, None, pool).write.mode("overwrite").parquet(target)

    writer = (drafts.writeStream.queryName(name).foreachBatch(write_batch)
              .option("checkpointLocation", os.path.join(out_dir, "_checkpoint")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def verified_drafts(spark: SparkSession, out_dir: str) -> DataFrame:
    """The results of all batches that the stream has committed; a batch that is still being written is left out."""
    commits = spark.read.format("binaryFile").load(os.path.join(out_dir, "_checkpoint", "commits")).selectExpr("regexp_extract(path, '([0-9]+)$', 1) AS id")
    done = commits.where("id <> ''").selectExpr("cast(id AS int) AS batch_id")
    return spark.read.parquet(out_dir).join(done, "batch_id", "left_semi")
