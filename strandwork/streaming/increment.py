"""Resumable chunk runs as a file-source stream.

The output of a run is a folder of its own, and a run counts from the moment its
record, one file, is renamed into the commit folder. A record names the chunks, the
files each was made of, and the run that holds their rows. Readers follow the
last finished record of each chunk, so a run that fails, at any point, leaves what was
there before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SCHEMA = "chunk_id string, source string, run string, finished boolean, version long"
#: The source of rows that carry none.
NO_SOURCE = "-"
#: Current chunks that are broadcast to readers at most.
BROADCAST_CHUNKS = 100_000


def _records(spark: SparkSession, out: str, stage: str) -> DataFrame:
    try:
        return spark.read.schema(RECORD_SCHEMA).parquet(f"{out}/commits/stage={stage}")
    except AnalysisException:  # nothing has been recorded yet
        return spark.createDataFrame([], RECORD_SCHEMA)


def _last(records: DataFrame) -> DataFrame:
    """The rows of each chunk's newest record."""
    newest = records.groupBy("chunk_id").agg(F.max("version").alias("version"))
    return records.join(newest, ["chunk_id", "version"], "left_semi")


def known_chunks(spark: SparkSession, out: str, stage: str) -> DataFrame:
    """(chunk_id, source, finished): the files each chunk was last computed from, and
    whether that ended. A forced run that failed leaves its chunks unfinished."""
    return _last(_records(spark, out, stage)).select("chunk_id", "source", "finished")


def finished_chunks(spark: SparkSession, out: str, stage: str) -> DataFrame:
    """(chunk_id, source): the files of each chunk whose stage output is committed."""
    return known_chunks(spark, out, stage).filter("finished").select("chunk_id", "source")


def _record(spark: SparkSession, out: str, stage: str, chunks: DataFrame, run: str, finished: bool) -> None:
    """Make ``chunks`` (chunk_id, source) the newest state of their chunks: one file, renamed as a whole."""
    version = (_records(spark, out, stage).agg(F.max("version")).first()[0] or 0) + 1
    rows = chunks.select("chunk_id", "source", F.lit(run).alias("run"), F.lit(finished).alias("finished"), F.lit(version).cast("long").alias("version"))
    rows.coalesce(1).write.mode("append").parquet(f"{out}/commits/stage={stage}")


def run_stage(rows: DataFrame, out: str, stage: str, fn: Callable[[DataFrame], DataFrame], force: bool = False, only: str | None = None) -> None:
    """Compute a stage for the chunks of ``rows`` that are not finished.

    A chunk is finished with the files it was made of (column ``source``, if
    ``rows`` have it). The same files again leave it untouched; ``force``
    recomputes it; ``only`` picks one chunk. Rows of a known chunk from a new
    file are an error, raised before anything is written: ``run_increment`` gives
    such a chunk with all of its files. A chunk is replaced as a whole, also by an
    empty result, when the record of the run is there. If a forced run fails, the
    former rows stay readable and the chunk is unfinished, so the next run takes it.
    """
    spark = rows.sparkSession
    if "source" not in rows.columns:
        rows = rows.withColumn("source", F.lit(NO_SOURCE))
    todo = rows.filter(F.col("chunk_id") == only) if only else rows
    if not force:
        known = known_chunks(spark, out, stage)
        done = known.filter("finished")
        new = todo.join(done, ["chunk_id", "source"], "left_anti").select("chunk_id").distinct()
        todo = todo.join(new, "chunk_id", "left_semi")
        missing = known.join(new, "chunk_id").join(todo.select("chunk_id", "source"), ["chunk_id", "source"], "left_anti")
        if not missing.isEmpty():
            raise ValueError("a known chunk got new rows without its earlier files")
    todo = todo.persist()
    try:
        if todo.isEmpty():
            return
        run = uuid.uuid4().hex
        chunks = todo.select("chunk_id", "source").distinct()
        if force:  # what is asked for again is not finished any more
            _record(spark, out, stage, chunks, run, finished=False)
        fn(todo.drop("source")).write.partitionBy("chunk_id").parquet(f"{out}/data/stage={stage}/run={run}")
        _record(spark, out, stage, chunks, run, finished=True)
    finally:
        todo.unpersist()


def run_increment(spark: SparkSession, source: str, schema: T.StructType | str, out: str, checkpoint: str, stages: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
    """Process all files that arrived since the last run, then stop.

    The stream's checkpoint remembers the files read; the done table remembers
    the files of each chunk finished per stage. A chunk that gets a further file
    is computed again from all of its files.
    """

    def read(fresh: DataFrame) -> DataFrame:
        return fresh.withColumn("source", F.col("_metadata.file_path"))

    def batch(rows: DataFrame, _epoch: int) -> None:
        for name, fn in stages.items():
            earlier = known_chunks(spark, out, name).filter(F.col("source") != NO_SOURCE).join(rows.select("chunk_id").distinct(), "chunk_id", "left_semi")
            earlier = earlier.join(rows.select("chunk_id", "source").distinct(), ["chunk_id", "source"], "left_anti")
            files = [r.source for r in earlier.select("source").distinct().collect()]  # files of the touched chunks
            again = rows
            if files:
                old = read(spark.read.schema(schema).parquet(*files)).join(earlier, ["chunk_id", "source"], "left_semi")
                again = rows.unionByName(old)
            run_stage(again, out, name, fn)

    stream = read(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source))
    job = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start()
    job.awaitTermination()


def stage_output(spark: SparkSession, out: str, stage: str, schema: T.StructType | str) -> DataFrame:
    """The committed rows of every chunk. Folders that no record leads to are not read."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    current = _last(_records(spark, out, stage).filter("finished")).select("chunk_id", "run").distinct()
    near = F.broadcast(current) if current.limit(BROADCAST_CHUNKS + 1).count() <= BROADCAST_CHUNKS else current
    rows = spark.read.schema(T.StructType([*fields.fields, T.StructField("run", T.StringType())])).parquet(f"{out}/data/stage={stage}")
    return rows.join(near, ["chunk_id", "run"], "left_semi").select(*fields.names)


def remove_old_runs(spark: SparkSession, out: str, stage: str) -> None:
    """Delete the folders of runs that no chunk is read from. Not while a run is going on."""
    kept = {r.run for r in _last(_records(spark, out, stage).filter("finished")).select("run").distinct().collect()}  # one name a run
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/data/stage={stage}")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(top) if fs.exists(top) else []:
        if status.getPath().getName().removeprefix("run=") not in kept:
            fs.delete(status.getPath(), True)
