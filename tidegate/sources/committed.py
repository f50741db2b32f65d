"""A log whose batches become visible whole: the data source ``tidegate_log``.

Tasks write Parquet files under names of their own, which no reader knows. Only when all tasks of a batch have
ended does the driver write the list of its files, by a rename; a failed batch leaves nothing to be seen. The files
of its ended and failed tasks go; what killed tasks or lost executors leave lies unseen until ``sweep``. A batch is known by ``run`` and ``batch``; once
it is committed it is final: writing it again, as after a stop before the checkpoint was written, changes nothing.

    stream.writeStream.format("tidegate_log").option("checkpointLocation", c).start(path)
    frame.write.format("tidegate_log").mode("append").options(run="a", batch=0).save(path)
    read_log(spark, path)

A stream's run is the id of its query, or the option ``run``. Paths are those of pyarrow's file systems, and shared
by driver and executors. Reading is Spark's own Parquet scan, with pruning and push-down.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "tidegate_log"
_MANIFEST = "file string, n_rows bigint, run string, batch bigint"


@dataclass
class Written(WriterCommitMessage):
    """The file of a task; None where the task had no rows."""

    file: str | None
    n_rows: int


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    local = re.fullmatch(r"file:/*(/.*)|(/.*)", path)
    return (fs.LocalFileSystem(), local[1] or local[2]) if local else fs.FileSystem.from_uri(path)


class _Log:
    """What tasks and the driver do for a batch, the same for streams and for frames."""

    def __init__(self, root: str, run: str | None, checkpoint: str | None, batch: int | None = None):
        self.root, self.run, self.checkpoint, self.batch = root.rstrip("/"), run, checkpoint, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _file_system(self.root)
        name = f"{uuid.uuid4().hex}.parquet"
        place, writer, n_rows = f"{root}/data/{name}", None, 0
        try:
            for rows in iterator:
                if rows.num_rows == 0:
                    continue
                if writer is None:
                    files.create_dir(f"{root}/data", recursive=True)
                    writer = pq.ParquetWriter(place, rows.schema, filesystem=files)
                writer.write_batch(rows)
                n_rows += rows.num_rows
            if writer is not None:
                writer.close()
        except BaseException:
            if writer is not None:
                writer.close()
                files.delete_file(place)
            raise
        return Written(name if n_rows else None, n_rows)

    def _commit(self, messages: list[Written | None], batch: int) -> None:
        files, root = _file_system(self.root)
        folder = f"{root}/commits/run={self._run()}/batch={batch}"
        if files.get_file_info(f"{folder}/files.json").type != fs.FileType.NotFound:
            self._abort(messages)
            return
        files.create_dir(folder, recursive=True)
        unseen = f"{folder}/_{uuid.uuid4().hex}"
        with files.open_output_stream(unseen) as out:
            for message in messages:
                if message is not None and message.file:
                    out.write((json.dumps({"file": message.file, "n_rows": message.n_rows}) + "\n").encode())
        files.move(unseen, f"{folder}/files.json")

    def _abort(self, messages: list[Written | None]) -> None:
        files, root = _file_system(self.root)
        for message in messages:
            if message is not None and message.file:
                files.delete_file(f"{root}/data/{message.file}")

    def _run(self) -> str:
        if self.run is None:
            files, place = _file_system(self.checkpoint)
            with files.open_input_stream(f"{place}/metadata") as about:
                self.run = json.loads(about.read())["id"]
        return self.run


class _FrameWriter(_Log, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        self._abort(messages)


class _StreamWriter(_Log, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._abort(messages)


class LogSource(DataSource):
    """``tidegate_log``; options ``path``, ``run``, and for frames ``batch``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _option(self, name: str) -> str:
        if not self.options.get(name):
            raise ValueError(f"{FORMAT}: the option {name} is missing")
        return self.options[name]

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError(f"{FORMAT}: a log is only appended to")
        _check_names(schema)
        return _FrameWriter(self._option("path"), _plain(self._option("run")), None, int(self._option("batch")))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        _check_names(schema)
        run = self.options.get("run")
        checkpoint = None if run else self._option("checkpointLocation")
        return _StreamWriter(self._option("path"), _plain(run) if run else None, checkpoint)


def _check_names(schema: StructType) -> None:
    """``run`` and ``batch`` are what a reader adds."""
    if taken := {"run", "batch"} & {n.lower() for n in schema.names}:
        raise ValueError(f"{FORMAT}: a log has its own column {', '.join(sorted(taken))}")


def _plain(run: str) -> str:
    """A run names a folder."""
    if not re.fullmatch(r"[\w-]+", run, re.A):
        raise ValueError(f"{FORMAT}: {run!r}: a run is named by letters, digits, _ and -")
    return run


def append(frame: DataFrame, path: str, run: str, batch: int) -> None:
    """Commit a frame as one batch; nothing happens where that batch is committed already."""
    frame.sparkSession.dataSource.register(LogSource)
    frame.write.format(FORMAT).mode("append").options(run=run, batch=batch).save(path)


def manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed files (``file``, ``n_rows``, ``run``, ``batch``); None while nothing is committed."""
    try:
        return spark.read.schema(_MANIFEST).option("basePath", f"{path}/commits").json(f"{path}/commits")
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def read_log(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame | None:
    """The rows of all committed batches with ``run`` and ``batch``; None while there is no row.

    Without a schema the columns of all batches are merged, which takes a look at every file's footer.
    """
    listed = manifests(spark, path)
    # names of files, as many as any scan of a folder lists on the driver
    names = [] if listed is None else [f"{path}/data/{r.file}" for r in listed.select("file").collect()]
    if not names:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    rows = reader.parquet(*names)
    held = rows.withColumn("_file", F.col("_metadata.file_name")).alias("rows")
    about = listed.select(F.col("file").alias("_file"), "run", "batch").alias("about")
    return held.join(about, "_file").select("rows.*", "about.run", "about.batch").drop("_file")


def sweep(spark: SparkSession, path: str) -> int:
    """Remove files that no batch lists, and return how many went. For times when nothing is written to the log."""
    listed = manifests(spark, path)
    known = set() if listed is None else {r.file for r in listed.select("file").collect()}
    files, root = _file_system(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True))
    unseen = [f.path for f in found if f.base_name not in known]
    for place in unseen:
        files.delete_file(place)
    return len(unseen)
