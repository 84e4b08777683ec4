"""Append sink: each row of a stream, or of a batch job, once in a folder of
delimited files, whatever is killed and run again.

``<path>/rows`` holds the files that any CSV reader can take, ``<path>/epochs``
one entry per finished epoch, ``<path>/staged`` what tasks are writing:

* a task writes its rows to a staged file of its own; a failed or repeated
  attempt leaves a file that nobody reads;
* the driver names the staged files of an epoch in one entry, put in place by a
  single rename, and then moves them to ``rows``;
* an epoch that comes again (the job died after the entry, or before the
  stream noted it) finds its entry: the moves it lacks are made up, the new
  files are dropped.

Cells: nulls are empty, text is quoted (so '' and null differ on reading), a
null of a table with one column becomes '' (a blank line would be no row).  An
epoch without rows adds an entry and no file; other columns than those of the
first epoch raise.  The path must be a folder that driver and executors share.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter,
                                    WriterCommitMessage)

FORMAT = "append_rows"
ENTRY = "epoch string, n_rows long, n_files int, finished double"


@dataclass
class Part(WriterCommitMessage):
    """What one task staged."""
    file: str | None
    n_rows: int
    columns: list[str] = field(default_factory=list)


class Ledger:
    """The folder, on any file system that pyarrow opens."""

    def __init__(self, path: str, sep: str = "\t", header: bool = False):
        from pyarrow import fs
        if path.startswith("file:"):
            path = "/" + path[len("file:"):].lstrip("/")
        self.fs, self.root = fs.FileSystem.from_uri(path)
        self.sep, self.header = sep, header

    def _at(self, *names: str) -> str:
        return "/".join((self.root.rstrip("/"), *names))

    def _has(self, *names: str) -> bool:
        from pyarrow import fs
        return self.fs.get_file_info(self._at(*names)).type == fs.FileType.File

    def open(self) -> None:
        """The folders that readers expect, also before the first epoch."""
        for name in ("rows", "epochs"):
            self.fs.create_dir(self._at(name), recursive=True)

    def _put(self, text: str, *names: str) -> None:
        """A small file that is there whole or not at all."""
        self.fs.create_dir(self._at(names[0]), recursive=True)
        self.fs.create_dir(self._at("staged"), recursive=True)
        draft = self._at("staged", f"{uuid.uuid4().hex}.draft")
        with self.fs.open_output_stream(draft) as out:
            out.write(text.encode())
        self.fs.move(draft, self._at(*names))

    def _get(self, *names: str) -> dict:
        with self.fs.open_input_stream(self._at(*names)) as f:
            return json.loads(f.read())

    def stage(self, batches) -> Part:
        """Write a task's rows, batch by batch."""
        from pyarrow import csv
        name, n, writer, out, columns = f"{uuid.uuid4().hex}.part", 0, None, None, []
        try:
            for batch in batches:
                if not len(batch):
                    continue
                if batch.num_columns == 1 and pa.types.is_string(batch.column(0).type):
                    batch = pa.RecordBatch.from_arrays([batch.column(0).fill_null("")], schema=batch.schema)
                if writer is None:
                    self.fs.create_dir(self._at("staged"), recursive=True)
                    out = self.fs.open_output_stream(self._at("staged", name))
                    writer = csv.CSVWriter(out, batch.schema, write_options=csv.WriteOptions(
                        include_header=self.header, delimiter=self.sep))
                    columns = batch.schema.names
                writer.write_batch(batch)
                n += len(batch)
        finally:
            if writer is not None:
                writer.close()
                out.close()
        return Part(name if n else None, n, columns)

    def commit(self, epoch: str, parts: list[Part]) -> None:
        """Make the parts the rows of ``epoch``, unless it has rows already."""
        parts = [p for p in parts if p is not None]
        entry = ("epochs", f"{epoch}.json")
        if not self._has(*entry):
            full = [p for p in parts if p.file]
            for columns in {tuple(p.columns) for p in full}:
                if not self._has("meta", "columns.json"):
                    self._put(json.dumps({"columns": columns}), "meta", "columns.json")
                known = self._get("meta", "columns.json")["columns"]
                if list(columns) != known:
                    self.abort(parts)
                    raise ValueError(f"the sink has columns {known}, the rows {list(columns)}")
            self._put(json.dumps({"epoch": str(epoch), "n_rows": sum(p.n_rows for p in full), "n_files": len(full),
                                  "finished": time.time(), "files": [p.file for p in full]}), *entry)
        files = self._get(*entry)["files"]
        self.fs.create_dir(self._at("rows"), recursive=True)
        for i, name in enumerate(files):
            if self._has("staged", name):
                self.fs.move(self._at("staged", name), self._at("rows", f"{epoch}-{i:05d}.csv"))
        self.abort([p for p in parts if p.file not in files])

    def abort(self, parts: list[Part]) -> None:
        for p in parts:
            if p is not None and p.file and self._has("staged", p.file):
                self.fs.delete_file(self._at("staged", p.file))


class _Writer:
    def __init__(self, options):
        self.ledger = (options["path"], options.get("sep", "\t"), options.get("header", "false").lower() == "true")
        self.epoch = options.get("epoch")

    def write(self, iterator):
        return Ledger(*self.ledger).stage(iterator)


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId):
        Ledger(*self.ledger).commit(str(batchId), messages)

    def abort(self, messages, batchId):
        Ledger(*self.ledger).abort(messages)


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages):
        Ledger(*self.ledger).commit(self.epoch, messages)

    def abort(self, messages):
        Ledger(*self.ledger).abort(messages)


class AppendSource(DataSource):
    """``format("append_rows")``: options path, sep, header and, for a batch
    write, epoch (the name under which the rows count once)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options)

    def writer(self, schema, overwrite):
        if overwrite or not self.options.get("epoch"):
            raise ValueError(f"{FORMAT} appends, and needs the option epoch")
        return _BatchWriter(self.options)


def append_rows(df: DataFrame, path: str, epoch: str, sep: str = "\t", header: bool = False) -> None:
    """Append a table's rows under the name ``epoch``; the same name again adds
    nothing (for jobs that are retried, and for ``foreachBatch``)."""
    df.sparkSession.dataSource.register(AppendSource)
    (df.write.format(FORMAT).mode("append").option("path", path).option("epoch", str(epoch)).option("sep", sep)
       .option("header", str(header).lower()).save())


def read_appended(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = False) -> DataFrame:
    """The rows so far, with ``schema`` (names and types in file order).  Empty
    cells are nulls and ``""`` is text, which Spark's reader tells apart only
    with a null value of its own: a cell that is one NUL character reads as null."""
    return (spark.read.schema(schema).options(sep=sep, header=str(header).lower(), quote='"', escape='"', multiLine="true",
                                              encoding="UTF-8", nullValue="\0", emptyValue="")
            .csv(f"{path.rstrip('/')}/rows"))


def appended_epochs(spark: SparkSession, path: str) -> DataFrame:
    """One row per epoch: ``epoch, n_rows, n_files, finished_at``."""
    rows = spark.read.schema(ENTRY).json(f"{path.rstrip('/')}/epochs")
    return rows.select("epoch", "n_rows", "n_files", F.timestamp_seconds("finished").alias("finished_at"))
