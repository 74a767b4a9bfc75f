"""A data source of audit lines: files that count once a commit names them."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

FORMAT = "audit_log"
_LINES_A_BATCH = 8192


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def _names(uri: str, suffix: str) -> list[str]:
    system, path = _at(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(suffix) and not f.base_name.startswith("."))


@dataclass
class Written(WriterCommitMessage):
    """One task's file, and what it holds."""

    name: str
    lines: int
    bytes: int


@dataclass
class Commit(InputPartition):
    name: str


def _write(path: str, batches: Iterator[pa.RecordBatch], most: int) -> Written:
    """The ``line`` column of the batches as one new file; a task that fails leaves none."""
    system, root = _at(path)
    system.create_dir(f"{root}/lines", recursive=True)
    name, lines, size = f"{uuid.uuid4().hex}.jsonl", 0, 0
    sink = system.open_output_stream(f"{root}/lines/{name}")
    try:
        for batch in batches:
            for line in batch.column("line").to_pylist():
                if line is None or "\n" in line or "\r" in line:
                    raise ValueError("an audit line is null or holds a line break")
                raw = line.encode() + b"\n"
                if len(raw) > most:
                    raise ValueError(f"an audit line has more than {most} bytes")
                sink.write(raw)
                lines, size = lines + 1, size + len(raw)
        sink.close()
    except BaseException:
        sink.close()
        system.delete_file(f"{root}/lines/{name}")
        raise
    return Written(name, lines, size)


def _drop(path: str, messages: list) -> None:
    """Delete the files of tasks whose job does not count."""
    system, root = _at(path)
    for message in messages:
        if message is not None:
            try:
                system.delete_file(f"{root}/lines/{message.name}")
            except FileNotFoundError:
                pass


def _commit(path: str, name: str, messages: list) -> bool:
    """Name the files in a commit that shows up whole, by a rename. False, and the files go, if there is such a commit already."""
    system, root = _at(path)
    if system.get_file_info(f"{root}/commits/{name}.json").type != fs.FileType.NotFound:
        _drop(path, messages)
        return False
    system.create_dir(f"{root}/commits", recursive=True)
    part = f"{root}/commits/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(json.dumps({"files": [{"name": m.name, "lines": m.lines, "bytes": m.bytes} for m in messages if m is not None and m.lines]}).encode())
    system.move(part, f"{root}/commits/{name}.json")
    for message in messages:
        if message is not None and not message.lines:
            _drop(path, [message])
    return True


class _Batch(DataSourceArrowWriter):
    def __init__(self, path: str, name: str, most: int) -> None:
        self.path, self.name, self.most = path, name, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.path, iterator, self.most)

    def commit(self, messages: list) -> None:
        _commit(self.path, self.name, messages)

    def abort(self, messages: list) -> None:
        _drop(self.path, messages)


class _Stream(DataSourceStreamArrowWriter):
    def __init__(self, path: str, name: str, most: int) -> None:
        self.path, self.name, self.most = path, name, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.path, iterator, self.most)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803  the interface's name
        _commit(self.path, f"{self.name}-{batchId:012d}", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        _drop(self.path, messages)


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Commit]:
        return [Commit(n) for n in _names(f"{self.path}/commits", ".json")] or [Commit("")]

    def read(self, partition: Commit) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = _at(self.path)
        with system.open_input_stream(f"{root}/commits/{partition.name}") as f:
            files = json.loads(f.read())["files"]
        for file in files:
            lines, size = 0, 0
            with system.open_input_stream(f"{root}/lines/{file['name']}") as f:
                rest: list[str] = []
                for raw in io.BufferedReader(f, 1 << 20):
                    rest.append(raw[:-1].decode())
                    lines, size = lines + 1, size + len(raw)
                    if len(rest) == _LINES_A_BATCH:
                        yield self._batch(rest, partition)
                        rest = []
                if rest:
                    yield self._batch(rest, partition)
            if (lines, size) != (file["lines"], file["bytes"]):
                raise ValueError(f"{file['name']} is not what its commit says")

    def _batch(self, lines: list[str], partition: Commit) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([partition.name[:-5]] * len(lines), pa.string())], names=["line", "commit"])


class AuditLog(DataSource):
    """``format("audit_log")``, once ``register`` has run in the session.

    Written, in batch or by a stream, it takes a ``line`` column and appends
    to the folder ``path``, which all executors see. Each task writes a file
    of its own under ``lines``; the driver's commit then names the files of
    the job in one file under ``commits`` that a rename brings in. What no
    commit names does not count: not what a lost or repeated task left, not
    what a failed job wrote. A commit has the option ``name`` (a stream
    needs one; its batch id is appended), and a name counts once: a batch
    that comes again after a restart, or a job run again under its name, adds
    nothing and its files go. One writer at a time has a name.

    A null line, a line break in a line, and a line of more than ``mostBytes``
    (1 MB) end the job with nothing written. Read, it gives (line, commit),
    a partition for each commit, and compares each file with the lines and
    bytes its commit counted. The driver lists names of commits only.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "line string, commit string"

    def _options(self, name: str | None) -> tuple[str, str, int]:
        name = self.options.get("name", name)
        if not self.options.get("path") or not name or not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError("an audit log needs a path, and a stream a name, of letters, digits, - and _")
        return self.options["path"].rstrip("/"), name, int(self.options.get("mostBytes", 1 << 20))

    def reader(self, schema) -> _Reader:
        return _Reader(self._options("read")[0])

    def writer(self, schema, overwrite: bool) -> _Batch:
        if overwrite:
            raise ValueError("an audit log is appended to, never overwritten")
        return _Batch(*self._options(uuid.uuid4().hex))

    def streamWriter(self, schema, overwrite: bool) -> _Stream:  # noqa: N802  the interface's name
        return _Stream(*self._options(None))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AuditLog)


def sweep(spark: SparkSession, path: str, older_seconds: int = 86400) -> int:
    """Delete the files that no commit names and that are older than any job that may yet commit; how many went.

    Killed tasks leave such files. Names are joined in Spark; the files are not read.
    """
    root = path.rstrip("/")
    if not _names(f"{root}/lines", ".jsonl"):
        return 0
    named = spark.read.schema("files array<struct<name:string>>").json(f"{root}/commits") if _names(f"{root}/commits", ".json") else spark.createDataFrame([], "files array<struct<name:string>>")
    there = spark.read.format("binaryFile").load(f"{root}/lines").where(F.col("modificationTime") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(older_seconds)))
    lost = there.select(F.substring_index("path", "/", -1).alias("name")).join(named.select(F.explode("files.name").alias("name")), "name", "left_anti")

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _drop(root, [Written(name, 0, 0) for name in batch.column("name").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return lost.mapInArrow(delete, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
