"""Files of fixed-size records without header: the data source "fixedrecord".

Options: path, or paths (a JSON list); spec ("value:uint32", ...); on_partial ("drop", the default, or "error") for a file
that does not end with a whole record; partition_bytes for reading; single ("true", or "false", the default) and run_column
for writing. Byte order is little.

Reading gives pos (the record's number, from 0, through all files in the order given) and the fields. A file is read in as
many partitions as it has ranges of partition_bytes; a folder is read as its part files, by name. Writing stages a file per
partition; on commit they become a folder of ordered parts by renaming, or, with single, the driver joins them to one file,
so a sorted DataFrame becomes one sorted file. With run_column, each of its values (numbers; rows of a run come together in
one partition) gets a file of its own, path.split.001 and so on, in one job. Paths are local or URIs that pyarrow.fs knows,
and must be seen by driver and executors alike.
"""

from __future__ import annotations

import contextlib
import decimal
import json
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from spillway.plans.spec import RecordSpec

_BATCH = 1 << 16


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def decode(data: bytes, spec: RecordSpec) -> list[pa.Array]:
    """Columns of whole records."""
    rows = np.frombuffer(data, dtype=spec.dtype)
    out = []
    for f in spec.fields:
        raw = rows[f.name]
        if f.kind.startswith("char"):
            out.append(pa.array([bytes(x).split(b"\0", 1)[0].decode("utf-8", "replace") for x in raw], pa.string()))
        elif f.kind.startswith("bytes"):
            out.append(pa.array([bytes(x) for x in raw], pa.binary()))
        elif f.kind == "uint64":
            out.append(pa.array([decimal.Decimal(int(x)) for x in raw], pa.decimal128(20, 0)))
        else:
            wide = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64}.get(f.kind)
            out.append(pa.array(np.ascontiguousarray(raw.astype(wide) if wide else raw)))
    return out


def encode(batch: pa.RecordBatch, spec: RecordSpec) -> bytes:
    """Records of a batch; text is cut to its field and padded with NUL. Values must fit and not be null."""
    rows = np.zeros(batch.num_rows, dtype=spec.dtype)
    for f in spec.fields:
        column = batch.column(batch.schema.get_field_index(f.name))
        if column.null_count:
            raise ValueError(f"{f.name} has a null, which a record can't hold")
        if f.length:
            values = [x.encode() if isinstance(x, str) else x for x in column.to_pylist()]
            rows[f.name] = np.array([v[: f.length].ljust(f.length, b"\0") for v in values], dtype=f"S{f.length}").view(f"V{f.length}") if values else []
        else:
            values = np.array([int(x) for x in column.to_pylist()], dtype=object) if f.kind == "uint64" else column.to_numpy(zero_copy_only=False)
            if f.kind.startswith("uint") and len(values) and (min(values) < 0 or max(values) > int(np.iinfo(f.dtype).max)):
                raise ValueError(f"{f.name} has a value outside {f.kind}")
            rows[f.name] = values.astype(f.dtype)
    return rows.tobytes()


@dataclass
class _Range(InputPartition):
    """`count` records of a file from its record `first`, the first of which has the number `pos`."""

    path: str
    first: int
    count: int
    pos: int


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    path: str
    records: int
    run: int | None = None


def run_file(prefix: str, index: int) -> str:
    return f"{prefix}.split.{index:03d}"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.spec = RecordSpec.parse(options["spec"])
        self.on_partial = options.get("on_partial", "drop")
        self.step = max(1, int(options.get("partition_bytes", 64 << 20)) // self.spec.record_size)
        if self.on_partial not in ("drop", "error"):
            raise ValueError(f"on_partial must be drop or error, not {self.on_partial!r}")

    def partitions(self) -> list[_Range]:
        out, before = [], 0
        for given in self.paths:
            for path, size in self._files(given):
                n, rest = divmod(size, self.spec.record_size)
                if rest and self.on_partial == "error":
                    raise ValueError(f"{path} ends with {rest} bytes of a record of {self.spec.record_size}")
                out += [_Range(path, a, min(self.step, n - a), before + a) for a in range(0, n, self.step)]
                before += n
        return out or [_Range("", 0, 0, 0)]

    @staticmethod
    def _files(given: str) -> list[tuple[str, int]]:
        """The file, or the parts of the folder, with their sizes."""
        where, path = _open(given)
        info = where.get_file_info(path)
        if info.type == fs.FileType.File:
            return [(given, info.size)]
        if info.type != fs.FileType.Directory:
            raise FileNotFoundError(f"no such file: {given}")
        parts = [x for x in where.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.base_name.startswith("part-")]
        return [(f"{given.rstrip('/')}/{x.base_name}", x.size) for x in sorted(parts, key=lambda x: (len(x.base_name), x.base_name))]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        where, path = _open(partition.path)
        size = self.spec.record_size
        names = ["pos", *[f.name for f in self.spec.fields]]
        with where.open_input_file(path) as f:
            for first in range(partition.first, partition.first + partition.count, _BATCH):
                n = min(_BATCH, partition.first + partition.count - first)
                data = f.read_at(n * size, first * size)
                at = partition.pos + first - partition.first
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *decode(data, self.spec)], names)


@dataclass
class _Runs(WriterCommitMessage):
    files: list[_Written]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.spec = options["path"], RecordSpec.parse(options["spec"])
        self.single, self.overwrite = options.get("single", "false").lower() == "true", overwrite
        self.run_column = options.get("run_column")
        self.staging = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written | _Runs:
        from pyspark import TaskContext

        context = TaskContext.get()
        where, staging = _open(self.staging)
        where.create_dir(staging, recursive=True)
        path, n = f"{staging}/{context.partitionId():06d}-{context.taskAttemptId()}", 0
        if self.run_column:
            return self._write_runs(iterator, where, path, context.partitionId())
        with where.open_output_stream(path) as f:
            for batch in iterator:
                f.write(encode(batch, self.spec))
                n += batch.num_rows
        return _Written(context.partitionId(), path, n)

    def _write_runs(self, iterator: Iterator[pa.RecordBatch], where: fs.FileSystem, path: str, partition: int) -> _Runs:
        done: list[_Written] = []
        with contextlib.ExitStack() as opened:
            for batch in iterator:
                runs = batch.column(batch.schema.get_field_index(self.run_column)).to_numpy(zero_copy_only=False)
                starts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist()] if len(runs) else []
                for a, b in zip(starts, [*starts[1:], len(runs)]):
                    run = int(runs[a])
                    if not done or done[-1].run != run:
                        if any(x.run == run for x in done):
                            raise ValueError(f"rows of run {run} don't come together")
                        opened.close()
                        done.append(_Written(partition, f"{path}-{run}", 0, run))
                        f = opened.enter_context(where.open_output_stream(done[-1].path))
                    f.write(encode(batch.slice(a, b - a), self.spec))
                    done[-1].records += b - a
        return _Runs(done)

    def _commit_runs(self, messages: list[_Runs | None]) -> None:
        files = [x for m in messages if m for x in m.files]
        if len({x.run for x in files}) < len(files):
            raise ValueError("rows of a run lie in several partitions")
        for x in files:
            where, target = _open(run_file(self.path, x.run))
            if not self.overwrite and where.get_file_info(target).type != fs.FileType.NotFound:
                raise FileExistsError(target)
        for x in files:
            where, target = _open(run_file(self.path, x.run))
            where.move(x.path, target)

    def commit(self, messages: list[_Written | _Runs | None]) -> None:
        if self.run_column:
            self._commit_runs(messages)
            self.abort(messages)
            return
        where, path = _open(self.path)
        _, staging = _open(self.staging)
        done = sorted((m for m in messages if m), key=lambda m: m.partition)
        exists = where.get_file_info(path).type != fs.FileType.NotFound
        if exists and not self.overwrite:
            raise FileExistsError(self.path)
        # The result is complete beside the target before anything is replaced; what was there goes last.
        fresh, old = f"{staging}-new", f"{staging}-old"
        if self.single:
            with where.open_output_stream(fresh) as out:
                for m in done:
                    with where.open_input_stream(m.path) as f:
                        shutil.copyfileobj(f, out, 1 << 22)
        else:
            where.create_dir(fresh, recursive=True)
            for k, m in enumerate(done):
                where.move(m.path, f"{fresh}/part-{k:05d}")
        if exists:
            where.move(path, old)
        where.move(fresh, path)
        if exists:
            (where.delete_dir if where.get_file_info(old).type == fs.FileType.Directory else where.delete_file)(old)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        where, staging = _open(self.staging)
        if where.get_file_info(staging).type == fs.FileType.Directory:
            where.delete_dir(staging)


class FixedRecord(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixedrecord"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("pos", T.LongType()), *RecordSpec.parse(self.options["spec"]).schema.fields])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FixedRecord)


def read_records(spark: SparkSession, path: str | list[str], spec: RecordSpec, **options: str):
    """Records of a file, of a folder of parts, or of several of them, in one scan."""
    register(spark)
    where = {"path": path} if isinstance(path, str) else {"paths": json.dumps(list(path))}
    return spark.read.format("fixedrecord").options(**where, spec=spec.text(), **options).load()


def remove(path: str) -> None:
    where, at = _open(path)
    kind = where.get_file_info(at).type
    if kind != fs.FileType.NotFound:
        (where.delete_dir if kind == fs.FileType.Directory else where.delete_file)(at)


@contextlib.contextmanager
def reading(spark: SparkSession, path: str | list[str], spec: RecordSpec, cleanup: bool = False, **options: str):
    """Records for the length of a `with`; with cleanup the files are deleted at its end, unless it fails.

    A reader can't delete them, as its tasks may run again: what is made of the records has to be written inside.
    """
    yield read_records(spark, path, spec, **options)
    for x in ([path] if isinstance(path, str) else path) if cleanup else ():
        remove(x)


def count_records(path: str, spec: RecordSpec) -> int:
    """Whole records of a file or folder, by its size."""
    return sum(p.count for p in _Reader({"path": path, "spec": spec.text()}).partitions())


def write_run_files(runs, prefix: str, spec: RecordSpec, parts: int | None = None) -> None:
    """A file for each run of `runs` (fields, run_id, pos_in_run), prefix.split.001 and so on, in one job."""
    register(runs.sparkSession)
    parts = parts or int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = runs.repartition(parts, "run_id").sortWithinPartitions("run_id", "pos_in_run").select(*[f.name for f in spec.fields], "run_id")
    ordered.write.format("fixedrecord").options(path=prefix, spec=spec.text(), run_column="run_id").mode("overwrite").save()


def write_records(df, path: str, spec: RecordSpec, **options: str) -> None:
    register(df.sparkSession)
    df.select(*[f.name for f in spec.fields]).write.format("fixedrecord").options(path=path, spec=spec.text(), **options).mode("overwrite").save()
