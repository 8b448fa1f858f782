"""Data sources of files: what media tools report on videos, and files that appear all at once or not at all.

    register(spark)
    spark.read.format("media_report").load(folder)
    rows.write.format("committed_files").mode("append").save(folder)
    spark.read.format("committed_files").load(folder)

Both reach files through ``pyarrow.fs``: local paths, and URIs of the stores it knows.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import media

REPORT = "video_id STRING, duration_seconds DOUBLE, width INT, height INT, fps DOUBLE, has_audio BOOLEAN, scene_cuts ARRAY<DOUBLE>, audio_mean_volume_db DOUBLE, error STRING"
#: Endings of a video's files: the probe's key=value lines, the scene filter's log, the volume filter's log.
KINDS = ("probe", "scenes", "volume")
MANIFEST = "_MANIFEST.json"
#: Bytes of a partition, and those that opening a file counts.
PARTITION, OPEN = 32 << 20, 64 << 10


class MediaError(RuntimeError):
    pass


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


@dataclass
class Videos(InputPartition):
    """Videos of one partition: (id, {kind: path})."""

    videos: list[tuple[str, dict[str, str]]]


def _dealt(items: list[tuple[int, object]], limit: int) -> list[list]:
    """Items in order, in groups of at most ``limit`` bytes; a larger one is alone."""
    out: list[list] = []
    held = limit + 1
    for n, x in items:
        if held + n > limit:
            out.append([])
            held = 0
        out[-1].append(x)
        held += n
    return out


class ReportReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        if "path" not in options:
            raise ValueError("media_report needs a path")
        self.path, self.limit = options["path"], int(options.get("maxPartitionBytes", PARTITION))
        self.strict = options.get("mode", "FAILFAST").upper() != "PERMISSIVE"

    def partitions(self) -> list[Videos]:
        """Whole videos, small ones together. Files and folders that begin with _ or . are not looked at."""
        store, path = opened(self.path)
        found: dict[str, dict[str, str]] = {}
        sizes: dict[str, int] = {}
        for f in sorted(store.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda f: f.path):
            name, _, kind = f.base_name.rpartition(".")
            hidden = any(p[:1] in ("_", ".") for p in posixpath.relpath(f.path, path).split("/"))
            if f.is_file and kind in KINDS and name and not hidden:
                if kind in found.setdefault(name, {}):
                    raise MediaError(f"two {kind} reports of {name}")
                found[name][kind] = f.path
                sizes[name] = sizes.get(name, 0) + OPEN + f.size
        return [Videos(g) for g in _dealt([(sizes[v], (v, found[v])) for v in sorted(found)], self.limit) or [[]]]

    def read(self, partition: Videos) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        rows = []
        for video, files in partition.videos:
            try:
                texts = {kind: _read(store, path).decode("utf-8", "replace") for kind, path in files.items()}
                row = {"video_id": video, "scene_cuts": media.parse_scenes(texts["scenes"]) if "scenes" in texts else None}
                row["audio_mean_volume_db"] = media.parse_volume(texts["volume"]) if "volume" in texts else None
                row |= media.parse_probe(texts.get("probe", ""))
            except ValueError as e:
                if self.strict:
                    raise MediaError(f"{video}: {e}") from e
                row = {"video_id": video, "error": str(e)}
            rows.append(row)
            if len(rows) == 1_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


_ARROW = {"STRING": pa.string(), "DOUBLE": pa.float64(), "INT": pa.int32(), "BOOLEAN": pa.bool_(), "ARRAY<DOUBLE>": pa.list_(pa.float64())}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([(n, _ARROW[kind]) for n, kind in (x.split() for x in REPORT.split(", "))])
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)


class MediaReport(DataSource):
    """A row of typed values for each video of a folder of reports: ``<video id>.probe``, ``.scenes`` and ``.volume``.

    Options: ``mode`` FAILFAST (a report without a duration, or with a number that isn't one, fails the job) or PERMISSIVE
    (the row has nulls and an ``error``); ``maxPartitionBytes``. Without a scene log scene_cuts is null, without a volume
    log, or with one that names no volume, audio_mean_volume_db is.
    """

    @classmethod
    def name(cls) -> str:
        return "media_report"

    def schema(self) -> str:
        return REPORT

    def reader(self, schema: T.StructType) -> ReportReader:
        return ReportReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    """A task's folder of staged files, and (path, bytes) of each."""

    folder: str | None
    files: list[tuple[str, int]]


class FilesWriter(DataSourceArrowWriter):
    """Each task writes into a folder of its own below ``_staged``, which readers don't look at. The commit moves the folders of
    the tasks that count into place and then names every file in a manifest; what failed tasks left is deleted. A
    folder with a manifest is never written again."""

    def __init__(self, options: Mapping[str, str]):
        if "path" not in options:
            raise ValueError("committed_files needs a path")
        self.path, self.job = options["path"], uuid.uuid4().hex
        self._refuse()

    def _refuse(self) -> tuple[fs.FileSystem, str]:
        store, path = opened(self.path)
        if store.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} was written before")
        return store, path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, path = opened(self.path)
        folder, files = f"{path}/_staged/{self.job}/{uuid.uuid4().hex}", []
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                name, data = name.as_py(), content.as_buffer() if content.is_valid else b""
                if not name or name.startswith(("/", "_", ".")) or ".." in name.split("/"):
                    raise ValueError(f"not a file's name: {name!r}")
                store.create_dir(posixpath.dirname(f"{folder}/{name}"), recursive=True)
                with store.open_output_stream(f"{folder}/{name}") as f:
                    f.write(data)
                files.append((name, len(data)))
        return Written(folder if files else None, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = self._refuse()
        parts = [m for m in messages if isinstance(m, Written) and m.folder]
        names = [n for m in parts for n, _ in m.files]
        if len({*names}) != len(names):
            self.abort(messages)
            raise ValueError("two rows name the same file")
        listed = []
        for k, m in enumerate(parts):
            store.move(m.folder, f"{path}/part-{k:05d}-{self.job}")
            listed += [{"path": f"part-{k:05d}-{self.job}/{n}", "name": n, "bytes": size} for n, size in m.files]
        self.abort(messages)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/_{self.job}.tmp") as f:
            f.write(json.dumps({"version": 1, "files": listed}).encode())
        store.move(f"{path}/_{self.job}.tmp", f"{path}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Takes away what the job has staged; nothing of it was visible."""
        store, path = opened(self.path)
        if store.get_file_info(at := f"{path}/_staged/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(at)


@dataclass
class Listed(InputPartition):
    files: list[dict]


class FilesReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.path, self.limit = options["path"], int(options.get("maxPartitionBytes", PARTITION))

    def partitions(self) -> list[Listed]:
        store, path = opened(self.path)
        if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.NotFound:
            raise FileNotFoundError(f"nothing was committed to {self.path}")
        files = json.loads(_read(store, f"{path}/{MANIFEST}"))["files"]
        return [Listed(g) for g in _dealt([(OPEN + f["bytes"], f) for f in files], self.limit) or [[]]]

    def read(self, partition: Listed) -> Iterator[tuple]:
        store, path = opened(self.path)
        for f in partition.files:
            if len(data := _read(store, f"{path}/{f['path']}")) != f["bytes"]:
                raise MediaError(f"{f['name']} isn't what was committed")
            yield f["name"], data


class CommittedFiles(DataSource):
    """Rows (path STRING, content BINARY), one file each. See FilesWriter for what a commit means; reading goes by the manifest."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def schema(self) -> str:
        return "path STRING, content BINARY"

    def reader(self, schema: T.StructType) -> FilesReader:
        return FilesReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("committed files are never overwritten")
        if [f.dataType.simpleString() for f in schema.fields] != ["string", "binary"]:
            raise ValueError("committed_files takes rows (path STRING, content BINARY)")
        return FilesWriter(self.options)


def register(spark: SparkSession) -> None:
    for source in (MediaReport, CommittedFiles):
        spark.dataSource.register(source)


def commit(files: DataFrame, folder: str) -> None:
    """Writes rows (path, content) as files that appear together; a folder that was written before is an error."""
    register(files.sparkSession)
    files.select("path", "content").write.format("committed_files").mode("append").save(folder)


def reports(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("media_report").options(**options).load(folder)


_NAME = re.compile(r"[^A-Za-z0-9._-]")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``, which driver and executors share; only a session with a local master may do without."""
    import os
    import tempfile

    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{at}/{_NAME.sub('-', name)}-{uuid.uuid4().hex}"
