"""Data sources in Python for folders that every executor mounts: batch scan, stream of frames, and a writer that leaves whole files or none."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from framelake.schemas import RASTERS
from framelake.sources.png import write_png
from framelake.sources.rasters import DPT_TAG, READERS, decode

#: Raster files that one task reads, one at a time.
FILES_A_TASK = 64

_ARROW = pa.schema([("path", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("channels", pa.int32()), ("values", pa.list_(pa.float32()))])


def local(path: str) -> str:
    """A mounted path; other stores need Spark's own readers."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: this source reads mounted folders only")
    return path.removeprefix("file://").removeprefix("file:")


def rasters_below(path: str) -> list[str]:
    """All raster files below a folder, by name; unfinished writes are left out."""
    kept = lambda d: [x for x in d if not x.startswith(("_", "."))]
    found = []
    for folder, folders, names in os.walk(path):
        folders[:] = kept(folders)
        found += [os.path.join(folder, n) for n in kept(names) if n.rsplit(".", 1)[-1].lower() in READERS]
    return sorted(found)


def read_files(paths: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch of one row for each file, so that one raster is held at a time."""
    for path in paths:
        with open(path, "rb") as f:
            h, w, channels, values = decode(f.read(), path)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, h, w, channels, values), _ARROW.types, strict=True)], schema=_ARROW)


class RasterFolder(DataSource):
    """spark.read.format("raster_folder").load(path): RASTERS rows of all files below a folder, FILES_A_TASK to a task.

    As a sink (``write.format("raster_folder").option("kind", "npy")``) it takes rows
    (path, h, w, channels, values), where path is the file's name below the folder,
    and writes a file for each: npy, pfm, dpt, or png of 8 (png) or 16 bits (png16).
    """

    @classmethod
    def name(cls) -> str:
        return "raster_folder"

    def schema(self):
        return RASTERS

    def reader(self, schema):
        return _FolderReader(local(self.options["path"]))

    def streamReader(self, schema):
        return FrameReader(local(self.options["path"]), int(self.options.get("files_per_batch", 8)), local(self.options["progress"]))

    def writer(self, schema, overwrite):
        return FileWriter(local(self.options["path"]), self.options.get("kind", "npy"), schema.names, overwrite)


class _FolderReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        found = rasters_below(self.path)
        return [InputPartition(found[i : i + FILES_A_TASK]) for i in range(0, len(found), FILES_A_TASK)]

    def read(self, partition):
        yield from read_files(partition.value)


class FrameReader(DataSourceStreamReader):
    """Frames of a folder in order of their names, ``most`` files admitted to a micro-batch.

    An offset is the number of files, by name, that were admitted; names must grow.
    What was planned last is kept in the file ``progress`` of a shared folder, so a restarted query
    admits from there on; which files a batch has follows from its offsets alone, so a batch that
    is run again has the same frames. Spark's checkpoint says which batches are done.
    """

    def __init__(self, path: str, most: int, progress: str) -> None:
        self.path, self.most, self.progress = path, most, progress

    def _planned(self) -> int:
        if not os.path.exists(self.progress):
            return 0
        with open(self.progress, encoding="utf-8") as f:
            return json.load(f)["planned"]

    def _plan(self, files: int) -> None:
        if files > self._planned():
            os.makedirs(os.path.dirname(self.progress), exist_ok=True)
            part = f"{self.progress}.{uuid.uuid4()}"
            with open(part, "w", encoding="utf-8") as f:
                json.dump({"planned": files}, f)
            os.replace(part, self.progress)

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": max(self._planned(), min(len(rasters_below(self.path)), self._planned() + self.most))}

    def partitions(self, start: dict, end: dict):
        self._plan(end["files"])
        found = rasters_below(self.path)[start["files"] : end["files"]]
        if len(found) != end["files"] - start["files"]:
            raise ValueError(f"{self.path} has lost files that were admitted before")
        return [InputPartition(found[i : i + FILES_A_TASK]) for i in range(0, len(found), FILES_A_TASK)]

    def read(self, partition):
        yield from read_files(partition.value)

    def commit(self, end: dict) -> None:
        self._plan(end["files"])


def as_bytes(image: np.ndarray, kind: str) -> bytes:
    """A raster file of a kind."""
    h, w = image.shape[:2]
    if kind == "npy":
        head = f"{{'descr': '<f4', 'fortran_order': False, 'shape': {image.shape}, }}"
        head += " " * (-(len(head) + 11) % 64) + "\n"
        return b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head.encode() + image.astype("<f4").tobytes()
    if kind == "pfm":
        return f"{'PF' if image.ndim == 3 else 'Pf'}\n{w} {h}\n-1.0\n".encode() + np.flipud(image).astype("<f4").tobytes()
    if kind == "dpt" and image.ndim == 2:
        return np.float32(DPT_TAG).tobytes() + np.array([w, h], "<i4").tobytes() + image.astype("<f4").tobytes()
    if kind == "png":
        return write_png(np.clip(np.nan_to_num(np.trunc(image)), 0, 255).astype(np.uint8))
    if kind == "png16":
        return write_png((np.nan_to_num(np.trunc(image)).astype(np.int64) & 0xFFFF).astype(np.uint16))
    raise ValueError(f"no {kind} of {image.shape}")


def file_bytes(frames: DataFrame, kind: str) -> DataFrame:
    """path, content of rows (path, h, w, channels, values), each as a raster file of a kind; what the folder sink writes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = []
            for h, w, channels, values in zip(batch["h"], batch["w"], batch["channels"], batch["values"], strict=True):
                content.append(as_bytes(np.asarray(values, dtype=np.float32).reshape((h, w) if channels == 1 else (h, w, channels)), kind))
            yield pd.DataFrame({"path": batch["path"], "content": content})

    return frames.select("path", "h", "w", "channels", "values").mapInPandas(run, "path string, content binary")


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, by their name below the folder, and where they lie until the commit."""

    folder: str
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    """Files go to a folder of their attempt; the commit moves them to their names, an abort removes them all.

    Readers of the folder leave out what lies below ``_unfinished``. A task that
    runs twice, as after a lost executor, has two folders, of which the commit takes one.
    With overwrite, rasters that are there and not written again go, once all tasks have ended well.
    """

    def __init__(self, path: str, kind: str, columns: list[str], overwrite: bool) -> None:
        missing = set(RASTERS.names) - set(columns)
        if missing:
            raise ValueError(f"raster files need the columns {sorted(missing)}")
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.unfinished = f"{path}/_unfinished-{uuid.uuid4()}"

    def write(self, batches) -> Written:
        task = TaskContext.get()
        folder = f"{self.unfinished}/{task.partitionId()}-{task.taskAttemptId()}"
        names = []
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)) for c in RASTERS.names)
            for name, h, w, channels, values in zip(*(c.to_pylist() if i < 4 else c for i, c in enumerate(columns)), strict=True):
                flat = values.values.to_numpy(zero_copy_only=False)
                image = flat.reshape((h, w) if channels == 1 else (h, w, channels))
                if os.path.isabs(name) or ".." in name.split("/"):
                    raise ValueError(f"{name} is not a name below a folder")
                to = f"{folder}/{name}"
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(to, "wb") as f:
                    f.write(as_bytes(image, self.kind))
                names.append(name)
        return Written(folder, names)

    def commit(self, messages) -> None:
        named = [(m.folder, n) for m in messages if m for n in m.names]
        if len({n for _, n in named}) != len(named):
            self._remove()
            raise ValueError("two rows have the same path")
        stale = set(rasters_below(self.path)) - {os.path.join(self.path, n) for _, n in named} if self.overwrite else set()
        for folder, name in named:
            os.makedirs(os.path.dirname(f"{self.path}/{name}"), exist_ok=True)
            os.replace(f"{folder}/{name}", f"{self.path}/{name}")
        for path in stale:
            os.remove(path)
        self._remove()

    def abort(self, messages) -> None:
        self._remove()

    def _remove(self) -> None:
        with contextlib.suppress(FileNotFoundError):
            shutil.rmtree(self.unfinished)
