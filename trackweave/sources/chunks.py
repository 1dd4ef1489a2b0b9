"""Rasters in chunks, as a data source of Spark: a folder with raster.json and one compressed file a chunk.

    write_chunks(labels, path, shape=(30, 2048, 2048), chunks=(1, 512, 512))
    spark.read.format("raster_chunks").load(path)

A chunk is a partition of the reader and is written by one task; chunks of zeros alone have no file. Files take a name of the
attempt and get their own in the commit, so that a task that is lost or run twice leaves nothing behind.
"""

from __future__ import annotations

import itertools
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT, META = "raster_chunks", "raster.json"
AXES = ("t", "y", "x")
#: Types of Spark by those of the chunks.
KINDS = {"i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "f4": "float", "f8": "double"}


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path or path.startswith("file:"):
        system, inside = fs.FileSystem.from_uri(path)
        return system, inside.rstrip("/")
    return fs.LocalFileSystem(), path.rstrip("/")


def exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def described(path: str) -> dict:
    system, folder = store(path)
    with system.open_input_stream(f"{folder}/{META}") as f:
        return json.loads(f.readall())


@dataclass
class Chunk(InputPartition):
    name: str
    origin: tuple[int, ...]

    def __init__(self, name: str, origin: tuple[int, ...]) -> None:
        super().__init__(name)
        self.name, self.origin = name, origin


class ChunkReader(DataSourceReader):
    """The non-zero pixels of a raster, a partition a chunk; with option dense, all of them."""

    def __init__(self, options: dict) -> None:
        self.path, self.dense = options["path"], str(options.get("dense", "false")).lower() == "true"
        self.meta = described(self.path)

    def partitions(self) -> list[Chunk]:
        shape, chunks = self.meta["shape"], self.meta["chunks"]
        grid = itertools.product(*(range(-(-n // c)) for n, c in zip(shape, chunks, strict=True)))
        system, folder = store(self.path)
        there = {x.base_name for x in system.get_file_info(fs.FileSelector(folder))}
        named = ((".".join(map(str, at)), tuple(k * c for k, c in zip(at, chunks, strict=True))) for at in grid)
        return [Chunk(name, origin) for name, origin in named if self.dense or name in there]

    def read(self, partition: Chunk | None) -> Iterator[pa.RecordBatch]:
        # Without any partition Spark reads once with none.
        if partition is None:
            return
        system, folder = store(self.path)
        shape, chunks = self.meta["shape"], self.meta["chunks"]
        size = [min(c, n - o) for c, n, o in zip(chunks, shape, partition.origin, strict=True)]
        values = np.zeros(size, self.meta["dtype"])
        name = f"{folder}/{partition.name}"
        if exists(system, name):
            with system.open_input_stream(name) as f:
                values = np.frombuffer(zlib.decompress(f.readall()), self.meta["dtype"]).reshape(size)
        at = np.indices(size).reshape(3, -1) if self.dense else np.stack(np.nonzero(values))
        columns = [pa.array((at[k] + partition.origin[k]).astype(np.int32)) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(values[tuple(at)])], names=[*AXES, "value"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ChunkWriter(DataSourceArrowWriter):
    """Rows (t, y, x, value) of whole chunks, chunk by chunk."""

    def __init__(self, options: dict) -> None:
        self.path, self.run = options["path"], uuid.uuid4().hex
        self.meta = json.loads(options["meta"])

    def _save(self, at: tuple[int, ...], rows: pa.Table) -> str:
        system, folder = store(self.path)
        shape, chunks = self.meta["shape"], self.meta["chunks"]
        values = np.zeros([min(c, n - k * c) for c, n, k in zip(chunks, shape, at, strict=True)], self.meta["dtype"])
        values[tuple(rows[a].to_numpy() - k * c for a, k, c in zip(AXES, at, chunks, strict=True))] = rows["value"].to_numpy()
        name = f"{'.'.join(map(str, at))}.{self.run}.{uuid.uuid4().hex}"
        with system.open_output_stream(f"{folder}/{name}", compression=None) as f:
            f.write(zlib.compress(values.tobytes()))
        return name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, here, held = [], None, []
        for batch in iterator:
            keys = np.stack([batch.column(a).to_numpy() // c for a, c in zip(AXES, self.meta["chunks"], strict=True)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(keys)]):
                if b > a:
                    at = tuple(keys[a].tolist())
                    if here is not None and at != here:
                        names.append(self._save(here, pa.Table.from_batches(held)))
                        held = []
                    here = at
                    held.append(batch.slice(a, b - a))
        if here is not None:
            names.append(self._save(here, pa.Table.from_batches(held)))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = store(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            system.move(f"{folder}/{name}", f"{folder}/{'.'.join(name.split('.')[:3])}")
        # What attempts left that did not count.
        for x in system.get_file_info(fs.FileSelector(folder)):
            if f".{self.run}." in x.base_name:
                system.delete_file(x.path)
        with system.open_output_stream(f"{folder}/{META}", compression=None) as f:
            f.write(json.dumps(self.meta).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = store(self.path)
        for x in system.get_file_info(fs.FileSelector(folder)):
            if f".{self.run}." in x.base_name:
                system.delete_file(x.path)


class RasterChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"t int, y int, x int, value {KINDS[np.dtype(described(self.options['path'])['dtype']).str[1:]]}"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options)


def large_chunks(shape: tuple[int, int, int], dtype: str = "i4", most_bytes: int = 2**24) -> tuple[int, int, int]:
    """A chunk of one frame, halved along its longer side until it is within most_bytes."""
    y, x = shape[1:]
    while y * x * np.dtype(dtype).itemsize > most_bytes and y * x > 1:
        y, x = (-(-y // 2), x) if y >= x else (y, -(-x // 2))
    return 1, y, x


def read_chunks(spark: SparkSession, path: str, dense: bool = False) -> DataFrame:
    """(t, y, x, value) of a raster: its non-zero pixels, or all."""
    spark.dataSource.register(RasterChunks)
    return spark.read.format(FORMAT).option("dense", str(dense)).load(path)


def write_chunks(pixels: DataFrame, path: str, shape: tuple[int, int, int], chunks: tuple[int, int, int] | None = None, value: str = "label", dtype: str = "i4", overwrite: bool = False) -> None:
    """Writes pixels (t, y, x, value) as a raster of that shape; pixels outside it are an error, null values are 0.

    FileExistsError if the folder holds a raster and overwrite isn't set; with it the old one goes first. Chunks hold whole
    frames of time (ValueError unless the first length is 1), as segments are read frame by frame. Of repeated pixels one
    counts. An empty table, or a frame without rows, gives zeros.
    """
    chunks = tuple(chunks or large_chunks(shape, dtype))
    if chunks[0] != 1:
        raise ValueError(f"chunks of {chunks[0]} frames; each frame needs its own")
    system, folder = store(path)
    if exists(system, f"{folder}/{META}"):
        if not overwrite:
            raise FileExistsError(path)
        system.delete_dir_contents(folder)
    system.create_dir(folder, recursive=True)
    outside = pixels.where(" OR ".join(f"{a} < 0 OR {a} >= {n} OR {a} IS NULL" for a, n in zip(AXES, shape, strict=True))).head(1)
    if outside:
        raise ValueError(f"pixel outside {shape}: {outside[0].asDict()}")
    keys = [F.floor(F.col(a) / c).alias(f"_{a}") for a, c in zip(AXES, chunks, strict=True)]
    kind = KINDS[np.dtype(dtype).str[1:]]
    rows = pixels.select(*(F.col(a).cast("int").alias(a) for a in AXES), F.coalesce(F.col(value).cast(kind), F.lit(0).cast(kind)).alias("value"))
    placed = rows.repartition(*keys).sortWithinPartitions(*keys)
    meta = json.dumps({"shape": list(shape), "chunks": list(chunks), "dtype": np.dtype(dtype).str})
    pixels.sparkSession.dataSource.register(RasterChunks)
    placed.write.format(FORMAT).mode("append").option("meta", meta).save(path)
