"""Length-prefixed frames as a data source of Spark: four bytes of length, little-endian, then so many bytes of JSON.

    spark.dataSource.register(FrameSource)
    spark.read.format("frames").load(folder)          # or spark.readStream

A file is a stream of frames. It is read in pieces of CHUNK bytes; a frame that a piece cuts is carried over
to the next one. Each file is a partition. A stream of files remembers how far each file has been read; a
file that ends inside a frame is read again from that frame once the rest is there.

Rows: file, offset (of the frame), size, json, error. A length of zero or over the cap ends its file, for what
follows has no known borders: the row has the reason as error and null json, as has the last frame of a file that
ends too early, in batch. Bytes that are no UTF-8 are replaced. Empty files and folders give no rows.
Options: path; cap (1 MiB), chunk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

CAP, CHUNK = 1 << 20, 1 << 16
SCHEMA = "file string, offset long, size long, json string, error string"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


def listed(path: str) -> dict[str, int]:
    """Files of a folder, or the file itself, with their sizes; names that begin with a dot or underscore are left out."""
    where, at = filesystem(path)
    info = where.get_file_info(at)
    found = where.get_file_info(pafs.FileSelector(at, recursive=True)) if info.type == pafs.FileType.Directory else [info]
    return {f.path: f.size for f in found if f.type == pafs.FileType.File and f.base_name[:1] not in "._"}


def frames(source, start: int, stop: int | None, cap: int, chunk: int, name: str) -> Iterator[tuple]:
    """Rows of a file's frames from a place on. stop: frames from there on are not read, and a cut one before it cannot be."""
    source.seek(start)
    held, at = b"", start
    while True:
        piece = source.read(chunk if stop is None else min(chunk, stop - at - len(held)))
        held += piece
        done = 0
        while len(held) - done >= 4:
            size = int.from_bytes(held[done : done + 4], "little")
            if not 0 < size <= cap:
                yield name, at + done, size, None, "empty frame" if size == 0 else "frame over the cap"
                return
            if len(held) - done < 4 + size:
                break
            yield name, at + done, size, held[done + 4 : done + 4 + size].decode("utf-8", "replace"), None
            done += 4 + size
        held, at = held[done:], at + done
        if not piece:
            if held and stop is None:
                yield name, at, int.from_bytes(held[:4], "little") if len(held) >= 4 else None, None, "file ends inside a frame"
            return


def whole(source, start: int, size: int, cap: int) -> int:
    """Where the last whole frame before `size` ends, by the lengths alone; a bad length ends the file."""
    at = start
    while at + 4 <= size:
        source.seek(at)
        n = int.from_bytes(source.read(4), "little")
        if not 0 < n <= cap:
            return size
        if at + 4 + n > size:
            break
        at += 4 + n
    return at


@dataclass
class Part(InputPartition):
    file: str
    start: int
    stop: int | None


class _Options:
    def __init__(self, options):
        self.path, self.cap, self.chunk = options["path"], int(options.get("cap", CAP)), int(options.get("chunk", CHUNK))

    def read(self, partition: Part) -> Iterator[tuple]:
        where, _ = filesystem(self.path)
        with where.open_input_file(partition.file) as source:
            yield from frames(source, partition.start, partition.stop, self.cap, self.chunk, partition.file)


class FrameReader(_Options, DataSourceReader):
    def partitions(self) -> list[Part]:
        return [Part(f, 0, None) for f, n in sorted(listed(self.path).items()) if n]


class FrameStreamReader(_Options, DataSourceStreamReader):
    """Offsets are places by file."""

    known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        where, _ = filesystem(self.path)
        out = {}
        for f, size in listed(self.path).items():
            with where.open_input_file(f) as source:
                out[f] = whole(source, self.known.get(f, 0), size, self.cap)
        self.known = out
        return {"files": json.dumps(out, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return [Part(f, before.get(f, 0), stop) for f, stop in sorted(now.items()) if stop > before.get(f, 0)]


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> FrameStreamReader:
        return FrameStreamReader(self.options)


def write_frames(rows, column: str, folder: str):
    """Writes a column of JSON texts as frames, a file a partition; returns file and frames of each. A null text is left out."""
    import uuid

    import pyarrow as pa

    where, at = filesystem(folder)
    where.create_dir(at, recursive=True)

    def run(batches):
        name, n = f"{at}/frames-{uuid.uuid4().hex}", 0
        with where.open_output_stream(f"{at}/.{name.rsplit('/', 1)[1]}") as out:
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    if text is not None:
                        body = text.encode()
                        out.write(len(body).to_bytes(4, "little") + body)
                        n += 1
        # a whole file appears under its name, or none
        where.move(f"{at}/.{name.rsplit('/', 1)[1]}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "frames"])

    return rows.select(column).mapInArrow(run, "file string, frames long")
