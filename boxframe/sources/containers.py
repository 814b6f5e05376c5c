"""A Spark data source of clip and frame headers: duration, rate, streams, size and frame count."""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import gcd
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADERS = "path string, name string, size long, duration double, rate string, banner string, width int, height int, n_frames long"


def boxes(f: BinaryIO, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the bodies of the boxes that follow each other in a part of a file."""
    at = start
    while at + 8 <= end:
        f.seek(at)
        size, kind = struct.unpack(">I4s", f.read(8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", f.read(8))[0], 16
        size = size or end - at  # nought: to the end
        if size < head or at + size > end:
            raise ValueError("a box leaves its parent")
        yield kind, at + head, at + size
        at += size


def found(f: BinaryIO, start: int, end: int, *kinds: bytes) -> tuple[int, int] | None:
    """The body of the first box of each kind within the one before."""
    for kind in kinds:
        inner = next(((a, b) for k, a, b in boxes(f, start, end) if k == kind), None)
        if inner is None:
            return None
        start, end = inner
    return start, end


def numbers(f: BinaryIO, at: int, layout: str) -> tuple:
    f.seek(at)
    return struct.unpack(layout, f.read(struct.calcsize(layout)))


def scale_and_length(f: BinaryIO, at: int) -> tuple[int, int]:
    """Ticks a second, and ticks, of a movie's or a track's header of either version."""
    return numbers(f, at + 20, ">IQ") if numbers(f, at, ">B")[0] else numbers(f, at + 12, ">II")


def ratio(a: int, b: int) -> str | None:
    return f"{a // gcd(a, b)}/{b // gcd(a, b)}" if a and b else None


def movie_facts(f: BinaryIO, size: int) -> dict:
    """Of an MP4 or MOV file: the movie's duration, and the first video track's frames and size."""
    movie = found(f, 0, size, b"moov")
    if movie is None:
        raise ValueError("no movie")
    facts = {"duration": 0.0, "banner": ""}
    for kind, a, b in boxes(f, *movie):
        if kind == b"mvhd":
            scale, length = scale_and_length(f, a)
            facts["duration"] = length / scale if scale else 0.0
        elif kind == b"trak" and (media := found(f, a, b, b"mdia")):
            handler, header = found(f, *media, b"hdlr"), found(f, *media, b"mdhd")
            if handler is None or numbers(f, handler[0] + 8, "4s")[0] != b"vide":
                facts["banner"] += "Stream: Audio or data\n"
                continue
            facts["banner"] += "Stream: Video:\n"
            table = found(f, *media, b"minf", b"stbl")
            if header is None or table is None or "n_frames" in facts:
                continue
            times, entries = found(f, *table, b"stts"), found(f, *table, b"stsd")
            n = ticks = 0
            if times:
                for i in range(numbers(f, times[0] + 4, ">I")[0]):
                    count, delta = numbers(f, times[0] + 8 + 8 * i, ">II")
                    n, ticks = n + count, ticks + count * delta
            facts |= {"n_frames": n, "rate": ratio(n * scale_and_length(f, header[0])[0], ticks)}
            if entries:
                facts["width"], facts["height"] = numbers(f, entries[0] + 8 + 32, ">HH")
    return facts


def chunks(f: BinaryIO, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """The chunks of a RIFF file; a list is named by its type."""
    at = start
    while at + 8 <= end:
        kind, size = numbers(f, at, "<4sI")
        inner = at + 8
        if kind in (b"RIFF", b"LIST"):
            kind, inner = numbers(f, inner, "4s")[0], inner + 4
        yield kind, inner, min(at + 8 + size, end)
        at += 8 + size + size % 2


def riff_facts(f: BinaryIO, size: int) -> dict:
    """Of an AVI file, likewise."""
    facts = {"duration": 0.0, "banner": ""}
    for _, a, b in chunks(f, 0, size):
        for kind, c, d in chunks(f, a, b):
            if kind != b"hdrl":
                continue
            for part, e, g in chunks(f, c, d):
                if part == b"avih":
                    facts["width"], facts["height"] = numbers(f, e + 32, "<II")
                for stream, h, _ in chunks(f, e, g) if part == b"strl" else ():
                    if stream != b"strh":
                        continue
                    video = numbers(f, h, "4s")[0] == b"vids"
                    facts["banner"] += "Stream: Video:\n" if video else "Stream: Audio or data\n"
                    step, rate, _, n = numbers(f, h + 20, "<IIII")
                    facts["duration"] = max(facts["duration"], n * step / rate if rate else 0.0)
                    if video and "n_frames" not in facts:
                        facts |= {"n_frames": n, "rate": ratio(rate, step)}
        return facts
    raise ValueError("no list of headers")


def picture_facts(f: BinaryIO, size: int) -> dict:
    """Width and height of a JPEG or PNG frame."""
    if numbers(f, 0, "8s")[0] == b"\x89PNG\r\n\x1a\n":
        width, height = numbers(f, 16, ">II")
        return {"width": width, "height": height}
    at = 2
    while at + 4 <= size:
        mark, kind, length = numbers(f, at, ">BBH")
        if mark != 0xFF:
            break
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a start of frame
            height, width = numbers(f, at + 5, ">HH")
            return {"width": width, "height": height}
        at += 1 if kind == 0xFF else 2 + length
    raise ValueError("no start of frame")


def facts_of(f: BinaryIO, size: int) -> dict:
    """What a file's headers say; a broken or unknown file has a duration of 0 and no streams."""
    try:
        begin = numbers(f, 0, "12s")[0]
        if begin[:4] == b"RIFF":
            return riff_facts(f, size)
        if begin[:2] == b"\xff\xd8" or begin[:4] == b"\x89PNG":
            return picture_facts(f, size)
        return movie_facts(f, size)
    except (ValueError, struct.error, OSError):
        return {"duration": 0.0, "banner": ""}


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.recursive = options["path"], options.get("recursive", "true").lower() == "true"
        self.patterns = options.get("pattern", "*.mp4,*.avi,*.mov").split(",")
        self.per_task = int(options.get("filespertask", 64))

    def partitions(self) -> Sequence[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        listed = store.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        files = sorted((i.path, i.size) for i in listed if i.is_file and any(fnmatch.fnmatch(i.base_name, p) for p in self.patterns))
        return [Files(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        names = [c.split()[0] for c in HEADERS.split(", ")]
        for path, size in partition.paths:
            with store.open_input_file(path) as f:
                facts = {"path": path, "name": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "size": size, **facts_of(f, size)}
            yield tuple(facts.get(n) for n in names)


class ClipHeaders(DataSource):
    """`spark.read.format("clip_headers").load(folder)`: one row a file, of which only headers are
    read. Options: pattern (comma-separated), recursive, filesPerTask. Files come in order of path;
    every task takes a group of them."""

    @classmethod
    def name(cls) -> str:
        return "clip_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema: object) -> DataSourceReader:
        return HeaderReader(uri(self.options))


def uri(options: dict) -> dict:
    """The options, their names in lower case, with an absolute path or a URI of a store."""
    path = options["path"]
    return {**{k.lower(): v for k, v in options.items()}, "path": path if "://" in path or path.startswith("/") else path.replace("file:", "", 1)}


def box_bytes(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def small_movie(duration: float, n_frames: int, step: int, scale: int, width: int, height: int, video: bool = True, write: Callable[..., bytes] = box_bytes) -> bytes:
    """The headers of an MP4 file without samples, for tests and for placeholders."""
    times = write(b"stts", struct.pack(">IIII", 0, 1, n_frames, step))
    entry = write(b"avc1", bytes(24), struct.pack(">HH", width, height), bytes(50))
    table = write(b"stbl", write(b"stsd", struct.pack(">II", 0, 1), entry), times)
    header = write(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, scale, n_frames * step, 0))
    handler = write(b"hdlr", bytes(8), b"vide" if video else b"soun", bytes(13))
    track = write(b"trak", write(b"mdia", header, handler, write(b"minf", table)))
    movie = write(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 1000, round(duration * 1000)), bytes(80))
    return write(b"ftyp", b"isom", bytes(4)) + write(b"free", bytes(16)) + write(b"moov", movie, track)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipHeaders)
