"""Members of a zip archive behind HTTP, read by range, and fetched in parallel by tasks.

A range read takes whole blocks ahead and keeps the last; it is repeated with growing pauses
where the server fails or breaks off, and not where it refuses (4xx).
"""

from __future__ import annotations

import io
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RangeFile(io.RawIOBase):
    """A read-only, seekable file at an http(s) address."""

    def __init__(self, url: str, ahead: int = 1 << 20, tries: int = 4, pause: float = 0.2, timeout: float = 30.0):
        if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
            raise ValueError(f"not an http(s) address: {url}")
        self.url, self.ahead, self.tries, self.pause, self.timeout = url, ahead, tries, pause, timeout
        self.at, self.start, self.block = 0, 0, b""
        self.size = int(self._ask({}, "HEAD")[1]["Content-Length"])

    def _ask(self, headers: dict, method: str = "GET", want: int | None = None):
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, headers=headers, method=method), timeout=self.timeout) as r:
                    body = r.read() if method == "GET" else b""
                    if want is not None and (r.status != 206 or len(body) != want):
                        raise OSError(f"{len(body)} bytes of {want}, status {r.status}")
                    return body, r.headers
            except urllib.error.HTTPError as e:
                if e.code < 500 or k + 1 == self.tries:
                    raise
            except OSError:
                if k + 1 == self.tries:
                    raise
            time.sleep(self.pause * 2**k)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), self.size - self.at)
        if n <= 0:
            return 0
        if not self.start <= self.at < self.start + len(self.block):
            end = min(self.size, self.at + max(n, self.ahead))
            self.block, self.start = self._ask({"Range": f"bytes={self.at}-{end - 1}"}, want=end - self.at)[0], self.at
        got = self.block[self.at - self.start :][:n]
        buffer[: len(got)] = got
        self.at += len(got)
        return len(got)


def open_zip(url: str, **options) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(RangeFile(url, **options), 1 << 16))


def members(url: str, **options) -> list[tuple[str, int]]:
    """(name, size) of every file in the archive, from its directory alone."""
    with open_zip(url, **options) as z:
        return [(i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]


def missing(wanted: DataFrame, folder: str) -> DataFrame:
    """wanted(name, size) without those that already stand in the folder with their full size.  Tasks look, each at its own names."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            system, root = fs.FileSystem.from_uri(folder)
            found = system.get_file_info([f"{root}/{n}" for n in b.column(0).to_pylist()])
            yield b.filter(pa.array([f.size != n for f, n in zip(found, b.column(1).to_pylist(), strict=True)], pa.bool_()))

    return wanted.select("name", F.col("size").cast("long").alias("size")).mapInArrow(run, "name string, size long")


def fetch(wanted: DataFrame, url: str, folder: str, tasks: int = 16, room: int | None = None, **options) -> DataFrame:
    """Copy wanted(name, size) from the archive into the folder, in parallel; -> (name, size) of those copied.

    What is there already is left alone; a member stands under its name only when it is whole (it is
    written beside and moved).  `room`: bytes that may be written; more raises before anything is."""
    todo = missing(wanted, folder)
    need = todo.agg(F.sum("size")).first()[0] or 0
    if room is not None and need > room:
        raise OSError(f"{need} bytes are wanted, {room} are free")

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        archive = None
        for b in batches:
            done = []
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ".." in name.split("/") or name.startswith("/"):
                    raise ValueError(f"the name {name} leaves the folder")
                archive = archive or open_zip(url, **options)
                path = f"{root}/{name}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                part = f"{path}.part-{os.getpid()}"
                with archive.open(name) as src, system.open_output_stream(part) as out:
                    while block := src.read(1 << 20):
                        out.write(block)
                system.move(part, path)
                done.append((name, size))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["name", "size"])

    return todo.repartition(tasks).mapInArrow(run, "name string, size long")
