"""Log files followed as a stream, and a receiver of syslog over UDP and TCP that writes such files.

    spark.dataSource.register(tail.TailSource)
    lines = spark.readStream.format("tail").option("path", folder).option("pattern", "*.log*").load()

A file is known by its inode and its first line, not by its name: a file that is rotated away (renamed) goes on where it
was, one that takes its name starts at its beginning, and one that is emptied in place starts anew. Offsets are the byte
behind the last complete line of each file, so a line is read once it has ended, and a batch that is run again, after a
restart or a loss, reads the same bytes. Large ranges are read by several tasks. The folder must be one that driver and
executors share, as a mounted one; rotate by renaming, since a copy is another file.
"""

from __future__ import annotations

import contextlib
import fnmatch
import os
import socketserver
import threading
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, place long, line string"
#: Bytes that a task reads, rows of a batch, and the step in which a file's last line break is looked for.
CHUNK, ROWS, BACK = 16 << 20, 4096, 1 << 16


def identity(path: str) -> str | None:
    """What a file is known by; None while its first line has no end."""
    with open(path, "rb") as f:
        first = f.readline()
        return f"{os.fstat(f.fileno()).st_ino}-{zlib.crc32(first)}" if first.endswith(b"\n") else None


def complete(path: str) -> int:
    """The byte behind a file's last complete line."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > 0:
            begin = max(0, end - BACK)
            f.seek(begin)
            if (at := f.read(end - begin).rfind(b"\n")) >= 0:
                return begin + at + 1
            end = begin
    return 0


def known(folder: str, pattern: str) -> dict[str, str]:
    """identity: path of the files there are. A file may go while it is looked at."""
    out = {}
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        with contextlib.suppress(FileNotFoundError):
            if entry.is_file() and fnmatch.fnmatch(entry.name, pattern) and (name := identity(entry.path)):
                out.setdefault(name, entry.path)
    return out


class Range(InputPartition):
    """Lines that begin in [begin, end) of a file; `first` if the byte at begin begins a line."""

    def __init__(self, name: str, path: str, begin: int, end: int, first: bool) -> None:
        super().__init__((name, begin))
        self.name, self.path, self.begin, self.end, self.first = name, path, begin, end, first


def lines_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) without the line break."""
    with open(part.path, "rb") as f:
        f.seek(part.begin)
        if not part.first:
            f.seek(part.begin - 1)
            f.readline()  # belongs to the range before, unless it ends just there
        while (place := f.tell()) < part.end:
            yield place, f.readline().removesuffix(b"\n").removesuffix(b"\r")


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, chunk: int, fail: bool) -> None:
        self.folder, self.pattern, self.chunk, self.fail = folder, pattern, chunk, fail

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """Files that have gone stay out: what was read of them is in the batches before."""
        return {"files": {name: complete(path) for name, path in known(self.folder, self.pattern).items()}}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        paths, out = known(self.folder, self.pattern), []
        for name, to in sorted(end["files"].items()):
            at = start["files"].get(name, 0)
            if at >= to:
                continue
            if name not in paths:
                if self.fail:
                    raise FileNotFoundError(f"a file of {self.folder} has gone before bytes {at} to {to} of it were read")
                continue
            out += [Range(name, paths[name], b, min(b + self.chunk, to), b == at) for b in range(at, to, self.chunk)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        paths = known(self.folder, self.pattern)  # it may have been rotated since the batch was planned
        if partition.name not in paths:
            raise FileNotFoundError(f"{partition.path} has gone before bytes {partition.begin} to {partition.end} of it were read")
        partition.path = paths[partition.name]
        places, lines = [], []
        for place, line in lines_of(partition):
            places.append(place)
            lines.append(line.decode("utf-8", "replace"))
            if len(lines) == ROWS:
                yield self.batch(partition, places, lines)
                places, lines = [], []
        if lines:
            yield self.batch(partition, places, lines)

    def batch(self, partition: Range, places: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [os.path.basename(partition.path)] * len(lines), "place": pa.array(places, pa.int64()), "line": lines})


class TailSource(DataSource):
    """Options: path (a folder), pattern (*), chunk (bytes a task reads), failOnDataLoss (true)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        o = self.options
        return TailReader(o["path"].removeprefix("file://"), o.get("pattern", "*"), int(o.get("chunk", CHUNK)), o.get("failOnDataLoss", "true").lower() == "true")


class Segments:
    """Lines appended to numbered files of a folder; a full one is closed and the next begun."""

    def __init__(self, folder: str, size: int) -> None:
        os.makedirs(folder, exist_ok=True)
        self.folder, self.size, self.lock = folder, size, threading.Lock()
        self.number = max([int(n[8:-4]) for n in os.listdir(folder) if n.startswith("segment-")], default=-1) + 1
        self.file = None

    def add(self, message: bytes) -> None:
        line = message.rstrip(b"\r\n\0").replace(b"\n", b" ") + b"\n"
        with self.lock:
            if self.file is None or self.file.tell() + len(line) > self.size > 0 < self.file.tell():
                self.close()
                self.file = open(f"{self.folder}/segment-{self.number:09}.log", "ab")  # noqa: SIM115
                self.number += 1
            self.file.write(line)
            self.file.flush()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def framed(stream) -> Iterator[bytes]:
    """Messages of a TCP connection: counted ("23 <11>...") or ended by a line break, as RFC 6587 has them."""
    while first := stream.read(1):
        if first.isdigit():
            count = first
            while (c := stream.read(1)).isdigit():
                count += c
            if c != b" ":
                yield count + c + stream.readline()
            else:
                yield stream.read(int(count))
        elif first not in b"\n\0":
            yield first + stream.readline()


@contextlib.contextmanager
def receiver(folder: str, host: str = "127.0.0.1", port: int = 0, size: int = 64 << 20) -> Iterator[tuple[int, int]]:
    """Takes syslog over UDP and TCP into files that the tail source follows; gives the ports (UDP, TCP). What has been written survives a restart of either side."""
    kept = Segments(folder, size)

    class Udp(socketserver.BaseRequestHandler):
        def handle(self) -> None:
            kept.add(self.request[0])

    class Tcp(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            for message in framed(self.rfile):
                kept.add(message)

    class Connections(socketserver.ThreadingTCPServer):
        allow_reuse_address, daemon_threads = True, True

    servers = [socketserver.UDPServer((host, port), Udp), Connections((host, port), Tcp)]
    threads = [threading.Thread(target=s.serve_forever, daemon=True) for s in servers]
    for t in threads:
        t.start()
    try:
        yield servers[0].server_address[1], servers[1].server_address[1]
    finally:
        for s in servers:
            s.shutdown()
            s.server_close()
        kept.close()
