"""The tail source: complete lines, rotation, emptied files, restarts and replays; syslog over UDP and TCP."""

import os
import socket
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.session import ship
from logloom.sources import ingest, tail


@pytest.fixture
def follow(spark, tmp_path):
    ship(spark)
    spark.dataSource.register(tail.TailSource)

    def run(folder, **options):
        lines = spark.readStream.format("tail").options(path=str(folder), pattern="*.log*", **options).load()
        lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return Counter(r["line"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    return run


def test_lines_come_once_across_rotation_and_restarts(follow, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log = folder / "app.log"
    log.write_bytes(b"one\ntwo\r\nhal")
    assert follow(folder) == Counter(["one", "two"])
    with log.open("ab") as f:
        f.write(b"f\nthree\n\xff\xfe\n")
    log.rename(folder / "app.log.1")  # rotated before it was read to its end
    log.write_bytes(b"new one\n")
    want = Counter(["one", "two", "half", "three", "��", "new one"])
    assert follow(folder) == want and follow(folder) == want
    (folder / "other.txt").write_bytes(b"not followed\n")
    log.write_bytes(b"emptied and begun anew\nmore\n")
    want.update(["emptied and begun anew", "more"])
    assert follow(folder) == want
    os.remove(folder / "app.log.1")  # read already
    (folder / "b.log").write_bytes(b"no end yet")
    assert follow(folder) == want


def test_large_files_are_read_by_several_tasks(follow, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = [f"{i} " + "x" * (i % 50) for i in range(2000)]
    (folder / "a.log").write_text("\n".join(lines) + "\n")
    assert follow(folder, chunk="100") == Counter(lines)


def test_ranges_split_anywhere():
    path = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"tail-{os.getpid()}.log")
    data = b"a\n\nbcd\nefghi\n\n\nj\n"
    with open(path, "wb") as f:
        f.write(data)
    for chunk in range(1, len(data) + 2):
        parts = [tail.Range("x", path, b, min(b + chunk, len(data)), b == 0) for b in range(0, len(data), chunk)]
        assert [line for p in parts for _, line in tail.lines_of(p)] == data.split(b"\n")[:-1]
    assert tail.complete(path) == len(data)
    os.remove(path)


def test_a_replayed_batch_reads_the_same_bytes(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\ntwo\n")
    reader = tail.TailReader(str(tmp_path), "*.log*", 1 << 20, True)
    start, end = reader.initialOffset(), reader.latestOffset()
    first = [b.to_pylist() for p in reader.partitions(start, end) for b in reader.read(p)]
    with log.open("ab") as f:
        f.write(b"three\n")
    planned = reader.partitions(start, end)
    log.rename(tmp_path / "a.log.1")
    again = [b.to_pylist() for p in planned for b in reader.read(p)]
    assert [[r["line"] for r in b] for b in again] == [[r["line"] for r in b] for b in first] == [["one", "two"]]
    os.remove(tmp_path / "a.log.1")
    with pytest.raises(FileNotFoundError):
        reader.partitions(start, end)
    assert tail.TailReader(str(tmp_path), "*.log*", 1 << 20, False).partitions(start, end) == []


def test_syslog_over_udp_and_tcp(spark, follow, tmp_path):
    folder, sent = tmp_path / "in", [f"<{i}>Jan  5 10:00:0{i % 10} h app[{i}]: message {i}" for i in range(40)]
    with tail.receiver(str(folder), size=300) as (udp, tcp):
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for line in sent[:10]:
                s.sendto(line.encode(), ("127.0.0.1", udp))
        with socket.create_connection(("127.0.0.1", tcp)) as s:
            s.sendall("".join(f"{x}\n" for x in sent[10:20]).encode())
            s.sendall(b"".join(b"%d %s" % (len(x.encode()), x.encode()) for x in sent[20:40]))
        for _ in range(100):
            if sum(p.read_bytes().count(b"\n") for p in folder.glob("*.log")) == 40:
                break
            time.sleep(0.1)
    assert len(list(folder.glob("*.log"))) > 3
    found = follow(folder)
    assert found == Counter(sent)
    lines = spark.createDataFrame(list(enumerate(found)), "id int, line string")
    rows = ingest.syslog(lines).where(F.col("service") == "app").collect()
    assert {r["message"] for r in rows} == {f"message {i}" for i in range(40)}
