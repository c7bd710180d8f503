"""The binary log in its modes, and alerts over a growing one."""

import struct

import pytest
from test_recordings import DL, A, E, K, P, R, S, W, Z

from causeway.sources.log_format import BadLog, Truncated, check_header, decode, encode, write_log
from causeway.sources.log_source import read_rows, register, truncated
from causeway.streaming.watch import watch

MAGIC = b"TEST"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    import __spark_entry__

    __spark_entry__._session(spark)
    register(spark)


def test_round_trip():
    events = [*DL, P(1, 5, -7, "sub"), W(3, 4), E(9, 1), Z(10, -1), S(1 << 62, 7, "é→", parent=3), {"ts": 0, "ev": "wake", "woken": 1, "by": 2}, {"ts": 5, "ev": "resource_drop", "id": 3}]
    for event in events:
        back = decode(encode(event)[4:])
        assert {k: v for k, v in back.items() if v is not None} == {k: v for k, v in event.items() if v is not None}


def test_bad_bytes():
    with pytest.raises(BadLog):
        check_header(b"NOPExx", MAGIC)
    with pytest.raises(BadLog):
        check_header(MAGIC + b"\x02\0", MAGIC)
    with pytest.raises(Truncated):
        check_header(b"TE")
    body = encode(A(1, 2, 3))[4:]
    for broken in (body[:-1], body + b"\0", b"\1\x63", b"\xff" * 12, b""):
        with pytest.raises(BadLog):
            decode(broken)


def test_modes(spark, tmp_path):
    path = str(tmp_path / "run.log")
    write_log(path, DL, MAGIC)
    read = lambda mode, p=path: spark.read.format("eventlog").option("mode", mode).option("magic", "TEST").load(p)
    rows = read("failfast").orderBy("seq").collect()
    assert len(rows) == len(DL) and rows[0].run_id == "run.log" and rows[2].name == "t1"
    assert not truncated(path)
    with open(path, "ab") as out:
        out.write(struct.pack("<I", 999) + b"abc")
    assert read("prefix").count() == len(DL) and truncated(path)
    with pytest.raises(Exception, match="incomplete"):
        read("failfast").count()
    part, gone = tmp_path / "part.log", str(tmp_path / "gone.log")
    part.write_bytes(b"TE")
    assert list(read_rows(str(part), "r", "FOLLOW")) == [] and list(read_rows(gone, "r", "FOLLOW")) == []
    with pytest.raises(Truncated):
        list(read_rows(str(part), "r", "PREFIX"))
    assert read("follow", gone).count() == 0


def test_watch(spark, tmp_path):
    path = str(tmp_path / "live.log")
    write_log(path, DL[:10], MAGIC)
    stream = spark.readStream.format("eventlog").option("magic", "TEST").load(path)
    got = []
    query, watcher = watch(stream, lambda df: got.append([tuple(r) for r in df.select("kind", "key").collect()]), stuck_ns=100)
    try:
        query.processAllAvailable()
        assert [a for batch in got for a in batch] == [] and watcher.exit_code() == 0
        with open(path, "ab") as out:
            for event in [*DL[10:], R(17, 300), S(17, 3), A(18, 300, 77), {"ts": 19, "ev": "poll_start", "task": 3}, K(20, 3, 300), Z(21, 3), S(500, 4)]:
                out.write(encode(event))
        query.processAllAvailable()
        assert sorted(a for batch in got for a in batch) == [("deadlock", "1,2"), ("stuck", "3,300,20")]
        with open(path, "ab") as out:
            out.write(encode(S(600, 5)))
        query.processAllAvailable()
        assert len([a for batch in got for a in batch]) == 2 and watcher.exit_code() == 2
    finally:
        query.stop()
