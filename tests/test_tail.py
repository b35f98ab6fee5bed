"""A tailed log gives what a batch read of it gives, however its bytes arrive."""

import json

import pytest

from samples import CLAUDE, CODEX, GEMINI
from spanloom.sources.pairs import read_pairs
from spanloom.sources.tail import tail_lines, tail_pairs, whole_lines


class Tail:
    def __init__(self, df, where, name):
        self.spark, self.name = df.sparkSession, name
        self.query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(where)).start()

    def rows(self):
        self.query.processAllAvailable()
        assert self.query.exception() is None
        return self.spark.table(self.name).collect()


@pytest.fixture
def tail(spark, tmp_path):
    made = []

    def start(df, name):
        made.append(Tail(df, tmp_path / f"{name}-state", name))
        return made[-1]

    yield start
    for t in made:
        t.query.stop()


def append(path, data):
    with path.open("ab") as f:
        f.write(data)


def test_torn_line_waits_and_appended_lines_come_once(spark, tmp_path, tail):
    log = tmp_path / "logs" / "a.jsonl"
    log.parent.mkdir()
    t = tail(tail_lines(spark, str(log.parent)), "torn")
    assert t.rows() == []
    append(log, b"one\ntw")
    assert [r.value for r in t.rows()] == ["one"]
    append(log, "o é".encode()[:-1])
    assert [r.value for r in t.rows()] == ["one"]
    append(log, "é".encode()[-1:] + b"\nthree\n")
    append(log.parent / "b.jsonl", b"other\n")
    append(log.parent / "c.txt", b"no log\n")
    got = sorted((r.source_path.rsplit("/")[-1], r.row_id, r.value, r.restarted) for r in t.rows())
    assert got == [("a.jsonl", 0, "one", False), ("a.jsonl", 4, "two é", False), ("a.jsonl", 11, "three", False),
                   ("b.jsonl", 0, "other", False)]


def test_truncated_log_starts_anew(spark, tmp_path, tail):
    log = tmp_path / "a.jsonl"
    log.write_bytes(b"old one\nold two\n")
    t = tail(tail_lines(spark, str(log)), "cut")
    assert len(t.rows()) == 2
    log.write_bytes(b"new\nto")
    t.query.processAllAvailable()
    append(log, b"rn\n")
    got = [(r.value, r.row_id, r.restarted) for r in t.rows()[2:]]
    assert got == [("new", 0, True), ("torn", 4, False)]


def test_restart_from_checkpoint_goes_on_where_it_stopped(spark, tmp_path):
    log = tmp_path / "a.jsonl"
    log.write_bytes(b"one\ntw")

    def run():
        q = (tail_lines(spark, str(log)).writeStream.format("json").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).start())
        q.processAllAvailable()
        q.stop()
        return sorted(r.value for r in spark.read.json(str(tmp_path / "out")).collect())

    assert run() == ["one"]
    append(log, b"o\nthree\n")
    assert run() == ["one", "three", "two"]
    assert run() == ["one", "three", "two"]


def test_pairs_are_those_of_the_batch(spark, tmp_path, tail):
    folder = tmp_path / ".claude-trace"
    folder.mkdir()
    log = folder / "a.jsonl"
    data = "".join(json.dumps(p) + "\n" for p in CLAUDE + CODEX + GEMINI).encode() + b'\n{"request": \nnot json\n'
    t = tail(tail_pairs(spark, str(folder), range_bytes=700), "pairs")
    cuts = [0, 1, 900, 901, 2500, len(data) - 3, len(data)]
    for a, b in zip(cuts, cuts[1:]):
        append(log, data[a:b])
        t.query.processAllAvailable()
    key = lambda r: (r.request.timestamp, r.request.body, None if r.response is None else r.response.body_raw)
    got = sorted(t.rows(), key=lambda r: r.row_id)
    want = read_pairs(spark, str(log)).orderBy("row_id").collect()
    assert len(want) == 5
    assert [key(r) for r in got] == [key(r) for r in want]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 100])
def test_every_cut_gives_every_line_once(tmp_path, step):
    path = tmp_path / "x"
    path.write_bytes(b"a\n\nbcd\n" + b"e" * 20 + b"\nlast")
    with path.open("rb") as f:
        got = [x for a in range(0, 32, step) for x in whole_lines(f, a, min(a + step, 32))]
    assert got == [(0, b"a"), (2, b""), (3, b"bcd"), (7, b"e" * 20)]
