"""Compressed logs by ranges of frames."""

import random

import pyarrow as pa
import pytest

from tallyforge.sources import event_logs, frames, transcripts


def frame(data: bytes) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out:
        out.write(data)
    return sink.getvalue().to_pybytes()


def cut_in_frames(data: bytes, rng, most: int) -> tuple[bytes, list[int]]:
    """The data as frames of random lengths, which do not end at line ends, and where each frame ends."""
    out, ends, at = b"", [], 0
    while at < len(data) or not ends:
        n = rng.randrange(0, most)
        out += frame(data[at : at + n])
        ends.append(len(out))
        at += n
    return out, ends


SKIPPABLE = (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"\n\n\n\n\n"


def stored(tmp_path, data: bytes, name="x.jsonl.zst"):
    (tmp_path / name).write_bytes(data)
    return frames.StoredFile(str(tmp_path / name))


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_every_line_once(tmp_path, seed, monkeypatch):
    monkeypatch.setattr(frames, "WINDOW_BYTES", 64)
    rng = random.Random(seed)
    lines = [bytes(rng.choices(b"ab \r\xc3\xa9", k=rng.choice([0, 1, 5, 40, 900]))) for _ in range(80)]
    data = b"\n".join(lines) + (b"\n" if seed % 2 else b"")
    whole, ends = cut_in_frames(data, rng, [30, 3000][seed % 2])
    file = stored(tmp_path, whole + (SKIPPABLE if seed > 3 else b""))
    assert list(frames.file_ranges(file, 1))[: len(ends)] == [(a, b - a) for a, b in zip([0, *ends], ends, strict=False)]
    for range_bytes in (1, 50, 1000, 1 << 30):
        ranges = list(frames.file_ranges(file, range_bytes))
        assert sum(n for _, n in ranges) == file.length
        got = [line for k, (start, size) in enumerate(ranges) for line in frames.range_lines(file, start, size, k == 0)]
        assert got == data.split(b"\n")[: -1 if data.endswith(b"\n") or not lines[-1] else None]


def test_large_frame_without_content_size(tmp_path):
    """Blocks of all kinds: raw, repeated and compressed; with a checksum where the writer adds one."""
    rng = random.Random(1)
    data = rng.randbytes(300_000) + b"a" * 500_000 + b"some words again and again " * 9000
    file = stored(tmp_path, frame(data) + frame(b""))
    first = len(frame(data))
    assert frames.frame_end(file, 0) == first and frames.frame_end(file, first) == file.length
    zstandard = pytest.importorskip("zstandard")
    for options in ({"write_checksum": True}, {"write_content_size": False}):
        one = zstandard.ZstdCompressor(**options).compress(data)
        assert frames.frame_end(stored(tmp_path, one + b"rest"), 0) == len(one)


def test_broken_files_lose_their_broken_range_only(spark, tmp_path):
    good = frame(b"{}\n{}\n")
    (tmp_path / "cut.jsonl.zst").write_bytes(good + good + frame(b"[1]\n" * 5000)[:-3])
    (tmp_path / "bad.jsonl.zst").write_bytes(good + b"no frame at all")
    (tmp_path / "empty.jsonl.zst").write_bytes(b"")
    for range_bytes in (1, 1 << 20):
        lines = event_logs.scan_compressed_lines(spark, str(tmp_path), range_bytes).collect()
        assert {r.source_file[-13:]: 0 for r in lines} == {"cut.jsonl.zst": 0, "bad.jsonl.zst": 0}
        assert sum(r.value == "{}" for r in lines) == 6
        marked = [r.source_file[-13:] for r in lines if r.value.startswith("\0unreadable")]
        assert set(marked) == {"cut.jsonl.zst", "bad.jsonl.zst"}
    records = event_logs.event_records(event_logs.scan_compressed_lines(spark, str(tmp_path)))
    assert {r.reason for r in transcripts.rejected_lines(records).collect()} >= {"unreadable file"}


def test_one_file_is_many_tasks(spark, tmp_path):
    rng = random.Random(2)
    text = "".join(f"line {i} {rng.random()}\n" for i in range(5000)).encode()
    (tmp_path / "x.jsonl.zstd").write_bytes(cut_in_frames(text, rng, 4000)[0])
    ranges = frames.frame_ranges(spark, str(tmp_path), 4000)
    n = ranges.count()
    lines = frames.frame_lines(ranges)
    assert n > 10 and lines.rdd.getNumPartitions() == n
    in_order = [r.value for r in lines.orderBy("block", "pos").collect()]
    assert "\n".join(in_order) + "\n" == text.decode()


def test_stores_that_only_spark_reads_give_whole_files(spark, tmp_path, monkeypatch):
    (tmp_path / "x.jsonl.zst").write_bytes(frame(b"a\nb") + frame(b"c\nd"))
    want = sorted(r.value for r in event_logs.scan_compressed_lines(spark, str(tmp_path), 1).collect())
    monkeypatch.setattr(event_logs, "opened_by_arrow", lambda folders: False)
    assert sorted(r.value for r in event_logs.scan_compressed_lines(spark, str(tmp_path)).collect()) == want == ["a", "bc", "d"]
    assert not frames.opened_by_arrow(["viewfs://store/in"])


def test_short_ranges_share_tasks(spark, tmp_path):
    """A task per range of a few bytes is no task per some megabytes; every line still comes once, in order."""
    logs = tmp_path / "logs"
    logs.mkdir()
    for name in "ab":
        (logs / f"{name}.jsonl.zst").write_bytes(b"".join(frame(f"{name}{i}\n{name}".encode()) for i in range(200)))
    ranges = frames.frame_ranges(spark, str(logs), 1)
    lines = frames.frame_lines(ranges)
    tasks = lines.rdd.getNumPartitions()
    assert ranges.count() == 400 and tasks <= 2 * spark.sparkContext.defaultParallelism
    got = [(r.source_file[-11], r.value) for r in lines.orderBy("source_file", "block", "pos").collect()]
    assert got == [(name, "" .join(([name] if i else []) + [f"{name}{i}"]) if i < 200 else name) for name in "ab" for i in range(201)]
    assert frames.frame_lines(ranges, 3).rdd.getNumPartitions() == 3
