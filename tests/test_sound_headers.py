"""Headers of real sound files with chunks before the samples, read by seeking and from whole contents."""

import struct

from contourlake.sources import files as S


def sound(rate, bits, channels, samples, before=(), between=(), cut=None):
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    fmt = chunk(b"fmt ", struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits))
    data = chunk(b"data", b"\1" * (samples * channels * bits // 8))
    body = b"WAVE" + b"".join(chunk(*c) for c in before) + fmt + b"".join(chunk(*c) for c in between) + data
    return (b"RIFF" + struct.pack("<I", len(body)) + body)[:cut]


def test_headers_of_files_with_extra_chunks(spark, tmp_path):
    made = {
        "plain.wav": sound(16000, 16, 1, 8000),
        "list.wav": sound(44100, 16, 2, 50_000, between=[(b"LIST", b"x" * 1001), (b"bext", b"y" * 602)]),
        "first.WAV": sound(8000, 8, 1, 4001, before=[(b"JUNK", b"")]),
        "short.wav": sound(16000, 16, 1, 8000, cut=4044),
        "text.wav": b"not a sound file at all, but long enough for one header, surely so",
        "list.TextGrid": b"text",
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    whole = spark.read.format("binaryFile").load(str(tmp_path))
    expected = {"plain": (16000, 16, 1, 0.5), "list": (44100, 16, 2, round(50_000 / 44100, 3)), "first": (8000, 8, 1, 0.5), "short": (16000, 16, 1, 0.125), "text": (None,) * 4}
    headers = S.sound_headers(whole)
    for found in (S.recording_inventory(whole), S.recording_inventory(headers)):
        got = {r.basename: r for r in found.collect()}
        assert {n: (r.sr, r.bit, r.channels, r.dur) for n, r in got.items()} == expected
        assert got["list"].tg_path.endswith("list.TextGrid") and got["list"].wav_size_kb == round(len(made["list.wav"]) / 1024, 1)
    read = {r.path.rsplit("/", 1)[1]: r.n_read for r in headers.collect()}
    assert read["plain.wav"] == 44 and read["list.wav"] == 60 and max(read.values()) <= 60
    assert "content" not in headers._jdf.queryExecution().executedPlan().toString()
