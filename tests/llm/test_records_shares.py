"""Token records: a repeated id is cut among files, the order of rows does not depend on the files, files are read in runs."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from contourlake.llm import records as R


def test_shares_of_a_repeated_bound_are_ascending_and_complete():
    bounds = np.array([3, 7, 7, 7, 9], np.int64)
    ids = np.array([1, 3, 5, 7, 7, 7, 8, 9, 12], np.int64)
    ties = np.array([0, 9, 9, 0, 1 << 31, (1 << 32) - 1, 5, 5, 5], np.int64)
    assert R.share_of(bounds, ids, ties).tolist() == [0, 1, 1, 2, 3, 4, 4, 5, 5]
    assert R.share_of(np.array([], np.int64), ids, ties).tolist() == [0] * 9


@pytest.fixture(scope="module")
def written(spark):
    rows = [(7, f"copy number {i} of the frequent id " + "word " * (i % 50)) for i in range(300)] + [(i, f"text {i}") for i in range(100, 160)] + [(None, None), (None, "no id"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    return rows, R.write_records(docs, shard_bytes=1 << 9)


def test_a_frequent_id_is_cut_among_files(spark, written):
    rows, manifest = written
    found = manifest.collect()
    assert sum(r["n_records"] for r in found) == len(rows)
    assert max(r["n_records"] for r in found) < len(rows) / 4


def test_order_and_starts_do_not_depend_on_files(spark, written):
    rows, manifest = written
    back = sorted(R.read_records(manifest).collect(), key=lambda r: r["start"])
    made = R.encoder(R.DEFAULT_VOCABULARY)
    want = []
    for d, text in rows:
        ids = [*made.library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((R.NO_ID if d is None else d, zlib.crc32(b"\x02" + np.array(ids, "<u2").tobytes()), np.array(ids, "<u4").tobytes()))
    want.sort(key=lambda w: w[:2])
    assert [(r["doc_id"], bytes(r["ids"])) for r in back] == [(None if d == R.NO_ID else d, ids) for d, _, ids in want]
    assert [r["start"] for r in back] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in back])[:-1]]).tolist()


@pytest.mark.parametrize("most_records, most_bytes", [(1, 1 << 20), (7, 1 << 20), (256, 1), (256, 300)])
def test_runs_equal_single_records(written, most_records, most_bytes):
    one = max(written[1].collect(), key=lambda r: r["n_records"])
    reader = R.ShardReader(one["path"], one["index_path"])
    flat, at = [], 0
    for i, part in reader.runs(most_records, most_bytes):
        assert i == at and len(part) <= most_records
        flat += part
        at += len(part)
    single = [reader[i] for i in range(len(reader))]
    assert [(d, x.tolist()) for d, x in flat] == [(d, x.tolist()) for d, x in single]


def test_a_changed_byte_is_found_in_runs(written, tmp_path):
    one = written[1].first()
    data = bytearray(open(one["path"].removeprefix("file://"), "rb").read())
    data[R.HEAD.size + 3] ^= 1
    (tmp_path / "x.rec").write_bytes(data)
    with pytest.raises(ValueError):
        list(R.ShardReader(f"file://{tmp_path}/x.rec", one["index_path"]).runs())
