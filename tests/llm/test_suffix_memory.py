"""What a task of the suffix operator holds at once, and that its blocks and ranges give what one pass gives."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd

from tidewater.llm import suffix_dedup


def peak(run) -> tuple[object, int]:
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_keys_of_a_piece_take_little_memory(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(97, 123, 1 << 20, np.uint8))
    starts = np.array([0, 60, 5_000, 400_000], np.int64)
    found, most = peak(lambda: suffix_dedup.records(starts, data))
    assert most < 30 * len(data)
    for block in (1, 997, 1 << 30):
        n = 3_000 if block == 1 else len(data)
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        again = suffix_dedup.records(starts[starts < n - 50], data[:n])
        monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 16)
        whole = suffix_dedup.records(starts[starts < n - 50], data[:n]) if block == 1 else found
        assert all((a == b).all() for a, b in zip(again, whole, strict=True))


def test_keys_of_a_bucket_take_little_memory(monkeypatch):
    rng = np.random.default_rng(2)
    docs, per_row = 500, 1_000
    keys = rng.integers(0, 1 << 40, docs * per_row, np.uint64)
    keys[rng.integers(0, len(keys), 50_000)] = keys[7]
    head = lambda d: np.array([1], "<u4").tobytes() + np.array([d], "<i8").tobytes() + np.array([per_row], "<u4").tobytes()
    data = [head(d) + suffix_dedup.pack_keys(keys[d * per_row : (d + 1) * per_row]) for d in range(docs)]
    table = pd.DataFrame({"bucket": 0, "direct": False, "doc": 0, "data": data})
    told, most = peak(lambda: pd.concat(suffix_dedup.shared_keys(iter([table]))))
    assert most < 50 * len(keys)
    found = {int(d): suffix_dedup.unpack_keys(x).tolist() for d, x in zip(told["doc"], told["data"], strict=True)}
    owner = np.repeat(np.arange(docs), per_row)
    both = pd.DataFrame({"key": keys, "doc": owner})
    wanted = both[both.groupby("key")["doc"].transform("nunique") > 1].groupby("doc")["key"].apply(sorted).to_dict()
    assert found == wanted
