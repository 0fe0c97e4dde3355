import gc
import re
import time
from pathlib import Path

import numpy as np
import zstandard

from vigilflow.llm import common
from vigilflow.llm.common import distinct, packed, release, stored, unpacked


def test_span_hashes_do_not_depend_on_blocks_or_places(monkeypatch):
    r = np.random.default_rng(3)
    raw = r.integers(97, 101, 5000).astype(np.uint8)
    starts = r.integers(0, 4900, 800)
    stops = starts + r.integers(0, 90, 800)
    whole = common.span_hashes(raw, starts, stops)
    monkeypatch.setattr(common, "BLOCK_BYTES", 300)
    assert (common.span_hashes(raw, starts, stops) == whole).all()
    texts = [raw[a:b].tobytes() for a, b in zip(starts, stops)]
    assert len(set(zip(texts, whole.tolist()))) == len(set(texts)) == len(set(whole.tolist()))
    assert (common.span_hashes(np.append(raw[:7], raw), starts + 7, stops + 7) == whole).all()


def test_order_of_hashes_with_equal_leading_bits():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 40_000):
        values = draw.integers(0, 1 << 63, n).astype(np.uint64)
        values[n // 2 :] = values[0] if n > 1000 else values[n // 2 :]
        values[: n // 3] = (values[: n // 3] & np.uint64(0xFFF)) | np.uint64(7 << 40)
        found, places = distinct(values)
        assert (found[places] == values).all() if n else len(found) == 0
        assert (found == np.unique(values)).all()
        assert (unpacked(packed(found, True), np.uint64, True) == found).all()
        assert (unpacked(packed(places), np.int64) == places).all()


def test_planes_are_packed_each_for_itself():
    r = np.random.default_rng(3)
    for n in (0, 1, 1023, 1024, 5000):
        sorted_, small = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64)) & ~np.uint64(0xFFF), r.integers(0, 3, n).astype(np.uint32)
        assert (common.unpacked(common.packed(sorted_, True), np.uint64, True) == sorted_).all()
        assert (common.unpacked(common.packed(small), np.uint32) == small).all()
    words = np.sort(np.concatenate([sorted_, r.integers(0, 1 << 63, 3000, dtype=np.uint64) & ~np.uint64(0xFF)]))
    planes = np.diff(words, prepend=np.uint64(0)).view(np.uint8).reshape(len(words), 8).T.tobytes()
    assert len(common.packed(words, True)) < 0.97 * len(zstandard.ZstdCompressor(level=1).compress(planes))


def test_memory_is_given_back_after_the_last_batch(monkeypatch):
    ended = []
    monkeypatch.setattr(common, "give_back", lambda: ended.append(len(seen)))
    seen = []
    step = common.giving_back(lambda batches: (2 * x for x in batches))
    for x in step(iter([1, 2, 3])):
        seen.append(x)
    assert seen == [2, 4, 6] and ended == [3]


def test_a_stored_step_returns_native_memory_of_the_driver(spark):
    jvm = spark._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")

    def used() -> float:
        return int(re.search(r"Pss_Anon:\s+(\d+)", status.read_text())[1]) / 1024

    release(stored(spark.range(10).toDF("id"), "first"))
    taken = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(4000)]
    # Every 20th buffer stays, so the allocator can't give the free memory between them back by itself.
    left, taken = taken[::20], None
    for _ in range(3):
        gc.collect()
        jvm.System.gc()
        time.sleep(1)
    before = used()
    release(stored(spark.range(10).toDF("id"), "second"))
    assert before - used() > 150 and len(left) == 200
