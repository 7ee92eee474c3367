import random
import time
from hashlib import sha256

import numpy as np
import pyarrow as pa

from tidemark.llm.queries import op2_suffix_dedup
from tidemark.llm.suffix_dedup import _REPEATED, _SEEN, _repeat, deep_shallow, repeated_bytes


def plain(rows):
    first, out = {}, {}
    docs = [(i, (t or "").encode()) for i, t in sorted(rows, key=lambda r: r[0])]
    for i, raw in docs:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if first.setdefault(raw[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), int(gone.sum()), runs, sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcé \n", k=n))
    passage, line = text(260), text(99)
    rows = [(i, text(rng.randint(0, 300)) + (passage if i % 3 == 0 else "") + text(50) + (line if i % 4 == 0 else "")) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(5)]
    rows += [(200, "a" * 500), (201, "a" * 150), (202, "ab" * 200), (203, None), (204, ""), (205, passage[:130] * 3), (206, text(100)), (207, text(30_000) + passage)]
    rng.shuffle(rows)
    return rows


def test_deep_shallow_is_the_sorted_order():
    rng = np.random.default_rng(1)
    for letters in (2, 3, 250):
        buf = rng.integers(0, letters, 4000, dtype=np.uint8)
        buf[1000:1500] = buf[200:700]
        buf[2000:2300] = 1
        starts = rng.permutation(len(buf) - 108)[:3000]
        order, new = deep_shallow(buf, starts)
        got = [buf[s : s + 100].tobytes() for s in starts[order]]
        assert got == sorted(got)
        assert new.tolist() == [True] + [a != b for a, b in zip(got, got[1:])]


def test_against_all_strings(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == plain(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    small = repeated_bytes(docs, block_bytes=3000)  # many blocks and buckets
    assert {r[0]: tuple(r[1:]) for r in small.collect()} == got
    frequent = repeated_bytes(docs, block_bytes=3000, hot=2)  # most anchors count as hot
    assert {r[0]: tuple(r[1:]) for r in frequent.collect()} == got


def test_edge_rows(spark):
    long = "".join(random.Random(4).choices("abcdefgh", k=200))
    docs = spark.createDataFrame([(None, long, 1), (5, long, 2), (5, long, 3), (6, None, 4)], "doc_id long, text string, block int")
    got = sorted((str(r.doc_id), r.n_removed) for r in repeated_bytes(docs).collect())
    assert got == [("5", 200), ("5", 200), ("6", 0), ("None", 0)]
    assert repeated_bytes(docs.limit(0)).count() == 0


def test_a_bucket_of_many_blocks_takes_time_by_its_codes():
    """8,000 blocks, as 32 GB have, leave a bucket no more codes than a few do; results as by a plain count."""
    rng = np.random.default_rng(6)
    n = 8000
    codes = [np.unique(rng.integers(0, 200_000, 15)).astype("<u4") for _ in range(n)]
    more = [c[:1] if i % 3 == 0 else c[:0] for i, c in enumerate(codes)]
    once = [c[1:] if i % 3 == 0 else c for i, c in enumerate(codes)]
    counts = [np.full(len(m), 5, "<i8") for m in more]
    columns = [[7] * n, list(range(n)), *[[x.tobytes() for x in c] for c in (once, more, counts)]]
    seen = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEEN, strict=True)], schema=_SEEN)
    began = time.perf_counter()
    got = _repeat(False, 5)(seen)
    assert time.perf_counter() - began < 2
    total = np.zeros(200_000, int)
    for o, m in zip(once, more, strict=True):
        total[o] += 1
        total[m] += 5
    assert got.schema == _REPEATED
    want = {}
    for i, (o, m) in enumerate(zip(once, more, strict=True)):
        own = [int(c) for c in [*o, *m] if total[c] > 1]
        if own:
            want[i] = ({c for c in own if total[c] <= 5}, {c for c in own if total[c] > 5})
    assert {r["block"]: tuple(set(np.frombuffer(r[c], "<u4").tolist()) for c in ("codes", "hot")) for r in got.to_pylist()} == want
    assert {(r["bucket"], r["whole"]) for r in got.to_pylist()} == {(7, False)}
