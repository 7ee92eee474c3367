import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from tidemark.llm.queries import op9_simhash
from tidemark.llm.simhash import LANES, _by_key, _majority, bits_apart, block_masks, cell_components, fingerprint, keep_one, near_blocks, near_links, shingle_hashes, simhash_groups


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    own = {i: i for i, _ in fps}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if bin(a ^ b).count("1") <= 3 and root(i) != root(j):
                own[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (f"{f:016x}", root(i)) for i, f in fps}


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 90)))) for i in range(60)]
    base = rng.choices(vocabulary, k=400)
    for i in range(60, 130):  # a chain of near copies
        base[rng.randrange(400)] = rng.choice(vocabulary)
        rows.append((i, "  ".join(base).upper() if i % 7 == 0 else "\t".join(base)))
    return [*rows, (200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "a\x1cb c d e")]


def test_fingerprint_is_the_plain_one():
    for _, text in corpus():
        assert fingerprint((text or "").encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("n", [10, 10**6, 10**10])
def test_any_three_bits_leave_a_key(n):
    rng = random.Random(n)
    masks = block_masks(n)
    for _ in range(500):
        diff = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(diff & (m % (1 << 64)) == 0 for m in masks)


def test_components_against_all_pairs(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, str(tmp_path)).collect()}
    assert got == plain_components(rows)


def test_large_keys_are_split(spark):
    """Thousands of fingerprints that share every key of the first level, some of them linked."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ (rng.getrandbits(24) << 40 if i % 2 else rng.getrandbits(24)) for i in range(600)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps)[:80]}
    own = {f: f for f in fps}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3 and root(a) != root(b):
                own[max(root(a), root(b))] = min(root(a), root(b))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for most in (32, 100, 4096):
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in near_links(df, most=most).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        mine = {f: f for f in fps}

        def find(x, mine=mine):
            while mine[x] != x:
                x = mine[x]
            return x

        for a, b in links:
            if find(a) != find(b):
                mine[max(find(a), find(b))] = min(find(a), find(b))
        assert {f: find(f) for f in fps} == {f: root(f) for f in fps}


def test_keys_that_go_on_over_batches():
    rng = np.random.default_rng(1)
    rows = np.column_stack([np.sort(rng.integers(0, 3, 400)), np.zeros(400, np.int64), np.arange(400)])
    for size in (1, 7, 100, 400):
        for most in (3, 60, 1000):
            batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[i : i + size].T], names=["t", "key", "x"]) for i in range(0, 400, size)]
            seen = list(_by_key(iter(batches), lambda r: [("whole", r)], lambda r: [("large", r)], most))
            assert np.array_equal(np.concatenate([r for _, r in seen]), rows)
            for kind, r in seen:
                for k in np.unique(r[:, 0]):
                    whole = (rows[:, 0] == k).sum()
                    assert (kind == "whole") == (whole <= most) and (kind == "large" or (r[:, 0] == k).sum() == whole)


def test_a_hot_key_takes_bounded_time(spark):
    import time

    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 40, 100_000)) << 12  # one key, next to no links
    began = time.perf_counter()
    near_links(spark.createDataFrame(pd.DataFrame({"fp": fps})).repartition(4)).count()
    assert time.perf_counter() - began < 60


def jaccard(a, b):
    a, b = ({" ".join(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_of_five_words_go(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(2000)]
    texts = [rng.choices(vocabulary, k=rng.randint(150, 400)) for _ in range(120)]
    rows, near = [(i, " ".join(t)) for i, t in enumerate(texts)], []
    for i, t in enumerate(texts):
        own = list(t)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        near.append((1000 + i, " ".join(own)))
    kept = {r.doc_id for r in keep_one(spark.createDataFrame(rows + near, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows} <= kept  # other texts stay
    like = [i for (i, a), (_, b) in zip(near, rows, strict=True) if jaccard(a, b) >= 0.85]
    assert len(like) >= 60 and sum(i not in kept for i in like) >= 0.9 * len(like)


def test_rows_of_a_large_group_leave_one(spark):
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(300)]
    rows = [(5000 - i, " ".join(base[:-1] + [f"x{i % 900}"])) for i in range(3000)] + [(9000, "something else that stands here for itself alone")]
    assert sorted(r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()) == [2001, 9000]


def test_edge_rows(spark):
    rows = [(None, "x y z w", 1), (7, "x y z w", 2), (7, "x y z w", 2), (None, "q r s t u", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash_groups(docs).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert sorted((str(r.doc_id), r.fp) for r in keep_one(docs).collect()) == [("7", 2), ("None", 3)]
    odd = [(1, None, 0), (2, "", 0), (3, " \t", 0), (4, "one", 0), (4, "two words", 0), (4, "two words", 1), (None, "one", 0), (None, None, 0)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, th int")
    assert keep_one(odd).columns == odd.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in keep_one(odd).collect()) == [("1", "None"), ("4", "one"), ("4", "two words")]
    assert keep_one(odd.limit(0)).count() == 0
    assert simhash_groups(docs.limit(0)).count() == 0


def wide_components(fps, most, also=lambda i, j: True):
    own = np.arange(len(fps))
    for i in range(len(fps)):
        apart = np.bitwise_count(fps[i] ^ fps).astype(int).sum(1)
        for j in np.flatnonzero((apart <= most) & also(i, slice(None))):
            own[own == max(own[i], own[j])] = min(own[i], own[j])
    return own.tolist()


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.95, 1.0])
def test_no_link_of_wide_fingerprints_is_without_a_block(similarity):
    rng = random.Random(4)
    most, blocks = int(bits_apart(similarity)), near_blocks(similarity)
    assert sorted(b for (lo, hi), _ in blocks for b in range(lo, hi)) == list(range(64 * LANES))
    for _ in range(300):
        differ = set(rng.sample(range(64 * LANES), most))
        assert any(not differ & set(range(*own)) and len([b for r in beside for b in range(*r) if b in differ]) <= 2 for own, beside in blocks)


def test_cells_by_pairs_and_by_bits_join_the_same():
    """Pairs at the limit, a large group of copies and rows of their own, by either way and against all pairs."""
    rng = np.random.default_rng(9)
    flips = lambda n: np.packbits(np.isin(np.arange(256), rng.choice(256, n, replace=False)), bitorder="little").view("<u8")
    fps = [rng.integers(0, 1 << 63, 4, dtype=np.uint64) for _ in range(150)]
    fps += [fps[i] ^ flips(36 + i % 5) for i in range(100)]
    base = fps[0]
    fps += [base ^ flips(int(rng.integers(0, 24))) for _ in range(300)] + [base ^ flips(int(rng.integers(30, 60))) for _ in range(100)]
    fps = np.array(fps)[rng.permutation(len(fps))]
    rest = (fps[:, 0] & np.uint64(0x1FFF)).astype(np.int64)
    lanes = [fps[:, k].view("<i8") for k in range(4)]
    near = lambda i, j: np.bitwise_count(rest[i] ^ rest[j]) <= 2
    groups = []
    for few in (10_000, 0):
        got = cell_components(rest, lanes, 38, few)
        assert (got[got] == got).all()
        groups.append([int(np.flatnonzero(got == g)[0]) for g in got])
    want, whole = wide_components(fps, 38, near), wide_components(fps, 38)
    for got in groups:  # all links within two bits of rest, and nothing that is no link
        assert all(got[i] == got[w] for i, w in enumerate(want)) and all(whole[i] == whole[g] for i, g in enumerate(got))


def test_no_near_copy_is_left_out(spark):
    """Texts whose fingerprints differ by about the limit: each link counts, however the work is divided."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(2000)]
    rows = []
    for i in range(250):
        text = rng.choices(vocabulary, k=120)
        rows.append((i, " ".join(text)))
        for k in rng.sample(range(120), rng.randint(1, 3)):
            text[k] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(text)))
    base = rng.choices(vocabulary, k=120)
    for i in range(80):  # a chain
        base[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((2000 + i, " ".join(base)))
    rows.sort()
    fps = np.array([_majority(shingle_hashes(t.encode(), 5), LANES) for _, t in rows])
    want = {i for (i, _), own in zip(rows, wide_components(fps, bits_apart(0.8)), strict=True) if rows[own][0] == i}
    limit = [int(np.bitwise_count(fps[k] ^ fps[k + 250]).sum()) for k in range(250)]
    assert sum(32 <= x <= 38 for x in limit) >= 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for few, dealt in ((3000, None), (0, 5)):
        assert {r.doc_id for r in keep_one(docs, few=few, dealt=dealt).collect()} == want
