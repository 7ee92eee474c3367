"""SimHash near-duplicates with pigeonhole blocks.

Fingerprints are made in one scan.  Two fingerprints at most ``k`` bits apart agree on at least ``b - k`` of ``b``
blocks, so every choice of ``b - k`` blocks is one join key; keys are wide enough for the number of distinct
fingerprints that a key holds few of them.  Within a key, Hamming distances are verified and only a spanning
forest of the true links leaves the task, never all pairs; components then come from distributed star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import at_work, connected_components, reachable, salted_join, text_bytes, written

SEED = 42
WORDS = 3
DISTANCE = 3
#: Near copies (:func:`keep_one`): words of a shingle, least similarity, words of 64 bits of a fingerprint.
WORDS_NEAR, SIMILARITY, LANES = 5, 0.8, 4
#: Blocks that a part has, fewest blocks in all; rows of a cell up to which all pairs are looked at, fewest and most rows from which
#: on a cell is dealt over tasks, pairs that are compared at once.
BLOCKS, LEAST_BLOCKS, FEW, DEALT, MOST_DEALT, PAIRS = 3, 39, 1500, 16_384, 1 << 20, 1 << 20
_LANES = [f"f{i}" for i in range(LANES)]
_MIX = (0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Candidates per fingerprint and key that unrelated fingerprints may give; more blocks are used beyond it, up to about 200 keys.
CANDIDATES = 2.0
#: Fingerprints of one key that are compared with each other; larger keys are split.
MOST = 1024


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of UTF-8 bytes: A-Z lowered, ASCII white space splits, every shingle counts as often as it stands."""
    return int(_majority(shingle_hashes(text, words))[0])


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    flat = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(flat, SEED)], "<u8")
    starts = list(accumulate((len(p) + 1 for p in parts), initial=0))
    n = len(parts) - words + 1
    spans = map(slice, starts, [s - 1 for s in starts[words:]])
    return np.fromiter(map(xxh64_intdigest, map(flat.__getitem__, spans), repeat(SEED)), "<u8", n)


def _majority(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Bits set in over half the hashes, as ``lanes`` words of 64 bits; lanes after the first mix each hash anew."""
    out = np.zeros(lanes, "<u8")
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 65_536):
            own = hashes[i : i + 65_536]
            if lane:
                own = (own ^ own >> np.uint64(31)) * np.uint64(_MIX[lane - 1])
                own = (own ^ own >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
                own = own ^ own >> np.uint64(32)
            ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[lane] = int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at_work("simhash")
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], "<u8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8"))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, fp long)`` for every row; the fingerprint's 64 bits as a signed long."""
    reachable(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("t")).mapInArrow(_fingerprints, "doc_id long, fp long")


def block_masks(n: int, distance: int = DISTANCE) -> list[int]:
    """Bit masks, one for each join key, for ``n`` distinct fingerprints (signed 64-bit).

    The fewest blocks whose keys hold about ``CANDIDATES`` unrelated fingerprints or fewer; every scheme finds all links.
    """
    for blocks in range(distance + 1, 65 // 2):
        key_bits = 64 * (blocks - distance) // blocks
        if n / 2**key_bits <= CANDIDATES / comb(blocks, distance) or comb(blocks, distance) > 200:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def spanning_links(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links between positions of ``fps`` that connect all that are at most ``distance`` bits apart, directly or by others."""
    rest, links = np.arange(len(fps)), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= distance
            if near.any():
                links += [(at, x) for x in rest[near]]
                front += list(rest[near])
                rest = rest[~near]
    return links


def _run_links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between positions of ``fp`` (sorted by ``key``) within each run of equal keys."""
    cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
    size = np.diff(cuts)
    run = np.repeat(np.arange(len(size)), size)
    small = np.repeat(size <= 6, size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, 6):
        i = np.flatnonzero((run[d:] == run[:-d]) & small[d:])
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
        a.append(i)
        b.append(i + d)
    for r in np.flatnonzero(size > 6):
        if links := spanning_links(fp[cuts[r] : cuts[r + 1]], distance):
            i, j = np.array(links).T
            a.append(i + cuts[r])
            b.append(j + cuts[r])
    return np.concatenate(a), np.concatenate(b)


def _by_key(batches: Iterator[pa.RecordBatch], whole, large, most: int) -> Iterator[pa.RecordBatch]:
    """``whole`` of rows with the whole of each key they hold, ``large`` of parts of keys that more than ``most`` rows have.

    Rows come sorted by their first two columns, the key; never more than a batch and ``most`` rows are held.
    """
    held: list[np.ndarray] = []
    n, long = 0, False  # rows held, all of one key, and whether earlier rows of it have gone to ``large``

    def flush():
        nonlocal held, n
        rows = np.concatenate(held)
        held, n = [], 0
        key = rows[:, :2]
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
        size = np.diff(cuts)
        big = np.repeat(size > most, size)
        if (~big).any():
            yield from whole(rows[~big])
        for r in np.flatnonzero(size > most):
            yield from large(rows[cuts[r] : cuts[r + 1]])

    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype("<i8") for c in batch.columns])
        if not len(rows):
            continue
        new = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
        cut = int(new[-1]) + 1 if len(new) else 0  # the last key may go on in the next batch
        if held and (held[-1][-1, :2] != rows[0, :2]).any() or long and (last != rows[0, :2]).any():
            if held:
                yield from (large(np.concatenate(held)) if long else flush())
                held, n = [], 0
            long = False
        if cut:
            if long:
                same = int(np.argmax((rows[:, :2] != last).any(1)))
                yield from large(np.concatenate([*held, rows[:same]]))
                held, n, long = [], 0, False
                if cut > same:
                    held.append(rows[same:cut])
            else:
                held.append(rows[:cut])
            if held:
                yield from flush()
        held.append(rows[cut:])
        n, last = n + len(held[-1]), rows[-1, :2].copy()
        if n > most:
            yield from large(np.concatenate(held))
            held, n, long = [], 0, True
    if held:
        yield from (large(np.concatenate(held)) if long else flush())


def sub_masks(mask: int, distance: int = DISTANCE) -> list[int]:
    """Masks that split a key further: ``mask`` with two of ``distance + 2`` blocks of the bits that it leaves."""
    left = [i for i in range(64) if not mask >> i & 1]
    blocks = distance + 2
    parts = [sum(1 << i for i in left[len(left) * k // blocks : len(left) * (k + 1) // blocks]) for k in range(blocks)]
    masks = [mask % (1 << 64) | x | y for x, y in combinations(parts, 2)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


_LINK = "kind int, a long, b long, c long"


def _links(distance: int, most: int):
    """Rows ``(mask, key, fp)`` to links (kind 0: two fingerprints) and to rows under finer masks where a key has too many (kind 1)."""

    def batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns[0])
        rest = [np.zeros(n, np.int64)] * (3 - len(columns))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.array(c) for c in (*columns, *rest)]], names=["kind", "a", "b", "c"])

    def whole(rows: np.ndarray):
        fp = np.ascontiguousarray(rows[:, 2])
        i, j = _run_links(rows[:, :2], fp.view("<u8"), distance)
        yield batch(0, fp[i], fp[j])

    def large(rows: np.ndarray):
        fp = np.ascontiguousarray(rows[:, 2])
        for m in sub_masks(int(rows[0, 0]), distance):
            yield batch(1, np.full(len(fp), m, np.int64), fp & m, fp)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_key(batches, whole, large, most)

    return over


def near_links(fps: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """Links ``(a, b)`` between distinct values of column ``fp`` that connect all pairs within ``distance`` bits.

    A key that more than ``most`` fingerprints share is split by the bits that it leaves, of which two blocks of
    ``distance + 2`` agree in a close pair, until all keys are small; so no task compares more than ``most`` with each other.
    """
    reachable(fps.sparkSession)
    if most < 2 ** (distance + 2):
        raise ValueError("keys of so few fingerprints may have no bits left to split by")
    masks = block_masks(fps.count(), distance)
    keys = F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for m in masks])
    rows = fps.select(F.explode(keys).alias("k"), "fp").select(F.col("k.mask").cast("long").alias("mask"), "k.key", "fp")
    links = None
    while True:
        found = written(rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_links(distance, most), _LINK))
        own = found.where("kind = 0").select("a", "b")
        links = own if links is None else links.unionByName(own)
        rows = found.where("kind = 1").select(F.col("a").alias("mask"), F.col("b").alias("key"), F.col("c").alias("fp"))
        if not rows.limit(1).count():
            return links


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    component_id is the smallest id reachable over links.  Null or blank texts have fingerprint zero and link as any
    other.  Rows that repeat an id each get a row.  A null id takes part and never names a component (null if its
    component has no other).  Long texts are read whole.  An empty table gives no rows; other columns are not read.
    """
    reachable(docs.sparkSession)
    made = written(fingerprints(docs, id_col, text_col))
    nodes = written(made.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(near_links(nodes.select("fp"), distance))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = salted_join(linked, least, ["root"]).select("fp", "component_id")
    return salted_join(made, named, ["fp"]).select("doc_id", "fp", "component_id")


# ---- near copies by similarity ----


def bits_apart(similarity: float, bits: int = 64 * LANES) -> float:
    """Expected differing bits of two texts whose shingle sets have this Jaccard similarity."""
    return bits * acos(2 * similarity / (1 + similarity)) / pi


def near_blocks(similarity: float) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """Ranges of bits, and for each those of the same part beside it: all links agree on a range and next to it but for two bits.

    A link differs in fewer bits than there are blocks.  So some part of three blocks differs in no more than two bits
    (were it three or more in each, they would be as many as the blocks), and one of its blocks in none.
    """
    blocks = max(LEAST_BLOCKS, int(bits_apart(similarity)) + 1)
    if blocks > 64 * LANES:
        raise ValueError("so low a similarity tells no texts apart")
    edges = [(64 * LANES * i // blocks, 64 * LANES * (i + 1) // blocks) for i in range(blocks)]
    parts = [edges[i : i + BLOCKS] for i in range(0, blocks, BLOCKS)]
    return [(own, [b for b in part if b != own]) for part in parts for own in part]


def _wide(words: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("simhash")
        for batch in batches:
            found = np.array([_majority(shingle_hashes(t.as_py(), words), LANES) for t in batch.column(2)], "<u8").reshape(-1, LANES).view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(LANES)]], names=["doc_id", "th", *_LANES])

    return over


def _values(bits: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(bits), np.int64)
    for lo, hi in ranges:
        for c in range(lo, hi):
            out = out << 1 | bits[:, c]
    return out


def _bits(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, 8192):
        part = batch.slice(at, 8192)
        lanes = np.column_stack([part.column(x).to_numpy() for x in _LANES]).astype("<i8")
        yield part, np.asfortranarray(np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little"))


def _cell_sizes(blocks: list):
    """Rows with all lanes to ``(cell, n)``: the block's number in the upper bits, its value in the lower 32."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for _, bits in _bits(batch):
                for k, (own, _) in enumerate(blocks):
                    value, n = np.unique(_values(bits, [own]), return_counts=True)
                    for c, x in zip((value + (k << 32)).tolist(), n.tolist(), strict=True):
                        found[c] = found.get(c, 0) + x
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["cell", "n"])

    return over


def _addressed(blocks: list, dealt: dict[int, int]):
    """A row for each block, with the cell that those meet in who agree on it, and the part's other bits.

    The rows of a cell in ``dealt`` go by hash to so many shares; each two shares meet in a task of their own.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bits in _bits(batch):
                node = part.column("node").to_numpy()
                share = ((node.astype(np.uint64) * np.uint64(_MIX[1])) >> np.uint64(33)).astype(np.int64)
                for k, (own, beside) in enumerate(blocks):
                    value, rest = _values(bits, [own]), _values(bits, beside)
                    cell, times = value + (k << 32), np.ones(len(value), np.int64)
                    for c in set(np.unique(cell).tolist()) & dealt.keys():
                        times[cell == c] = dealt[c]
                    at = np.repeat(np.arange(len(value)), times)
                    n = times[at]
                    me, other = share[at] % n, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    pair = np.minimum(me, other) * n + np.maximum(me, other)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[at]), pa.array(pair), pa.array(rest[at]), *[part.column(x).take(pa.array(at)) for x in _LANES], pa.array(node[at])],
                        names=["cell", "pair", "rest", *_LANES, "node"],
                    )

    return over


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least position of each component once ``a`` and ``b`` are joined; ``root`` holds those of before."""
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def cell_components(rest: np.ndarray, lanes: np.ndarray, most: int, few: int = FEW) -> np.ndarray:
    """Component of each row, as the position of one row of it, over links of ``most`` bits or fewer between rows whose ``rest`` differs in two or fewer.

    Links of rows that differ more in ``rest`` may join components too.
    """
    n = len(rest)
    order = np.argsort(rest, kind="stable")
    rest = rest[order]
    f = [np.ascontiguousarray(x[order]).view("<u8") for x in lanes]
    root = np.arange(n)

    def apart(i, j):
        return np.bitwise_count(f[0][i] ^ f[0][j]).astype(np.int16) + np.bitwise_count(f[1][i] ^ f[1][j])

    def links(i, j):
        nonlocal root
        differ = root[i] != root[j]
        i, j = i[differ], j[differ]
        d = apart(i, j)
        near = d <= most
        i, j, d = i[near], j[near], d[near]
        for x in f[2:]:
            d = d + np.bitwise_count(x[i] ^ x[j])
        near = d <= most
        if near.any():
            root = _merge(root, i[near], j[near])

    # many rows with the same bits are likely copies of one text: a star joins them, and they need not be compared with each other
    first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
    size = np.diff(np.r_[first, n])
    dense = np.flatnonzero(size > max(8, 4 * n >> 13))
    star = np.zeros(n, np.int64)
    for c in dense[np.argsort(-size[dense], kind="stable")][:64]:
        free = np.flatnonzero(star[first[c] : first[c] + size[c]] == 0)
        if len(free) <= 8:
            continue
        at = first[c] + free[0]
        d = apart(slice(None), at)
        for x in f[2:]:
            d += np.bitwise_count(x ^ x[at])
        near = np.flatnonzero((d <= most) & (star == 0))
        if len(near) > 8:
            star[near] = at + 1
            root = _merge(root, near, np.full(len(near), at))
    if n <= few:
        short = rest.astype(np.uint16) if n and rest[-1] < 1 << 16 else rest
        for a in range(0, n, 512):
            for b in range(a, n, 4096):
                near = np.bitwise_count(short[a : a + 512, None] ^ short[None, b : b + 4096]) < BLOCKS
                if star.any():
                    near &= (star[a : a + 512, None] != star[None, b : b + 4096]) | (star[a : a + 512, None] == 0)
                i, j = np.divmod(np.flatnonzero(near), near.shape[1])
                i, j = i + a, j + b
                later = i < j
                links(i[later], j[later])
    else:
        by = np.lexsort((star, rest))
        back = order[by]
        rest, star, f = rest[by], star[by], [x[by] for x in f]
        root = np.argsort(by)[root[by]]
        root = _merge(np.arange(n), np.arange(n), root)
        width = int(rest[-1]).bit_length()
        begin = np.searchsorted(rest, np.arange((1 << width) + 1))
        key = rest * (n + 1) + star if star.any() else None
        for flips in range(BLOCKS):
            for chosen in combinations(range(width), flips):
                flip = sum(1 << c for c in chosen)
                other = rest ^ flip
                i = np.flatnonzero(rest <= other)
                lo, hi = begin[other[i]], begin[other[i] + 1]
                if not flip:
                    lo = i + 1
                pieces = [(lo, hi)]
                if key is not None:
                    same = other[i] * (n + 1) + star[i]
                    skip = star[i] > 0
                    a = np.clip(np.where(skip, np.searchsorted(key, same), hi), lo, hi)
                    b = np.clip(np.where(skip, np.searchsorted(key, same, side="right"), hi), lo, hi)
                    pieces = [(lo, a), (b, hi)]
                for lo, hi in pieces:
                    count = hi - lo
                    own = np.flatnonzero(count > 0)
                    ends = np.cumsum(count[own])
                    done = 0  # pairs are made PAIRS at a time; a row has at most as many as the cell has rows
                    at = 0
                    while at < len(own):
                        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
                        c = count[own[at:to]]
                        x = np.repeat(i[own[at:to]], c)
                        y = np.repeat(lo[own[at:to]] - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
                        links(x, y)
                        done, at = int(ends[to - 1]), to
        order = back
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _near(most: int, few: int):
    """Rows of cells, sorted by cell and pair of shares, to links ``(a, b)`` that join the nodes of each component."""

    def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1), True]).tolist()
        found = [np.zeros((0, 2), np.int64)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j - i > 1:
                own = rows[i:j]
                root = cell_components(np.ascontiguousarray(own[:, 2]), own[:, 3 : 3 + LANES].T, most, few)
                linked = np.flatnonzero(root != np.arange(len(root)))
                found.append(np.column_stack([own[root[linked], -1], own[linked, -1]]))
        a, b = np.concatenate(found).T
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], names=["a", "b"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if not len(rows):
                continue
            new = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last cell may go on in the next batch
            if held and (cut or (held[-1][-1, :2] != rows[0, :2]).any()):
                yield from flush(np.concatenate([*held, rows[:cut]]))
                held = []
            elif cut:
                yield from flush(rows[:cut])
            held.append(rows[cut:])
        if held:
            yield from flush(np.concatenate(held))

    return over


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS_NEAR, similarity: float = SIMILARITY, few: int = FEW, dealt: int | None = None
) -> DataFrame:
    """``docs`` without near copies: of texts linked by a similarity of ``similarity`` or more, one stays, once.

    Similarity is that of the sets of ``words``-word shingles, as told by fingerprints of ``64 * LANES`` bits: two are linked
    if they differ in no more bits than two texts of just this similarity do on average.  No link is missed: its two
    fingerprints agree on one of the blocks of :func:`near_blocks`, whose rows are compared in one task, or in several where they
    are many.  ``few`` and ``dealt`` divide the work and change no result.  Of a group the
    row of the smallest id stays (then by a hash of the text; rows without an id last); rows that share an id alone are
    different rows, those that repeat id and text are one.  Null and blank texts are copies of each other, a text of
    fewer words is one shingle.  Other columns stay as they are, whatever their names; an empty table stays empty.
    """
    reachable(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), text_bytes(F.col(text_col)).alias("t"))
    made = written(slim.mapInArrow(_wide(words), ", ".join(["doc_id long", "th long", *[f"{x} long" for x in _LANES]])))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    nodes = made.groupBy(*_LANES).agg(F.min(place).alias("first"), F.count("*").alias("rows")).withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes)
    blocks = near_blocks(similarity)
    if dealt is None:  # four times what a cell of even rows would hold
        dealt = min(MOST_DEALT, max(DEALT, 4 * nodes.count() * len(blocks) // sum(1 << hi - lo for (lo, hi), _ in blocks)))
    sizes = nodes.select(*_LANES).mapInArrow(_cell_sizes(blocks), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    large = {r.cell: -(-r.n // dealt) for r in sizes.where(F.col("n") > dealt).collect()}
    rows = nodes.select("node", *_LANES).mapInArrow(_addressed(blocks, large), ", ".join(f"{x} long" for x in ("cell", "pair", "rest", *_LANES, "node")))
    rows = rows.repartition("cell", "pair").sortWithinPartitions("cell", "pair")
    roots = connected_components(rows.mapInArrow(_near(int(bits_apart(similarity)), few), "a long, b long"))
    linked = nodes.join(roots, "node", "left").select("node", "first", "rows", *_LANES, F.coalesce("root", "node").alias("root"))
    best = linked.groupBy("root").agg(F.min("first").alias("best"), F.sum("rows").alias("all")).where("all > 1")
    # only rows of groups are matched with the texts; far fewer go than stay
    several = written(salted_join(linked, best, ["root"]).select(*_LANES, "best"))
    rows = salted_join(made, several, _LANES).groupBy("doc_id", "th").agg(F.bool_or(F.col("best") == place).alias("stays"), F.count("*").alias("n"))
    rows = written(rows)
    gone = rows.where("not stays")
    here = [docs[id_col].cast("long"), F.xxhash64(docs[text_col])]
    out = docs.join(gone, here[0].eqNullSafe(gone["doc_id"]) & (here[1] == gone["th"]), "left_anti")
    if not rows.where("stays and n > 1").limit(1).count():
        return out
    marked = out.withColumns({"__id": F.col(id_col), "__th": F.xxhash64(text_col)})
    return marked.dropDuplicates(["__id", "__th"]).drop("__id", "__th")
