"""Removal of repeated byte strings with suffix arrays sorted deep-shallow.

A string of ``DEPTH`` bytes always holds the same anchor: the position whose ``GRAM``-byte hash is least among its own.
A first scan finds anchors whose hash occurs more than once anywhere; only suffixes of strings with such an anchor can
repeat.  These go, with their bytes, to buckets by anchor, where a suffix array of each bucket is built: multikey
quicksort on 8-byte words to a shallow depth, then blind tries for groups that still agree.  Runs of suffixes that agree
to full depth are equal strings; all but the first of each run are removed.

Documents are dealt to blocks of bounded size.  Within a block, equal contexts are sent on once, so that many copies
shrink before they are shuffled.  An anchor that occurs very often, such as that of a notice in a third of all documents,
would still bring all that stands around it to one bucket.  For such anchors the strings themselves are counted by hash
in a scan more, and only those that repeat are sent, each to the bucket of its own hash.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import reachable, text_bytes, written

DEPTH, GRAM, SHALLOW = 100, 32, 16
#: UTF-8 bytes that one block of documents holds, unless a single document is longer.
BLOCK_BYTES = 4_000_000
#: Occurrences from which on an anchor's strings go by their own hashes: another way to the same result.
HOT = 4096
#: Bytes whose hashes are made at once: few enough for a core's cache.
SLICE = 1 << 15
_LETTERS = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def words_at(buf: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte word that starts at each position but the last seven, as a view."""
    return np.ndarray((max(0, len(buf) - 7),), ">u8", np.ascontiguousarray(buf), strides=(1,))


def deep_shallow(buf: np.ndarray, starts: np.ndarray, depth: int = DEPTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes, and whether each differs from the one before.

    ``buf`` must go on ``depth + 8`` bytes beyond every start.
    """
    n = len(starts)
    words = words_at(buf)
    word = lambda at: words[at].astype(np.uint64)
    # shallow: multikey sort with 8-byte words as letters, partitioned by sorting each word; only groups equal so far go on
    key = word(starts)
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][:n]
    for at in range(8, shallow, 8):
        group = np.cumsum(new) - 1
        open_ = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1)
        if not len(open_):
            break
        key = word(starts[order[open_]] + at)
        own = np.argsort(key)
        own = own[np.argsort(group[open_][own], kind="stable")]
        order[open_], key = order[open_][own], key[own]
        new[open_] |= np.r_[True, (key[1:] != key[:-1]) | (group[open_][1:] != group[open_][:-1])]
    # deep: each group that is left becomes a blind trie.  Its first suffix is a path; every other one branches off where
    # it first differs, so branch depth and byte give its place, and those that share a branch form the next trie.
    last = np.uint64((0xFFFFFFFFFFFFFFFF << 8 * (-depth % 8)) & 0xFFFFFFFFFFFFFFFF)
    group = np.cumsum(new) - 1
    open_ = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1)
    while len(open_):
        g = group[open_]
        head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[head, len(g)])
        s = starts[order[open_]]
        rep = np.repeat(s[head], size)
        branch = np.full(len(s), depth, np.int64)
        byte = np.zeros(len(s), np.int64)
        path = np.zeros(len(s), np.int64)
        left = np.arange(len(s))
        for at in range(shallow, depth, 8):
            mine, theirs = word(s[left] + at), word(rep[left] + at)
            diff = mine ^ theirs
            if at + 8 > depth:
                diff &= last
            off = diff != 0
            if off.any():
                d, here = diff[off], left[off]
                top = np.zeros(len(d), np.int64)  # the first byte that differs
                for b in range(7, 0, -1):
                    top = np.where(d < np.uint64(1) << np.uint64(64 - 8 * b), np.maximum(top, b), top)
                branch[here] = at + top
                shift = (56 - 8 * top).astype(np.uint64)
                byte[here] = (mine[off] >> shift & np.uint64(255)).astype(np.int64)
                path[here] = (theirs[off] >> shift & np.uint64(255)).astype(np.int64)
                left = left[~off]
                if not len(left):
                    break
        middle = 256 * depth
        key = np.where(branch == depth, middle, np.where(byte < path, branch * 256 + byte, middle + 1 + (depth - 1 - branch) * 256 + byte))
        which = np.repeat(np.arange(len(head)), size) * (2 * middle + 2) + key
        own = np.argsort(which)
        order[open_], which = order[open_][own], which[own]
        starts_new = np.r_[True, which[1:] != which[:-1]]
        new[open_] |= starts_new
        run = np.cumsum(starts_new) - 1
        go_on = (np.bincount(run)[run] > 1) & (which % (2 * middle + 2) != middle)
        open_ = open_[go_on]
        group = np.cumsum(new) - 1
    return order, new


class Block:
    """Documents of one block as one buffer, in the order in which they count as earlier."""

    def __init__(self, docs: pa.Table):
        ids = [-(1 << 63) if i is None else i for i in docs["doc_id"].to_pylist()]
        texts = docs["t"].to_pylist()
        places = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.row = [0] * len(ids)  # of each input row, its document: repeated rows are one
        self.ids, self.texts = [], []
        for i in places:
            if not self.ids or (self.ids[-1], self.texts[-1]) != (ids[i], texts[i]):
                self.ids.append(ids[i])
                self.texts.append(texts[i])
            self.row[i] = len(self.ids) - 1
        self.buf = np.frombuffer(b"".join(self.texts), np.uint8)
        self.edges = np.r_[0, np.cumsum([len(t) for t in self.texts], dtype=np.int64)]

    def strings(self, at: np.ndarray) -> np.ndarray:
        """Hash of the ``DEPTH`` bytes from each of these sorted places on, all of which have as many after them."""
        out = np.zeros(len(at), np.uint64)
        cuts = range(0, len(self.buf), SLICE)
        ends = np.searchsorted(at, [*cuts, len(self.buf)]).tolist()
        for begin, i, j in zip(cuts, ends, ends[1:], strict=False):
            if i == j:
                continue
            h = grams(self.buf[begin : begin + SLICE + DEPTH - 1], *[1 << k for k in range(7) if DEPTH >> k & 1])
            place, own, left = at[i:j] - begin, np.zeros(j - i, np.uint64), DEPTH
            for size in sorted(h, reverse=True):
                while left >= size:
                    own = own * _MIX[5] + h[size][place]
                    place, left = place + size, left - size
            out[i:j] = _mixed(own)
        return out

    def anchors(self, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each anchor, and the first and the number of the starts whose string it stands for."""
        n, width = len(self.buf), depth - gram + 1
        none = np.zeros(0, np.int64)
        if n < depth:
            return none.astype(np.uint64), none, none
        inside = np.zeros(n + 1, np.int32)
        long = np.diff(self.edges) >= depth
        np.add.at(inside, self.edges[:-1][long], 1)
        np.add.at(inside, self.edges[1:][long] - depth + 1, -1)
        low = np.uint64(0xFFFFFFFF)  # the same for all blocks, so that equal strings choose equal anchors: leftmost of the least upper halves
        hashes, firsts, places = [none.astype(np.uint64)], [none], [none]
        total, last, depth_now = 0, -1, 0
        for begin in range(0, n - depth + 1, SLICE):
            h = _mixed(grams(self.buf[begin : begin + SLICE + depth - 1], gram)[gram])
            least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            size = 1
            while 2 * size <= width:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < width:
                least = np.minimum(least[: size - width], least[width - size :])
            own = np.cumsum(inside[begin : begin + len(least)]) + depth_now
            depth_now = own[-1]
            starts = np.flatnonzero(own > 0)
            if not len(starts):
                continue
            at = (least[starts] & low).astype(np.int64)
            first = np.flatnonzero(np.r_[at[0] + begin != last, at[1:] != at[:-1]])
            hashes.append(h[at[first]])
            firsts.append(starts[first] + begin)
            places.append(first + total)
            total, last = total + len(at), at[-1] + begin
        places = np.concatenate(places)
        return np.concatenate(hashes), np.concatenate(firsts), np.diff(np.r_[places, total])


def grams(buf: np.ndarray, *sizes: int) -> dict[int, np.ndarray]:
    """Hash of so many bytes (1, 2, 4, ... 64) from each position on."""
    h = _LETTERS[buf]
    out = {1: h} if 1 in sizes else {}
    for i, mix in enumerate(_MIX):
        size = 1 << i
        if 2 * size > max(sizes):
            break
        h = h[:-size] * mix + h[size:] if len(h) > size else h[:0]
        if 2 * size in sizes:
            out[2 * size] = h
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * _MIX[1]
    return h ^ h >> np.uint64(32)


def _codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, 32 bits of the hash in the lower."""
    mixed = h * _MIX[4]
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _table(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.Table.from_arrays([c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _none(schema: pa.Schema) -> pa.Table:
    return _table(schema, [[] for _ in schema])


# Blocks times buckets rows pass between the steps, more of them in a GB the more GB there are: none is handled by itself.


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array | pa.ChunkedArray:
    """Binary column whose rows hold so many of ``values``, one after the other."""
    values = np.ascontiguousarray(values)
    ends = np.r_[0, np.cumsum(sizes)] * values.itemsize
    if ends[-1] >= 1 << 31:  # more than one array can hold
        return pa.array([values.data.cast("B")[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def _unpacked(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column without nulls, and how many each row holds."""
    dtype = np.dtype(dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype), pc.binary_length(column).to_numpy().astype(np.int64) // dtype.itemsize


_SEEN = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])
_REPEATED = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("whole", pa.bool_()), ("codes", pa.binary()), ("hot", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("places", pa.binary()), ("context", pa.binary())])
_SPANS = pa.schema([("block", pa.int32()), ("spans", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _cuts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and length of each run of codes sorted by bucket."""
    b = codes >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]][: len(b)])
    return b[first].astype(np.int32), np.diff(np.r_[first, len(b)])


def _counted(codes: np.ndarray, block: int) -> pa.Table:
    codes, count = np.unique(codes, return_counts=True)
    buckets, sizes = _cuts(codes)
    more = count > 1
    several = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[more], minlength=len(sizes))
    short = codes.astype("<u4")
    return _table(_SEEN, [buckets, np.full(len(buckets), block, np.int32), _packed(short[~more], sizes - several), _packed(short[more], several), _packed(count[more].astype("<i8"), several)])


def _see(buckets: int):
    def of(docs: pa.Table) -> pa.Table:
        return _counted(_codes(Block(docs).anchors()[0], buckets), docs["block"][0].as_py())

    return of


def _repeat(whole: bool, hot: int | None):
    def of(seen: pa.Table) -> pa.Table:
        once, n_once = _unpacked(seen["once"], "<u4")
        more, n_more = _unpacked(seen["more"], "<u4")
        codes = np.concatenate([once, more])
        known, place = np.unique(codes, return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([np.ones(len(once)), _unpacked(seen["counts"], "<i8")[0]]), minlength=len(known))[place]
        n = seen.num_rows
        row = np.concatenate([np.repeat(np.arange(n), n_once), np.repeat(np.arange(n), n_more)])
        much = total > (np.inf if hot is None else hot)

        def of_rows(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            which = np.flatnonzero(which)
            return codes[which[np.argsort(row[which], kind="stable")]], np.bincount(row[which], minlength=n)

        few, n_few = of_rows((total > 1) & ~much)
        often, n_often = of_rows((total > 1) & much)
        any_ = n_few + n_often > 0
        left = int(any_.sum())
        block, bucket = (seen[c].to_numpy()[any_] for c in ("block", "bucket"))
        return _table(_REPEATED, [block, bucket, np.full(left, whole), _packed(few, n_few[any_]), _packed(often, n_often[any_])])

    return of


def _full(rows: pa.Table, column: str, whole: bool) -> np.ndarray:
    """Codes with their buckets, of anchors or of whole strings."""
    own = rows.filter(pc.equal(rows["whole"], whole))
    codes, sizes = _unpacked(own[column], "<u4")
    return np.repeat(own["bucket"].to_numpy().astype(np.uint64), sizes) << np.uint64(32) | codes.astype(np.uint64)


def _starts(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _see_strings(buckets: int):
    def of(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        hot = _full(repeated, "hot", False)
        if not docs.num_rows or not len(hot):
            return _none(_SEEN)
        block = Block(docs)
        h, first, count = block.anchors()
        own = np.isin(_codes(h, buckets), hot)
        return _counted(_codes(block.strings(_starts(first[own], count[own])), buckets), docs["block"][0].as_py())

    return of


def _send(buckets: int):
    def of(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        if not docs.num_rows or not repeated.num_rows:
            return _none(_SENT)
        block = Block(docs)
        name = docs["block"][0].as_py()
        h, first, count = block.anchors()
        codes = _codes(h, buckets)
        hot = np.isin(codes, _full(repeated, "hot", False))
        own = np.isin(codes, _full(repeated, "codes", False))
        if hot.any():
            at = _starts(first[hot], count[hot])
            by = _codes(block.strings(at), buckets)
            again = np.isin(by, _full(repeated, "codes", True))
            codes, first, count = np.r_[codes[own], by[again]], np.r_[first[own], at[again]], np.r_[count[own], np.ones(int(again.sum()), np.int64)]
            order = np.argsort(first, kind="stable")
            codes, first, count = codes[order], first[order], count[order]
        else:
            codes, first, count = codes[own], first[own], count[own]
        flat = block.buf.tobytes()
        doc = np.searchsorted(block.edges, first, side="right") - 1
        seen: set[bytes] = set()
        sent, local = [], []
        for i, (a, c) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
            context = flat[a : a + c + DEPTH - 1]
            if context in seen:
                local.append(i)
            else:
                seen.add(context)
                sent.append(i)
        del seen
        sent = np.array(sent, np.int64)
        sent = sent[np.argsort(codes[sent] >> np.uint64(32), kind="stable")]
        ids = np.array(block.ids, np.int64)[doc]
        inside = first - block.edges[doc]
        own, sizes = _cuts(codes[sent])
        length = count[sent] + DEPTH - 1
        context = np.frombuffer(b"".join([flat[a : a + c] for a, c in zip(first[sent].tolist(), length.tolist(), strict=True)]), np.uint8)
        ends = np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(sizes)]]
        places = np.column_stack([inside[sent], first[sent], count[sent]]).astype("<i8")
        out = _table(_SENT, [own, np.full(len(own), name, np.int32), _packed(ids[sent], sizes), _packed(places.ravel(), 3 * sizes), _packed(context, np.diff(ends))])
        if local:  # what an earlier place of this block holds whole needs no sorting; it only passes through
            out = pa.concat_tables([out, _table(_SENT, [[name % buckets], [name], [None], [np.column_stack([first[local], count[local]]).tobytes()], [None]])])
        return out

    return of


def _spans(positions: np.ndarray) -> np.ndarray:
    """First and number of each run of sorted, distinct positions."""
    first = np.flatnonzero(np.r_[True, np.diff(positions) != 1])
    return np.column_stack([positions[first], np.diff(np.r_[first, len(positions)])])


def _sort(sent: pa.Table) -> pa.Table:
    through = pc.is_null(sent["ids"])
    local, own = sent.filter(through), sent.filter(pc.invert(through))
    out = pa.Table.from_arrays([local["block"].cast(pa.int32()), local["places"].cast(pa.binary())], schema=_SPANS)
    if own.num_rows:
        ids, sizes = _unpacked(own["ids"], "<i8")
        block = np.repeat(own["block"].to_numpy().astype(np.int64), sizes)
        inside, first, count = _unpacked(own["places"], "<i8")[0].reshape(-1, 3).T
        buf = np.frombuffer(b"".join([*own["context"].to_pylist(), bytes(DEPTH + 8)]), np.uint8)
        begin = np.r_[0, np.cumsum(count + DEPTH - 1)[:-1]]
        which = np.repeat(np.arange(len(ids)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        order, new = deep_shallow(buf, begin[which] + step)
        group = np.cumsum(new) - 1
        whole = np.bincount(group)[group] > 1
        order, group = order[whole], group[whole]
        if len(order):
            w, s = which[order], step[order]
            rank = np.unique(ids, return_inverse=True)[1]
            place = rank[w] << 32 | inside[w] + s
            head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            earliest = np.minimum.reduceat(place, head)
            later = place != np.repeat(earliest, np.diff(np.r_[head, len(group)]))
            w, s = w[later], s[later]
            packed = np.sort(block[w] << 40 | first[w] + s)
            if len(packed):
                packed = packed[np.r_[True, packed[1:] != packed[:-1]]]  # strings at one place come once
                spans = _spans(packed)  # none goes over into the next block, whose first place is 2**40 further on
                blocks, sizes = np.unique(spans[:, 0] >> 40, return_counts=True)
                spans[:, 0] &= (1 << 40) - 1
                out = pa.concat_tables([out, _table(_SPANS, [blocks.astype(np.int32), _packed(spans.astype("<i8").ravel(), 2 * sizes)])])
    return out


def _finish(docs: pa.Table, spans: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return _none(_OUT)
    block = Block(docs)
    change = np.zeros(len(block.buf) + 1, np.int32)
    first, count = _unpacked(spans["spans"], "<i8")[0].reshape(-1, 2).T
    np.add.at(change, first, 1)
    np.add.at(change, first + count + DEPTH - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    found = []
    for i, text in enumerate(block.texts):
        own = gone[block.edges[i] : block.edges[i + 1]]
        n = int(own.sum())
        runs = int((own[1:] & ~own[:-1]).sum() + own[0]) if len(own) else 0
        kept = block.buf[block.edges[i] : block.edges[i + 1]][~own].tobytes() if n else text
        found.append((len(text), n, runs, sha256(kept).hexdigest()))
    return _table(_OUT, [docs["doc_id"].combine_chunks(), *[[found[r][k] for r in block.row] for k in range(4)]])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row.

    A byte is removed if a string of ``DEPTH`` bytes over it also starts earlier: in a smaller id, or before it in the
    same document.  Null text is empty; a null id counts as smaller than any.  Rows that repeat id and text are one
    document and get equal rows; of rows that share an id alone, the one whose string starts at the smaller place counts as
    earlier, and neither where both start at one place.  ``block_bytes`` and ``hot`` divide the work and change no result; a text longer than a block is one by itself.
    An empty table gives no rows; other columns are not read.
    """
    reachable(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("t"))
    total = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "t"), F.lit(n)).cast("int")).repartition("block")
    blocks = dealt.groupBy("block")
    seen_shape, shape = "bucket int, block int, once binary, more binary, counts binary", "block int, bucket int, whole boolean, codes binary, hot binary"
    seen = blocks.applyInArrow(_see(n), seen_shape)
    repeated = written(seen.groupBy("bucket").applyInArrow(_repeat(False, hot), shape))
    if repeated.where(F.octet_length("hot") > 0).limit(1).count():
        strings = blocks.cogroup(repeated.groupBy("block")).applyInArrow(_see_strings(n), seen_shape)
        repeated = repeated.unionByName(strings.groupBy("bucket").applyInArrow(_repeat(True, None), shape))
    sent = blocks.cogroup(repeated.groupBy("block")).applyInArrow(_send(n), "bucket int, block int, ids binary, places binary, context binary")
    spans = sent.groupBy("bucket").applyInArrow(_sort, "block int, spans binary")
    return blocks.cogroup(spans.groupBy("block")).applyInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
