"""Tokenise documents and pack the pieces into sequences by hierarchical residual packing.

One scan tokenises and cuts; only slim piece rows go on.  Pieces are dealt into groups of bounded size, each packed
best-fit decreasing.  Nearly full bins are final; all others go up as items to the next level, where those of several groups
meet in fewer groups of the same size, until one group is left or a level brings nothing together.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import at_work, reachable, remembers, text_bytes, written

CAPACITY = 2048
END = b"\0\0\0\0"
#: Pieces that one task packs at once; share of a sequence from which a bin is nearly full, and final.
GROUP, NEARLY_FULL = 8192, 0.98
#: Words whose ids a Python worker remembers, and as many pieces of words.
REMEMBERED = 300_000
#: UTF-8 bytes of the pieces that are merged together, at most.
_SIZES = (4, 8, 12, 24)
#: Characters of a text that are taken apart at once.
_STEP = 500_000
_LONGEST, _BREAK = _SIZES[-1], b"\xff\xff\xff\xff"


class WordTokenizer:
    """Ids of a word-level BPE file of `tokenizers`, with a memory for words.

    The file's rules never look across white space, so ids of a text are those of its words.  Unknown words are
    merged many at once on arrays; words outside plain Latin letters, and any the arrays do not cover, go to the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        char = [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in char], np.int32)
        self.last = np.array([vocab[c + suffix] for c in char], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
        self.plain = regex.compile(r"[\n!-;=?-~À-ÖØ-öø-įĲ-ž]+")
        self.odd, self.spaced = regex.compile("[\x1c-\x1f]"), regex.compile(r"(?:\S|[\x1c-\x1f])+")
        self.latin = re.compile("[\\x00-\\x1b -;=-~\u00c0-\u00ff]*")
        # memories of two halves: words that are still in use outlive the older half
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_words, self.old_pieces = self.words, self.pieces

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair's merge (large: none) and where it stands."""
        key = left.astype(np.uint32) << 16 | right.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0) & (left >= 0), self.rank[at], 1 << 30), at

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many short pieces, by applying each piece's best-ranked merge until none is left."""
        size = np.array([len(p) for p in pieces])
        n, width = len(pieces), int(size.max())
        raw = np.zeros((n, width), np.uint8)
        raw[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.where(np.arange(width) < size[:, None], self.inner[raw], -1).astype(np.int32)
        rows = np.arange(n)
        ids[rows, size - 1] = self.last[raw[rows, size - 1]]
        out = np.full((n, width), -1, np.int32)
        live = rows
        ids = np.column_stack([ids, np.full(n, -1, np.int32)])
        rank, at = self._ranked(ids[:, :-1], ids[:, 1:])
        while len(live):
            best = rank.argmin(1)
            r = np.arange(len(live))
            done = rank[r, best] == 1 << 30
            if done.any():
                out[live[done]] = ids[done, :-1]
                live, ids, rank, at, best = live[~done], ids[~done], rank[~done], at[~done], best[~done]
                r = np.arange(len(live))
            if not len(live):
                break
            new = self.made[at[r, best]]
            after = np.arange(width) > best[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            at[:, :-1] = np.where(after[:, :-1], at[:, 1:], at[:, :-1])
            rank[:, -1] = 1 << 30
            ids[r, best] = new
            rank[r, best], at[r, best] = self._ranked(new, ids[r, best + 1])
            has = best > 0
            before = best[has] - 1
            rank[r[has], before], at[r[has], before] = self._ranked(ids[r[has], before], new[has])
        flat = out[out >= 0].astype("<u4").tobytes()
        edges = [0, *(4 * np.cumsum((out >= 0).sum(1))).tolist()]
        return [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _recalled(fresh: set[str], now: dict[str, bytes], old: dict[str, bytes]) -> set[str]:
        """What of ``fresh`` the older half of the memory does not hold either; the rest moves to the newer half."""
        known = fresh & old.keys()
        now.update(zip(known, map(old.__getitem__, known), strict=True))
        return fresh - known

    def _know(self, pieces: set[str]) -> None:
        """See that the memory holds the ids of all these pieces."""
        if len(self.pieces) > REMEMBERED // 2:
            self.old_pieces, self.pieces = self.pieces, {}
        fresh = self._recalled(pieces - self.pieces.keys() - {"\n"}, self.pieces, self.old_pieces)
        by_size: tuple[list[str], ...] = tuple([] for _ in _SIZES)
        long: list[str] = []
        for p in fresh:
            n = len(p) if p.isascii() else len(p.encode())
            (by_size[bisect_left(_SIZES, n)] if n <= _LONGEST else long).append(p)
        for some in by_size:
            for i in range(0, len(some), 8192):
                part = some[i : i + 8192]
                self.pieces.update(zip(part, self._merge([p.encode() for p in part]), strict=True))
        self.pieces.update(zip(long, self._library(long), strict=True))

    def learn(self, words: list[str]) -> None:
        flat = "\n".join(words)
        if not self.plain.fullmatch(flat):
            other = [w for w in words if not self.plain.fullmatch(w)]
            self.words.update(zip(other, self._library(other), strict=True))
            words = [w for w in words if self.plain.fullmatch(w)]
            flat = "\n".join(words)
        if not words:
            return
        split = self.parts.findall(flat.lower())
        self._know(set(split))
        self.pieces["\n"] = _BREAK
        # ids are below 2**16, so a break never stands across ids
        self.words.update(zip(words, b"".join(map(self.pieces.__getitem__, split)).split(_BREAK), strict=True))

    def _remember(self, words: set[str]) -> None:
        if len(self.words) > REMEMBERED // 2:
            self.old_words, self.words = self.words, {}
        if fresh := self._recalled(words - self.words.keys(), self.words, self.old_words):
            self.learn(list(fresh))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        # texts of plain letters alone are taken apart on arrays; special tokens begin with "<"
        simple = [bool(self.latin.fullmatch(t)) for t in texts]
        own = [(i, part.encode()) for i, ok in enumerate(simple) if ok and texts[i] for part in _parts(texts[i])]
        found = self._simple_ids([part for _, part in own])
        if found is None:
            simple = [False] * len(texts)
        else:
            for (i, _), raw in zip(own, found, strict=True):
                out[i] += raw
        other = [i for i, ok in enumerate(simple) if not ok]
        # the separators U+001C to U+001F are white space to Python alone
        split = [self.spaced.findall(texts[i]) if self.odd.search(texts[i]) else texts[i].split() for i in other]
        self._remember(set().union(*split))
        for i, s in zip(other, split, strict=True):
            out[i] = b"".join(map(self.words.__getitem__, s))
        return out

    @staticmethod
    def _contract(low: np.ndarray, kind: np.ndarray, new: np.ndarray) -> None:
        """Mark in ``new`` that an apostrophe which begins a piece takes in the ending after it, and what follows is a piece."""
        wide = np.r_[low, np.zeros(3, np.uint8)]
        at = np.flatnonzero((low == 39) & new)
        one, two = wide[at + 1], wide[at + 2]
        long = np.zeros(len(at), bool)
        for ending in ("re", "ve", "ll"):
            long |= (one == ord(ending[0])) & (two == ord(ending[1]))
        short = np.isin(one, [ord(c) for c in "stmd"])
        for which, size in ((short, 1), (long, 2)):
            hit = at[which]
            new[hit + 1] = False
            after = hit + 1 + size
            after = after[after < len(low)]
            new[after[kind[after] == _LETTER]] = True

    def _simple_ids(self, texts: list[bytes]) -> list[bytes] | None:
        """Ids of texts of ASCII and the letters up to U+00FF: each different piece of them all is looked up once.

        Pieces are runs of letters, single digits, runs of signs, and contractions, as in the file's own pattern.  None
        where two different pieces share a hash.
        """
        if not texts:
            return []
        flat = b" ".join(texts)
        raw = np.frombuffer(flat, np.uint8)
        low = _LOWER[raw]
        low[1:][(raw[:-1] == 0xC3) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)] += 32
        kind = _KIND[low]
        kind[1:][(low[:-1] == 0xC3) & ((low[1:] == 0x97) | (low[1:] == 0xB7))] = _SIGN
        kind[:-1][(low[:-1] == 0xC3) & ((low[1:] == 0x97) | (low[1:] == 0xB7))] = _SIGN
        new = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)]
        self._contract(low, kind, new)
        edges = np.r_[np.flatnonzero(new), len(raw)]
        own = kind[edges[:-1]] != _BLANK
        start, end = edges[:-1][own], edges[1:][own]
        power, inverse = _powers(1 << max(20, len(raw).bit_length()))
        total = np.r_[np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)]
        plain = np.r_[0, np.cumsum(low, dtype=np.int64)]
        size = end - start
        code, different = pd.factorize((total[end] - total[start]) * inverse[start] + size.astype(np.uint64))
        first = np.zeros(len(different), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        # pieces of one hash must also agree in length and sum
        if (size != size[first][code]).any() or ((plain[end] - plain[start]) != (plain[end] - plain[start])[first][code]).any():
            return None
        lower = low.tobytes()
        pieces = [lower[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        self._know(set(pieces))
        made = list(map(self.pieces.__getitem__, pieces))
        length = np.fromiter(map(len, made), np.int64, len(made)) // 4
        offset = np.cumsum(length) - length
        count = length[code]
        upto = np.r_[0, np.cumsum(count)]
        ids = np.frombuffer(b"".join(made), "<u4")[np.repeat(offset[code] - upto[:-1], count) + np.arange(upto[-1])].tobytes()
        ends = np.cumsum([len(t) + 1 for t in texts])
        cut = 4 * upto[np.searchsorted(start, np.r_[0, ends])]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that end at a space, across which no id goes."""
    at = 0
    while len(text) - at > _STEP and (to := text.rfind(" ", at + 1, at + _STEP)) > 0:
        yield text[at:to]
        at = to
    yield text[at:] if at else text


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK, _LETTER, _DIGIT, _SIGN = range(4)
#: Of lower-case bytes; those of letters beyond ASCII are letters.
_KIND = np.array([_BLANK if b == 32 or 9 <= b <= 13 else _LETTER if 97 <= b <= 122 or b >= 128 else _DIGIT if 48 <= b <= 57 else _SIGN for b in range(256)], np.uint8)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    odd = 0xD6E8FEB86659FD93
    return tuple(np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n, x, np.uint64)], dtype=np.uint64) for x in (odd, pow(odd, -1, 1 << 64)))


@cache
def tokenizer(path: str) -> WordTokenizer:
    own = WordTokenizer(path)
    probe = ["It's a naïve TEST, 123 times: héllo wörld unbelievably antidisestablishmentarianism (x=1)!", "don't l'été\tÅngström 2nd"]
    if own.ids(probe) != [np.array(e.ids, "<u4").tobytes() for e in own.library.encode_batch(probe, add_special_tokens=False)]:
        raise ValueError(f"{path}: not a word-level BPE file of the kind that this tokenizer merges")
    return own


def _forget() -> None:
    tokenizer.cache_clear()
    _powers.cache_clear()


remembers("packing", _forget)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cut(path: str, capacity: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("packing")
        own = tokenizer(path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, taken = [], 0
                first = at
                while at < batch.num_rows and taken < _STEP:
                    texts.append(batch.column(1)[at].as_py().decode("utf-8", "replace"))
                    taken += len(texts[-1])
                    at += 1
                rows = []
                for doc, ids in zip(batch.column(0)[first:at].to_pylist(), own.ids(texts), strict=True):
                    ids += END
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[i : i + 4 * capacity]
                        rows.append((doc, k, i // 4, len(part) // 4, crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return over


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and an end id, cut only where longer than ``capacity``."""
    reachable(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("t"))
    return slim.mapInArrow(_cut(path or default_path(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill.  Ties go to the item that stands first."""
    order = np.argsort(-sizes, kind="stable").tolist()
    size = sizes.tolist()
    bins, offsets, fill = [0] * len(size), [0] * len(size), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with r free exists
    for i in order:
        s = size[i]
        fits = rooms >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
        else:
            b, r = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        left = r - s
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array(fill, np.int64)


def _packed(capacity: int, level: int):
    def of(group: pa.Table) -> pa.Table:
        bins, offsets, fill = best_fit(group["length"].to_numpy(), capacity)
        up = fill < NEARLY_FULL * capacity
        name = (np.int64(level) << 58) | (np.int64(group["grp"][0].as_py()) << 28)
        for column, kind, values in (("bin", pa.int64(), name + bins), ("offset", pa.int64(), offsets), ("fill", pa.int64(), fill[bins]), ("up", pa.bool_(), up[bins])):
            group = group.append_column(column, pa.array(values, kind))
        return group.drop_columns(["grp"])

    return of


def _level(items: DataFrame, columns: str, groups: int, level: int, capacity: int) -> DataFrame:
    dealt = items.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups)))
    return written(dealt.groupBy("grp").applyInArrow(_packed(capacity, level), f"{columns}, bin long, offset long, fill long, up boolean"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row for each piece.

    Null text is empty: one piece that holds only the end id.  Rows that repeat a doc_id, or have none, are packed as
    documents of their own.  Pieces that fill a sequence are one.  Very long texts are cut whole; of equal pieces the one that
    stands first in its group goes first.  An empty table gives no rows; other columns are not read.
    """
    reachable(docs.sparkSession)
    cut = written(pieces(docs, id_col, text_col, path, capacity).withColumn("item", F.monotonically_increasing_id()))
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = cut.where(F.col("length") >= capacity).select(*names[:5], (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // GROUP))
    levels = [_level(rest, shape, groups, 0, capacity)]
    while groups > 1:
        below = levels[-1].where("up").groupBy(F.col("bin").alias("item")).agg(F.max("fill").alias("length"))
        n = below.count()
        if not n:
            break
        groups = -(-n // GROUP)
        levels.append(_level(below, "item long, length long", groups, len(levels), capacity))
        if levels[-1].select("bin").distinct().count() == n:  # no two of them could share a sequence
            break
    top = levels[-1]
    for below in reversed(levels[:-1]):
        higher = top.select(F.col("item").alias("_from"), F.col("bin").alias("_bin"), F.col("offset").alias("_more"))
        joined = below.join(higher, below["bin"] == higher["_from"], "left")
        top = joined.withColumn("bin", F.coalesce("_bin", "bin")).withColumn("offset", F.col("offset") + F.coalesce("_more", F.lit(0))).drop("_from", "_bin", "_more")
    return full.unionByName(top.select(*names[:5], F.col("bin").alias("sequence_id"), "offset"))
