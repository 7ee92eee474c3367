"""Benchmark decontamination by template windows.

Numbers, units and names become typed placeholders, so a question with other values keeps its template.  Every window of
every item has a key: the 128-bit hash of its tokens, in which a placeholder stands with the place of its value among the
window's different values, so that equal keys mean equal templates whose slots map one to one.  Windows of few words carry the values
themselves and match verbatim only.  Documents are scanned once, whatever the benchmark's size: bit tables of bounded size
tell which windows can be the benchmark's, only their keys leave the scan, and one hash join finds the items.

Whether a capitalised word is a name cannot be told where a sentence or an item begins, so items and texts are taken in
several readings (``READINGS``), and any of an item is looked up in any of a text.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from tidemark.llm.common import at_work, reachable, remembers, salted_join, text_bytes, written

WINDOW = 13
#: Words, not placeholders, from which a window may have other values; with fewer its values must be the item's own.
LEAST_WORDS = 7
#: Bits (as a power of 2) of each of the two tables that every worker holds: 8 MB at most.
MOST_BITS = 26
#: Words and tokens that a worker remembers.
REMEMBERED = 300_000

# Units that make a quantity with the number before them.
UNITS = "km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|kg|g|mg|lbs?|pounds?|oz|tons?|l|ml|litres?|liters?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|kmh|mph|dollars?|euros?|cents?|percent|degrees?|volts?|watts?|kwh|hz|mb|gb|tb"
_VALUE = re.compile(rf"\d+(?:[.,:/]\d+)*(%|[ ]?(?:{UNITS})\b)?", re.IGNORECASE)
_NAME = re.compile(r"[A-ZÀ-ÖØ-Þ](?<=[a-zß-öø-ÿ,;] .)[^\W\d_]*(?: [A-ZÀ-ÖØ-Þ][^\W\d_]*)*")
#: A word, a placeholder, or the signs between two values.
_TOKEN = re.compile(r"[^\W_]+|\x01\w|(?<=\x01[nu] )\s*([-+*/^=<>×÷]+)(?=\s*\x01[nu])")
_CAPITALS = re.compile(r"(?<![^\W_])([A-ZÀ-ÖØ-Þ][^\W\d_]*)((?: [A-ZÀ-ÖØ-Þ][^\W\d_]*)*)")
#: Names are: capitalised words after a small letter, comma or semicolon; none; all runs of capitalised words; those without
#: their first word, which may only open a sentence.
READINGS = ("inside", "none", "all", "tails")


def _names(text: str, reading: str) -> list[tuple[int, int]]:
    """Spans of the names of a text."""
    if reading == "none":
        return []
    if reading == "inside":
        return [m.span() for m in _NAME.finditer(text)]
    return [(m.start(2) + 1 if reading == "tails" and m[2] else m.start(), m.end()) for m in _CAPITALS.finditer(text)]


def template(text: str, reading: str = "inside") -> list[str]:
    """Lower-case tokens, with ``\\x01n`` for a number, ``\\x01u`` for a quantity with unit, ``\\x01p`` for a name."""
    parts, at = [], 0
    for start, end in _names(text, reading):
        parts += [text[at:start], " \x01p "]
        at = end
    text = "".join([*parts, text[at:]])
    text = _VALUE.sub(lambda m: " \x01u " if m[1] else " \x01n ", text)
    return [m[1] or m[0] for m in _TOKEN.finditer(text.lower())]


def slots(text: str, reading: str = "inside") -> list[str]:
    """What stood in each placeholder of :func:`template`, in order."""
    found, parts, at = [], [], 0
    for start, end in _names(text, reading):
        found.append((start, text[start:end]))
        parts += [text[at:start], " " * (end - start)]
        at = end
    found += [(m.start(), m[0]) for m in _VALUE.finditer("".join([*parts, text[at:]]))]
    return [x.lower() for _, x in sorted(found)]


def readings(text: str) -> list[tuple[str, list[str]]]:
    """The different templates of a text, each with the name of its reading."""
    out: list[tuple[str, list[str]]] = []
    for r in READINGS:
        toks = template(text, r)
        if all(toks != t for _, t in out):
            out.append((r, toks))
    return out


def signature(toks: list[str], values: list[str]) -> str:
    """What two windows must agree on: the tokens, and which placeholders of a kind hold equal values.

    With fewer than ``LEAST_WORDS`` words (or any placeholder in a shorter window) the values themselves.
    """
    words = sum(t[0].isalnum() for t in toks)
    verbatim = words < min(LEAST_WORDS, len(toks))
    out, at, known = [], 0, {}
    for t in toks:
        if t[0] == "\x01":
            slot = (t, values[at])
            t += values[at] if verbatim else str(known.setdefault(slot, len(known)))
            at += 1
        out.append(t)
    return ("=" if verbatim else "~") + "\n".join(out)


def _key(toks: list[str], values: list[str]) -> tuple[int, int]:
    return struct.unpack("<qq", xxh3_128_digest(signature(toks, values).encode("utf-8", "surrogatepass")))


class Template:
    """One reading of a text: its tokens, and what stands in its placeholders (found when first asked for)."""

    def __init__(self, text: str, reading: str, toks: list[str]):
        self.text, self.reading, self.toks = text, reading, toks
        self.values: list[str] | None = None

    def key(self, i: int, size: int) -> tuple[int, int]:
        if self.values is None:
            self.values = slots(self.text, self.reading)
            self.nth = np.cumsum([0] + [t[0] == "\x01" for t in self.toks])
        return _key(self.toks[i : i + size], self.values[self.nth[i] : self.nth[i + size]])


def code(token: str) -> int:
    return xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 7) | 1


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the tokens of each window, as a signed number."""
    out = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    for i in range(size):
        out = out * np.uint64(6_364_136_223_846_793_005) + codes[i : len(codes) - size + 1 + i]
    return _mixed(out).view(np.int64)


def item_windows(text: str) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """``(reading, start, size, tokens of the item, words and values in the window, hash, key, key)`` of all windows."""
    out, text = [], text.replace("\x01", " ")
    for r, (reading, toks) in enumerate(readings(text)):
        if not toks:
            continue
        own, size = Template(text, reading, toks), min(WINDOW, len(toks))
        h = window_hashes(np.array([code(t) for t in toks], np.uint64), size).tolist()
        for j in range(len(h)):
            pieces = sum(t[0].isalnum() or t[0] == "\x01" for t in toks[j : j + size])
            out.append((r, j, size, len(toks), pieces, h[j], *own.key(j, size)))
    return out


#: Classes of bytes: letters (all beyond ASCII are taken for such), digits, and what stands between.
_LETTER, _DIGIT = 1, 2
_CLASS = np.array([_LETTER if b >= 128 or chr(b).isalpha() else _DIGIT if 48 <= b <= 57 else 0 for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes whose runs are told apart at once.
_STEP = 1 << 19


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, up to ``2**bits``."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    return tuple(np.cumprod(np.r_[np.ones(1, np.uint64), np.full(1 << bits, x)], dtype=np.uint64) for x in (_ODD, inverse))


def runs(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and of digits in UTF-8 bytes: start, end, a hash of the lower-case letters, and whether it tells nothing.

    The hash says nothing of numbers, of runs that begin with a capital, and of what lies beyond the letters up to U+00FF,
    which is not looked into; then the last figure is the most tokens that the run can be, else 0.  ``first``: where texts start, at which runs end.
    """
    kind = _CLASS[raw]
    change = np.r_[True, kind[1:] != kind[:-1]] if len(kind) else np.zeros(0, bool)
    change[first[first < len(kind)]] = True
    edges = np.r_[np.flatnonzero(change), len(kind)]
    own = kind[edges[:-1]] > 0
    start, end = edges[:-1][own], edges[1:][own]
    low = _LOWER[raw]
    after = np.r_[False, raw[:-1] == 0xC3]
    upper = after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    low[upper] += 32
    odd = (raw >= 0x80) & ~after & (raw != 0xC3) | after & ((raw == 0x97) | (raw == 0xB7))
    upper[:-1] |= upper[1:]  # the first of the two bytes of a capital, which is where a run may begin
    capital = (raw >= 65) & (raw <= 90) | upper
    power, inverse = _powers(max(10, len(raw).bit_length()))
    total = np.r_[np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)]
    h = (total[end] - total[start]) * inverse[start]
    strange = np.r_[0, np.cumsum(odd)]
    size = np.where(strange[end] > strange[start], end - start, 1)
    return start, end, _mixed(h), np.where((kind[start] == _DIGIT) | capital[start] | (size > 1), size, 0)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def run_hash(word: str) -> int:
    raw = np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)
    found = runs(raw, np.zeros(0, np.int64))[2]
    return int(found[0]) if len(found) else 0


class Filter:
    """Bit tables of the benchmark's words and windows, and the sizes of its windows.

    A set bit is only a hint: what it lets through is decided by the join of keys.
    """

    def __init__(self, words: np.ndarray, letters: np.ndarray, windows: np.ndarray, sizes: list[int], least: int, name: str | None = None):
        self.words, self.letters, self.windows, self.sizes, self.least, self.name = words, letters, windows, sizes, least, name or uuid4().hex
        self.bits, self.mask = words.tobytes(), 8 * len(words) - 1
        self.codes: dict[str, int] = {}

    def __reduce__(self):
        return _restored, (self.words, self.letters, self.windows, self.sizes, self.least, self.name)

    def code(self, token: str) -> int:
        """0 for a token that is in no item."""
        found = self.codes.get(token)
        if found is None:
            if len(self.codes) >= REMEMBERED:
                self.codes.clear()
            found = code(token)
            at = found & self.mask
            self.codes[token] = found = found if self.bits[at >> 3] >> (at & 7) & 1 else 0
        return found

    def parts(self, texts: list[bytes]) -> list[str]:
        """Of each text, what is left without stretches in which no reading has a window of tokens of items, values or names.

        The words at both edges of a stretch stay, so that it is read as in the text.
        """
        if not self.sizes:
            return [""] * len(texts)
        flat = b"".join(texts)
        raw = np.frombuffer(flat, np.uint8)
        first = np.cumsum([0, *map(len, texts)])
        found, at = [], 0
        while at < len(raw):
            to = min(len(raw), at + _STEP)
            if to < len(raw):  # not amid a run
                gap = np.flatnonzero(_CLASS[raw[at:to]] == 0)
                to = at + int(gap[-1]) + 1 if len(gap) else to + int(np.argmax(np.r_[_CLASS[raw[to:]] == 0, True]))
            start, end, h, free = runs(raw[at:to], first[(first >= at) & (first < to)] - at)
            spot = h & np.uint64(8 * len(self.letters) - 1)
            may = np.maximum(free, (self.letters[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(np.int64))
            found.append((start + at, end + at, may))
            at = to
        start, end, may = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        # cuts are words that no window holds, and the ends of texts
        lo, hi = np.r_[start[may == 0], first], np.r_[end[may == 0], first]
        order = np.lexsort((hi, lo))
        lo, hi = lo[order], hi[order]
        inside = np.r_[0, np.cumsum(may)][np.searchsorted(start, lo)]
        out: list[list[str]] = [[] for _ in texts]
        for k in np.flatnonzero(np.diff(inside) >= self.least).tolist():
            row = int(np.searchsorted(first, hi[k], side="right")) - 1
            out[row].append(flat[lo[k] : hi[k + 1]].decode("utf-8", "replace").replace("\x01", " "))
        return ["\n".join(x) for x in out]

    def keys(self, text: str) -> set[tuple[int, int]]:
        """Keys of all windows that may be the benchmark's, of what :meth:`parts` leaves of a text."""
        found: set[tuple[int, int]] = set()
        for reading, toks in readings(text) if text else []:
            codes = np.array(list(map(self.code, toks)), np.uint64)
            absent = np.r_[0, np.cumsum(codes == 0)]
            own = Template(text, reading, toks)
            for size in self.sizes:
                if len(toks) < size:
                    continue
                full = np.flatnonzero(absent[size:] == absent[:-size])
                if len(full):
                    at = window_hashes(codes, size)[full] & (8 * len(self.windows) - 1)
                    full = full[self.windows[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
                    found.update(own.key(i, size) for i in full.tolist())
        return found


#: What may stand after a number without being in any item.
_UNIT_HASHES = np.array([run_hash(x) for u in UNITS.split("|") for x in {re.sub(r"\(.*?\)\?|.\?", "", u), u.replace("(?:", "").replace(")", "").replace("?", "")}], np.uint64)
_LAST: list[Filter] = []
remembers("decontaminate", lambda: (_LAST.clear(), _powers.cache_clear()))


def _restored(*parts) -> Filter:
    """A worker's later tasks go on with what its earlier ones remember."""
    if not _LAST or _LAST[0].name != parts[-1]:
        _LAST[:] = [Filter(*parts)]
    return _LAST[0]


def _bits(values: int) -> int:
    return 1 << min(MOST_BITS, max(12, (32 * values).bit_length()))


def _bit_table(values: np.ndarray) -> np.ndarray:
    n = _bits(len(values))
    out = np.zeros(n // 8, np.uint8)
    at = values.view(np.uint64) & np.uint64(n - 1)
    np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return out


def _bit_table_of(values: DataFrame, column: str) -> np.ndarray:
    """The same from a DataFrame: bits are joined on the cluster, at most ``2**MOST_BITS / 64`` numbers come to the driver."""
    n = _bits(values.select(F.approx_count_distinct(column)).first()[0])
    at = F.col(column).bitwiseAND(F.lit(n - 1))
    found = values.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toArrow()
    out = np.zeros(n // 64, "<i8")
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint8)


class Items:
    """A few items in memory, joined as :func:`contaminated` joins tables; for single texts."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.windows: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        every = [(i, w) for i, t in rows for w in item_windows(t)]
        for i, (r, j, size, n, _, _, *key) in every:
            self.windows[tuple(key)].append((i, r, j, size, n))
        known = {t for _, t in rows for _, toks in readings(t) for t in toks}
        words, letters = (np.array([f(t) for t in known] or [0], np.uint64) for f in (code, run_hash))
        hashes = np.array([w[5] for _, w in every] or [0], np.int64)
        self.filter = Filter(_bit_table(words), _bit_table(np.r_[letters, _UNIT_HASHES]), _bit_table(hashes), sorted({w[2] for _, w in every}), min((w[4] for _, w in every), default=0))


def matches(text: str, items: Items) -> list[tuple[int, int, int, int]]:
    """``(item_id, windows, tokens covered, tokens of the item)`` for each item of which a window stands in the text.

    The figures are those of the item's reading that is covered best.
    """
    at: dict[tuple[int, int, int], set[tuple[int, int]]] = defaultdict(set)
    for key in items.filter.keys(items.filter.parts([text.encode("utf-8", "surrogatepass")])[0]):
        for i, r, j, size, n in items.windows.get(key, ()):
            at[i, r, n].add((j, size))
    best: dict[int, tuple[float, int, int, int]] = {}
    for (i, _, n), spans in at.items():
        covered = len({x for j, size in spans for x in range(j, j + size)})
        best[i] = max(best.get(i, (0.0, 0, 0, 0)), (covered / n, len(spans), covered, n))
    return sorted((i, *b[1:]) for i, b in best.items())


_WINDOWS = "r int, j int, size int, n int, pieces int, h long, k1 long, k2 long"
_ITEM = pa.schema(
    [("item_id", pa.int64()), ("cls", pa.binary()), ("words", pa.list_(pa.int64())), ("letters", pa.list_(pa.int64())),
     ("windows", pa.list_(pa.struct([(c.split()[0], pa.int64() if c.endswith("long") else pa.int32()) for c in _WINDOWS.split(", ")])))]
)


def _itemised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _WINDOWS.split(", ")]
    for batch in batches:
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            windows = item_windows(t)
            if windows:
                known = sorted({x for _, toks in readings(t) for x in toks})
                words, letters = (np.array([f(x) for x in known], np.uint64).view(np.int64) for f in (code, run_hash))
                rows.append({"item_id": i, "cls": xxh3_128_digest(repr(windows)), "words": words, "letters": letters, "windows": [dict(zip(names, w, strict=True)) for w in windows]})
        yield pa.RecordBatch.from_pylist(rows, _ITEM)


def _keyed(held: Filter):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("decontaminate")
        for batch in batches:
            texts = batch.column(3).to_pylist()
            keys = []
            at = 0
            while at < len(texts):
                first, taken = at, 0
                while at < len(texts) and taken < _STEP:
                    taken += len(texts[at])
                    at += 1
                keys += [sorted(held.keys(t)) if t else [] for t in held.parts(texts[first:at])]
            row = np.repeat(np.arange(batch.num_rows), [len(k) for k in keys])
            flat = np.array([k for ks in keys for k in ks], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(row)) for i in range(3)], pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["row", "doc_id", "th", "k1", "k2"])

    return over


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """``(row, doc_id, th, item_id, items, windows, covered, item_tokens)``; th: a hash of the text.  None without items."""
    reachable(docs.sparkSession)
    own = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).distinct()
    items = own.mapInArrow(_itemised, f"item_id long, cls binary, words array<long>, letters array<long>, windows array<struct<{_WINDOWS}>>")
    # items with all windows in common are one
    items = written(items.groupBy("cls").agg(F.min("item_id").alias("item_id"), F.count("*").alias("items"), F.first("words").alias("words"), F.first("letters").alias("letters"), F.first("windows").alias("windows")))
    windows = items.select("cls", "item_id", "items", F.explode("windows").alias("w")).select("cls", "item_id", "items", "w.*")
    shape = windows.agg(F.collect_set("size"), F.min("pieces")).first()
    if shape[1] is None:
        return None
    units = docs.sparkSession.createDataFrame([(int(x),) for x in _UNIT_HASHES.view(np.int64)], "x long")
    words, letters = (items.select(F.explode(c).alias("x")) for c in ("words", "letters"))
    held = Filter(_bit_table_of(words, "x"), _bit_table_of(letters.unionByName(units), "x"), _bit_table_of(windows, "h"), sorted(shape[0]), shape[1])
    held = docs.sparkSession.sparkContext.broadcast(held)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), text_bytes(F.col(text_col)).alias("t"))
    keys = written(slim.mapInArrow(lambda batches: _keyed(held.value)(batches), "row long, doc_id long, th long, k1 long, k2 long"))
    joined = salted_join(keys, windows.select("cls", "item_id", "items", "r", "j", "size", "n", "k1", "k2"), ["k1", "k2"])
    each = joined.groupBy("row", "doc_id", "th", "cls", "r").agg(F.first("item_id").alias("item_id"), F.first("items").alias("items"), F.first("size").alias("size"), F.first("n").alias("n"), F.sort_array(F.collect_set("j")).alias("js"))
    gaps = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("js") - 1), lambda k: F.least(F.col("size"), F.get("js", k) - F.get("js", k - 1))), F.lit(0), lambda a, x: a + x)
    covered = F.col("size") + F.when(F.size("js") > 1, gaps).otherwise(0)
    each = each.select("row", "doc_id", "th", "cls", "item_id", "items", F.struct((covered / F.col("n")).alias("share"), F.size("js").alias("windows"), covered.alias("covered"), F.col("n").alias("item_tokens")).alias("best"))
    best = each.groupBy("row", "doc_id", "th", "cls").agg(F.first("item_id").alias("item_id"), F.first("items").alias("items"), F.max("best").alias("best"))
    return best.select("row", "doc_id", "th", "item_id", "items", "best.windows", "best.covered", "best.item_tokens")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, items, windows, covered, item_tokens)`` for each document that holds part of an item.

    Items shorter than a window count as one window.  Windows of fewer than ``LEAST_WORDS`` words match verbatim only.
    Items with all windows in common are one, named by the smallest id (null ids are taken too, and name it only if all
    are null); ``items`` counts the different rows.  Null or empty texts and items never match.  Repeated rows give repeated
    rows; of equally covered readings the one with more windows counts; an empty table on either side gives none.  Long
    texts are read whole.  Other columns are not read.
    """
    shape = "doc_id long, item_id long, items long, windows int, covered int, item_tokens int"
    found = _found(docs, benchmark, id_col, text_col)
    return docs.sparkSession.createDataFrame([], shape) if found is None else found.drop("row", "th")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows that :func:`contaminated` would name; rows of one id are judged each by its text."""
    found = _found(docs, benchmark, id_col, text_col)
    if found is None:
        return docs
    gone = written(found.select("doc_id", "th").distinct())
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs[text_col]) == gone["th"]), "left_anti")
