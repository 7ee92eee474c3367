"""Language-model scores of documents: a hashed maximum-entropy model beside an add-0.1 unigram base.

Word counts are exact over all training documents: documents are dealt to blocks of bounded size, each block sends its
distinct words to buckets, and each bucket returns the corpus counts of the words a block asked for.

The model factors a word into its class and the word within the class.  The most frequent words make up classes by
frequency; all others are classed by their ending, and within such a class follow their smoothed counts.  Both factors
are softmaxes over hashed features of the history: the word before, the one before that (skip), and both (n-gram).  The
vocabulary, the classes and the hashed rows grow with the corpus (:func:`shape_for`).

Training is distributed.  Each document becomes a row of symbols, and since a gradient depends on a history and on what
follows it alone, all training documents are counted once by history, in buckets; the table grows with the different
histories.  Every step sums the gradient over all buckets, that is, over all training documents, and moves the weights
once.  Buckets follow from the data, so scores do not depend on how the table is laid out or on the number of tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, reachable, text_bytes, written

ALPHA = 0.1
#: Frequent words in classes of this many, the rest in classes by ending.
IN_CLASS, ENDING_CLASSES = 32, 16
#: Frequent classes of the smallest and the largest model; tokens from which the smallest no longer does.
LEAST_CLASSES, MOST_CLASSES, GROWS_AT = 16, 128, 8_000_000
#: Hashed rows of both weight tables, at least and for each frequent class.
LEAST_ROWS, ROWS_A_CLASS = 8192, 128
STEPS, RATE, SMOOTH, DECAY = 8, 0.7, 3.0, 0.5
#: UTF-8 bytes of a block of documents, and the fewest blocks, so that a few do not meet in one task by chance.
BLOCK_BYTES, LEAST_BLOCKS = 12_000_000, 32
#: Training tokens whose histories one bucket counts and one task sums up; the most buckets (there are fewer than 2**25
#: histories); tokens that are counted or scored at once; histories at once; parts that a sum of gradients is cut into.
BUCKET_TOKENS, TASK_TOKENS, MOST_BUCKETS, BATCH, CHUNK, PIECES = 2_000_000, 16_000_000, 4096, 1_000_000, 8192, 16
#: The end of a document as a word: no word holds white space.
_END = b"\n"


@dataclass(frozen=True)
class Shape:
    """Sizes of a model.  Symbols: frequent words by rank, then endings, then the start of a document."""

    classes: int

    @property
    def top(self) -> int:
        return self.classes * IN_CLASS

    @property
    def width(self) -> int:
        return self.classes + ENDING_CLASSES

    @property
    def rows(self) -> int:
        return max(LEAST_ROWS, ROWS_A_CLASS * self.classes)

    @property
    def start(self) -> int:
        return self.top + ENDING_CLASSES

    @property
    def symbols(self) -> int:
        return self.start + 1


def shape_for(tokens: int) -> Shape:
    """Classes double, and with them the vocabulary and the hashed rows, whenever the training tokens grow fourfold."""
    classes = LEAST_CLASSES
    while classes < MOST_CLASSES and tokens >= GROWS_AT * (classes // LEAST_CLASSES) ** 2:
        classes *= 2
    return Shape(classes)


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes, A-Z lowered, split at ASCII white space."""
    return text.lower().split()


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0


def ending_class(word: bytes) -> int:
    return crc32(word[-3:]) % ENDING_CLASSES


# ---- counts ----


def _counts(docs: pa.Table) -> Counter:
    """Words of a block with their counts in its training documents."""
    counts: Counter = Counter()
    for text, out in zip(docs["t"].to_pylist(), docs["held_out"].to_pylist(), strict=True):
        if out:
            counts.update(dict.fromkeys(words(text), 0))
        else:
            counts.update(words(text))
    return counts


def _vocabulary(words_: Iterable[bytes], buckets: int) -> dict[int, list[bytes]]:
    """By bucket: distinct words, sorted."""
    parts: dict[int, list[bytes]] = {}
    for w in words_:
        parts.setdefault(crc32(w) % buckets, []).append(w)
    return {b: sorted(ws) for b, ws in parts.items()}


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
_COUNTED = "block int, bucket int, counts binary, known long, tokens long, top array<struct<word:binary,n:long>>, sums array<long>, kinds array<long>"


def _send(buckets: int):
    def of(docs: pa.Table) -> pa.Table:
        rows, counts = [], _counts(docs)
        for b, ws in _vocabulary(counts, buckets).items():
            rows.append({"bucket": b, "block": docs["block"][0].as_py(), "words": b" ".join(ws), "counts": np.array([counts[w] for w in ws], "<u4").tobytes()})
        return pa.Table.from_pylist(rows, _SENT)

    return of


def _count(sent: pa.Table) -> pa.Table:
    total: Counter = Counter()
    asked = []
    for block, ws, counts in zip(sent["block"].to_pylist(), sent["words"].to_pylist(), sent["counts"].to_pylist(), strict=True):
        ws = ws.split(b" ")
        asked.append((block, ws))
        for w, c in zip(ws, np.frombuffer(counts, "<u4").tolist(), strict=True):
            total[w] += c
    bucket = sent["bucket"][0].as_py()
    rows = [{"block": block, "bucket": bucket, "counts": np.array([total[w] for w in ws], "<i8").tobytes()} for block, ws in asked]
    sums, kinds = [0] * ENDING_CLASSES, [0] * ENDING_CLASSES
    known = [(w, c) for w, c in total.items() if c]
    for w, c in known:
        e = ending_class(w)
        sums[e] += c
        kinds[e] += 1
    top = sorted(known, key=lambda x: (-x[1], x[0]))[: Shape(MOST_CLASSES).top]
    rows.append({"block": -1, "known": len(known), "tokens": sum(c for _, c in known), "top": [{"word": w, "n": c} for w, c in top], "sums": sums, "kinds": kinds})
    return pa.Table.from_pylist(
        rows,
        pa.schema(
            [("block", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary()), ("known", pa.int64()), ("tokens", pa.int64()),
             ("top", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))), ("sums", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int64()))]
        ),
    )


# ---- the model ----


@dataclass
class Model:
    shape: Shape
    top: dict[bytes, int]
    class_weights: np.ndarray  # rows x width
    word_weights: np.ndarray  # rows x IN_CLASS
    class_bias: np.ndarray
    word_bias: np.ndarray  # classes x IN_CLASS
    ending_mass: np.ndarray  # smoothed size of each ending class

    def symbol(self, word: bytes) -> int:
        found = self.top.get(word)
        return self.shape.top + ending_class(word) if found is None else found


def untrained(shape: Shape, top: list[tuple[bytes, int]], sums: np.ndarray, kinds: np.ndarray) -> Model:
    """The model that follows counts alone; ``sums`` and ``kinds`` hold all words by ending, frequent ones too."""
    sums, kinds = sums.astype(float), kinds.astype(float)
    counts = np.full(shape.top, -1.0)
    for i, (w, c) in enumerate(top):
        counts[i] = c + ALPHA
        if w != _END:
            sums[ending_class(w)] -= c
            kinds[ending_class(w)] -= 1
    ending = sums + ALPHA * (kinds + 1)
    mass = np.r_[np.where(counts > 0, counts, 0).reshape(shape.classes, IN_CLASS).sum(1), ending]
    none = np.float32(-1e9)
    with np.errstate(divide="ignore"):
        class_bias = np.where(mass > 0, np.log(np.maximum(mass, 1e-300)), none).astype(np.float32)
        word_bias = np.where(counts > 0, np.log(np.maximum(counts, 1e-300)), none).astype(np.float32).reshape(shape.classes, IN_CLASS)
    zero = np.zeros((shape.rows, shape.width), np.float32), np.zeros((shape.rows, IN_CLASS), np.float32)
    return Model(shape, {w: i for i, (w, _) in enumerate(top)}, *zero, class_bias, word_bias, ending)


def _hash(shape: Shape, kind: int, a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    return ((a * 2_654_435_761 + b * 40_503_000_017 + kind * 97_531_003) >> 7) % shape.rows


class Tokens:
    """Documents as symbols with the history of each."""

    def __init__(self, shape: Shape, symbols: np.ndarray, first: np.ndarray):
        """``first``: where each document starts."""
        symbols = symbols.astype(np.int64)
        one, two = np.roll(symbols, 1), np.roll(symbols, 2)
        one[first] = two[first] = shape.start
        two[first[first + 1 < len(symbols)] + 1] = shape.start
        self.group = np.where(symbols < shape.top, symbols // IN_CLASS, symbols - shape.top + shape.classes)
        self.history = one * shape.symbols + two
        self.often = np.flatnonzero(symbols < shape.top)
        self.inner = one[self.often] * shape.classes + self.group[self.often]
        self.word = symbols[self.often] % IN_CLASS


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def class_rows(shape: Shape, histories: np.ndarray) -> list[np.ndarray]:
    one, two = np.divmod(histories, shape.symbols)
    return [_hash(shape, 1, one), _hash(shape, 2, two), _hash(shape, 3, one, two + 1)]


def word_rows(shape: Shape, inner: np.ndarray) -> np.ndarray:
    one, group = np.divmod(inner, shape.classes)
    return _hash(shape, 4, one, group + 1)


def class_log(model: Model, histories: np.ndarray) -> np.ndarray:
    """Log probability of each class after each history."""
    logits = np.repeat(model.class_bias[None], len(histories), 0)
    for r in class_rows(model.shape, histories):
        logits += model.class_weights[r]
    return _log_softmax(logits)


def word_log(model: Model, inner: np.ndarray) -> np.ndarray:
    """Log probability of each word of a class after a word."""
    return _log_softmax(model.word_bias[inner % model.shape.classes] + model.word_weights[word_rows(model.shape, inner)])


def _looked_up(codes: np.ndarray, column: np.ndarray, log) -> np.ndarray:
    """``log(codes)[:, column]``, computed once for each different code."""
    order = np.argsort(codes, kind="stable")
    own = codes[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    out = np.zeros(len(codes))
    edges = np.r_[first, len(own)]
    for at in range(0, len(first), CHUNK):
        lo, hi = edges[at], edges[min(at + CHUNK, len(first))]
        size = np.diff(edges[at : min(at + CHUNK, len(first)) + 1])
        table = log(own[first[at : at + CHUNK]])
        part = order[lo:hi]
        out[part] = table[np.repeat(np.arange(len(size)), size), column[part]]
    return out


def score(model: Model, tokens: Tokens, rare: np.ndarray) -> np.ndarray:
    """Log10 probability of each token; ``rare``: log10 of a word's share of its ending class, 0 for frequent words."""
    out = _looked_up(tokens.history, tokens.group, lambda h: class_log(model, h))
    out[tokens.often] += _looked_up(tokens.inner, tokens.word, lambda x: word_log(model, x))
    return out / np.log(10) + rare


def rare_share(model: Model, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ending = symbols - model.shape.top
    return np.where(ending < 0, 0.0, np.log10((counts + ALPHA) / model.ending_mass[np.maximum(ending, 0)]))


# ---- training ----

_PART = "bucket int, kind int, codes binary, counts binary"
_PART_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return codes[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts


def _counted(shape: Shape, buckets: int):
    """What follows which history, of the documents of each batch."""

    def rows(held: list[bytes]) -> list[dict]:
        lengths = np.array([len(h) // 2 for h in held])
        tokens = Tokens(shape, np.frombuffer(b"".join(held), "<u2"), np.cumsum(lengths) - lengths)
        out = []
        for kind, (before, after, n) in enumerate(((tokens.history, tokens.group, shape.width), (tokens.inner, tokens.word, IN_CLASS))):
            codes, counts = np.unique(before * n + after, return_counts=True)
            which = (codes // n * 2_654_435_761 >> 9) % buckets
            order = np.argsort(which, kind="stable")
            edges = np.searchsorted(which[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                out.append({"bucket": b, "kind": kind, "codes": codes[own].astype("<u4").tobytes(), "counts": counts[own].astype("<u4").tobytes()})
        return out

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        n = 0
        for batch in batches:
            for x in batch.column(0):
                held.append(x.as_py())
                n += len(held[-1])
                if n >= 4 * BATCH:
                    yield pa.RecordBatch.from_pylist(rows(held), _PART_SCHEMA)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(rows(held), _PART_SCHEMA)

    return over


def _merged(parts: pa.Table) -> pa.Table:
    out = []
    for kind in (0, 1):
        own = parts.filter(pc.equal(parts["kind"], kind))
        if own.num_rows:
            codes, counts = _summed(*[np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in own[c]]) for c in ("codes", "counts")])
            out.append({"bucket": parts["bucket"][0].as_py(), "kind": kind, "codes": codes.tobytes(), "counts": counts.astype("<i8").tobytes()})
    return pa.Table.from_pylist(out, _PART_SCHEMA)


def _scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    if len(first):
        into[own[first]] += np.add.reduceat(values[order], first, axis=0)


def sums(model: Model, kind: int, codes: np.ndarray, counts: np.ndarray, observed: bool, out: np.ndarray | None = None) -> np.ndarray:
    """By hashed row and class (or word): how often it followed, observed or expected under the model; added to ``out``."""
    shape = model.shape
    n = shape.width if kind == 0 else IN_CLASS
    out = np.zeros((shape.rows, n)) if out is None else out
    before = codes // n
    first = np.flatnonzero(np.r_[True, before[1:] != before[:-1]][: len(codes)])
    edges = np.r_[first, len(codes)]
    for at in range(0, len(first), CHUNK):
        own = before[first[at : at + CHUNK]]
        part = slice(edges[at], edges[min(at + CHUNK, len(first))])
        which = np.repeat(np.arange(len(own)), np.diff(edges[at : at + len(own) + 1]))
        if observed:
            values = np.bincount(which * n + codes[part] % n, weights=counts[part], minlength=len(own) * n).reshape(len(own), n)
        else:
            total = np.bincount(which, weights=counts[part], minlength=len(own))
            values = np.exp(class_log(model, own) if kind == 0 else word_log(model, own)) * total[:, None]
        for r in class_rows(shape, own) if kind == 0 else [word_rows(shape, own)]:
            _scatter(out, r, values)
    return out


def _gradient(model: Model, observed: bool):
    """Sums of each task, in double precision, so that their total depends on the tasks in its last digits only."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray | None] = [None, None]
        for batch in batches:
            for kind, codes, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out[kind] = sums(model, kind, np.frombuffer(codes, "<u4").astype(np.int64), np.frombuffer(counts, "<i8"), observed, out[kind])
        for kind, found in enumerate(out):
            if found is not None:
                cut = [c.tobytes() for c in np.array_split(found.ravel(), PIECES)]
                yield pa.RecordBatch.from_pydict({"piece": pa.array(range(kind * PIECES, (kind + 1) * PIECES), pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * PIECES, pa.int32()), "v": pa.array(cut, pa.binary())})

    return over


def _added(rows: pa.Table) -> pa.Table:
    total = np.zeros(len(rows["v"][0].as_py()) // 8)
    for v in rows.sort_by("part")["v"]:
        total += np.frombuffer(v.as_py())
    return pa.table({"piece": rows["piece"][:1].combine_chunks(), "part": rows["part"][:1].combine_chunks(), "v": pa.array([total.tobytes()], pa.binary())})


def _total(table: DataFrame, model: Model, observed: bool) -> list[np.ndarray]:
    """The sums over all buckets: for classes and for words."""
    shape = "piece int, part int, v binary"
    found = table.mapInArrow(_gradient(model, observed), shape).groupBy("piece").applyInArrow(_added, shape).collect()
    parts = {r["piece"]: np.frombuffer(r["v"]) for r in found}
    out = []
    for kind, n in ((0, model.shape.width), (1, IN_CLASS)):
        own = [parts[p] for p in sorted(parts) if p // PIECES == kind]
        out.append(np.concatenate(own).reshape(-1, n) if own else np.zeros((model.shape.rows, n)))
    return out


def moved(weights: np.ndarray, seen: np.ndarray, expected: np.ndarray, rate: float) -> np.ndarray:
    """One gradient step, scaled by what each weight expects; rare features move little and decay."""
    step = np.clip((seen - expected - DECAY * weights) / (expected + SMOOTH), -1.0, 1.0)
    return (weights + rate * step).astype(np.float32)


def train(coded: DataFrame, model: Model, tokens: int, steps: int = STEPS, rate: float = RATE) -> Model:
    """``model`` after ``steps`` gradient steps over all ``symbols`` (little-endian 16-bit) of ``coded``."""
    buckets = min(MOST_BUCKETS, max(1, -(-tokens // BUCKET_TOKENS)))
    parts = coded.select("symbols").mapInArrow(_counted(model.shape, buckets), _PART)
    table = kept = written(parts.groupBy("bucket").applyInArrow(_merged, _PART))
    table = table.select("kind", "codes", "counts").coalesce(max(1, -(-buckets * BUCKET_TOKENS // TASK_TOKENS)))
    seen = _total(table, model, True)
    for step in range(steps if seen[0].any() else 0):
        expected = _total(table, model, False)
        now = rate if step < steps - 2 else rate / 2
        moves = [moved(w, s, e, now) for w, s, e in zip((model.class_weights, model.word_weights), seen, expected, strict=True)]
        model = Model(model.shape, model.top, *moves, model.class_bias, model.word_bias, model.ending_mass)
    discard(kept)
    return model


# ---- scores ----

_CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rare double, symbols binary"
_CODED_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("rare", pa.float64()), ("symbols", pa.binary())]
)


def _code(model: Model, buckets: int, total: int, known: int, ends: int):
    """Documents of a block as symbols, with what follows from counts alone."""

    def of(docs: pa.Table, counted: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_pylist([], _CODED_SCHEMA)
        counts = {_END: ends}
        back = dict(zip(counted["bucket"].to_pylist(), counted["counts"].to_pylist(), strict=True))
        found: set[bytes] = set()
        for text in docs["t"]:
            found.update(words(text.as_py()))
        for b, ws in _vocabulary(found, buckets).items():
            counts.update(zip(ws, np.frombuffer(back[b], "<i8").tolist(), strict=True))
        place = dict(zip(counts, range(len(counts)), strict=True))
        symbol = np.fromiter(map(model.symbol, counts), np.int64, len(counts))
        count = np.fromiter(counts.values(), np.int64, len(counts))
        del counts
        base = np.log10((count + ALPHA) / (total + ALPHA * (known + 1)))
        rare = rare_share(model, symbol, count)
        short = symbol.astype("<u2")
        out = []
        for i, held, text in zip(docs["doc_id"].to_pylist(), docs["held_out"].to_pylist(), docs["t"].to_pylist(), strict=True):
            own = words(text)
            at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
            at = np.r_[at, place[_END]]
            out.append((i, held, len(at), int((count[at] > 0).sum()), float(base[at].sum()), float(rare[at].sum()), short[at].tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CODED_SCHEMA, strict=True)], schema=_CODED_SCHEMA)

    return of


def _score(model: Model, total: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, made = batch.column(6).to_pylist(), []
            at = 0
            while at < len(raw):
                first, taken = at, 0
                while at < len(raw) and taken < BATCH:
                    taken += len(raw[at]) // 2
                    at += 1
                lengths = np.array([len(r) // 2 for r in raw[first:at]])
                begin = np.cumsum(lengths) - lengths
                per = score(model, Tokens(model.shape, np.frombuffer(b"".join(raw[first:at]), "<u2"), begin), np.zeros(1))
                made.append(np.add.reduceat(per, begin))
            found = np.concatenate([np.zeros(0), *made]) + batch.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(len(raw), total), pa.int64()), batch.column(4), pa.array(found)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return over


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Null text is empty and scores as its end alone.  With nothing to learn from, counts are zero and the base score is
    0.  Repeated rows count and score each; of words of equal count the one that sorts first ranks before.  A text longer
    than a block is a block's only long one and is scored whole.  An empty table gives no rows; other columns are not read.
    """
    reachable(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_bytes(F.col(text_col)).alias("t"))
    sizes = slim.agg(F.sum(F.octet_length("t")), F.sum((~F.col("held_out")).cast("long"))).first()
    n, ends = max(LEAST_BLOCKS, -(-(sizes[0] or 0) // block_bytes)), sizes[1] or 0
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "t"), F.lit(n)).cast("int")).repartition("block")
    counted = written(dealt.groupBy("block").applyInArrow(_send(n), "bucket int, block int, words binary, counts binary").groupBy("bucket").applyInArrow(_count, _COUNTED))
    all_ = counted.where("block = -1")
    found = all_.agg(F.sum("known"), F.sum("tokens"), *[F.sum(F.col("sums")[i]) for i in range(ENDING_CLASSES)], *[F.sum(F.col("kinds")[i]) for i in range(ENDING_CLASSES)]).first()
    found = [x or 0 for x in found]
    known, total = found[0] + (ends > 0), found[1] + ends
    shape = shape_for(total)
    top = all_.select(F.explode("top").alias("x")).select("x.word", "x.n").orderBy(F.desc("n"), "word").limit(shape.top - 1).collect()
    top = sorted([*[(bytes(r["word"]), r["n"]) for r in top], (_END, ends)], key=lambda x: (-x[1], x[0]))
    model = untrained(shape, top, np.array(found[2 : 2 + ENDING_CLASSES]), np.array(found[2 + ENDING_CLASSES :]))
    back = counted.where("block >= 0").select("block", "bucket", "counts")
    coded = written(dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_code(model, n, total, known, ends), _CODED))
    discard(counted)
    model = train(coded.where(~F.col("held_out")), model, total, steps)
    return coded.mapInArrow(_score(model, total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
