"""Language identification with hyperdimensional profiles.

Each letter has a random vector of signs.  A trigram is the product of its letters' vectors, rotated by their place; a
text is the sum of its trigrams, a language the sum over its training texts.  A text gets the language of largest cosine.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import at_work, reachable

DIMENSIONS = 512
SEED = 20_240_601
#: Letters a-z have a vector each; all others share the rest.  0 stands for what is no letter.
SYMBOLS = 128
#: Cosine from which a text is in a language; random letters come to about 0.05.  Bytes below which any above 0 will do.
LEAST_SCORE, SHORT = 0.1, 64
#: Sums that one task adds up.
ADDED = 512
_CHUNK, _CELLS, _SLICE = 500_000, 2_000_000, 16_384


@cache
def _symbols() -> np.ndarray:
    """Symbol of each code point, lower case and upper case alike."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low - 96 if 97 <= low <= 122 else 27 + (low * 2_654_435_761 >> 12) % (SYMBOLS - 27)
    return out


@cache
def _letters(dimensions: int) -> tuple[np.ndarray, ...]:
    signs = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1
    return np.roll(signs, 2, axis=1), np.roll(signs, 1, axis=1), signs


def trigram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    a, b, c = _letters(dimensions)
    return (a[codes >> 14] * b[codes >> 7 & 127] * c[codes & 127]).astype(np.float32)


def bundles(texts: list[bytes], owner: np.ndarray, owners: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sum of the trigram vectors of all texts of each owner; a text without letters adds nothing."""
    out = np.zeros((owners, dimensions))
    at = 0
    while at < len(texts):
        first, taken = at, 0
        while at < len(texts) and taken < _CHUNK:
            taken += len(texts[at])
            at += 1
        points = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts[first:at]]
        gap = np.full(1, 32, "<u4")
        flat = _symbols()[np.concatenate([gap, *[x for p in points for x in (p, gap)]])].astype(np.int32)
        if len(flat) < 3:
            continue
        codes = flat[:-2] << 14 | flat[1:-1] << 7 | flat[2:]
        whose = np.repeat(owner[first:at], [len(p) + 1 for p in points])[: len(codes)]
        keep = flat[1:-1] > 0
        codes, whose = codes[keep], whose[keep]
        seen = np.zeros(1 << 21, bool)
        seen[codes] = True
        known = np.flatnonzero(seen)
        if not len(known):
            continue
        place = np.zeros(1 << 21, np.int32)
        place[known] = np.arange(len(known))
        codes = place[codes]
        names, whose = np.unique(whose, return_inverse=True)
        for lo in range(0, len(known), _SLICE):
            part = known[lo : lo + _SLICE]
            vectors = trigram_vectors(part, dimensions)
            step = max(1, _CELLS // len(part))
            for start in range(0, len(names), step):
                n = min(step, len(names) - start)
                own = slice(None) if n == len(names) and len(part) == len(known) else (whose >= start) & (whose < start + n) & (codes >= lo) & (codes < lo + len(part))
                cells = (whose[own] - start) * len(part) + (codes[own] - lo)
                counts = np.bincount(cells, minlength=n * len(part)).reshape(n, len(part)).astype(np.float32)
                out[names[start : start + n]] += counts @ vectors
    return out


def _learn(dimensions: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("language_id")
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names, owner = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            found = bundles(batch.column(0).to_pylist(), owner, len(names), dimensions)
            for name, row in zip(names, found, strict=True):
                sums[name] = sums.get(name, 0) + row
        part = pa.array([TaskContext.get().partitionId()] * len(sums), pa.int32())
        yield pa.RecordBatch.from_pydict({"part": part, "lang": pa.array(list(sums), pa.string()), "v": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    return over


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": rows["part"][:1] // ADDED, "lang": rows["lang"][:1], "v": [sum(np.frombuffer(v) for v in rows["v"]).tobytes()]})


def profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit vector of each language over all labelled rows.

    Each task hands on one sum for each language it saw; what the driver gets is one vector for each distinct label.
    Null labels and null texts are left out.
    """
    reachable(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    shape = "part int, lang string, v binary"
    sums = rows.select(F.col(text_col).cast("binary").alias("t"), F.col(lang_col).alias("lang")).mapInArrow(_learn(dimensions), shape)
    for step in (F.floor(F.col("part") / ADDED), F.lit(0)):  # a tree, so that no task adds up the sums of all others
        sums = sums.groupBy("lang", step.alias("to")).applyInPandas(_added, shape)
    sums = sums.collect()
    found = {r["lang"]: np.frombuffer(r["v"]) for r in sorted(sums, key=lambda r: r["lang"])}
    return {k: v / n for k, v in found.items() if (n := float(np.linalg.norm(v))) > 0}


def classify(texts: list[bytes], known: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Language and cosine (0 where negative) of each text; ``und`` and 0 where it has no letters or nothing was learned."""
    if not texts or not known:
        return ["und"] * len(texts), np.zeros(len(texts))
    own = bundles(texts, np.arange(len(texts)), len(texts), dimensions)
    length = np.linalg.norm(own, axis=1)
    near = own @ np.array(list(known.values())).T / np.maximum(length, 1e-9)[:, None]
    best = near.argmax(1)
    names = list(known)
    lettered = [bool(_symbols()[np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")].any()) if n == 0 else True for t, n in zip(texts, length, strict=True)]
    return [names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, np.clip(near[np.arange(len(best)), best], 0, 1), 0.0)


def _predict(known: dict[str, np.ndarray], dimensions: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("language_id")
        for batch in batches:
            names, score = classify(batch.column(2).to_pylist(), known, dimensions)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return over


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a document is kept from learning; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row, learned from rows not held out that have a label.

    lang_pred is ``und`` with score 0 for null texts, texts without letters, and all if nothing was learned.  Equal
    cosines go to the label that sorts first.  An empty table gives no rows; repeated rows get equal ones.
    """
    reachable(docs.sparkSession)
    known = profiles(docs.where(~held_out()), dimensions=dimensions)
    slim = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    return slim.mapInArrow(_predict(known, dimensions), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, wanted: Collection[str] | None = None, least: float = LEAST_SCORE, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` without rows that are in none of the ``wanted`` languages (all that were learned, by default).

    A row goes if it is ``und`` (null text, no letters, nothing learned), if its language is not wanted, or if its text is
    like no language: a cosine below ``least``, or, in texts of fewer than ``SHORT`` bytes, whose cosines say little, none
    above 0.  Repeated rows share their fate; columns stay as they are, whatever their names; an empty table stays empty.
    """
    reachable(docs.sparkSession)
    known = profiles(docs.where(~held_out()), dimensions=dimensions)
    place = docs.columns.index("text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("language_id")
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(place).to_pylist()]
            found = zip(texts, *classify(texts, known, dimensions), strict=True)
            keep = [x != "und" and (wanted is None or x in wanted) and (s >= least or len(t) < SHORT and s > 0) for t, x, s in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(over, docs.schema)
