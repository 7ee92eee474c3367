"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

Vectors are centred and get one more component that brings all to the same norm, so that the nearest point is the one of
largest inner product.  Each table hashes a vector to the cell of some Gaussian projections; a query also visits cells with
some coordinates moved by one, in order of the estimated chance that a neighbour fell there.  How many projections, how wide
the cells and how many probes is told by a bounded sample of queries, whose neighbours are searched exactly in one scan: of
the settings that find enough of them, the one whose cells hold least is taken, so the share of the rows that are
candidates falls as their number grows.  Equal vectors are one point with its smallest ids, so copies never pile up in a
cell.  Cells are worked on in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.llm.common import reachable, salted_join, written

NEAREST = 20
TABLES, MOST_PROBES = 4, 48
#: Settings that are tried: projections, and cell width in units of the largest norm.
LADDER = ((1, 1.0), (2, 1.0), (2, 1.5), (3, 1.5), (4, 1.5), (4, 2.0), (5, 2.0), (6, 2.0), (6, 2.5))
#: Recall that the sample must reach; queries and points of the sample; what it costs to visit a cell, in candidates.
TARGET, SAMPLE_QUERIES, SAMPLE_POINTS, CELL = 0.95, 64, 8192, 50
SEED = 11
#: Points and queries of a cell that one task holds.
BLOCK = 1024
#: More candidates than asked for are scored again exactly, so that rounding in the bulk product decides nothing.
SPARE = 4


class Hashes:
    """The hash functions for vectors of one dimension whose largest norm is ``norm``."""

    def __init__(self, centre: np.ndarray, norm: float, tables: int, projections: int, width: float):
        """``centre`` is taken from all points; ``norm``: the largest that they have then."""
        rng = np.random.default_rng(SEED)
        dimension = len(centre)
        self.centre, self.norm, self.projections, self.tables = centre, norm, projections, tables
        self.axes = rng.standard_normal((dimension + 1, tables * projections)) / (width * norm)
        self.shift = rng.uniform(0, 1, tables * projections)
        self.moves = np.array(list(product((0, -1, 1), repeat=projections)))

    def cells(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Projections ``(n, tables, projections)`` in cell widths."""
        if query:
            full = np.column_stack([vectors * (self.norm / np.sqrt((vectors**2).sum(1)))[:, None], np.zeros(len(vectors))])
        else:
            vectors = vectors - self.centre
            square = (vectors**2).sum(1)
            full = np.column_stack([vectors, np.sqrt(np.maximum(0, self.norm**2 - square))])
        return (full @ self.axes + self.shift).reshape(len(vectors), self.tables, self.projections)

    @staticmethod
    def code(cell: np.ndarray) -> np.ndarray:
        out = np.zeros(cell.shape[:-1], np.int64)
        with np.errstate(over="ignore"):
            for i in range(cell.shape[-1]):
                out = out * 1_000_003 + cell[..., i]
        return out

    def own(self, vectors: np.ndarray) -> np.ndarray:
        return self.code(np.floor(self.cells(vectors, False)).astype(np.int64))

    def probes(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """Cells to visit ``(queries, tables, n)``: moves with the least sum of squared distances to the walls crossed."""
        at = self.cells(vectors, True)
        cell = np.floor(at)
        inside = at - cell
        cost = np.where(self.moves == -1, inside[:, :, None, :] ** 2, np.where(self.moves == 1, (1 - inside[:, :, None, :]) ** 2, 0)).sum(-1)
        best = np.argsort(cost, axis=-1, kind="stable")[:, :, :n]
        return self.code((cell[:, :, None, :] + self.moves[best]).astype(np.int64))


def _ranks(seen: np.ndarray, own: np.ndarray) -> np.ndarray:
    """At which probe of any table a query ``(tables, probes)`` comes to each point ``(points, tables)``; the number of probes if never."""
    hit = own[:, :, None] == seen[None]
    return np.where(hit.any(2), hit.argmax(2), seen.shape[1]).min(1)


def choose(queries: np.ndarray, near: list[np.ndarray], points: np.ndarray, centre: np.ndarray, norm: float, n: int, tables: int = TABLES) -> tuple[int, float, int, float, float]:
    """Projections, width and probes, with the recall and the share of candidates that they come to on a sample.

    Of settings with enough recall the one that costs least among ``n`` points: the candidates, and the cells to be visited.
    ``near``: the true neighbours of each query; ``points``: any points.
    """
    best: tuple[tuple, tuple] | None = None
    for projections, width in LADDER:
        hashes = Hashes(centre, norm, tables, projections, width)
        most = min(MOST_PROBES, 3**projections)
        seen = hashes.probes(queries, most)
        wanted = np.concatenate([_ranks(s, hashes.own(v)) for s, v in zip(seen, near, strict=True) if len(v)] or [np.zeros(0, np.int64)])
        other = hashes.own(points)
        met = np.concatenate([np.bincount(_ranks(s, other), minlength=most + 1)[None, :most] for s in seen]).sum(0).cumsum() / max(1, len(points) * len(seen))
        recall = np.bincount(wanted, minlength=most + 1)[:most].cumsum() / max(1, len(wanted))
        enough = np.flatnonzero(recall >= TARGET) if len(wanted) else np.array([most - 1])
        probes = int(enough[0]) if len(enough) else most - 1
        rank = (len(enough) == 0, met[probes] * n + CELL * tables * (probes + 1) if len(enough) else -recall[probes])
        if best is None or rank < best[0]:
            best = rank, (projections, width, probes + 1, float(recall[probes]), float(met[probes]))
    return best[1]


def _stack(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(float).reshape(len(column), -1)


def _nearest_in_batch(ids: np.ndarray, queries: np.ndarray, keep: int, kind: str):
    """The best points of each batch for each of a few queries (itself among them), with their vectors."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                vectors = np.stack([np.array(v, float) for v in part.column(1).to_pylist()])
                score = queries @ vectors.T
                top = np.argsort(-score, axis=1, kind="stable")[:, :keep]
                whose = np.repeat(np.arange(len(queries)), top.shape[1])
                at_ = top.reshape(-1)
                raw = pa.array([v.astype(kind).tobytes() for v in vectors], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[whose]), part.column(0).take(pa.array(at_)), pa.array(score[whose, at_]), raw.take(pa.array(at_))], names=["q", "p", "score", "v"])

    return over


def _addressed(hashes: Hashes, probes: int | None, kind: str, some: np.ndarray | None = None, keep: int = 0):
    """Rows ``(t, cell, id, v, low)``: ``low`` is a score that a query's ``keep`` best reach, as they do among ``some`` points."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = np.stack([np.array(v, float) for v in part.column(1).to_pylist()])
                codes = hashes.own(vectors)[:, :, None] if probes is None else hashes.probes(vectors, probes)
                n, tables, each = codes.shape
                raw = pa.array([v.astype(kind).tobytes() for v in vectors], pa.binary())
                low = np.full(n, -np.inf)
                if some is not None and len(some) >= keep:
                    score = vectors @ some.T
                    low = np.partition(score, len(some) - keep, axis=1)[:, len(some) - keep]
                    low -= 1e-9 * (1 + np.abs(low))  # rounding decides nothing
                row = np.repeat(np.arange(n), tables * each)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), n)),
                        pa.array(codes.reshape(-1)),
                        part.column(0).take(pa.array(row)),
                        raw.take(pa.array(row)),
                        pa.array(low[row]),
                    ],
                    names=["t", "cell", "id", "v", "low"],
                )

    return over


def _raw(kind: str):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, kind).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "v"])

    return over


def _best(keep: int, kind: str):
    names, kinds = ["query", "point", "score"], [pa.int64(), pa.int64(), pa.float64()]

    def of(queries: pa.Table, points: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and points.num_rows:
            points = points.sort_by("id")
            ids, vectors = points["id"].to_numpy(), _stack(points["v"], kind)
            whose, asked = queries["id"].to_numpy(), _stack(queries["v"], kind)
            low = queries["low"].to_numpy() if "low" in queries.column_names else np.full(len(whose), -np.inf)
            step = max(1, 4_000_000 // len(ids))
            for i in range(0, len(whose), step):
                score = asked[i : i + step] @ vectors.T
                n = min(len(ids), keep + SPARE)
                top = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < len(ids) else np.broadcast_to(np.arange(len(ids)), score.shape)
                q = np.repeat(np.arange(i, i + len(score)), n)
                p = top.reshape(-1)
                enough = score[q - i, p] >= low[q]
                q, p = q[enough], p[enough]
                out.append((whose[q], ids[p], np.einsum("ij,ij->i", asked[q], vectors[p])))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        return pa.Table.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return of


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` without null, zero and non-finite vectors, null ids, repeats, and vectors of any but the commonest length."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(~F.coalesce(bad, F.lit(True))).where(F.exists("v", lambda x: x != 0.0))
    sizes = v.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return v.where(F.size("v") == (sizes["n"] if sizes else 0)).groupBy("id", "v").agg(F.lit(1).alias("_")).select("id", "v")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = NEAREST,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` (over column ``id``) picks, its ``k`` nearest found.

    Nearest first by inner product in doubles, ties to the smaller id; the query's own id is no candidate.  Vectors that
    are null, zero, of another length or not finite take no part.  Rows that repeat id and vector count once.  An empty
    table gives no rows; other columns are not read.
    """
    spark, out = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    reachable(spark)
    # vectors of floats travel as floats, which loses nothing
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    rows = written(usable(vectors, id_col, vector_col).withColumn("h", F.xxhash64("v")))
    same = W.partitionBy("v").orderBy("id")
    # a query and its k nearest use at most k + 1 ids of a class of equal vectors
    few = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    classes = written(few.groupBy("v", "h").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    total = classes.count()
    if not total:
        return spark.createDataFrame([], out)
    means = classes.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).collect()
    centre = np.array([r["x"] for r in sorted(means, key=lambda r: r["i"])])
    norm = classes.agg(F.max(F.aggregate(F.zip_with("v", F.array(*[F.lit(float(c)) for c in centre]), lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x))).first()[0]
    # one vector may be that of a third of all queries
    asked = salted_join(rows.where(is_query), classes.select("h", "rep", F.col("v").alias("_v")), ["h"]).where(F.col("v") == F.col("_v"))
    asked = written(asked.select("id", "rep", "v"))
    probing_of = asked.groupBy("rep").agg(F.first("v").alias("v"))
    some = probing_of.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_QUERIES).collect()
    if not some:
        return spark.createDataFrame([], out)
    names, sample = np.array([r["rep"] for r in some]), np.array([r["v"] for r in some], float)
    tops = classes.select("rep", "v").mapInArrow(_nearest_in_batch(names, sample, k + 1, kind), "q long, p long, score double, v binary")
    tops = tops.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "p"))).where(F.col("n") <= k + 1).where("q != p").select("q", "v").collect()
    near = [np.array([np.frombuffer(r["v"], kind) for r in tops if r["q"] == q], float).reshape(-1, len(centre)) for q in names.tolist()]
    points = np.array([r["v"] for r in classes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_POINTS).collect()], float)
    # all points may be one and the same: any width will do
    projections, width, probes, _, _ = choose(sample, near, points[:4096], centre, float(np.sqrt(norm)) or 1.0, total, tables)
    hashes = Hashes(centre, float(np.sqrt(norm)) or 1.0, tables, projections, width)
    address, some = "t int, cell long, id long, v binary, low double", points[: total // 8]
    points = classes.select("rep", "v").mapInArrow(_addressed(hashes, None, kind), address)
    probing = probing_of.mapInArrow(_addressed(hashes, probes, kind, some, k + 1), address)
    points, probing = written(points), written(probing.dropDuplicates(["t", "cell", "id"]))
    sizes = points.groupBy("t", "cell").agg(F.count("*").alias("np")).join(probing.groupBy("t", "cell").agg(F.count("*").alias("nq")), ["t", "cell"])
    sizes = sizes.select("t", "cell", F.ceil(F.col("np") / BLOCK).cast("int").alias("pb"), F.ceil(F.col("nq") / BLOCK).cast("int").alias("qb"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["t", "cell", "p", "q"]
    points = salted_join(points, sizes, ["cell", "t"]).withColumn("p", part("pb")).withColumn("q", every("qb")).select(*key, "id", "v")
    probing = salted_join(probing, sizes, ["cell", "t"]).withColumn("q", part("qb")).withColumn("p", every("pb")).select(*key, "id", "v", "low")
    found = probing.groupBy(*key).cogroup(points.groupBy(*key)).applyInArrow(_best(k + 1, kind), "query long, point long, score double")
    found = found.groupBy("query", "point").agg(F.max("score").alias("score"))
    found = written(found)
    got = found.groupBy("query").agg(F.count("*").alias("n"))
    short = probing_of.join(got, F.col("rep") == F.col("query"), "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, total)).select("rep", "v")
    blocks = -(-total // BLOCK)
    short = short.mapInArrow(_raw(kind), "id long, v binary").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("q", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    full = classes.select("rep", "v").mapInArrow(_raw(kind), "id long, v binary").withColumn("p", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    if short.limit(1).count():  # queries whose cells held too few: all rows, in blocks
        full = full.join(short.select("p", F.col("q").alias("_q")).distinct(), "p").withColumnRenamed("_q", "q")
        more = short.groupBy("p", "q").cogroup(full.groupBy("p", "q")).applyInArrow(_best(k + 1, kind), "query long, point long, score double")
        found = found.unionByName(more).groupBy("query", "point").agg(F.max("score").alias("score"))
    first = W.partitionBy("query").orderBy(F.desc("score"), "point")
    found = written(found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("query", "point", "score"))
    ids = found.join(classes.select(F.col("rep").alias("point"), "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    # one list for each query vector: its own id and k more are enough for every query that has it
    last = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("n", F.row_number().over(last)).where(F.col("n") <= k + 1)
    lists = ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("list"))
    pairs = salted_join(asked.select(F.col("id").alias("query_id"), F.col("rep").alias("query")), lists, ["query"])
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    found = pairs.select("query_id", F.posexplode(others).alias("at", "x"))
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
