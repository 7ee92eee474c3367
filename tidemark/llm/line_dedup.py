"""Line dedup by content-defined chunks, on DataFrame operations alone.

A rolling hash over the hashes of ``ROLLED`` lines is taken at every line.  Windows whose hash repeats anywhere are compared
byte by byte with the first of their kind; touching windows that stood earlier make up a chunk, which is removed.  So a
chunk's boundaries are where repeated content begins and ends: they move with the lines around them, and no head or tail of
a repeated passage stays, as it does where texts are cut at chosen hashes first and whole chunks are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import salted_join, written

#: Lines of the rolling hash, the fewest that a chunk has.
ROLLED = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(text: Column) -> Column:
    """Array of ``(i, h, g)``: the first line of each window and two hashes of it.  Windows of empty lines are left out."""

    def hashed(lines: Column) -> Column:
        one, two = F.transform(lines, lambda x: F.xxhash64(x)), F.transform(lines, lambda x: F.crc32(x.cast("binary")))
        return _bound(F.struct(lines.alias("l"), one.alias("h"), two.alias("g")), rolled)

    def rolled(p: Column) -> Column:
        at = F.when(F.size(p["l"]) >= ROLLED, F.sequence(F.lit(0), F.size(p["l"]) - ROLLED)).otherwise(F.array().cast("array<int>"))
        said = lambda i: sum((F.length(F.get(p["l"], i + d)) for d in range(ROLLED)), F.lit(0)) > 0
        each = lambda i, a: [F.get(p[a], i + d) for d in range(ROLLED)]
        return F.transform(F.filter(at, said), lambda i: F.struct(i.alias("i"), F.xxhash64(*each(i, "h")).alias("h"), F.hash(*each(i, "g")).alias("g")))

    return _bound(_lines(text), hashed)


def _body(lines: Column, i: Column) -> Column:
    return F.concat_ws("\n", *[F.get(lines, i + d) for d in range(ROLLED)])


def _kept(lines: Column, gone: Column) -> Column:
    """``(text, cut)``: the lines without windows that start at ``gone`` (sorted), and how many were cut.  Linear in both."""

    def runs(p: Column) -> Column:
        g = p["g"]
        first = F.filter(g, lambda x, k: (k == 0) | (x > F.get(g, k - 1) + ROLLED))
        last = F.filter(g, lambda x, k: (k == F.size(g) - 1) | (F.get(g, k + 1) > x + ROLLED))
        return _bound(F.struct(p["l"].alias("l"), first.alias("a"), F.transform(last, lambda x: x + ROLLED).alias("b")), joined)

    def joined(p: Column) -> Column:
        begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(p["b"], k - 1))
        end = lambda k: F.when(k == F.size(p["a"]), F.size(p["l"])).otherwise(F.get(p["a"], k))
        between = F.filter(F.sequence(F.lit(0), F.size(p["a"])), lambda k: end(k) > begin(k))
        parts = F.transform(between, lambda k: F.array_join(F.slice(p["l"], begin(k) + 1, end(k) - begin(k)), "\n"))
        cut = F.aggregate(p["b"], F.lit(0), lambda s, x: s + x) - F.aggregate(p["a"], F.lit(0), lambda s, x: s + x)
        return F.struct(F.array_join(parts, "\n").alias("text"), cut.alias("cut"))

    return _bound(F.struct(lines.alias("l"), gone.alias("g")), runs)


def _row() -> Column:
    """All columns of a row in one value, which column pruning leaves whole: both joins read one exchange of the texts."""
    return F.get(F.reverse("_row"), F.lit(0))


def _cut(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_row, _text, _n, _gone)``: each row, its text without repeated chunks, its lines, and how many of them were cut."""
    text, key = _row()[text_col], ["_k1", "_k2"]
    who = F.when(docs[id_col].isNull(), F.xxhash64(F.monotonically_increasing_id(), F.lit(1))).otherwise(F.xxhash64(docs[id_col]))
    base = docs.select(F.array(F.struct(*docs.columns)).alias("_row"), who.alias("_k1"), F.xxhash64(docs[text_col]).alias("_k2"))
    own = base.select(_row()[id_col].alias("_id"), *key, text.alias("_text")).where(F.instr("_text", "\n") > 0)
    place = ["_last", "_id", "_k2", "_k1"]
    own = own.select(F.col("_id").isNull().alias("_last"), "_id", *key, F.explode(_windows(F.col("_text"))).alias("w"))
    slim = written(own.select(*place, "w.i", "w.h", "w.g"))
    first = slim.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct(*place, "i")).alias("f")).where("n > 1")
    first = written(first.select("h", "g", F.col("f._k1").alias("_a1"), F.col("f._k2").alias("_a2"), F.col("f.i").alias("_i")))
    asked = first.groupBy("_a1", "_a2").agg(F.collect_list(F.struct("_i", "h", "g")).alias("asked"))
    bodies = base.join(asked, (F.col("_k1") == F.col("_a1")) & (F.col("_k2") == F.col("_a2")), "left")
    # size() asks for the whole value, so that this join's exchange of the texts is the one that the last join reads again
    read = F.when(F.col("asked").isNotNull() & (F.size("_row") == 1), _bound(_lines(_row()[text_col]), lambda lines: F.transform("asked", lambda a: F.struct(a["h"].alias("h"), a["g"].alias("g"), a["_i"].alias("_i"), _body(lines, a["_i"]).alias("body")))))
    bodies = bodies.select("_a1", "_a2", F.explode_outer(read).alias("r")).where("r is not null").select("_a1", "_a2", "r.*").dropDuplicates(["h", "g"])
    later = salted_join(slim.select(*key, "i", "h", "g"), bodies, ["h", "g"]).where("_k1 != _a1 or _k2 != _a2 or i != _i")
    later = later.groupBy(F.col("_k1").alias("_o1"), F.col("_k2").alias("_o2")).agg(F.sort_array(F.collect_set(F.struct("i", "body"))).alias("later"))
    out = base.join(later, (F.col("_k1") == F.col("_o1")) & (F.col("_k2") == F.col("_o2")), "left")

    def cut(lines: Column) -> Column:
        return _kept(lines, F.transform(F.filter("later", lambda w: _body(lines, w["i"]) == w["body"]), lambda w: w["i"]))

    found = out.withColumn("_done", F.when(F.col("later").isNotNull(), _bound(_lines(text), cut)))
    return found.select(
        _row().alias("_row"),
        F.coalesce("_done.text", text).alias("_text"),
        F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1, F.lit(0)).alias("_n"),
        F.coalesce("_done.cut", F.lit(0)).alias("_gone"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated multi-line chunks cut from the text, and columns ``_lines``, ``_cut_lines`` (counts).

    A line goes if it is in a window of ``ROLLED`` lines that also starts earlier: in a row of smaller id, or before it in
    the same row.  Texts of one id are told apart and come in the order of a hash, so that it does not depend on the files;
    rows that repeat both id and text are one place and are cut alike; each row without an id is a place of its own, after
    all others.  Null and empty
    texts and texts of one line stay as they are (a null text has 0 lines), and so do windows of empty lines.  A text of
    which nothing stays becomes empty.  Very long texts take time in proportion to their lines.  Columns of ``docs`` that
    have the names of the two counts are replaced; an empty table gives no rows.
    """
    columns = [c for c in docs.columns if c not in ("_lines", "_cut_lines")]
    return _cut(docs, id_col, text_col).select(*[(F.col("_text") if c == text_col else F.col("_row")[c]).alias(c) for c in columns], F.col("_n").alias("_lines"), F.col("_gone").alias("_cut_lines"))


def keep_new_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks cut as by :func:`dedup_lines`; rows of which nothing is left go.

    A column ``n_chars`` follows the text where it was cut; all other columns, whatever their names, stay as they are.
    """
    out = _cut(docs, id_col, text_col).where((F.col("_gone") == 0) | (F.col("_text") != ""))
    columns = {c: F.col("_row")[c] for c in docs.columns} | {text_col: F.col("_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_gone") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[c.alias(name) for name, c in columns.items()])


ORACLE_SQL = """
WITH lines AS (
    SELECT doc_id, i, string_split(text, chr(10))[i] AS line
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), windows AS (
    SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM lines
), marked AS (
    SELECT *, after IS NOT NULL AND (line <> '' OR after <> '') AND row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) > 1 AS again FROM windows
), cut AS (
    SELECT *, again OR coalesce(lag(again) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS gone FROM marked
), kept AS (
    SELECT doc_id, count(*) AS lines, count(*) FILTER (gone) AS cut_lines, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
    FROM cut GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(k.lines, 0) AS BIGINT) AS lines, CAST(coalesce(k.cut_lines, 0) AS BIGINT) AS cut_lines,
       CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
