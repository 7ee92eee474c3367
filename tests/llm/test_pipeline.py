"""The whole pipeline against a plain version, on the smallest tables."""

from zlib import crc32

import numpy as np
from pyspark.sql import functions as F
from test_operators import plain_dedup

import corpus_pipeline as p
from tidemark.llm.decontaminate import LEAST_WORDS, WINDOW, template
from tidemark.llm.packing import default_path, tokenizer
from tidemark.llm.simhash import _majority, bits_apart, shingle_hashes

SF = "/root/testdata/sf0.001"


def plain_lines(rows):
    rows = sorted(rows)
    return [(i, kept) for (i, t), (kept, cut) in zip(rows, plain_dedup([t for _, t in rows]), strict=True) if kept or not cut]


def plain_near(rows):
    """The smallest id of each group of texts whose fingerprints of 256 bits are as near as a similarity of 0.8 makes them."""
    fps = [(i, int.from_bytes(_majority(shingle_hashes(t.encode(), 5), 4).tobytes(), "little")) for i, t in rows]
    own = {i: i for i, _ in fps}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if (a ^ b).bit_count() <= bits_apart(0.8) and root(i) != root(j):
                own[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in fps}


def plain_windows(text):
    toks = template(text)
    return {tuple(toks[i : i + min(WINDOW, len(toks))]) for i in range(max(1, len(toks) - WINDOW + 1))}


def test_against_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t)]
    rows = plain_lines(rows)
    own = plain_near(rows)
    rows = [(i, t) for i, t in rows if own[i] == i]
    leaks = {w for t in items for w in plain_windows(t) if sum(x[0] != "\x01" for x in w) >= min(LEAST_WORDS, len(w))}
    rows = [(i, t) for i, t in rows if not leaks & plain_windows(t)]
    want = set()
    for i, t in rows:
        ids = [*tokenizer(default_path()).library.encode(t, add_special_tokens=False).ids, 0]
        want |= {(i, k, a, len(ids[a : a + 2048]), crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    got = p.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    whole = len({r.sequence_id for r in got})
    assert whole <= 1.05 * sum(r.length for r in got) / 2048 + 1


def test_stages_with_odd_rows(spark):
    """Clashing names, null ids and texts, repeated ids and rows, long texts, ties; then an empty table."""
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    odd = ["_key", "_row", "_id", "_of", "_lines", "_cut_lines", "_gone", "_text", "stays", "th", "row", "first", "node", "best", "doc_id_", "lang_pred", "score", "_salt"]
    rows = plain.limit(60)
    a, b = plain.where("length(text) > 400").orderBy("doc_id").select("text").limit(2).collect()
    own = [(5, a.text, "en", "s", 1), (5, b.text, "en", "s", 2), (None, a.text, "en", "s", 3), (None, None, None, None, None), (8, None, "en", "s", 0), (8, "", "en", "s", 0), (8, "", "en", "s", 0), (9, "word " * 200_000, "en", "s", 1_000_000)]
    rows = rows.unionByName(spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(plain.schema[c].dataType).alias(c) for c in plain.columns]))
    for i, name in enumerate(odd):
        rows = rows.withColumn(name, F.lit(i))
    rows = rows.repartition(3)
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, rows, SF)
        found = kept.collect()
        assert kept.columns == rows.columns and 0 < len(found) <= 68, name
        assert all(r[c] == i for r in found for i, c in enumerate(odd)), name
        assert stage(spark, rows.limit(0), SF).count() == 0, name
    texts = {(r.doc_id, r.text) for r in p.line_dedup(spark, rows, SF).collect()}
    assert (8, None) in texts and (8, "") in texts
    assert sorted(str(r.doc_id) for r in p.near_dedup(spark, spark.createDataFrame(own[:3], "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()) == ["5", "5"]
    assert p.packing(spark, rows, SF).where("doc_id = 9").count() > 50 and p.packing(spark, rows.limit(0), SF).count() == 0
