"""Small tests of the operators against plain versions, and of rows that are null, empty, repeated or long."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import queries as q
from tidemark.llm.ann import nearest
from tidemark.llm.decontaminate import Items, contaminated, keep_clean, matches, slots, template
from tidemark.llm.html_text import extract, main_text
from tidemark.llm.language_id import identify, keep_identified
from tidemark.llm.line_dedup import dedup_lines, keep_new_lines
from tidemark.llm.lm_scoring import lm_scores
from tidemark.llm.packing import best_fit, default_path, pack, tokenizer
from tidemark.llm.sharding import shard
from tidemark.llm.simhash import simhash_groups

SF = "/root/testdata/sf0.001"


# ---- 1: lines ----


def test_line_dedup_keeps_the_first_chunk(spark):
    rng = random.Random(1)
    line = lambda: "".join(rng.choices("abcdefgh ", k=30))
    shared = [line() for _ in range(40)]
    texts = {i: "\n".join([line() for _ in range(i)] + shared + [line()]) for i in range(4)}
    rows = [*texts.items(), (10, None), (11, ""), (12, "one line"), (13, "one line"), (None, texts[0]), (14, texts[0])]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, gone int, n_chars string")
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert got[0].text == texts[0] and got[0]._cut_lines == 0
    for i in (1, 2, 3):
        own = texts[i].split("\n")
        assert (got[i]._lines, got[i]._cut_lines) == (len(own), 40) and got[i].text.split("\n") == own[:i] + own[-1:]
    assert (got[10].text, got[10]._lines, got[11].text, got[12].text, got[13].text) == (None, 0, "", "one line", "one line")
    assert (got[None].text, got[None]._cut_lines) == (got[14].text, got[14]._cut_lines) == ("", 41)
    assert dedup_lines(docs.limit(0)).count() == 0
    assert set(keep_new_lines(docs).columns) == {"doc_id", "text", "gone", "n_chars"}


def plain_dedup(rows):
    """Texts after the cut, of rows in order."""
    seen, out = set(), []
    for t in rows:
        lines = [] if t is None else t.split("\n")
        gone = set()
        for i in range(len(lines) - 1):
            w = (lines[i], lines[i + 1])
            if w in seen:
                gone |= {i, i + 1}
            if any(w):
                seen.add(w)
        out.append((None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_line_dedup_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.HOT_PARTS", 8)
    rng = random.Random(2)
    texts = ["\n".join(rng.choices(["", "a", "b", "c c", "d", "é", "hot\nnotice"], weights=[2, 1, 1, 1, 1, 1, 3], k=rng.randint(0, 12))) for _ in range(150)]
    texts += ["same\n" * 40, None, "", "x\n" * 3 + "y", "\n\n\n", "\n".join(f"l{i % 70_000}" for i in range(100_000))]
    rows = [(i, t, 1, "q", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cut_lines int, _row string, `_key` int").repartition(5)
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert [(got[i].text, got[i]._cut_lines) for i in range(len(texts))] == plain_dedup(texts)
    kept = keep_new_lines(docs)
    assert kept.columns == docs.columns and {r._row for r in kept.collect()} == {"q"}


def test_line_dedup_cuts_by_row(spark):
    line = iter(f"line {i}" for i in range(1000))
    a, b = ("\n".join(next(line) for _ in range(40)) for _ in "ab")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (None, b + "\nmore"), (None, "more"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text or "", r._cut_lines) for r in dedup_lines(docs).collect())
    assert got == sorted([("1", a, 0), ("5", "", 40), ("5", b, 0), ("None", "more", 40), ("None", "more", 0), ("None", "", 0)])


# ---- 3: shards ----


@pytest.mark.parametrize("rows", [0, 1, 39, 700])
def test_shards_are_even_and_groups_whole(spark, rows):
    rng = random.Random(rows)
    texts = [rng.choice(["hot"] * 3 + [f"pair {i // 2}", f"own {i}", None]) for i in range(rows)]
    docs = spark.createDataFrame([(i // 2 if i % 50 == 0 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    got = shard(docs, 7).collect()
    assert len(got) == rows
    count = Counter(r.shard for r in got)
    assert not rows or max(count.values()) - min(count[s] for s in range(7)) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    where, drawn = defaultdict(Counter), defaultdict(Counter)
    for r, s in zip(got, rng.choices(range(7), k=rows), strict=True):
        where[r.text_crc32][r.shard] += 1
        drawn[r.text_crc32][s] += 1
    cut = lambda w: sum(sum(p.values()) ** 2 - sum(n * n for n in p.values()) for p in w.values() if sum(p.values()) <= rows // 7)
    assert cut(where) <= 0.1 * cut(drawn)  # links cut (each twice), of groups that fit in a shard
    for places in where.values():  # nearly all of a group is in as few shards as can hold it
        n = sum(places.values())
        least = max(1, -(-n // max(1, rows // 7)))
        assert sum(x for _, x in places.most_common(least)) >= (0.75 * n if n > rows // 14 else n)


# ---- 4: packing ----


def test_tokens_are_the_library_ones():
    own = tokenizer(default_path())
    rng = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCÉéßñüŒœſıİΣσς0123456789'’.,!?-_<|>&# \n\t　日本語한é‍👍\x1c"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(400)]
    plain = "abcdreslltvmABC''ÉéßàÿçÀ0123.,!?-_|>&# \n\t×÷\x00\x0b"
    texts += ["".join(rng.choices(plain, k=rng.randint(0, 60))) for _ in range(1500)] + ["don't DON'T 'tis 're'll'd 'S's ''s 5's's x'sun", "a'" * 50, "'", "'l", "'r", "×'s"]
    texts += ["", "it's we've I'll you'd don't", "<|endoftext|> x<|startoftext|>", "ÀÉÎ naïve straße", "a" * 300, "0123 4.5", "''s'sx", "éêeux ouionan. Ça"]
    want = [np.array(e.ids, "<u4").tobytes() for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert own.ids(texts) == want


def test_long_texts_are_taken_in_parts(monkeypatch):
    own = tokenizer(default_path())
    text = "Some words, it's 12 of them.  And\nmore " * 40 + "x" * 90 + " end"
    want = np.array(own.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for step in (7, 50, 10_000):
        monkeypatch.setattr("tidemark.llm.packing._STEP", step)
        assert own.ids([text, "a", text]) == [want, own.ids(["a"])[0], want]


def plain_best_fit(sizes, capacity):
    """Each item, largest first, to the fullest bin that holds it."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if sum(b) + s <= capacity]
        (max(fits, key=sum) if fits else bins.append([]) or bins[-1]).append(s)
    return sorted(sorted(b) for b in bins)


def test_best_fit_against_a_plain_version():
    rng = np.random.default_rng(9)
    for capacity, n in ((10, 30), (100, 120), (2048, 150)):
        sizes = rng.integers(1, capacity, n)
        bins, _, fill = best_fit(sizes, capacity)
        want = plain_best_fit(sizes.tolist(), capacity)
        assert sorted(fill.tolist()) == sorted(map(sum, want))


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    file = json.load(open(default_path(), encoding="utf-8"))
    file["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(file), encoding="utf-8")
    with pytest.raises(ValueError):
        tokenizer(str(tmp_path / "other.json"))


def test_best_fit_fills_exactly():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 2048, 3000)
    bins, offsets, fill = best_fit(sizes)
    assert (np.bincount(bins, weights=sizes) == fill).all() and fill.max() <= 2048
    spans = sorted(zip(bins.tolist(), offsets.tolist(), sizes.tolist(), strict=True))
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(spans, spans[1:], strict=False))
    assert len(fill) <= 1.01 * sizes.sum() / 2048 + 1


def test_packing_edge_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a " * 5000, 3), (3, "b", 4), (None, "c d", 5)] + [(10 + i, "x " * (i * 37 % 2000), 0) for i in range(300)], "doc_id long, text string, piece int")
    monkeypatch.setattr("tidemark.llm.packing.GROUP", 20)
    got = pack(docs).collect()
    assert {(r.doc_id, r.piece, r.start, r.length) for r in got if r.doc_id in (1, 2, 3)} == {(1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 2048), (3, 1, 2048, 2048), (3, 2, 4096, 905), (3, 0, 0, 2)}
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= 2048
    assert len(by) <= 1.1 * sum(r.length for r in got) / 2048 + 1
    assert pack(docs.limit(0)).count() == 0


# ---- 5: neighbours ----


def test_neighbours_against_all(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((800, 16)) * rng.uniform(0.5, 2, (800, 1))
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x.astype(np.float32).astype(float))]
    odd = [(900, None, 1), (920, [0.0] * 16, 1), (940, [float("nan")] * 16, 1), (960, [None] + [1.0] * 15, 1), (980, [1.0], 1), (None, [1.0] * 16, 1), rows[20], rows[20]]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in sorted(nearest(vectors, _every(20)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    x = x.astype(np.float32).astype(float)
    recall = []
    assert set(got) == set(range(0, 800, 20))
    for i, found in got.items():
        s = x @ x[i]
        s[i] = -np.inf
        want = set(np.lexsort((np.arange(800), -s))[:20].tolist())
        recall.append(len(want & {v for v, _, _ in found}) / 20)
        assert [r for _, _, r in found] == list(range(1, 21)) and all(abs(c - s[v]) < 1e-9 for v, c, _ in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert np.mean(recall) >= 0.9
    few = nearest(vectors.where("vec_id < 5 or vec_id in (100, 101, 102)"), _every(20)).collect()
    assert Counter(r.query_id for r in few) == {0: 7, 100: 7}
    assert nearest(vectors.limit(0), _every(20)).count() == 0


def test_candidates_are_a_smaller_share_of_more_rows():
    from tidemark.llm.ann import Hashes, _ranks, choose

    rng = np.random.default_rng(4)
    shares = []
    for n in (500, 5000, 50_000):
        x = rng.standard_normal((n, 12))
        x /= np.linalg.norm(x, axis=1)[:, None]
        queries = x[:40]
        order = [np.argsort(-(x @ q), kind="stable")[1:21] for q in queries]
        centre = x.mean(0)
        norm = float(np.linalg.norm(x - centre, axis=1).max())
        projections, width, probes, recall, _ = choose(queries, [x[o] for o in order], x[-4096:], centre, norm, n)
        hashes = Hashes(centre, norm, 4, projections, width)
        own, seen = hashes.own(x), hashes.probes(queries, probes)
        met = [_ranks(s, own) < probes for s in seen]
        assert recall >= 0.9 and np.mean([m[o].mean() for m, o in zip(met, order, strict=True)]) >= 0.9
        shares.append(float(np.mean(met)))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.3


def test_queries_whose_cells_hold_too_few_are_searched_whole(spark, monkeypatch):
    """Neighbours far from any sample: a cluster for the sample's choice, and a few vectors that point elsewhere."""
    monkeypatch.setattr("tidemark.llm.ann.LADDER", ((6, 0.15),))
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(nearest(rows, _every(20)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    for i in range(0, 400, 20):
        s = x @ x[i]
        s[i] = -np.inf
        assert got[i] == np.lexsort((np.arange(400), -s))[:20].tolist()


def test_one_vector_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.HOT_PARTS", 4)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 8)).astype(np.float32).astype(float)
    x[::3] = x[0]
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, h int").repartition(4)
    got = defaultdict(list)
    for r in sorted(nearest(rows, _every(20)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    for i in range(0, 900, 60):  # those of the common vector: all twenty others that come first are copies
        s = x @ x[i]
        s[i] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        assert got[i] == [(int(j), round(float(s[j]), 9)) for j in best]
    assert set(got) == set(range(0, 900, 20)) and all(len(v) == 20 for v in got.values())


def _every(n):
    from pyspark.sql import functions as F

    return F.col("id") % n == 0


# ---- 6: pages ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><!-- <p>no</p> -->
<header><a href="/">Site</a> Tag line, with commas, many</header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, to make this page better for all of us.</p></div>
<div id=content><h1>The  title &amp; more</h1><p>First <b>bold</b> paragraph, with commas, and
 some length to it so that it counts.<script>if (a < b) document.write("</p>")</script><p>Second, unclosed &eacute;&#8211;x <a href=y>link</a> text goes on and on, for a while.
<ul><li>item one<li>item two</ul><blockquote>Quoted, at some length, for the points that it gives.</blockquote></div>
<aside><p>Related, things, here, that are long enough to score well in points.</p></aside>
<form><p>Subscribe, now, please, to our newsletter and more of it</p><input></form>
<div id="comments"><p>Reader comment, which is long, and has commas, too.</p></div><footer>&copy; 2024</footer></body></html>"""


def test_the_article_alone(spark):
    text = extract(PAGE)
    assert text == (
        "The title & more\nFirst bold paragraph, with commas, and some length to it so that it counts.\n"
        "Second, unclosed é–x link text goes on and on, for a while.\nitem one\nitem two\nQuoted, at some length, for the points that it gives."
    )
    assert extract("") == extract("<p>") == "" and extract("just words") == "just words"
    assert extract("<article><p>short</p></article><div class=ad><p>long, long, long advert text that goes on</p></div>") == "short"
    assert extract("<" * 3000 + "<p a='" * 500) is not None
    assert extract("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"
    pages = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (2, None, "<p>x</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, main_text(pages).collect()), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (2, None, "x", 1)]
    assert main_text(pages.limit(0)).count() == 0


def test_containers_without_article():
    page = "<body><div class='site-header'>Name<ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div class='main has-sidebar'><h1>Title</h1>%s</div><div id=sidebar>Side, side, side and some more of it</div></body>"
    listed = "".join(f"<li>item {i}, which is long enough to count" for i in range(9))
    assert extract(page % f"<p>Intro.</p><ol>{listed}</ol><p>End.</p>").split("\n")[:2] == ["Title", "Intro."]
    two = "<div><p>First part, with some text, that is long enough.</p></div><div><p>Second part, with other text, long as well.</p></div>"
    assert extract(page % two).split("\n") == ["Title", "First part, with some text, that is long enough.", "Second part, with other text, long as well."]
    assert extract("<div class='post-header'><h1>T</h1></div><div class=post><p>Text, of the post, at some length for points.</p></div>").split("\n")[-1].startswith("Text")


def test_short_parts_beside_the_best_container_stay():
    long = "<p>The main part, which goes on for a while, with commas, and with enough said in it to be the best by far.</p>" * 4
    page = "<body><div class=menu><a href=1>Home</a></div><div class=page>%s</div><div class=footer>Bye.</div></body>"
    got = extract(page % f"<p>Short intro.</p>Bare words too.<div>{long}</div><p>Another.</p><div><p>A closing section of some length, with one comma</p><p>and its end.</p></div>Final words.<p><a href=2>More of this</a></p><div>Logo</div><div>© Them.</div>")
    lines = got.split("\n")
    assert lines[:2] == ["Short intro.", "Bare words too."] and lines[6:] == ["Another.", "A closing section of some length, with one comma", "and its end.", "Final words."]


def test_names_alone_do_not_decide_in_a_marked_article():
    page = (
        "<article><h1>T</h1><section class='related-work'><p>Others have, too.</p></section><div class='notice-of-motion'>Moved, and seconded.</div>"
        "<div class='search-results-we-found'>They were few.</div><div class='related-posts box'><p>Read this, too.</p></div><div class='share-buttons'>Share</div><div class=ad>Buy.</div>"
        "<div class='related-reading-tips'><a href=1>All of it a link</a></div><p>End.</p></article>"
    )
    assert extract(page).split("\n") == ["T", "Others have, too.", "Moved, and seconded.", "They were few.", "End."]


def test_deep_and_long_pages():
    deep = "<div>" * 400 + "<p>Deep down, there is, after all, a paragraph of some length to find here.</p>" + "</div>" * 400
    assert extract(f"<body><div class=nav>x</div>{deep}</body>").startswith("Deep down")
    many = "".join(f"<p>Paragraph {i}, with some text, that is long enough.</p>" for i in range(20_000))
    assert len(extract(f"<body><div>{many}</div></body>").split("\n")) == 20_000


def plain_points(html):
    """Texts of an unmarked page's best container by the rule as it is told: points halved at each ancestor, less the share in links."""
    import xml.etree.ElementTree as et

    root = et.fromstring(html)
    up = {c: p for p in root.iter() for c in p}
    score = Counter()
    for p in root.iter("p"):
        text, at, points = "".join(p.itertext()), up[p], 1.0
        points += text.count(",") + min(len(text) / 100, 3)
        while at is not None:
            score[at] += points
            at, points = up.get(at), points / 2
    linked = lambda n: sum(len("".join(a.itertext())) for a in n.iter("a")) / max(1, len("".join(n.itertext())))
    best = max((n for n in root.iter() if n in score), key=lambda n: score[n] * (1 - linked(n)))
    return ["".join(p.itertext()).strip() for p in best.iter("p")]


def test_best_container_against_plain_points():
    rng = random.Random(11)
    for _ in range(60):
        part = lambda: f"<p>{'word, ' * rng.randint(0, 6)}{'x' * rng.randint(30, 200)}.</p>"
        boxes = ["".join(part() for _ in range(rng.randint(1, 5))) for _ in range(3)]
        links = "".join(f"<p><a href='u'>{'link, ' * 4}</a></p>" for _ in range(rng.randint(1, 6)))
        page = f"<html><body><div><div>{boxes[0]}</div></div><ul>{links}</ul><div><section>{boxes[1]}</section></div><div>{links}</div><div>{boxes[2]}</div></body></html>"
        assert set(plain_points(page)) <= set(extract(page).split("\n"))


def test_unmarked_pages_of_the_tables(spark):
    """The tables' pages with the mark of their article taken away: nothing of it goes, nothing else comes."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    whole = 0
    for r in pages:
        plain = re.sub(r"<(/?)article>", r"<\1div>", r.html)
        whole += extract(plain) == extract(r.html)
    assert whole >= 0.95 * len(pages)


def test_pages_of_the_tables(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in q.op6_html_text(spark, SF).collect():
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        from html import unescape

        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


# ---- 7: benchmark ----

ITEM = "If a train leaves the town at 5 km per hour and another follows it after 3 hours, how far from the town do they meet at last?"


def test_reparameterised_questions():
    assert "\x01u" in template("it ran 5 km") and "\x01n" in template("page 12") and "\x01p" in template("then Anna Bell left")
    assert slots("then Anna Bell ran 5 km to 7") == ["anna bell", "5 km", "7"]
    items = Items([(1, ITEM), (2, "Short one here"), (3, "9 8 7 6 5 4 3 2 1 9 8 7 6 5 4 3 2")])
    assert matches(f"Well. {ITEM} Yes", items)[0][:1] == (1,)
    assert matches(ITEM.replace("5 km", "81 km").replace("3 hours", "12 hours").upper(), items)[0][0] == 1
    assert matches("that is a short one here, see", items) == [(2, 1, 3, 3)]
    assert [m[0] for m in matches("9 8 7 6 5 4 3 2 1 9 8 7 6 5 4 3 2", items)] == [3]  # numbers alone, word for word
    assert matches("9 8 7 6 5 4 3 2 1 9 8 7 6", items) == [(3, 1, 13, 17)] and matches("9 8 7 6 5 4 3 1 2 9 8 7 6", items) == []
    same = Items([(1, "first 5 apples and then 5 more apples on the table by the old wooden door of the house")])
    assert matches("first 6 apples and then 6 more apples on the table by the old wooden door of the house", same)
    other = matches("first 6 apples and then 7 more apples on the table by the old wooden door of the house", same)
    assert not other or other[0][1] < matches("first 6 apples and then 6 more apples on the table by the old wooden door of the house", same)[0][1]
    assert matches("a clean document about nothing in particular that nobody asked for, at length, with no leaks at all", items) == []


def test_windows_of_few_words_match_verbatim():
    dense = "Add 12, 7, 30, 41 and 5, 16, 28, 9 to 3, 11, 64 and 2"
    items = Items([(1, "What is 12 times 7?"), (2, dense), (3, ITEM)])
    assert [m[0] for m in matches("so: What is 12 times 7? It is 84", items)] == [1]
    assert [m[0] for m in matches(f"Now. {dense}.", items)] == [2]
    assert matches("so: What is 13 times 7? It is 91", items) == matches(dense.replace("30", "31").replace("28", "82"), items) == []


def test_names_do_not_depend_on_what_stands_before():
    planet = "Which planet has rings that are seen from far away?"
    apples = "Tom has 5 apples in a basket. Tom gives away 2 of them to a friend. Tom eats what is left over. Tom sleeps."
    short = "If Tom has 5 apples and eats 2, how many are left?"
    items = Items([(1, planet), (2, apples), (3, short)])
    for before in ("He asked ", "well, ", "He asked: ", "one; ", "Then Anna Bell asked Question ", ""):
        for i, t in enumerate((planet, apples, short), 1):
            assert i in [m[0] for m in matches(before + t, items)], (before, t)
    assert [m[0] for m in matches(apples.replace("Tom", "Sue").replace("5", "9"), items)] == [2]
    assert [m[0] for m in matches("He asked If Ann has 7 apples and eats 3, how many are left?", items)] == [3]
    mixed = "Tom has 5 apples and Bob has pears. Tom gives away two of them."
    assert not matches("Sue has 5 apples and Sue has pears. Sue gives away two of them.", Items([(1, mixed)]))


def test_texts_are_passed_over_only_without_a_match():
    rng = random.Random(4)
    vocabulary = "Tom Ann the a to İx ΑΣ σ has 5 7 km km_ 12 , . ; which Which zzz yy _ x_ l’été a×b Élan élan été ÿ été\u00a0ß 5kg x²".split(" ")
    for _ in range(2000):
        items = Items([(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 6)))) for i in range(3)])
        text = " ".join(rng.choices(vocabulary, k=30))
        found = [m[0] for m in matches(text, items)]
        items.filter.parts = lambda ts: [t.decode() for t in ts]
        assert [m[0] for m in matches(text, items)] == found


def test_arithmetic_is_found_word_for_word():
    sums = "Compute 12 + 7 * 9 - 4 / 3 + 8 - 2 and then 6 + 5 * 3 over 11 plus 9 minus 4"
    items = Items([(1, "What is 12 times 7?"), (2, sums)])
    assert [m[0] for m in matches(f"It says 5. {sums}. Good", items)] == [2]
    assert matches(sums.replace("+", "-"), items) == matches("What is 12 times 8?", items) == []


def plain_windows(text):
    """All windows of all readings, with their values."""
    from tidemark.llm.decontaminate import readings

    out = []
    for reading, toks in readings(text):
        values, at = slots(text, reading), 0
        own = [(t, (at := at + 1) and values[at - 1]) if t[0] == "\x01" else (t, None) for t in toks]
        out += [(i, own[i : i + min(13, len(own))]) for i in range(max(0, len(own) - 13) + 1) if own]
    return out


def plain_same(a, b):
    if [t for t, _ in a] != [t for t, _ in b]:
        return False
    if sum(t[0].isalnum() for t, _ in a) < min(7, len(a)):
        return a == b
    pairs = {(t, x, y) for (t, x), (_, y) in zip(a, b, strict=True) if t[0] == "\x01"}
    return len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs})


def test_leaks_against_all_windows(spark):
    rng = random.Random(6)
    vocabulary = "Tom Ann Bob the a to of has 5 7 9 km 3km + - , . ; which Which is times ate them".split(" ")
    sentence = lambda k: " ".join(rng.choices(vocabulary, k=k))
    items = [(i if i % 5 else None, sentence(rng.choice([3, 8, 13, 16, 25]))) for i in range(40)]
    texts = []
    for i in range(120):
        leak = rng.choice(items)[1].split(" ")
        change = rng.choice([{}, {"5": "8", "Tom": "Sue"}, {"5": "7"}, {"Ann": "Bob"}, {"+": "-"}])
        texts.append((i, f"{sentence(rng.randint(0, 9))} {' '.join(change.get(w, w) for w in leak)} {sentence(rng.randint(0, 9))}", "x"))
    want = {d for d, t, _ in texts if any(len(a) == len(b) and plain_same(a, b) for _, i in items for _, a in plain_windows(i) for size in {len(a)} for b in _cut(t, size))}
    docs = spark.createDataFrame(texts, "doc_id long, text string, th string")
    found = contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == want and 0 < len(want) < 120
    assert {r.doc_id for r in keep_clean(docs, spark.createDataFrame(items, "item_id long, text string")).collect()} == set(range(120)) - want


def _cut(text, size):
    from tidemark.llm.decontaminate import readings

    for reading, toks in readings(text):
        values, at = slots(text, reading), 0
        own = [(t, (at := at + 1) and values[at - 1]) if t[0] == "\x01" else (t, None) for t in toks]
        for i in range(len(own) - size + 1):
            yield own[i : i + size]


def test_hot_and_odd_rows_of_decontamination(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.HOT_PARTS", 4)
    docs = [(i, f"note {i}. {ITEM}", 1, 2) for i in range(300)] + [(None, ITEM, 1, 2), (5, "other", 1, 2), (900, "word " * 300_000 + ITEM, 1, 2), (901, "\x01n 5 \x01p", 1, 2)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, _salt int, doc_ID2 int").repartition(3)
    bench = spark.createDataFrame([(None, ITEM, 0), (3, "\x01u and \x01n", 0), (2, "", 0)], "item_id long, text string, windows int")
    found = contaminated(docs, bench).collect()
    assert len(found) == 302 and {r.item_id for r in found} == {None} and {r.windows for r in found} == {found[0].windows}
    kept = keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text[:5]) for r in kept.collect()) == [(5, "other"), (901, "\x01n 5 ")]


def test_leaks_in_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts, items = docs.collect(), bench.collect()
    want = {(d.doc_id, b.item_id) for d in texts for b in items if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert want <= got
    kept = {r.doc_id for r in keep_clean(docs, bench).collect()}
    assert kept == {d.doc_id for d in texts} - {d for d, _ in got}
    rows = spark.createDataFrame([(1, None), (2, ""), (None, ITEM), (3, ITEM), (3, ITEM)], "doc_id long, text string")
    own = spark.createDataFrame([(7, ITEM), (8, None), (None, ITEM), (9, "")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in contaminated(rows, own).collect()) == ["3", "3", "None"]
    assert contaminated(rows, own.limit(0)).count() == contaminated(rows.limit(0), own).count() == 0


# ---- 8: languages ----


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = identify(docs).collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) >= 0.98 and all(0 <= r.score <= 1 for r in got)


def test_language_edge_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1), (3, "der hund und die katze", "de", 2), (4, None, "en", 3), (5, "12 34", "en", 4), (6, "", None, 5), (7, "the the", None, 6), (None, "die und der", "de", 7), (8, "x", "de", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs).collect()}
    assert got[4] == got[5] == got[6] == ("und", 0.0) and got[7][0] == "en" and got[None][0] == "de"
    assert {r.doc_id for r in keep_identified(docs).collect()} == {1, 3, 7, 8, None}
    assert {r.lang_pred for r in identify(docs.where("lang is null")).collect()} == {"und"}
    assert identify(docs.limit(0)).count() == 0


def test_only_texts_in_a_wanted_language_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9000 + i, "".join(chr(0x4E00 + random.Random(i).randrange(3000)) for _ in range(500)), None) for i in range(20)] + [(9100, None, None), (9101, "12 %", None)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("score", docs.doc_id)
    kept = keep_identified(rows)
    assert kept.columns == rows.columns
    ids, lang = {r.doc_id for r in kept.collect()}, {r.doc_id: r.lang_pred for r in identify(rows).collect()}
    assert len([i for i in ids if i >= 9000]) <= 2 and len([i for i in ids if i < 9000]) >= 0.99 * docs.count()
    assert {r.doc_id for r in keep_identified(rows, wanted=["en"]).collect()} == {i for i in ids if lang[i] == "en"}


def test_language_sums_against_letters(spark):
    """The bundle of a text is the sum of its bound trigrams, one by one."""
    from tidemark.llm import language_id as m

    text = "Ab cé, ßtraße x"
    want = np.zeros(m.DIMENSIONS)
    a, b, c = m._letters(m.DIMENSIONS)
    symbols = [0, *[int(m._symbols()[ord(x)]) for x in text], 0]
    for x, y, z in zip(symbols, symbols[1:], symbols[2:], strict=False):
        want += a[x].astype(float) * b[y] * c[z] if y else 0
    assert np.array_equal(m.bundles([text.encode()], np.array([0]), 1)[0], want)


# ---- 10: language model ----


def test_scores_against_plain_counts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [*map(tuple, docs), (9001, None), (9002, "  "), (9003, "Zzz\x0bzzz\x1cq unseen")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for i, t in rows}
    count = Counter(w for i, ws in words.items() if crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in q.op10_lm_score(spark, str(tmp_path)).collect()}
    assert set(got) == set(words)
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc32(str(i).encode()) % 10 == 0, len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def small_model(seed):
    from tidemark.llm import lm_scoring as m

    rng = random.Random(seed)
    shape = m.Shape(3)
    vocabulary = [bytes(rng.choices(b"abcdef", k=rng.randint(1, 5))) for _ in range(900)]
    count = Counter(rng.choices(vocabulary, k=6000))
    count[m._END] = 40
    top = sorted(count.items(), key=lambda x: (-x[1], x[0]))[: shape.top]
    sums, kinds = np.zeros(m.ENDING_CLASSES), np.zeros(m.ENDING_CLASSES)
    for w, c in count.items():
        if w != m._END:
            sums[m.ending_class(w)] += c
            kinds[m.ending_class(w)] += 1
    model = m.untrained(shape, top, sums, kinds)
    noise = np.random.default_rng(1)
    model.class_weights += noise.normal(0, 1, model.class_weights.shape).astype(np.float32)
    model.word_weights += noise.normal(0, 1, model.word_weights.shape).astype(np.float32)
    return m, model, count


def test_probabilities_sum_to_one(spark):
    m, model, count = small_model(8)
    total = 0.0
    unseen = [(model.shape.top + e, 0) for e in range(m.ENDING_CLASSES)]  # one unknown word for each ending
    for symbol, c in [(model.symbol(w), c) for w, c in count.items()] + unseen:
        tokens = m.Tokens(model.shape, np.array([3, model.shape.top + 2, symbol]), np.array([0]))
        total += 10 ** m.score(model, tokens, m.rare_share(model, np.array([3, model.shape.top + 2, symbol]), np.array([5, 1, c])))[2]
    assert total == pytest.approx(1, abs=1e-4)


def test_gradient_against_plain_sums(spark):
    """Expected and observed sums token by token, and scores of one token at a time."""
    m, model, _ = small_model(9)
    shape, rng = model.shape, np.random.default_rng(3)
    docs = [rng.integers(0, shape.start, n) for n in (1, 2, 7, 60)]
    flat, first = np.concatenate(docs), np.cumsum([0, 1, 2, 7])
    tokens = m.Tokens(shape, flat, first)
    for kind, (before, after, n) in enumerate(((tokens.history, tokens.group, shape.width), (tokens.inner, tokens.word, m.IN_CLASS))):
        codes, counts = np.unique(before * n + after, return_counts=True)
        want = {True: np.zeros((shape.rows, n)), False: np.zeros((shape.rows, n))}
        for h, a in zip(before.tolist(), after.tolist(), strict=True):
            h = np.array([h])
            p = np.exp((m.class_log if kind == 0 else m.word_log)(model, h))[0]
            for r in m.class_rows(shape, h) if kind == 0 else [m.word_rows(shape, h)]:
                want[True][r[0], a] += 1
                want[False][r[0]] += p
        for observed in (True, False):
            assert np.allclose(m.sums(model, kind, codes, counts, observed), want[observed], atol=1e-5)
    per = m.score(model, tokens, np.zeros(len(flat)))
    for d, at in zip(docs, first, strict=True):
        history = [shape.start, shape.start, *d]
        for i, x in enumerate(d):
            h = np.array([history[i + 1] * shape.symbols + history[i]])
            group = x // m.IN_CLASS if x < shape.top else x - shape.top + shape.classes
            want = m.class_log(model, h)[0, group]
            if x < shape.top:
                want += m.word_log(model, np.array([history[i + 1] * shape.classes + group]))[0, x % m.IN_CLASS]
            assert per[at + i] == pytest.approx(want / np.log(10), abs=1e-5)


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = [{r.doc_id: r for r in lm_scores(docs.repartition(n)).collect()} for n in (1, 8, 64)]
    for i, r in found[0].items():
        assert all(f[i].score == pytest.approx(r.score, rel=1e-9, abs=1e-6) for f in found[1:])
    out = [r for r in found[0].values() if r.held_out]
    assert (sum(r.score for r in out) - sum(r.base_score for r in out)) / sum(r.n_tokens for r in out) >= 0.09


def test_model_grows_with_the_corpus():
    from tidemark.llm.lm_scoring import shape_for

    assert [shape_for(n).classes for n in (0, 7_999_999, 8_000_000, 32_000_000, 10**12)] == [16, 16, 32, 64, 128]
    most = shape_for(10**12)
    assert most.symbols < 1 << 16 and most.symbols**2 * most.width < 1 << 32  # as symbols and codes are kept


def test_lm_edge_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (0, "a b", 2), (0, "a b", 2)], "doc_id long, text string, score int")
    got = lm_scores(docs).collect()
    assert len(got) == 3 and len({r.score for r in got if r.doc_id == 0}) == 1
    assert lm_scores(docs.limit(0)).count() == 0
    alone = next(i for i in range(100) if crc32(str(i).encode()) % 10 == 0)
    r = lm_scores(spark.createDataFrame([(alone, "x y")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and r.score <= 0


def test_very_long_texts_and_ties(spark):
    """Texts of megabytes beside short ones; words of equal count, equal cosines, repeated ids."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(500)]
    long = " ".join(rng.choices(vocabulary, k=400_000))
    rows = [(1, long, "en"), (2, long[: len(long) // 2], "en"), (2, "b a", "en"), (3, "a b", "de"), (11, "a b", "en"), (None, long, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, held_out int").repartition(3)
    scored = sorted(lm_scores(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    assert [r.n_tokens for r in scored] == [400_001, 3, len(long[: len(long) // 2].split()) + 1, 3, 3, 400_001]
    assert scored[0].score == pytest.approx(scored[-1].score) and scored[3].score == pytest.approx(scored[4].score)
    told = identify(docs).collect()
    assert len(told) == 6 and len({(r.lang_pred, round(r.score, 9)) for r in told if r.doc_id in (3, 11)}) == 1
    kept = simhash_groups(docs).collect()
    assert {str(r.component_id) for r in kept if r.doc_id in (1, None)} == {"1"} and len({r.fp for r in kept if r.doc_id in (1, None)}) == 1
    packed = pack(docs).collect()
    assert sum(r.length for r in packed if r.doc_id == 1) == sum(r.length for r in packed if r.doc_id is None)
    sizes = {(r.doc_id, r.size) for r in shard(docs, 3).collect()}
    assert (1, len(long) + 16) in sizes and len(sizes) == 6


# ---- the pipeline ----


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.schema == docs.schema or set(kept.columns) == set(docs.columns), name
        assert 0 < kept.count() <= before.count()
    packed = p.packing(spark, kept, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}
    whole = p.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in whole} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed}
