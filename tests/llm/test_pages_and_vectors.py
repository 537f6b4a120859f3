import hashlib
import pathlib
import random
import re
import uuid

import numpy as np
import pytest
import xxhash

from barline.llm import ann, html, warc
from barline.llm.common import shared_dir
from tests.llm import brute
from tests.llm.conftest import prose


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- WARC


def expected_records(pages):
    groups = {}
    for i, _, h in pages:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in pages:
        data, top = (h or "").encode(), max((x for x in groups[h or ""] if x is not None), default=None)
        again = len(data) >= 1000 and top is not None and len(groups[h or ""]) > 1 and i != top
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return out


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(20)
    big = "<p>" + "x é " * 500
    magic = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abc<é\r\n ") for _ in range(rng.randrange(3000)))) for i in range(1, 60)]
    rows += [(100, "http://h/a b\nc", big), (101, None, big), (102, "u", big), (103, "u", "small"), (104, "u", "small"), (105, "u", None), (106, "u", ""), (None, "u", big), (None, None, "y" * 2000), (-7, "u", "neg")]
    rows += [(200, "u", magic * 40), (201, "u", "WARC/1.1\r\n" * 200), (202, "u", "tail\r\n\r\nWARC/1.1\r\n"), (203, "u", magic * 40)]
    return rows


def test_warc_round_trip(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    assert sorted(rows_of(warc.round_trip(df)), key=str) == sorted(expected_records(pages), key=str)


def test_warc_small_ranges_reject_magic_inside_payloads(spark, pages):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(df.coalesce(1)), path, records_per_file=20)
    files = warc.files_of(spark, path)
    found = warc.candidates(files, size=700).cache()
    kept = warc.reachable(found, files).cache()
    assert found.count() > kept.count() + 30
    assert sorted((r["page_id"] if r["page_id"] is not None else 0, r["payload_digest"]) for r in kept.collect()) == sorted((r[0] or 0, r[2]) for r in expected_records(pages))


def test_warc_headers_of_any_length_and_broken_chains(spark, monkeypatch):
    rows = [(1, "http://h/" + "x" * 70_000, "one"), (2, None, "two"), (3, "u", "three")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.plan_records(df.coalesce(1)), path)
    files = warc.files_of(spark, path)
    monkeypatch.setattr(warc, "AHEAD", 64)
    assert sorted(r["page_id"] for r in warc.reachable(warc.candidates(files, size=64), files).collect()) == [1, 2, 3]
    part = next(p for p in pathlib.Path(path.removeprefix("file:")).glob("part-*"))
    data = part.read_bytes()
    part.write_bytes(data[:-40] + b"?" * 40)  # the last record no longer ends as it should
    pathlib.Path(part.parent, f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="breaks off"):
        warc.read_archives(spark, path)


def test_warc_shared_payloads_by_join(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "GROUPS_AT_ONCE", 0)
    monkeypatch.setattr("barline.llm.common.DEALT", 2)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted(rows_of(warc.round_trip(df)), key=str) == sorted(expected_records(pages), key=str)


def test_chains_are_those_of_single_steps():
    rng = random.Random(25)
    for _ in range(200):
        places = sorted(rng.sample(range(60), 15))
        steps = {at: rng.choice([x for x in [*places, 7, 70, 75] if x > at] or [80]) for at in places}
        found = warc.chains(steps, 60)
        for at in places:
            way, x = [], at
            while x in steps:
                way.append(x)
                x = steps[x]
            assert found[at][0] == (x if x >= 60 else None)
            assert {y for y in places if found[y][1] <= found[at][1] < found[y][2]} == set(way)


def test_warc_odd_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, payload string, file long")
    assert warc.round_trip(empty).count() == 0
    same = spark.createDataFrame([(5, "u", "z" * 1500)] * 2 + [(4, "u", "z" * 1500)], "page_id long, url string, html string")
    assert sorted(r[3:] for r in rows_of(warc.round_trip(same))) == [("response", None), ("response", None), ("revisit", 5)]


# --- pages


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><!-- x > y --><div class="cookie-notice">We use cookies</div>
    <article class="post"><h1>A &amp; B</h1><p><b>First<br><p>Second   &#233;\n line</p><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table>
    <div class="share-buttons">Share</div><section id="comments"><p>Nice!</p></section><form>Mail<input></form><p>Last</article>
    <aside>Side</aside><footer>&copy; me</footer></body></html>"""
    assert html.Page(page).text(set()) == "A & B\nFirst\nSecond é line\none\ntwo\n1 2\n3\nLast"


@pytest.mark.parametrize("page, text", [("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<div>a <b>b</div> c", "a b\nc"), ("</p></div>x", "x"), ("<article><p>cut &am", "cut &am"), ("<script>never ends", ""), ("a < b > c", "a < b > c"), ("<main>in</main>out", "in")])
def test_broken_markup(page, text):
    assert html.Page(page).text(set()) == text


def test_site_templates_go_and_shared_articles_stay(spark):
    rng, rows = random.Random(21), []
    for i in range(40):
        body = "".join(f"<p>{rng.random()} words of page {i}</p>" for _ in range(3))
        rows.append((i, f"http://plain.example/{i}", f"<div>Home of plain</div><div>{body}</div><p>Made by us</p>"))
    story = "<article><h1>Story</h1><p>The same story on many pages.</p><div>Read more like this</div></article>"
    rows += [(100 + i, f"https://news.example:80/{i}", f"<div>top</div>{story}<div>{i}</div>") for i in range(30)]
    # that box can only be told from the story by other stories that have it
    rows += [(150 + i, f"https://news.example:80/more/{i}", f"<article><h1>Other</h1><p>{prose(rng, 20)}</p><div>Read more like this</div></article>") for i in range(30)]
    rows += [(200 + i, f"http://rare.example/{i}", "<div>Home of plain</div>x") for i in range(2)]
    found = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Home" not in found[i]["text"] and "Made" not in found[i]["text"] and found[i]["text"].count("\n") == 2 for i in range(40))
    assert all(found[100 + i]["text"] == "Story\nThe same story on many pages." for i in range(30))
    assert found[200]["text"] == "Home of plain\nx"
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_names_are_whole_words():
    """Words beside a mark that change its meaning, wrappers of the text, and named parts of a line."""
    assert html.Page('<div id="page" class="no-sidebar"><article><p>a<section id="related-work"><p>b</section><div class="header-image">c</div></article></div>').text(set()) == "a\nb\nc"
    assert html.Page('<div class="sidebar-right"><article><p>a</article></div>').text(set()) == "a"
    assert html.Page('<article><p>one <span class="ad">buy</span>two<p>three</article>').text(set()) == "one two\nthree"
    assert html.Page('<article><p>a<div class="share-buttons top">x</div><div class="site-footer">y</div><ul class="related-posts"><li>z</ul></article>').text(set()) == "a"


def plain_extract(pages, min_pages=html.MIN_PAGES, min_share=html.MIN_SHARE):
    """Text of each page, with subtrees counted by plain loops; uses the parser alone."""
    seen, parsed = {}, {}
    for _, url, text in pages:
        host = (re.match(r"[a-z]+://([^/:]*)", url or "") or [None, ""])[1]
        page = parsed.setdefault((host, text), html.Page(text or ""))
        kept = page.kept()
        shingles = {}
        for i in kept:
            words = page.blocks[i][0].split()
            shingles[i] = min([xxhash.xxh64_intdigest(f"{a} {b}") for a, b in zip(words, words[1:])] or [xxhash.xxh64_intdigest(words[0] + " ")])
        article = any(page.blocks[i][1] for i in kept)
        for digest, first, end, inside, prose in page.trees:
            if not (prose and inside and article):
                outside = sorted((i for i in kept if not first <= i < end), key=lambda i: (-len(page.blocks[i][0]), i))
                for rank in (0, 1):
                    around = shingles[outside[rank]] if rank < len(outside) else None
                    seen.setdefault((host, digest, rank), {}).setdefault(around, set()).add((host, text))
    found = {k[:2] for k, by in seen.items() if len(by) >= min_pages and len(by) >= min_share * sum(map(len, by.values()))}
    out = []
    for _, url, text in pages:
        host = (re.match(r"[a-z]+://([^/:]*)", url or "") or [None, ""])[1]
        page = parsed[host, text]
        kept = page.kept()
        article = any(page.blocks[i][1] for i in kept)
        gone = {i for digest, first, end, inside, prose in page.trees if (host, digest) in found and not (prose and inside and article) for i in range(first, end)}
        out.append("\n".join(page.blocks[i][0] for i in [i for i in kept if i not in gone] or kept))
    return out


@pytest.fixture(scope="module")
def site():
    rng, rows = random.Random(27), []
    notice = "<div><p>Please take note that this site will move to another place, and that all of its many pages move with it; a note of well over forty words, with paragraphs, that every page of the site has, so that no count of its words can tell it from text.</p></div>"
    box = "<div><a href=x>More from us</a> <a href=y>and from them</a></div>"
    for i in range(60):
        body = "".join(f"<p>{prose(rng, 30)}</p>" for _ in range(3))
        rows.append((i, f"http://plain.example/{i}", f"<div>Home of plain</div>{notice}<div>{body}</div>"))
        rows.append((100 + i, f"http://news.example/{i}", f"<h2>News</h2><article><h1>{i} {prose(rng, 3)}</h1>{body}{box}</article><div>end</div>"))
    copied = [f"<p>{prose(rng, 40)}</p>" for _ in range(6)]
    for i in range(40):  # near copies of one page without an article, and pages that are repeated whole
        near = list(copied)
        near[i % 6] = near[i % 6].replace("the", f"the{i}", 1)
        rows.append((200 + i, "http://copies.example/", "".join(near)))
        rows.append((300 + i, "http://same.example/", "<p>first</p><p>second</p><div>third</div>"))
    rows += [(400 + i, "http://shell.example/", f"<div>only this</div>{'<b>x</b>' * i}") for i in range(3)]
    rows += [(500 + i, "http://shell.example/", f"<div>only this</div><p>{prose(rng, 9)}</p>") for i in range(9)]
    return rows


def test_templates_decide_and_copies_stay(spark, site):
    df = spark.createDataFrame(site, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert all("Home" not in found[i] and "take note" not in found[i] and found[i].count("\n") == 2 for i in range(60))
    assert all("More from" not in found[100 + i] and found[100 + i].count("\n") == 3 for i in range(60))
    assert all(found[200 + i].count("\n") == 5 for i in range(40))
    assert all(found[300 + i] == "first\nsecond\nthird" for i in range(40))
    assert found[400] == "only this" and all("only" not in found[500 + i] for i in range(9))
    expected = dict(zip([r[0] for r in site], plain_extract(site)))
    assert found == expected
    # by joins, where the templates are too many for a broadcast
    assert {r["page_id"]: r["text"] for r in html.extract(df, templates_at_once=1).collect()} == expected


def test_page_odd_rows(spark):
    rows = [(1, None, None, 1), (2, "not a url", "<p>a", 2), (2, "not a url", "<p>a", 2), (None, "http://h", "", None), (3, "http://h", "<p>" + "word " * 100_000, 1)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int"))
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in found.collect()) == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 499_999)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- vectors


def as_dict(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()}


def clustered(rng, n):
    centres = rng.normal(size=(12, 16))
    return {i: np.round((centres[i % 12] + 0.3 * rng.normal(size=16)).astype(np.float32), 3) for i in range(n)}


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<float>")


def recall(found, exact):
    """Share of exact's entries whose score is found or beaten."""
    last, n, hits = {}, {}, {}
    for (q, _), (_, score) in exact.items():
        last[q] = min(score, last.get(q, score))
        n[q] = n.get(q, 0) + 1
    for (q, _), (_, score) in found.items():
        hits[q] = hits.get(q, 0) + (score >= last[q] - 1e-12)
    return sum(min(hits.get(q, 0), n[q]) for q in n) / sum(n.values())


def test_small_tables_and_deep_searches_are_exact(spark):
    rng = np.random.default_rng(22)
    for vectors, first in ((clustered(rng, 600), ann.FIRST), ({i: rng.normal(size=8).astype(np.float32) for i in range(700)}, ann.FIRST), (clustered(rng, 1500), 6000)):
        assert as_dict(ann.search(frame(spark, vectors), 5, 50, first=first)) == brute.nearest(vectors, 5, 50)


def test_copies_of_a_vector_count_by_their_ids(spark, monkeypatch):
    rng = np.random.default_rng(23)
    vectors = clustered(rng, 300) | {i: np.ones(16, np.float32) for i in range(300, 600)}
    assert as_dict(ann.search(frame(spark, vectors), 7, 20)) == brute.nearest(vectors, 7, 20)
    monkeypatch.setattr("barline.llm.common.DEALT", 4)  # the queries that are copies are joined in parts
    assert as_dict(ann.search(frame(spark, vectors), 7, 20)) == brute.nearest(vectors, 7, 20)


def test_curves_find_nine_of_ten_neighbours(spark, monkeypatch, n=5000):
    """Of clusters, of vectors without any, and of one tight cluster of a third of all rows; in several blocks."""
    rng = np.random.default_rng(24)
    monkeypatch.setattr(ann, "BLOCK", 2000)
    loose = {i: v.astype(np.float32) for i, v in enumerate(rng.normal(size=(n, 32)) / 6)}
    tight = loose | {i: (np.ones(32) / 6 + rng.normal(size=32) / 60).astype(np.float32) for i in range(0, n, 3)}
    for vectors in (clustered(rng, n), loose, tight):
        vectors = {i: (v / np.linalg.norm(v)).astype(np.float32) for i, v in vectors.items()}
        assert recall(as_dict(ann.search(frame(spark, vectors), 20, 300)), brute.nearest(vectors, 20, 300)) >= 0.9


def test_recall_and_share_on_the_embeddings(spark):
    """At sf0.1 the curves alone reach 0.9, comparing less than all rows; the share falls with the number of rows."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in rows.collect()}
    table, ids = np.array(list(vectors.values())), list(vectors)
    exact = {}
    for q in (i for i in ids if i % 20 == 0):
        score = table @ vectors[q]
        best = [k for k in np.argsort(-score)[:21] if ids[k] != q][:20]
        exact |= {(q, r): (ids[k], score[k]) for r, k in enumerate(best, 1)}
    found = {key: (i, score + 1e-9) for key, (i, score) in as_dict(ann.search(rows, 20, 20)).items()}
    assert recall(found, exact) >= 0.9
    compared = [ann.Plan(64, n).probes * 2 * ann.WINDOW + 2 * ann.Plan(64, n).own for n in (2000, 50_000, 10**9)]
    assert compared[0] / 2000 > 1.5 * compared[1] / 50_000 > 6 * compared[2] / 10**9


def test_probes_are_shifts_in_order_of_length():
    plan, rng = ann.Plan(16, 20_000), np.random.default_rng(26)
    spread = plan.spread(rng.normal(size=(5, 16)), 0)
    keys = plan.probe_keys(spread)
    assert keys.shape == (5, plan.probes) and (keys[:, 0] == plan.keys(spread)).all()
    assert all(len(set(row)) > 1 for row in keys.tolist())


def test_hilbert_curve_visits_every_cell_by_single_steps():
    bits, n = 3, 3
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1).T
    keys = ann.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(1 << bits * n))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, []), (40, [1.0, 2.0, 3.0]), (1, [2.0, 1.0]), (60, None)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<float>, size int, query_id string")
    found = as_dict(ann.search(df, 20, 20))
    assert found == {(0, 1): (1, 2.0), (0, 2): (20, 0.0), (20, 1): (1, 1.0), (20, 2): (0, 0.0), (40, 1): (7, 6.0)}
    assert ann.search(df.limit(0), 20, 20).count() == 0
