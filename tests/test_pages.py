"""Recognised pages to documents: the reference's cases, as rows."""

import json

import pytest

from inkglass.functions.markup import parse_markup, to_markup
from inkglass.operators import blocks, documents, pages
from inkglass.sinks import render


def line(text, y, size=12.0, x=20.0, conf=95.0, block=1, confs=None):
    words, at, y = [], float(x), float(y)
    for i, w in enumerate(text.split(" ")):
        c = confs[i] if confs else conf
        width = len(w) * size * 0.6
        box = {"x0": at, "y0": y, "x1": at + width, "y1": y + size}
        words.append({"text": w, "confidence": c, "bbox": box, "symbols": [{"text": "H", "bbox": box}]})
        at += width + size * 0.6
    return {"block": block, "para": block, "text": text, "confidence": conf, "bbox": {"x0": float(x), "y0": y, "x1": at - size * 0.6, "y1": y + size}, "words": words}


def page(lines, name="a.png", h=1000, w=1000):
    return {"page": 0, "file_name": name, "img_w": w, "img_h": h, "lines": lines}


@pytest.mark.parametrize(
    ("text", "kind", "checked"),
    [("[x] Done thing", "check", True), ("[1 Open thing", "check", False), ("☐ Open", "check", False), ("2. Second", "ordered", None), ("« Old bicycle", "bullet", None), ("e Box of books", "bullet", None), ("e.g. not a bullet", "text", None), ("Time: 9:00", "field", None), ("https://example.com", "text", None)],
)
def test_line_classes(text, kind, checked):
    got = pages.classify_line(text)
    assert got["kind"] == kind and got.get("checked") == checked


def test_weak_words_are_cut():
    assert pages.read_line(line("View the recipe xq", 100, confs=[95, 90, 92, 20]), 0, 1000, 1000, True, set()).text == "View the recipe"
    assert pages.read_line(line("zzqp mmk", 100, confs=[11, 30]), 0, 1000, 1000, True, set()) is None
    assert pages.read_line(line("| will come", 100), 0, 1000, 1000, True, set()).text == "I will come"


def test_chrome_is_left_out():
    p = page([line("9:41 5G 87%", 10), line("@ ~ |", 200), line("One real line here", 300)], h=900, w=400)
    doc = blocks.organize([p])
    assert blocks.block_texts(doc["sections"][0]["blocks"]) + [doc["sections"][0]["title"]] in (["One real line here", "Screenshot 1"], ["One real line here", "One real line here"])


def test_structure():
    rows = [line("Weekend Plans", 40, 24), line("Saturday", 90, 17), line("• Farmers market", 120), line("• Lunch at noon", 140), line("Notes", 180, 17), line("Time: 9:00", 215)]
    doc = blocks.organize([page(rows)])
    s = doc["sections"][0]
    assert s["title"] == "Weekend Plans" and doc["title"] == "Weekend Plans"
    assert [b["type"] for b in s["blocks"]] == ["heading", "list", "heading", "fields"]


def test_scrolled_pages_are_joined():
    texts = [f"Sentence number {k} of the long scrolled page {'abcdefghi'[k]}" for k in range(9)]
    one = page([line(texts[k], 100 + 40 * (k - 3), block=k) for k in range(3, 9)], "b.png")
    two = page([line(texts[k], 100 + 40 * k, block=k) for k in range(7)], "a.png")
    doc = blocks.organize([one, two])
    assert len(doc["sections"]) == 1 and doc["sections"][0]["source_files"] == ["a.png", "b.png"]
    whole = " ".join([doc["sections"][0]["title"], *blocks.block_texts(doc["sections"][0]["blocks"])])
    assert all(whole.count(f"Sentence number {k} ") <= 2 for k in range(9)) and all(f"number {k} " in whole for k in range(9))
    apart = blocks.organize([one, two], remove_overlap=False)
    assert len(apart["sections"]) == 2


def test_chat():
    rows = [line("Jamie Diaz", 180, x=530), line("Hi there friend", 300, x=40, block=1), line("how are you", 320, x=40, block=1), line("Very well thanks", 420, x=900, block=2), line("Dinner tonight then", 520, x=40, block=3), line("Sounds great to me", 620, x=880, block=4), line("See you", 720, x=1020, block=5)]
    doc = blocks.organize([page(rows, w=1170, h=2500)])
    s = doc["sections"][0]
    assert s["title"] == "Conversation with Jamie Diaz"
    items = s["blocks"][0]["items"]
    assert items[0] == {"label": "Jamie Diaz", "value": "Hi there friend how are you"} and len(items) == 5


def test_overlays_by_join(spark):
    def screen(doc, n, words):
        return {"doc": doc, "page": n, "file_name": f"{n}.png", "img_w": 1080, "img_h": 2400, "lines": [line(t, y, x=x) | {"block": k} for k, (t, x, y) in enumerate(words)]}

    rows = [screen("d", 0, [("Follow", 500, 100), ("alpha beta gamma delta", 40, 700), ("epsilon zeta", 40, 900)]), screen("d", 1, [("Follow", 500, 100), ("other words entirely now", 40, 700), ("and more", 40, 1100)])]
    df = spark.createDataFrame(rows, pages.PAGE_SCHEMA)
    assert sorted(map(tuple, pages.overlay_words(pages.words_of(df)).collect())) == [("d", 0, 0, 0), ("d", 1, 0, 0)]
    doc = json.loads(documents.organize(df).first().json)
    assert "Follow" not in json.dumps(doc["sections"])


def test_empty_and_null_pages(spark):
    df = spark.createDataFrame([("d", 0, None, None, None, None), ("e", 0, "x", 10, 10, [])], pages.PAGE_SCHEMA)
    assert {r.doc for r in documents.organize(df).collect()} == {"d", "e"}
    assert documents.organize(df.limit(0)).count() == 0


def test_components(spark):
    from inkglass.operators.pages import link_components

    nodes = spark.range(60).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 49)] + [(55, 52)], "i long, j long")
    got = {r.node: r.component for r in link_components(nodes, links).collect()}
    assert {got[i] for i in range(50)} == {0} and got[55] == got[52] == 52 and got[59] == 59


DOC = {
    "title": "My *Notes*", "created": "2026-03-01", "word_count": 9, "screenshots": 2,
    "highlights": [{"key": "emails", "label": "Email addresses", "items": [{"value": "a@b.com", "sources": [0]}]}],
    "sections": [
        {"title": "First", "source_files": ["a.png"], "blocks": [{"type": "heading", "level": 1, "text": "Head"}, {"type": "paragraph", "text": "see www.x.com now"}, {"type": "list", "style": "checklist", "items": [{"text": "t", "checked": True}]}, {"type": "list", "style": "ordered", "items": [{"text": "n", "number": 3}]}, {"type": "fields", "items": [{"label": "L", "value": "V"}]}]},
        {"title": "Second", "source_files": [], "blocks": []},
    ],
}


def test_renderers(spark):
    md, txt, web = render.to_markdown(DOC), render.to_text(DOC), render.to_html(DOC)
    assert "# My \\*Notes\\*" in md and "- [x] t" in md and "3. n" in md and "- **L:** V" in md and "_No text was found" in md and "from 2 screenshots · 9 words" in md
    assert "MY *NOTES*\n==========" in txt and "  [x] t" in txt and "1. First\n--------" in txt
    assert '<a href="https://www.x.com">www.x.com</a>' in web and '<ol start="3">' in web and "mailto:a@b.com" in web
    import io
    import zipfile

    rows = spark.createDataFrame([("d", json.dumps(DOC))], "doc string, json string")
    data = bytes(render.rendered(rows, "docx").first().content)
    assert "checklist" not in zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode() and b"PK" == data[:2]


def test_write(spark, tmp_path):
    rows = spark.createDataFrame([("d1", json.dumps(DOC)), ("d2", json.dumps(DOC))], "doc string, json string")
    assert render.write(rows, "md", str(tmp_path)) == 2 and (tmp_path / "d1.md").read_text().startswith("# My")


def test_markup_round_trip():
    b = [{"type": "heading", "level": 2, "text": "H"}, {"type": "list", "style": "checklist", "items": [{"text": "a", "checked": True}, {"text": "b", "checked": False}]}, {"type": "list", "style": "ordered", "items": [{"text": "c", "number": 2}]}, {"type": "fields", "items": [{"label": "Time", "value": "9:00"}]}, {"type": "paragraph", "text": "plain words"}]
    assert parse_markup(to_markup(b)) == b and parse_markup(None) == []


def test_details_document():
    p = page([line("naca . com — Private", 100, conf=90), line("Some words that are not a link", 200)], "reel.png")
    doc = blocks.extract_details([p], kinds=("links",), keywords=("words",))
    assert doc["sections"][0]["blocks"][0]["items"] == [{"text": "naca.com  (found in: reel.png)"}]
    assert doc["sections"][1]["title"] == 'Mentions of "words"' and len(doc["sections"][1]["blocks"][0]["items"]) == 1


def test_files_are_whole_documents(spark, tmp_path):
    """A page that goes on over the eighth page is one section of one document."""
    from inkglass import queries

    shared = [f"shared sentence number {w} of the long page" for w in ("one", "two", "three", "four")]
    rows = []
    for p in range(1, 12):
        texts = [f"{chr(96 + p) * 3}{k} {chr(97 + p) * 9} own words of this page" for k in range(6)]
        texts = texts + shared if p == 7 else shared + texts if p == 8 else texts
        for k, t in enumerate(texts):
            rows.append((100 * p + k, 5, p, 0, 0, k, t, 90.0, (40.0, 200.0 + 60 * k, 900.0, 240.0 + 60 * k), 1240, 1754))
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame(rows, f"line_id long, file_id long, page int, block int, para int, line_no int, text string, confidence double, bbox {box}, img_w int, img_h int")
    df.write.parquet(f"{tmp_path}/ocr_line.parquet")
    (row,) = queries.organized_documents(spark, str(tmp_path)).collect()
    doc = json.loads(row.json)
    assert row.doc == "5" and doc["screenshots"] == 11
    together = next(s for s in doc["sections"] if "page 8" in s["source_files"])
    assert together["source_files"] == ["page 7", "page 8"] and together["removed_lines"] == 4


def test_near_texts_like_brute_force():
    import random

    from inkglass.operators.pages import alike, near_texts

    rnd = random.Random(4)
    norms = {"".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 70))) for _ in range(60)}
    for s in list(norms):
        for _ in range(4):
            t = list(s)
            for _ in range(rnd.randint(1, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(["a", "b", "", "cc"])
            norms.add("".join(t))
    near = near_texts(sorted(norms))
    want = {(a, b) for a in norms for b in norms if a != b and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and alike(a, b) >= 0.92}
    assert {(a, b) for a in near for b in near[a]} == want and len(want) > 50


def test_overlay_words_of_tables(spark, tmp_path):
    from inkglass import queries

    rows = []
    for file in (1, 2):
        for p in (1, 2, 3):
            texts = [(500.0, 100.0 + p, "follow")] + [(60.0, 300.0 + 200 * k, f"own {'abcdefgh'[4 * file - 4 + k]}{'xyz'[p - 1]}") for k in range(4)]
            rows += [(100 * file + 10 * p + k, file, p, 0, 0, k, t, 90.0, (x, y, x + 20, y + 20), 1080, 2400) for k, (x, y, t) in enumerate(texts)]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame(rows, f"line_id long, file_id long, page int, block int, para int, line_no int, text string, confidence double, bbox {box}, img_w int, img_h int")
    df.write.parquet(f"{tmp_path}/ocr_line.parquet")
    got = {(r.doc, r.page, r.line, r.word) for r in queries.page_overlay_words(spark, str(tmp_path)).collect()}
    assert got == {(f, p, 0, 0) for f in ("1", "2") for p in (1, 2, 3)}


def test_scalars_of_documents(spark, tmp_path):
    from inkglass import queries

    spark.createDataFrame([(7, "A <b> & *c*"), (8, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.document_scalars(spark, str(tmp_path)).collect()}
    assert set(got) == {7, 8} and got[7].norm == "abc" and got[7].alnum == 3 and got[7].html == "A &lt;b&gt; &amp; *c*" and got[7].slug.startswith("sec-8-")


def test_overlay_words_without_all_pairs_of_pages(spark, monkeypatch):
    """A word at one place of k pages gives no k * k rows, and words and pages near it are those of brute force."""
    import random

    from inkglass import session
    from inkglass.operators import pages

    rnd, rows = random.Random(3), []
    for p in range(150):
        rows += [("long", p, 0, 0, "follow", 500.0 + p % 3, 100.0, 1080, 2400), *(("long", p, k, 0, f"own{p}x{k}", 60.0, 300.0 * k, 1080, 2400) for k in (1, 2, 3))]
    base = [(rnd.choice("abcdefgh") * 2, rnd.uniform(0, 120), rnd.uniform(0, 120)) for _ in range(8)]
    for p in range(14):
        own = [(n, x + rnd.choice([0, 3, 6, 12]), y + rnd.choice([0, 0, 3, 6, 40])) for n, x, y in base if rnd.random() < 0.5]
        own += [(n, x + 1, y) for n, x, y in own if rnd.random() < 0.2] + [(rnd.choice("ijklmn") * 2, rnd.uniform(0, 120), 5.0) for _ in range(rnd.randint(0, 6))]
        rows += [("odd", p, k, 0, n, x, y, *rnd.choice([(1080, 1200), (900, 1600)])) for k, (n, x, y) in enumerate(own) for rnd in (random.Random(p),)]

    def brute(own):
        by = {}
        for w in own:
            by.setdefault(w[1], []).append(w)
        known = set()
        for i in by:
            for j in (j for j in by if i < j):
                tol = max(3.0, by[i][0][8] * 0.0025)
                near = {a: min((b for b in by[j] if a[4] == b[4] and a[7:] == b[7:] and abs(a[5] - b[5]) <= 2 * tol and abs(a[6] - b[6]) <= tol), default=None) for a in by[i]}
                hits = {(a, b) for a, b in near.items() if b}
                if len(hits) < 0.5 * min(len(by[i]), len(by[j])):
                    known |= {x for pair in hits for x in pair}
        return {w[:4] for w in own if any(w[4] == k[4] and abs(w[6] - k[6]) <= w[8] * 0.05 and abs(w[5] - k[5]) <= w[7] * 0.03 for k in known)}

    sizes, write = [], session.cut
    monkeypatch.setattr(session, "cut", lambda df: sizes.append((out := write(df)).count()) or out)
    df = spark.createDataFrame(rows, "doc string, page int, line int, word int, norm string, cx double, cy double, img_w int, img_h int")
    got = {tuple(r) for r in pages.overlay_words(df).collect()}
    assert got == {w for d in ("long", "odd") for w in brute([r for r in rows if r[0] == d])} and len(got) > 170
    assert max(sizes) <= len(rows)


def _pages_of_files(spark, folder):
    rows = [(100 * f + 10 * p + k, f, p, 0, 0, k, t, 90.0, (60.0, 300.0 + 200 * k, 500.0, 330.0 + 200 * k), 1080, 2400) for f in (1, 2) for p in (1, 2, 3) for k, t in enumerate(["Follow", *(f"own words {'abcdefgh'[f + k]}{'xyz'[p - 1]}" for k in range(4))])]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    spark.createDataFrame(rows, f"line_id long, file_id long, page int, block int, para int, line_no int, text string, confidence double, bbox {box}, img_w int, img_h int").write.parquet(f"{folder}/ocr_line.parquet")


def _not_sent_to_the_driver(df):
    """Written tables can have many more rows than their files are large, so none is broadcast."""
    return "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_pages_and_overlays_are_not_broadcast(spark, tmp_path):
    from inkglass import queries

    _pages_of_files(spark, tmp_path)
    df = queries.organized_documents(spark, str(tmp_path))
    assert _not_sent_to_the_driver(df)
    docs = {r.doc: json.loads(r.json) for r in df.collect()}
    assert set(docs) == {"1", "2"} and all("Follow" not in json.dumps(d["sections"]) for d in docs.values())


def test_rendered_pages_are_not_broadcast(spark, tmp_path):
    from inkglass import queries

    _pages_of_files(spark, tmp_path)
    df = queries.rendered_markdown(spark, str(tmp_path))
    assert _not_sent_to_the_driver(df)
    got = {r.doc: r.content for r in df.collect()}
    assert set(got) == {"1", "2"} and all(c.startswith("# ") and "own words" in c and "Follow" not in c for c in got.values())
