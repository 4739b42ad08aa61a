"""The operators for training text on small hand-made tables, against brute force."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkglass.llm import encodings, leaks, lookalikes, personal, scans, spans, subjects
from inkglass.llm.boosting import Booster

# ---- 1: garbled text

CLEAN = ["el año pasado llovió más en España", "Größe und Übergabe für Gäste", "déjà vu à l'hôtel près du café", "старая папка лежит на полке", "MAÇÃ, LIMÃO e PÃO na lista", "ÂGE et PÂTE sur l'étiquette", "Søren and ZOË", "± 5 µm, ¼ °"]


def fields(spark, rows):
    return spark.createDataFrame([(i, "text", t, "clash") for i, t in enumerate(rows)], "id long, field string, text string, token string").drop("token")


def test_garbled(spark):
    good = [t for t in CLEAN for _ in range(5)]
    bad = [
        (CLEAN[0].encode().decode("cp1252", "replace"), CLEAN[0]), (CLEAN[1].encode().decode("latin-1"), CLEAN[1]), (CLEAN[2].encode().decode("cp437"), CLEAN[2]), (CLEAN[3].encode("cp1251").decode("cp1252"), CLEAN[3]),
        (CLEAN[3].encode("koi8_r").decode("cp1251"), CLEAN[3]), (CLEAN[0].encode("cp1252").decode("utf-8", "replace"), None), ("x " + CLEAN[1].encode("cp1252").decode("cp437") + " y", "x " + CLEAN[1] + " y"), (CLEAN[2].encode().decode("cp1252").encode().decode("cp1252"), CLEAN[2]), ("żółta gałąź".encode().decode("mac_roman"), "żółta gałąź"),
    ]
    df = fields(spark, good + [b for b, _ in bad] + ["", None, "plain"])
    found = encodings.garbled_tokens(df).persist()
    assert sorted({r.id for r in found.collect()}) == list(range(len(good), len(good) + len(bad)))
    restored = {r.id: r.restored for r in encodings.restore(df, found).collect()}
    for k, (_, want) in enumerate(bad):
        if want:
            assert restored[len(good) + k] == want
    assert encodings.garbled_tokens(df.limit(0)).count() == 0


# ---- 2: shared spans


def brute_spans(rows, least):
    places = defaultdict(set)
    for i, t, _ in rows:
        for k in range(len(t or "") - least + 1):
            places[t[k : k + least]].add(i)
    sources = {i: set(s or ()) for i, _, s in rows}
    out = set()
    for i, t, _ in rows:
        now = None
        for k in range(len(t or "") - least + 1):
            if any(j != i and not sources[i] & sources[j] for j in places[t[k : k + least]]):
                if now and k <= now[1]:
                    now[1] = k + least
                else:
                    out |= {(i, *now)} if now else set()
                    now = [k, k + least]
        out |= {(i, *now)} if now else set()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_spans_like_brute_force(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 3, 5, 9, 12, 30])))
    pool = [" ".join(word() for _ in range(rnd.randint(8, 60))) for _ in range(6)] + ["x" * 400, "é漢🙂 " * 90]
    rows = []
    for i in range(60):
        parts = [rnd.choice(pool)[rnd.randint(0, 30) :][: rnd.randint(80, 600)] if rnd.random() < 0.5 else " ".join(word() for _ in range(20)) for _ in range(rnd.randint(1, 4))]
        sources = rnd.choice([None, [], ["a"], ["a", "b"], ["c", "a"], ["b", "c", "c"], ["d"], [f"f{i}"]])
        rows.append((i, "".join(parts), sources))
    rows += [(900, None, ["a"]), (901, "", None), (902, "short", None)]
    df = spark.createDataFrame(rows + rows[:7], "id long, text string, sources array<string>")
    got = {tuple(r) for r in spans.shared_stretches(df).collect()}
    assert got == brute_spans(rows, 200)


def test_spans_with_one_source_in_common(spark):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(i, text, ["hub", f"s{i}"]) for i in range(30)] + [(50, text, ["hub"] + [f"x{k}" for k in range(15)]), (60, text, ["s3", "s4"])]
    df = spark.createDataFrame(rows, "id long, text string, sources array<string>")
    assert {tuple(r) for r in spans.shared_stretches(df).collect()} == brute_spans(rows, 200)
    share = spans.shared_share(df, spans.shared_stretches(df)).where("id = 60").first()
    assert share.shared_chars == share.n_chars and share.share == 1.0
    assert spans.shared_stretches(df.limit(0)).count() == 0


# ---- 3: scans


def scan_tables(spark):
    vocabulary = "the committee described every cupboard beside station with notice about morning library counter pattern between holidays without"
    clean = [(1000 + k, 500 + k, 0, " ".join(random.Random(k).sample(vocabulary.split(), 12))) for k in range(400)]
    lines, n = [], 0
    for page in range(1, 7):
        body = [" ".join(random.Random(100 * page + k).sample(vocabulary.split(), 6)) for k in range(12)]
        body[4] = "without the comm-"
        body[5] = "ittee described every cupboard"
        body[7] = "notice about mornlng 1ibrary counter" if page == 2 else body[7]
        for no, t in enumerate(["Minutes of the Blue Office" if page != 3 else "Minutcs of the B1ue Office", *body, f"- {page + 40} -"]):
            lines.append((n, 7, page, no, t))
            n += 1
    ocr = spark.createDataFrame(lines + lines[:5] + [(9000, 8, 1, 0, None), (9001, 8, 1, 1, "")], "line_id long, file_id long, page int, line_no int, text string")
    blocks = spark.createDataFrame(clean + [(1, 2, 0, None), (2, 2, 1, "")], "block_id long, section_id long, block_no int, text string")
    return ocr, blocks, {(x[2], x[3]): x[0] for x in lines}


def test_noise(spark):
    ocr, blocks, at = scan_tables(spark)
    got = {(r.rec_id, r.noise) for r in scans.noise(ocr, blocks).collect()}
    assert {r for r, k in got if k == "running"} == {at[p, 0] for p in range(1, 7)}
    assert {r for r, k in got if k == "page_number"} == {at[p, 13] for p in range(1, 7)}
    assert {r for r, k in got if k == "broken_word"} == {at[p, 5] for p in range(1, 7)}
    assert (at[2, 8], "misread") in got and {r for r, k in got if k == "misread"} <= {at[2, 8], at[3, 0]}
    assert scans.noise(ocr.limit(0), blocks.limit(0)).count() == 0
    text = {(r.grp, r.page): r.text for r in scans.paragraphs(ocr.withColumn("para", F.lit(1)), blocks).where("src = 'line'").collect()}
    assert "without the committee described every cupboard" in text[7, 1] and "morning library" in text[7, 2] and not any("Blue" in t or "- 4" in t for t in text.values())


def test_long_pages(spark):
    """Words cut where a page goes from one task to the next; retrieval against all known words."""
    _, blocks, _ = scan_tables(spark)
    words = "the committee described every cupboard beside station with notice about morning library counter pattern".split()
    lines = []
    for page in range(3):
        body = [" ".join(random.Random(1000 * page + k).sample(words, 6)) for k in range(450)]
        for k in (399, 420):
            body[k], body[k + 1] = "without the comm-", "ittee described every cupboard"
        lines += [(1000 * page + k, 7, page, k, t) for k, t in enumerate(body)]
    ocr = spark.createDataFrame(lines, "line_id long, file_id long, page int, line_no int, text string")
    all_pages = scans.pages(ocr, blocks)
    rows = scans.read_pages(all_pages).where("t in ('cut', 'edge')").collect()
    cuts = {(r.rec, r.a, r.b.split("\t")[1]) for r in rows if r.t == "cut"}
    assert cuts == {(1000 * p + k, "comm-", "ittee") for p in range(3) for k in (399, 420)}
    assert {r.no for r in rows if r.t == "edge"} <= {0, 1, 448, 449}


def test_retrieval_recall():
    """Half of a word's q-grams bring at least nine in ten misreadings to their word."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghilmnoprstuvw") for _ in range(rnd.randint(5, 12))) for _ in range(1500)]
    swaps = [*scans.PAIRS, *((b, a) for a, b in scans.PAIRS), ("e", "c"), ("o", "0"), ("l", "1"), ("t", "f"), ("h", "b"), ("s", "5")]
    grams = lambda w, few: {(g, n) for b in scans._grams(iter([pa.RecordBatch.from_arrays([pa.array([w]), pa.array([few])], ["word", "few"])])) for g, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())}
    asked = found = 0
    for w in words:
        a, b = rnd.choice(swaps)
        if a not in w:
            continue
        mine, theirs = grams(w.replace(a, b, 1), 1), {g for g, _ in grams(w, 0)}
        asked += 1
        found += any(sum(g in theirs for g, _ in mine if g[0] == v) >= 0.4 * max(n for g, n in mine if g[0] == v) for v in "01")
    assert asked > 300 and found >= 0.9 * asked, (found, asked)


def test_near_words_like_brute_force(spark):
    """No known word within FAR is left out, whatever its shapes share and however many pairs of letters differ."""
    rnd = random.Random(5)
    known = sorted({"".join(rnd.choice("abcdefhilmnorstuvw") for _ in range(rnd.randint(2, 14))) for _ in range(300)} | {"the", "lifted", "mammommomm", "immunkommunikation"})
    swaps = [*scans.PAIRS, *((b, a) for a, b in scans.PAIRS), ("e", "c"), ("o", "0"), ("l", "1"), ("s", "5")]
    asked = {"tlie", "hfted", "rnarnrnornrnornrn", "irnrnunkornrnunikation"}
    for w in known:
        for _ in range(2):
            v = w
            for _ in range(rnd.randint(1, 3)):
                a, b = rnd.choice([x for x in swaps if x[0] in v] or [("", "")])
                at = rnd.randrange(len(v))
                v = rnd.choice([v.replace(a, b, 1), v.replace(a, b), v[:at] + rnd.choice("aeknx") + v[at + 1 :], v[:at] + rnd.choice("aeknx") + v[at:], v[:at] + v[at + 1 :] or v])
            asked.add(v)
    table = lambda words: spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.word, r.known) for r in scans.near_words(table(asked), table(known)).collect()}
    close = {(w, k) for w in asked for k in known if w != k and scans.distance(w, k) <= scans.FAR}
    assert {("tlie", "the"), ("hfted", "lifted"), ("rnarnrnornrnornrn", "mammommomm")} <= close and len(close) > 800
    assert close <= got
    long = "".join(rnd.choice("abcdefghilmnorstuvw") for _ in range(20_000))
    assert sum(map(len, scans.keys_of(long, True))) < 100 * len(long)
    assert scans.keys_of(long, False) & scans.keys_of(long[:9000] + "x" + long[9001:15_000] + long[15_001:], True)


def test_corrections_of_unlike_shapes(spark):
    """Misreadings whose shapes share too few q-grams with those of their words."""
    known = "the library committee lifted hallway tunnel blieb outline june turn described cupboard station notice about morning pattern holidays without between counter".split()
    odd = {w.replace(a, b, 1) for w in known for a, b in (("l", "1"), ("o", "0"), ("i", "!"), ("s", "5")) if a in w}
    rows = [(w, 500, 500) for w in known] + [(w, 3, 0) for w in [*odd, "hfted", "hallvvay", "tiinnel", "bheb"]]
    fixes = {r.word: r.known for r in scans.corrections(spark.createDataFrame(rows, "word string, scan long, clean long"), 3, 100).collect()}
    assert {w: fixes.get(w) for w in ("hfted", "hallvvay", "tiinnel", "bheb")} == {"hfted": "lifted", "hallvvay": "hallway", "tiinnel": "tunnel", "bheb": "blieb"}


def test_titles_misread_far_away(spark):
    """A title's misreading many pages from where it is read well; lines nearly like a title, against all pairs."""
    body = lambda p: [" ".join(random.Random(100 * p + k).sample("committee described every cupboard beside station with notice".split(), 4)) for k in range(8)]
    title = {p: "Minutes of the Blue Office" for p in range(1, 20)} | {90: "Mixutes of the Blae Office"}
    lines = [(100 * p + k, 7, p, k, t) for p in range(1, 91) for k, t in enumerate([title.get(p, f"in the {'abcdefghij'[p // 10] * 3}{'klmnopqrst'[p % 10] * 3} week"), *body(p)])]
    _, blocks, _ = scan_tables(spark)
    rows = scans.read_pages(scans.pages(spark.createDataFrame(lines, "line_id long, file_id long, page int, line_no int, text string"), blocks))
    assert {r.rec for r in scans.running_lines(rows).where("src = 'line' and no = 0").collect()} >= {100 * p for p in title}
    rnd = random.Random(3)
    titles, asked = set(), set()
    for g in range(20):
        for _ in range(4):
            t = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 40)))
            titles.add(("line", g, t))
            for _ in range(20):
                w = list(t)
                for _ in range(rnd.randint(1, max(1, len(t) // 6) + 1)):
                    at = rnd.randrange(len(w))
                    w[at : at + rnd.randint(0, 1)] = rnd.choice(["", *"abcdefgh"])
                asked.add(("line", g, "".join(w)))
    a, t = (spark.createDataFrame(sorted(x), "src string, grp long, a string") for x in ({x for x in asked if len(x[2]) >= 5}, titles))
    got = {tuple(r) for r in scans.near_titles(a, t).collect()}
    every = a.join(t.withColumnRenamed("a", "known"), ["src", "grp"]).where("levenshtein(a, known) <= greatest(1, int(length(known) / 6))")
    assert got == {(r.src, r.grp, r.a) for r in every.collect()} and len(got) > 500


def test_cut_words_misread(spark):
    """A misread word that the corpus has only cut in two."""
    ocr, blocks, at = scan_tables(spark)
    ocr = ocr.withColumn("text", F.when(F.col("line_id") == at[4, 6], "1ttee described every cupboard").otherwise(F.col("text")))
    got = {(r.rec_id, r.noise) for r in scans.noise(ocr, blocks).collect()}
    assert {(at[4, 5], "broken_word"), (at[4, 6], "misread")} <= got


def test_booster():
    import numpy as np

    x = np.random.default_rng(1).normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((Booster().fit(x[:600], y[:600]).probability(x[600:]) > 0.5) == y[600:]).mean() > 0.9
    assert len(Booster().fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3)))) == 2


# ---- 4: personal details

TEXTS = [
    ("Dear Dr. Tomas Eldlunde, call (712) 555-0198 today.", {("name", 9), ("phone", 30)}),
    ("Write to jo.b+x@mail.example or anna [at] post [dot] example.", {("email", 9), ("email", 32)}),
    ("Lives at 12 Brindle Lane, Ostermoor.", {("address", 9)}),
    ("Anschrift: Talbrückallee 97, 52581 Lohfelde", {("address", 11)}),
    ("Passport no. L05X68T82 is on the last page.", {("id_number", 13)}),
    ("SSN 666-82-2797", {("id_number", 4)}),
    ("Order no. 666-31-5678 was packed.", set()),
    ("Summer Market 798 is open; sign in @ desk.", set()),
    ("The summer market and the harbour walk.", set()),
    ("", set()),
    (None, set()),
]


def test_mentions(spark):
    filler = [("Order no. 111-22-3333 was packed.", None), ("Passport no. 222-33-4444 is on the last page.", None), ("SSN 333-44-5555", None), ("Call 07700 900123 before noon.", None), ("Ask Anna Eldlunde about it.", None)] * 4 + [(f"Write to {n}@mail.example.", None) for n in ("tomas.eldlunde", "tomas_pelodal", "anna.eldlunde")] + [("Ask Tomas Pelodal.", None)]
    rows = [("file", i, t) for i, (t, _) in enumerate(TEXTS + filler)]
    df = spark.createDataFrame(rows + rows[:3], "src string, rec_id long, text string")
    found = personal.mentions(df).persist()
    got = defaultdict(set)
    for r in found.collect():
        got[r.rec_id].add((r.kind, r.start_at))
    assert {i: got[i] for i in range(len(TEXTS))} == {i: want for i, (_, want) in enumerate(TEXTS)}
    clean = {r.rec_id: r.clean for r in personal.sanitised(df).collect()}
    assert clean[0] == "Dear Dr. [name], call [phone] today." and clean[6] == TEXTS[6][0]
    assert personal.mentions(df.limit(0)).count() == 0


def test_names_with_initials(spark):
    filler = ["Ask Anna Eldlunde about it.", "Ask Anna Pelodal about it."] * 4 + ["please ask at the desk, as is the plan on the shelf"] * 2 + [f"Write to {n}@mail.example." for n in ("samuel.pelodal", "marta_molghast", "greta.fenkamp", "anna+notes")]
    texts = ["Photo by Samuel M. Pelodal", "Ask Márta A. Molghast", "Greta K. J. Fenkamp signed.", "Ask Samuel M.\nPelodal now", "Shelf Plan B. Pelodal is here"]
    df = spark.createDataFrame([("file", i, t) for i, t in enumerate(texts + filler)], "src string, rec_id long, text string")
    found = personal.mentions(df).persist()
    got = {(r.rec_id, r.kind, r.start_at, r.end_at) for r in found.collect() if r.rec_id < len(texts)}
    assert got == {(0, "name", 9, 26), (1, "name", 4, 21), (2, "name", 0, 19), (3, "name", 4, 21)}
    clean = {r.rec_id: r.clean for r in personal.sanitised(df).collect()}
    assert clean[0] == "Photo by [name]" and clean[2] == "[name] signed." and clean[4] == "Shelf Plan B. [name] is here"


def test_phones_without_cue(spark):
    texts = ["It is 0049 30 1234567 there.", "It is 030/1234567 there.", "It is 01.23.45.67.89 there.", "Order no. 030/7654321 was packed.", "See 00331234A below."]
    df = spark.createDataFrame([("file", i, t) for i, t in enumerate(texts + ["Order no. 111-22-3333 was packed.", "Order no. 040/1234567 was packed.", "Order no. 00441234B was packed.", "Tel. 040/7654321", "Tel. 01.99.45.67.89"] * 4)], "src string, rec_id long, text string")
    assert {(r.rec_id, r.kind, r.start_at) for r in personal.mentions(df).collect() if r.rec_id < len(texts)} == {(i, "phone", 6) for i in range(3)}


# ---- 5: look-alikes


def test_alike(spark):
    rows = ["Office in the hall", "Oﬃce in the hall", "Оffice in the hall", "Of​fice in the hall", "Ｏffice in the hall", "office in the hall", "Office in the hall", "café", "café", "cafe", "x²", "x2", "½", "1/2", "", None]
    df = spark.createDataFrame([("text", i, t) for i, t in enumerate(rows)], "src string, id long, text string")
    table = lookalikes.rewrites(lookalikes.count_members(df))
    got = {(r.id_a, r.id_b) for r in lookalikes.alike_pairs_of(df.union(df), table).collect()}
    group = [0, 1, 2, 3, 4, 6]
    assert got == {(a, b) for a in group for b in group if a < b and (a, b) != (0, 6)} | {(7, 8)}
    parts = {r.id: (r.class_id, r.strings, r.links) for r in lookalikes.classes(df.union(df), table).collect()}
    assert parts == {i: (0, 5, 4 if i in (0, 6) else 5) for i in group} | {7: (7, 2, 1), 8: (7, 2, 1)}
    forms = {r.id: r.form for r in lookalikes.canonical(df, table).collect()}
    assert {forms[i] for i in group} == {"Office in the hall"} and forms[10] == "x²" and 14 not in forms
    assert lookalikes.alike_pairs_of(df.limit(0), table).count() == 0


# ---- 8: leaked items


def test_leaks_like_brute_force(spark):
    import regex

    rnd = random.Random(3)
    items = [(i, f"Puzzle {rnd.randint(1, 99)}: a potter fills {rnd.randint(100, 999)} pouches with {rnd.randint(100, 999)} beads each, donates {rnd.randint(10, 99)} of them and keeps {i} kites.") for i in range(12)] + [(50, "too short"), (51, None)]
    docs = []
    for k in range(80):
        words = rnd.choice(items[:12])[1].split()
        a = rnd.randint(0, 6)
        part = words[a : a + rnd.randint(6, 20)]
        part = [w.upper() if rnd.random() < 0.2 else w.replace("o", "о") if rnd.random() < 0.1 else w + rnd.choice(["", ",", " –", "\n"]) for w in part]
        docs.append((k, "before it " + " ".join(part) + " and after"))
    docs += [(900, None), (901, ""), (902, "x " * 30_000)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    table = lookalikes.rewrites(lookalikes.count_members(d.select("text").union(i.select("text"))))
    fold = lookalikes.Rewriter(table)
    cut = lambda t: regex.findall(r"[\p{L}\p{N}]+", fold(t).casefold()) if t else []
    want = set()
    for k, t in docs[:-1]:
        w = cut(t)
        runs = {tuple(w[x : x + 10]) for x in range(len(w) - 9)}
        want |= {(k, n) for n, x in items for v in [cut(x)] if any(tuple(v[y : y + 10]) in runs for y in range(len(v) - 9))}
    assert {tuple(r) for r in leaks.leaked(d, i, table).collect()} == want
    other = spark.createDataFrame([(1, items[0][1].replace("pouches", "pouches").replace(str(items[0][0]) + " kites", "77 kites").replace("Puzzle", "PUZZLE"))], "doc_id long, text string")
    changed = other.withColumn("text", F.regexp_replace("text", r"fills \d+", "fills 5"))
    assert 0 in {r.item_id for r in leaks.reparameterised(changed, i, table).collect()} | {r.item_id for r in leaks.leaked(changed, i, table).collect()}
    assert leaks.leaked(d.limit(0), i, table).count() == 0 and leaks.leaked(d, i.limit(0), table).count() == 0


# ---- 9: subjects


def test_subjects(spark):
    rnd = random.Random(5)
    names = ["medicine", "sport", "law", "cooking", "travel", "gardening"]
    terms = {
        "medicine": "patient vaccine bandage ward dosage fever", "sport": "goalkeeper referee medal marathon racket sprint", "law": "verdict plaintiff statute clause notary bailiff",
        "cooking": "oven dough marinade saucepan whisk ladle", "travel": "airport passport luggage hostel stopover gangway", "gardening": "compost hedge greenhouse trowel seedling trellis",
    }
    terms = {s: t.split() for s, t in terms.items()}
    filler = "drawer umbrella ticket corridor lantern counter notice".split()
    docs, want = [], set()
    for k in range(600):
        own = rnd.sample(names, rnd.choice([0, 1, 1, 2]))
        lines = [f"The {rnd.choice(filler)} and the {rnd.choice(filler)} were counted." for _ in range(3)]
        for s in own:
            lines += [f"The {rnd.choice(terms[s])} was seen near the {rnd.choice(filler)}." for _ in range(4)]
            want.add((k, s))
        if k % 10 == 0 and "sport" not in own:
            lines.append("Only once a medal.")
        rnd.shuffle(lines)
        docs.append((k, "\n".join(lines), "Download"))
    docs += [(900, None, None), (901, "", "x")]
    labels = [(k, s.upper() + " ") for k, s in sorted(want) if k % 2 == 0]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels + labels[:3] + [(5, None)], "doc_id long, subject string")
    got = {tuple(r) for r in subjects.assign(d, lab, names).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)
    assert subjects.assign(d.limit(0), lab, names).count() == 0
