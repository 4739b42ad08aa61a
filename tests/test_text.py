"""Text scalars and names against stated cases."""

import pytest
from pyspark.sql import functions as F

from inkglass.functions import dates, describe, kinds, names, text, titles


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "want"), [("night", "nacht", 0.25), ("same", "same", 1.0), ("a", "b", 0.0), ("aaaa", "aa", 0.5)])
def test_similarity(spark, a, b, want):
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_clean_text(spark):
    assert one(spark, text.clean_text(F.col("a")), a=" ​“Hi”  ''there''  ") == "\"Hi\" 'there'"


@pytest.mark.parametrize(("n", "want"), [(12, "12 B"), (1535, "1 KB"), (1536, "2 KB"), (5 * 1048576, "5.0 MB"), (3 * 1024**3, "3.00 GB")])
def test_format_size(spark, n, want):
    assert one(spark, text.format_size(F.col("n").cast("long")), n=n) == want


@pytest.mark.parametrize(("s", "want"), [(59, "59 sec"), (90, "2 min"), (3700, "1 hr 1 min")])
def test_format_duration(spark, s, want):
    assert one(spark, text.format_duration(F.col("s").cast("long")), s=s) == want


def test_preview_and_nulls(spark):
    assert one(spark, text.preview(F.col("t")), t="word " * 60).endswith("word…")
    assert one(spark, text.preview(F.col("t")), t="  \n ") is None
    assert one(spark, text.word_count(F.lit(None).cast("string"))) == 0


def test_field_round_trip(spark):
    for s in ("a\tb\\n\nc", "\\\\t", "plain", ""):
        assert one(spark, text.field_unescape(text.field_escape(F.col("s"))), s=s) == s


def test_safe_file_name(spark):
    assert one(spark, text.safe_file_name(F.col("t"), "docx"), t="delicious…. / menu?.") == "delicious. menu.docx"
    assert one(spark, text.safe_file_name(F.col("t"), "md"), t="???") == "screenshot-notes.md"


def test_natural_key(spark):
    rows = spark.createDataFrame([("page 10.png",), ("Page 9.png",), ("page 2b.png",)], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["page 2b.png", "Page 9.png", "page 10.png"]


UNCLEAR = ["IMG_20240512_143022", "Screenshot_2024-05-12-14-30-22", "IMG-20240512-WA0001", "download (3)", "document", "1693847223", "doc_1234567", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "final copy", "receipt", "untitled", "xkcdq", "VID_0001", "statement (2)"]
CLEAR = ["Car insurance 2024", "Beach holiday packing list", "Grandma birthday", "Tax return 2023", "Walmart receipt March", "recipes", "myTaxReturn_2023-final"]


def test_meaningful_names(spark):
    rows = spark.createDataFrame([(n, n in CLEAR) for n in UNCLEAR + CLEAR], "n string, want boolean")
    bad = [(r.n, r.got) for r in rows.withColumn("got", names.is_meaningful(F.col("n"))).collect() if r.got != r.want]
    assert not bad


def test_sanitize_and_case(spark):
    assert one(spark, names.sanitize(F.col("n")), n='a/b:c*"d"  <e>.') == "a b c d e"
    assert len(one(spark, names.sanitize(F.col("n")), n="word " * 40)) <= 90
    assert one(spark, names.tidy_case(F.col("n")), n="WALMART SUPERCENTER OF TOWN") == "Walmart Supercenter of Town"
    assert one(spark, names.strip_copy_suffix(F.col("n")), n="Trip (2) - Copy") == "Trip"


@pytest.mark.parametrize(
    ("name", "want"),
    [("IMG_20240512_143022", "2024-05-12 14:30:22"), ("Screenshot_2024-05-12-14-30-22.png", "2024-05-12 14:30:22"), ("notes 2024-5-3", "2024-05-03 12:00:00"), ("1715524222000.jpg", "2024-05-12 14:30:22"), ("IMG_20240231_1", None), ("holiday", None)],
)
def test_dates_of_names(spark, name, want):
    got = one(spark, dates.from_file_name(F.col("n"), F.lit("2026-01-01").cast("date")), n=name)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(("t", "want"), [("due May 12, 2024 or 2023-01-02", "2024-05-12"), ("on 12 May 2024", "2024-05-12"), ("05/12/2024", "2024-05-12"), ("25/12/2024", "2024-12-25"), ("31/02/2024", None), (None, None)])
def test_dates_of_texts(t, want):
    got = dates.first_date(t)
    assert (str(got) if got else None) == want


def test_kinds(spark):
    cases = {"a/Screenshots/x.png": "SCREENSHOT", "x.jpg": "PHOTO", "Recordings/voice 1.m4a": "VOICE_RECORDING", "Music/a.mp3": "MUSIC", "x.amr": "VOICE_RECORDING", "x.3ga": "OTHER", "noext": "OTHER", "x.TS": "VIDEO"}
    rows = spark.createDataFrame(list(cases.items()), "p string, want string").withColumn("got", kinds.kind_of(F.col("p"))).collect()
    assert all(r.got == r.want for r in rows), rows


def test_titles(spark):
    t = "Page 1 of 3\n12/05/2024\n- GROCERY STORE RECEIPT -\nmilk"
    assert one(spark, titles.first_good_line(F.col("t")), t=t) == "Grocery Store Receipt"
    assert one(spark, titles.first_good_line(F.col("t")), t="www.x.com\n***") is None
    assert one(spark, titles.is_useful_title(F.col("t")), t="Microsoft Word - x.docx") is False
    assert one(spark, titles.is_person_name(F.col("t")), t="Office User") is False


def test_describe(spark):
    got = one(spark, describe.describe({"kind": F.lit("PDF"), "pages": F.lit(2), "width": F.lit(3), "height": F.lit(4), "tags": F.array(F.lit("Dog")), "details": F.array(F.lit("x"))}))
    assert got == "PDF · 2 pages · 3×4 · shows: Dog · x"


def test_sql_functions(spark):
    from inkglass.functions import sql

    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    row = spark.sql("SELECT ink_normalize('A-b 1') AS a, ink_word_count(' x  y ') AS b, ink_format_size(1536) AS c, size(ink_bigrams('night')) AS d, ink_md_escape('a*b') AS e, ink_alnum_count('é1-') AS f").first()
    assert tuple(row) == ("ab1", 2, "2 KB", 4, "a\\*b", 2)


def test_near_pairs_like_brute_force(spark):
    import random

    from inkglass.operators import duplicates
    from inkglass.operators.pages import alike

    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdef") for _ in range(rnd.choice([1, 2, 5, 12, 25, 60, 300]))) for _ in range(40)]
    for s in texts[:40]:
        t = list(s)
        for _ in range(rnd.randint(1, max(1, len(s) // 30))):
            t[rnd.randrange(len(t))] = rnd.choice(["a", "xy", ""])
        texts.append("".join(t))
    texts += [*texts[:5], "", ""]
    first: dict = {}
    for i, s in enumerate(texts):
        first.setdefault(s, i)
    want = {(first[s], i) for i, s in enumerate(texts) if s and first[s] != i}
    want |= {(i, k) for a, i in first.items() for b, k in first.items() if a and i < k and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and alike(a, b) >= 0.92}
    got = duplicates.near_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, norm string")).collect()
    assert {(r.kept, r.other) for r in got} == want and len(got) == len(want) > 20


def test_whole_titles_are_compared(spark, tmp_path):
    from inkglass import queries

    same = "the same forty characters and more stand at the beginning of both "
    spark.createDataFrame([(1, same + "apples"), (2, same + "violin")], "section_id long, title string").write.parquet(f"{tmp_path}/sections.parquet")
    assert queries.similar_whole_titles(spark, str(tmp_path)).first().dice < 1


def test_near_pairs_of_long_texts(spark, monkeypatch):
    """Long texts of one language share parts without being alike: they get no keys by parts, and their pairs are those of brute force."""
    import random

    from inkglass.operators import duplicates
    from inkglass.operators.pages import alike

    rnd = random.Random(5)
    words = ["".join(rnd.choice("etaoinshrd") for _ in range(rnd.randint(2, 7))) for _ in range(80)]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.choice([12, 15, 18, 22, 26, 60, 200, 900]))) for _ in range(50)]
    for s in texts[:50]:
        for share in (0.02, 0.04, 0.08):
            t = list(s)
            for _ in range(int(len(s) * share)):
                t[rnd.randrange(len(t))] = rnd.choice(["q", "", "zx"])
            texts.append("".join(t))
    texts = list(dict.fromkeys(texts))
    want = {(i, k) for i, a in enumerate(texts) for k, b in enumerate(texts) if i < k and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and alike(a, b) >= 0.92}
    written, write = [], duplicates.cut
    monkeypatch.setattr(duplicates, "cut", lambda df: written.append((out := write(df)).count()) or out)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    got = {(r.kept, r.other) for r in duplicates.near_pairs(df).collect()}
    assert got == want and len(want) > 60
    assert max(written) < 50 * len(texts)
    monkeypatch.setattr(duplicates, "SQUARE", 4)
    assert {(r.kept, r.other) for r in duplicates.near_pairs(df).collect()} == want
