"""A pretend phone: scanned, planned, moved, searched, taken back."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from inkglass.functions import detectors, topics
from inkglass.operators import catalog, duplicates
from inkglass.plans import journal, planner
from inkglass.sinks import indexes
from inkglass.sources import readers


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


DOCX = office(word__document_xml="<w:document><w:p><w:t>Walmart Supercenter</w:t></w:p><w:p><w:t>Receipt total due $5, subtotal, sales tax, receipt</w:t></w:p></w:document>")
FILES = {
    "DCIM/Camera/IMG_20240512_143022.jpg": b"photo-bytes", "Documents/notes.txt": b"Packing list for Spain\npassport\nsun cream\n2024-05-20", "Download/receipt(1).docx": DOCX, "Download/receipt.docx": DOCX, "Documents/receipt copy.docx": DOCX,
    "Download/invite.ics": b"BEGIN:VCALENDAR\nSUMMARY:Dentist appointment\nDTSTART:20240704T0930\nEND:VCALENDAR", "Download/contacts.vcf": b"FN:Jo Bloggs\nEND\n", "Download/x.bin": b"\x00\x01", "Android/data/secret.txt": b"never", "Download/.hidden": b"no", "Documents/empty.txt": b"",
    "Documents/page.html": b"<html><head><title>Garden shed plans</title><script>x</script></head><body><p>A &amp; B</p></body></html>", "Documents/list.csv": b"name,price\na,1\nb,2\n", "Documents/mail.eml": b"Subject: =?UTF-8?B?SGVsbG8gdGhlcmU=?=\nFrom: Ann <a@b.c>\nDate: Mon, 06 May 2024 10:00:00 +0000\n\nBody", "Documents/broken.docx": b"not a zip",
}


@pytest.fixture
def phone(tmp_path):
    for rel, data in FILES.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
        os.utime(p, (1_700_000_000, 1_700_000_000))
    return str(tmp_path)


def test_readers(spark, phone):
    facts = {r.rel_path: r for r in readers.facts(readers.scan(spark, phone)).collect()}
    assert "Android/data/secret.txt" not in facts and "Download/.hidden" not in facts and "Documents/empty.txt" not in facts
    assert facts["Documents/notes.txt"].title == "Packing list for Spain" and str(facts["Documents/notes.txt"].date) == "2024-05-20 12:00:00"
    assert facts["Documents/page.html"].title == "Garden shed plans" and facts["Documents/page.html"].text == "A & B"
    assert facts["Documents/list.csv"].title == "Table of name, price" and "about 2 rows" in facts["Documents/list.csv"].details
    assert facts["Documents/mail.eml"].title == "Hello there" and facts["Documents/mail.eml"].author == "Ann"
    assert facts["Download/invite.ics"].title == "Dentist appointment" and str(facts["Download/invite.ics"].date) == "2024-07-04 09:30:00"
    assert facts["Documents/broken.docx"].error and facts["Download/x.bin"].title is None


def test_plan_apply_search_undo(spark, phone):
    moves = planner.plan(readers.scan(spark, phone)).persist()
    to = {r.rel_path: r for r in moves.collect()}
    assert to["Documents/notes.txt"].target == "Documents/Notes & Text Files/Packing list for Spain (2024-05-20).txt"
    assert to["Download/invite.ics"].target == "Contacts & Calendar/Event - Dentist appointment (2024-07-04).ics"
    assert to["DCIM/Camera/IMG_20240512_143022.jpg"].target == "Photos/2024/05 - May/2024-05-12 14.30 Photo.jpg"
    copies = [r for r in to.values() if r.duplicate_of]
    assert len(copies) == 2 and all(r.target.startswith("Duplicates - Review/001 - Receipt - Walmart Supercenter") for r in copies)
    c = planner.counts(moves).first()
    assert (c.duplicates, c.wasted) == (2, 2 * len(DOCX))
    entries = planner.catalog_rows(moves, "r1").persist()
    found = [r.path for r in catalog.search(entries, "spain packing").collect()]
    assert found == [to["Documents/notes.txt"].target] and catalog.search(entries, "  ").count() == 0 and catalog.search(entries, "spain nowhere").count() == 0
    index = {r.folder: r.content for r in indexes.folder_indexes(entries).collect()}
    assert "Packing list for Spain" in index["Documents/Notes & Text Files"] and "exact copies of" in next(v for k, v in index.items() if k.startswith("Duplicates - Review/001"))
    before = sorted(os.path.relpath(os.path.join(d, f), phone) for d, _, fs in os.walk(phone) for f in fs)
    output = os.path.join(phone, "Organized Files")
    run, moved, failed = journal.apply([(r.rel_path, r.target) for r in to.values()], phone, output)
    assert moved == len(to) and not failed
    # a new copy of an organised file is seen as one (what is kept of the old listing would answer for it)
    spark.catalog.clearCache()
    os.makedirs(f"{phone}/Download", exist_ok=True)
    with open(f"{phone}/Download/again.docx", "wb") as f:
        f.write(DOCX)
    again = planner.plan(readers.scan(spark, phone)).collect()
    assert [r.rel_path for r in again] == ["Download/again.docx"] and again[0].duplicate_of
    os.remove(f"{phone}/Download/again.docx")
    restored, failed = journal.undo_last(output)
    after = sorted(os.path.relpath(os.path.join(d, f), phone) for d, _, fs in os.walk(phone) for f in fs if ".organizer" not in d)
    assert restored == moved and not failed and after == before


def test_unique_names(spark):
    rows = spark.createDataFrame([(1, "F", "a.txt"), (2, "f", "A.TXT"), (3, "F", "a (2).txt"), (4, "F", "a.txt"), (5, "G", "a.txt")], "i int, folder string, name string")
    got = {r.i: r.claimed for r in planner.unique_names(rows, "folder", "name", ["i"]).collect()}
    assert got[1] == "a.txt" and got[5] == "a.txt" and len({got[i].lower() for i in (1, 2, 3, 4)}) == 4


def test_duplicates_cascade(spark):
    big = bytes(200_000)
    rows = [("a", 5, b"aaaaa"), ("b", 5, b"aaaaa"), ("c", 5, b"bbbbb"), ("d", 200_000, big), ("e", 200_000, big[:100_000] + b"\x01" + big[100_001:]), ("f", 200_000, big), ("g", 0, b""), ("h", 0, b"")]
    df = spark.createDataFrame(rows, "path string, size long, content binary")
    h = duplicates.file_hashes(df)
    got = duplicates.groups(h, F.col("path"), F.col("hash"), F.col("size"), F.col("path")).collect()
    assert sorted((r.copies, r.kept, r.wasted) for r in got) == [(2, "a", 5), (2, "d", 200_000)]
    assert duplicates.groups(h.limit(0), F.col("path"), F.col("hash"), F.col("size"), F.col("path")).count() == 0


def test_catalog_file(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("A/b.txt", "o", "TEXT", "2024", 5, "d\te", "p", "n", "s\\", "r")], ", ".join(f"{f} {'long' if f == 'size' else 'string'}" for f in catalog.FIELDS))
    catalog.save(rows, path)
    assert catalog.load(spark, path).collect() == rows.collect()
    new = rows.withColumn("path", F.lit("a/B.TXT"))
    assert [r.path for r in catalog.upsert(rows, new).collect()] == ["a/B.TXT"] and catalog.remove(rows, new).count() == 0
    files = spark.createDataFrame([("A/b.txt",), ("x y.txt",)], "path string")
    assert [r.path for r in catalog.untracked(rows, files).collect()] == ["x y.txt"] and catalog.prune(rows, files).count() == 1
    assert [r.path for r in catalog.search_all(rows, files, "x y").collect()] == ["x y.txt"]


def test_roll_up(spark):
    files = spark.createDataFrame([("a/b/c.txt", 3), ("a/d.txt", 4), ("e.txt", None)], "path string, size long")
    assert {r.folder: (r.files, r.bytes) for r in catalog.roll_up(files).collect()} == {"": (3, 7), "a": (2, 7), "a/b": (1, 3)}


def test_details(spark):
    rows = [(1, 1, 0, "Saturday, October 12, 2026 at 9:00 AM - call (555) 123-4567 or +1 555-222-3333"), (1, 2, 0, "jo.b@mail.example.com costs $25.50 or 102 USD"), (1, 3, 1, "JO.B@mail.example.com www.tickets.com/show 11/03/2026 7pm, $20 Billion"), (1, 4, 1, None)]
    df = spark.createDataFrame(rows, "grp int, pos int, source int, text string")
    got = {(r.key, r.value): list(r.sources) for r in detectors.highlights(df).collect()}
    assert got["emails", "jo.b@mail.example.com"] == [0, 1]
    assert {v for k, v in got if k == "dates"} == {"Saturday, October 12, 2026 at 9:00 AM", "11/03/2026", "7pm"}
    assert {v for k, v in got if k == "phones"} == {"(555) 123-4567", "+1 555-222-3333"}
    assert {v for k, v in got if k == "links"} == {"www.tickets.com/show"} and {v for k, v in got if k == "money"} == {"$25.50", "102 USD", "$20 Billion"}


def test_topics(spark):
    assert topics.classify_text("Receipt", "Walmart total due subtotal")[:2] == ("Bills & Receipts", "Receipt")
    assert topics.classify_text(None, "patient diagnosis by the physician at the hospital")[0] == "Medical & Health"
    assert topics.classify_text("Trip", "passport, towel, sun cream") is None
    df = spark.createDataFrame([(None, None), ("Receipt", "invoice amount due")], "title string, text string")
    assert [r.match and r.match.topic for r in topics.classify(df).collect()] == [None, "Bills & Receipts"]


def test_incremental(spark, tmp_path):
    from inkglass.streaming import incremental

    src, cat, chk = (str(tmp_path / x) for x in ("in", "cat", "chk"))
    os.makedirs(src)
    to_rows = lambda b: b.select(F.col("path"), F.col("length").alias("size"))
    for k in range(2):
        with open(f"{src}/f{k}.txt", "w") as f:
            f.write("x" * (k + 1))
        incremental.maintain(incremental.watch(spark, src), to_rows, cat, chk).awaitTermination()
    assert sorted(r.size for r in incremental.current(spark, cat).collect()) == [1, 2]
