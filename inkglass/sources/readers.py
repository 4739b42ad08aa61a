"""Files to facts: titles, texts and dates out of bytes, by extension.

A scan is Spark's own ``binaryFile`` source; listing, filtering and pruning of
the content column are left to it.  Only bytes that built-in functions cannot
open (archives, odd charsets, mail headers) go through Arrow batches of pandas;
a file that cannot be read gives its error in ``error`` and no facts.
"""

from __future__ import annotations

import email.header
import html
import io
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import DOCUMENTS, EXTENSIONS, LABELS, kind_of

#: Characters kept of a text, bytes read of a file's head and of one archive entry.
TEXT, HEAD, ENTRY = 6000, 64 * 1024, 4 * 1024 * 1024
# Folders at the top that are never read, and those that are read by default.
NEVER = ("android", "alarms", "notifications", "ringtones", "lost.dir", "lost+found")
STANDARD = (
    "download", "downloads", "documents", "dcim", "pictures", "movies", "music", "recordings", "audiobooks", "podcasts", "screenshots", "screen recordings",
    "voice recorder", "sounds", "bluetooth",
)
INDEX_NAME, MASTER_NAME = "000 INDEX - ", "000 MASTER INDEX"


def scan(spark: SparkSession, root: str, output: str = "Organized Files") -> DataFrame:
    """(rel_path, length, modificationTime, content) of files below ``root``: no
    hidden, empty or index files, none below a folder that is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    rows = files.withColumn("rel_path", F.expr(f"substring(path, locate({_sql(base)}, path) + {len(base)})"))
    name = F.substring_index("rel_path", "/", -1)
    top = F.when(F.contains("rel_path", F.lit("/")), F.lower(F.substring_index("rel_path", "/", 1)))
    keep = (F.col("length") > 0) & ~F.exists(F.split("rel_path", "/"), lambda p: F.startswith(p, F.lit("."))) & ~F.startswith(name, F.lit(INDEX_NAME)) & ~F.startswith(name, F.lit(MASTER_NAME))
    return rows.where(keep & F.coalesce(~top.isin(*NEVER), F.lit(True))).withColumn("organized", F.coalesce(F.startswith("rel_path", F.lit(output + "/")), F.lit(False)))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def folder_choices(files: DataFrame) -> DataFrame:
    """(folder, files, selected) of the top folders; standard ones are selected."""
    top = F.substring_index("rel_path", "/", 1)
    rows = files.where(F.contains("rel_path", F.lit("/")) & ~F.col("organized")).groupBy(top.alias("folder")).agg(F.count("*").alias("files"))
    return rows.withColumn("selected", F.lower("folder").isin(*STANDARD))


def decode(data: bytes) -> str:
    """UTF-16 by its mark, else UTF-8, else Windows-1252 if more than three characters fail."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data[2:].decode("utf-16-le" if data[:1] == b"\xff" else "utf-16-be", "replace")
    text = data.decode("utf-8", "replace")
    return data.decode("cp1252", "replace") if text.count("�") > 3 else text.removeprefix("﻿")


def strip_tags(s: str) -> str:
    s = re.sub(r"<[^>]+>", " ", re.sub(r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr)[^>]*>", "\n", s))
    return re.sub(r"\n\s*\n+", "\n", re.sub(r"[ \t]+", " ", html.unescape(s).replace(" ", " "))).strip()


def xml_tag(xml: str, name: str) -> str | None:
    m = re.search(rf"(?s)<{re.escape(name)}(?:\s[^>]*)?>(.*?)</{re.escape(name)}>", xml)
    return (strip_tags(m[1]) or None) if m else None


def xml_texts(xml: str, *names: str) -> list[str]:
    """The text of each element of these names, tabs and breaks as blanks."""
    every = "|".join(map(re.escape, names))
    found = (m[2] for m in re.finditer(rf"(?s)<({every})(?:\s[^>]*)?>(.*?)</\1>", xml))
    plain = (re.sub(r"<[^>]+>", "", re.sub(r"<(?:w:tab|text:tab|w:br|a:br)[^>]*/>", " ", x)) for x in found)
    return [t for t in (html.unescape(x).strip() for x in plain) if t]


def mime_words(s: str) -> str:
    try:
        return str(email.header.make_header(email.header.decode_header(s)))
    except Exception:  # noqa: BLE001 - unknown charsets stay as they are
        return s


def iso_date(s: str | None) -> datetime | None:
    try:
        d = datetime.fromisoformat((s or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return d.astimezone(timezone.utc).replace(tzinfo=None) if d.tzinfo else d


def _zip(data: bytes) -> tuple[zipfile.ZipFile, Callable[[str], str]]:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    return z, lambda name: z.open(name).read(ENTRY).decode("utf-8", "replace") if name in names else ""


def _props(read: Callable[[str], str], part: str = "docProps/core.xml", author: str = "dc:creator", created: str = "dcterms:created") -> dict:
    xml = read(part)
    return {"meta_title": xml_tag(xml, "dc:title"), "author": xml_tag(xml, author), "date": iso_date(xml_tag(xml, created))}


def read_plain(data: bytes) -> dict:
    text = decode(data[:HEAD])
    m = re.search(r"^#{1,3}\s+(.+)$", text, re.M)
    return {"text": text, "own_title": m and m[1]}


def read_table(data: bytes, sep: str) -> dict:
    lines = [x for x in decode(data[:HEAD]).splitlines() if x.strip()]
    head = [c for c in (x.strip().strip('"') for x in (lines or [""])[0].split(sep)) if c]
    details = (["columns: " + ", ".join(head[:8])] if head else []) + [f"about {len(lines) - 1} rows" + ("+" if len(data) > HEAD else "")]
    return {"text": decode(data[:HEAD]), "own_title": "Table of " + ", ".join(head[:3]) if head else None, "details": details, "no_guess": True}


def read_rtf(data: bytes) -> dict:
    s = decode(data[: 2 * HEAD])
    for pattern, to in ((r"\{\\\*[^{}]*\}", " "), (r"\\(par|line)\b", "\n"), (r"\\'[0-9a-f]{2}", ""), (r"\\[a-zA-Z]+-?[0-9]* ?", ""), (r"[{}]", "")):
        s = re.sub(pattern, to, s)
    return {"text": s.strip()}


def read_docx(data: bytes) -> dict:
    _, read = _zip(data)
    pages = xml_tag(read("docProps/app.xml"), "Pages")
    return _props(read) | {"text": "\n".join(xml_texts(read("word/document.xml"), "w:p")), "pages": int(pages) if pages and pages.isdigit() else None}


def read_xlsx(data: bytes) -> dict:
    _, read = _zip(data)
    sheets = [html.unescape(x) for x in re.findall(r'<sheet [^>]*name="([^"]+)"', read("xl/workbook.xml"))]
    strings = xml_texts(read("xl/sharedStrings.xml"), "t")
    named = next((s for s in sheets if not re.fullmatch(r"(?i)(sheet|feuil|hoja|tabelle|blad)\s*\d+", s)), None)
    return _props(read) | {"text": "\n".join(strings), "own_title": named, "details": ["sheets: " + ", ".join(sheets[:5])] if sheets else []}


def read_pptx(data: bytes) -> dict:
    z, read = _zip(data)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    text = "\n".join(t for n in slides[:15] for t in xml_texts(read(n), "a:p"))
    return _props(read) | {"text": text, "details": ["1 slide" if len(slides) == 1 else f"{len(slides)} slides"] if slides else []}


def read_open_document(data: bytes) -> dict:
    _, read = _zip(data)
    return _props(read, "meta.xml", "meta:initial-creator", "meta:creation-date") | {"text": "\n".join(xml_texts(read("content.xml"), "text:p", "text:h"))}


def read_html(data: bytes) -> dict:
    s = decode(data[: 4 * HEAD])
    return {"meta_title": xml_tag(s, "title"), "text": strip_tags(re.sub(r"(?is)<(script|style|head)[^>]*>.*?</\1>", " ", s))}


def read_mail(data: bytes) -> dict:
    s = decode(data[: 2 * HEAD])
    m = re.search(r"\r?\n\r?\n", s)
    head, body = (s[: m.start()], s[m.start() :]) if m else (s, "")
    head = re.sub(r"\r?\n[ \t]+", " ", head)
    get = lambda k: (x := re.search(rf"(?im)^{k}:\s*(.+)$", head)) and x[1].strip()
    sender, when = get("From"), None
    try:
        when = parsedate_to_datetime(get("Date")).replace(tzinfo=None)
    except (TypeError, ValueError):
        pass
    name = mime_words(sender).split("<")[0].strip().strip('"') or sender.split("<")[-1].split(">")[0] if sender else None
    subject = get("Subject")
    return {"own_title": subject and mime_words(subject), "author": name, "date": when, "text": body, "no_guess": True}


def read_contacts(data: bytes) -> dict:
    names = [x.strip() for x in re.findall(r"(?m)^FN[^:]*:(.+)$", decode(data[: 8 * HEAD])) if x.strip()]
    many = len(names) > 1
    details = ["includes " + ", ".join(names[:5]) + (", …" if len(names) > 5 else "")] if many else []
    return {"own_title": f"{len(names)} contacts" if many else names[0] if names else None, "details": details, "text": "\n".join(names), "no_guess": True}


def read_calendar(data: bytes) -> dict:
    s = re.sub(r"\r?\n[ \t]", "", decode(data[: 8 * HEAD]))
    names = [x.strip().replace("\\,", ",") for x in re.findall(r"(?m)^SUMMARY[^:]*:(.+)$", s)]
    when, m = None, re.search(r"(?m)^DTSTART[^:]*:(\d{8})(?:T(\d{4}))?", s)
    if m:
        try:
            when = datetime.strptime(m[1] + (m[2] or "1200"), "%Y%m%d%H%M")
        except ValueError:
            pass
    many = len(names) > 1
    return {"own_title": f"{len(names)} events" if many else names[0] if names else None, "details": ["includes " + ", ".join(names[:4])] if many else [], "date": when, "text": "\n".join(names), "no_guess": True}


def read_epub(data: bytes) -> dict:
    z, read = _zip(data)
    opf = read(next((n for n in z.namelist() if n.lower().endswith(".opf")), ""))
    return {"own_title": xml_tag(opf, "dc:title"), "author": xml_tag(opf, "dc:creator"), "no_guess": True}


def read_archive(data: bytes) -> dict:
    names = [n for n in _zip(data)[0].namelist() if not n.endswith("/")]
    if not names:
        return {}
    by_ext = {e: k for k, es in EXTENSIONS.items() for e in es.split()}
    kind, n = Counter(by_ext.get(x.rsplit(".", 1)[-1].lower(), "OTHER") for x in names).most_common(1)[0]
    details = ["1 file inside" if len(names) == 1 else f"{len(names)} files inside"]
    if kind != "OTHER" and 2 * n > len(names):
        details.append(f"mostly {LABELS[kind].lower()}s")
    tops = {x.split("/")[0] for x in names if "/" in x}
    inner = tops.pop() if len(tops) == 1 else names[0].split("/")[-1].rsplit(".", 1)[0] if len(names) == 1 else None
    return {"inner_name": inner, "details": details, "text": "\n".join(names[:200]), "no_guess": True}


READERS: dict[str, Callable[[bytes], dict]] = {
    **dict.fromkeys(("txt", "md", "markdown", "text"), read_plain), "csv": lambda b: read_table(b, ","), "tsv": lambda b: read_table(b, "\t"), "rtf": read_rtf, "docx": read_docx,
    **dict.fromkeys(("xlsx", "xlsm"), read_xlsx), "pptx": read_pptx, **dict.fromkeys(("odt", "ods", "odp"), read_open_document), **dict.fromkeys(("html", "htm"), read_html), "eml": read_mail,
    **dict.fromkeys(("vcf", "vcard"), read_contacts), **dict.fromkeys(("ics", "vcs"), read_calendar), "epub": read_epub, "zip": read_archive,
}
FACTS = "rel_path string, meta_title string, own_title string, inner_name string, no_guess boolean, author string, date timestamp_ntz, pages int, details array<string>, text string, error string"


def register(ext: str, reader: Callable[[bytes], dict]) -> None:
    """Another reader for an extension: bytes to some of the facts."""
    READERS[ext.lower()] = reader


def read_facts(files: DataFrame) -> DataFrame:
    """One row of raw facts for each file (rel_path, content); unknown extensions give none but the path."""
    readers = dict(READERS)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["rel_path"], b["content"]):
                row = dict.fromkeys(x.split()[0] for x in FACTS.split(", ")) | {"rel_path": path, "details": []}
                reader = readers.get(path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "")
                try:
                    row |= reader(bytes(content)) if reader else {}
                except Exception as e:  # noqa: BLE001 - one bad file must not stop the others
                    row["error"] = f"{type(e).__name__}: {e}"
                row["text"] = row["text"][:TEXT] if row["text"] else row["text"]
                row["no_guess"] = bool(row["no_guess"])
                rows.append(row)
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in FACTS.split(", ")])
            out["date"] = pd.to_datetime(out["date"])
            out["pages"] = out["pages"].astype("Int32")
            yield out

    return files.select("rel_path", "content").mapInPandas(go, FACTS)


def facts(files: DataFrame) -> DataFrame:
    """The facts of each file with titles judged and dates chosen: a captured or
    content date, else that of the name, else (documents) of the text, else none."""
    from ..functions import dates, names, titles

    raw = read_facts(files.where(F.col("length") > 0))
    path = F.col("rel_path")
    clean = lambda c: names.tidy_case(F.btrim(F.regexp_replace(c, r"\s+", " ")))
    useful = F.when(titles.is_useful_title(F.col("meta_title")), clean(F.col("meta_title")))
    own = F.when(F.col("own_title").isNotNull(), clean(F.col("own_title")))
    inner = F.when(names.is_meaningful(F.col("inner_name")), F.col("inner_name"))
    guess = F.when(~F.col("no_guess"), titles.first_good_line(F.col("text")))
    base = files.select("rel_path", "length", "modificationTime", "organized")
    rows = raw.join(base, "rel_path").withColumn("kind", kind_of(path))
    named = dates.from_file_name(F.substring_index(path, "/", -1))
    rows = rows.withColumns({"title": F.coalesce(useful, own, inner, guess), "author": F.when(titles.is_person_name(F.col("author")), clean(F.col("author"))), "date": F.coalesce("date", named), "date_source": F.when(F.col("date").isNotNull(), dates.CONTENT).when(named.isNotNull(), dates.FILE_NAME)})
    written = F.when(F.col("kind").isin(*DOCUMENTS) & F.col("date").isNull(), dates.from_text(F.col("text"))).cast("timestamp_ntz") + F.expr("interval 12 hours")
    rows = rows.withColumn("written", written)
    return rows.withColumns({"date": F.coalesce("date", "written"), "date_source": F.coalesce("date_source", F.when(F.col("written").isNotNull(), dates.CONTENT), F.lit(dates.MODIFIED))}).drop("written", "meta_title", "own_title", "inner_name", "no_guess")
