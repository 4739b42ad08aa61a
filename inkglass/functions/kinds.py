"""What sort of file something is, from its name and folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import extension

# Extensions of each kind.
EXTENSIONS = {
    "PHOTO": "jpg jpeg png heic heif webp gif bmp dng tif tiff avif",
    "VIDEO": "mp4 mov mkv 3gp 3g2 webm avi m4v wmv mpg mpeg ts",
    "MUSIC": "mp3 m4a aac wav ogg oga opus flac wma mid midi amr awb m4b",
    "PDF": "pdf",
    "WORD": "doc docx odt rtf pages wps",
    "TEXT": "txt md markdown text",
    "SPREADSHEET": "xls xlsx xlsm ods csv tsv numbers",
    "PRESENTATION": "ppt pptx odp key",
    "EBOOK": "epub mobi azw azw3 fb2",
    "CONTACT": "vcf vcard",
    "CALENDAR": "ics vcs",
    "EMAIL": "eml msg",
    "WEB_PAGE": "html htm mhtml mht",
    "ARCHIVE": "zip rar 7z tar gz tgz bz2 xz",
    "APP_INSTALLER": "apk xapk apks apkm",
}
# Names of kinds for people.
LABELS = {
    "PHOTO": "Photo", "SCREENSHOT": "Screenshot", "VIDEO": "Video", "MUSIC": "Music", "VOICE_RECORDING": "Voice recording", "PDF": "PDF",
    "WORD": "Word document", "TEXT": "Note", "SPREADSHEET": "Spreadsheet", "PRESENTATION": "Presentation", "EBOOK": "eBook", "CONTACT": "Contact",
    "CALENDAR": "Calendar event", "EMAIL": "Email", "WEB_PAGE": "Web page", "ARCHIVE": "Zip file", "APP_INSTALLER": "App installer", "OTHER": "File",
}
DOCUMENTS = ("PDF", "WORD", "TEXT", "SPREADSHEET", "PRESENTATION", "EMAIL", "WEB_PAGE")
IMAGES = ("PHOTO", "SCREENSHOT")
VOICE_HINTS = "(^|[^a-z])(voice|recording|recorder|record|memo|ptt|call|audio[-_ ]?rec|sound[-_ ]?rec)([^a-z]|$)"
VOICE_ONLY = ("amr", "awb", "3ga")


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])


def kind_of(path: Column) -> Column:
    """The kind of the file at ``path``; OTHER for unknown extensions and null."""
    by_ext = _table({e: k for k, es in EXTENSIONS.items() for e in es.split()})
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    ext = extension(path)
    plain = F.coalesce(F.try_element_at(by_ext, ext), F.lit("OTHER"))
    # a hint counts in any one part of the path, so the parts are tried one by one
    voice = ext.isin(*VOICE_ONLY) | F.exists(F.split(low, "/"), lambda part: part.rlike(VOICE_HINTS))
    return F.when((plain == "PHOTO") & low.rlike("screenshot|screen_shot|screen shot"), "SCREENSHOT").when((plain == "MUSIC") & voice, "VOICE_RECORDING").otherwise(plain)


def label_of(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(LABELS), kind), F.lit("File"))
