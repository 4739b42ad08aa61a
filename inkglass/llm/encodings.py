"""Text that was decoded with an encoding other than its own.

Every distinct clean word of the corpus is garbled under all encoding chains
(written in one encoding, read in another, also twice over), and the distinct
tokens of the corpus are hash-joined to the garbled forms.  A hit is verified:
the original must be the likelier of the two, by how odd its letters sit
together and by how often the corpus has it.

Words that the corpus only has garbled: single characters are garbled under the
chains through UTF-8 in the same way, and a token all of whose odd places are
garbled characters of one chain is that chain's text.  Words restored so are
garbled and joined in their turn; how common a word is counts where it stands
clean and where it was restored.

Fixed meaning: null and empty fields are no case; a field with U+FFFD, which
stands for bytes that could not be decoded, is a case without an original.
"""

from __future__ import annotations

import unicodedata as U
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep

# Encodings that texts are written in, and read in by mistake.
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "koi8_r", "mac_roman", "mac_cyrillic", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15")
TOKEN = regex.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
REPLACED = "�"
#: Characters that are garbled one by one: letters and marks of the alphabets of Europe, besides those the corpus has.
ALPHABETS = tuple(c for a, b in ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2010, 0x2040), (0x20A0, 0x20C0)) for c in map(chr, range(a, b)) if U.category(c)[0] in "LNPSZ")


@cache
def _tables(name: str) -> tuple[list[str], dict[str, int]]:
    """Decoding of each byte (bytes without a letter give the C1 control) and encoding."""
    to = []
    for b in range(256):
        try:
            to.append(bytes((b,)).decode(name))
        except UnicodeDecodeError:
            to.append(chr(b))
    back = {c: b for b, c in reversed(list(enumerate(to)))}
    return to, back


def _read(data: bytes, name: str, strict: bool = False) -> str:
    if strict:
        return data.decode(name, "replace")
    to = _tables(name)[0]
    return "".join([to[b] for b in data])


def _written(text: str, name: str) -> bytes | None:
    back = _tables(name)[1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def garbled_forms(word: str) -> dict[str, tuple[str, int]]:
    """Every garbled form of a word: the chain, and 1 if the chain proves itself (UTF-8 read as another encoding)."""
    out: dict[str, tuple[str, int]] = {}
    raw = word.encode("utf-8", "surrogatepass")
    for name in SINGLE:
        once = _read(raw, name)
        out.setdefault(once, (f"utf-8>{name}", 1))
        out.setdefault(_read(raw, name, True), (f"utf-8>{name}", 1))
        for second in (name, "cp1252"):
            twice = _read(once.encode("utf-8", "surrogatepass"), second)
            out.setdefault(twice, (f"utf-8>{name}>utf-8>{second}", 1))
    for own in SINGLE:
        data = _written(word, own)
        if data is None:
            continue
        for name in SINGLE:
            if name != own:
                out.setdefault(_read(data, name), (f"{own}>{name}", 0))
        out.setdefault(data.decode("utf-8", "replace"), (f"{own}>utf-8", 1))
    out.pop(word, None)
    return {k: v for k, v in out.items() if not k.isascii()}


def oddness(word: str) -> int:
    """How odd the characters of a word sit together: 0 for words of any language."""
    odd, last = 0, None
    for c in word:
        kind = U.category(c)
        if c == REPLACED or kind in ("Cc", "Co", "Cn"):
            odd += 4
            last = None
            continue
        if kind[0] == "L":
            script = "Latin" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else "Greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "Cyrillic" if "Ѐ" <= c <= "ԯ" else U.name(c, "?").split()[0]
            if last and last[0] != script:
                odd += 2
            elif last and last[1] == "Ll" and kind == "Lu":
                odd += 1
            if script == "Latin" and c >= "\x80" and last and last[2] >= "\x80" and last[0] == "Latin":
                odd += 1  # two accented letters side by side are rare in any language
            last = (script, kind, c)
        elif c >= "\x80" and kind[0] in "SNZM" or kind == "Lo":
            odd += 2 if last else 1
        elif c >= "\x80" and c not in "–—‘’“”„…«»¿¡‹›":
            odd += 1
    return odd


def character_forms(letters: Iterable[str]) -> list[tuple[dict[str, str], int]]:
    """Of each chain through UTF-8, once or twice over: garbled forms of the
    characters, and the length of the longest form."""
    tables = []
    letters = sorted({v for c in (*letters, *ALPHABETS) for v in (c, c.upper(), c.lower()) if len(v) == 1 and v >= "\x80"})
    for name in SINGLE:
        once = {c: _read(c.encode("utf-8", "surrogatepass"), name) for c in letters}
        tables.append({form: c for c, form in once.items()})
        for second in dict.fromkeys((name, "cp1252")):
            tables.append({_read(form.encode("utf-8", "surrogatepass"), second): c for c, form in once.items()})
    return [(t, max(map(len, t), default=0)) for t in tables]


def spelled(token: str, tables: list[tuple[dict[str, str], int]]) -> str | None:
    """The token with its garbled characters replaced, or None where no chain accounts for all characters beyond ASCII."""
    best, least = None, max(oddness(token), 1)
    for table, longest in tables:
        out, k = [], 0
        while k < len(token):
            if token[k] < "\x80":
                out.append(token[k])
                k += 1
                continue
            size = next((n for n in range(longest, 0, -1) if token[k : k + n] in table), 0)
            if not size:
                break
            out.append(table[token[k : k + size]])
            k += size
        else:
            text = "".join(out)
            if text != token and oddness(text) < least:
                best, least = text, oddness(text)
    return best


def tokens_of(fields: DataFrame) -> DataFrame:
    """(id, field, token) of each token with a character beyond ASCII; ``fields`` has id, field, text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, tokens = [], [], []
            for i, name, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not text.isascii():
                    for t in set(TOKEN.findall(text)):
                        ids.append(i)
                        names.append(name)
                        tokens.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(tokens, pa.string())], ["id", "field", "token"])

    kind = fields.schema["id"].dataType.simpleString()
    return fields.where("text <> ''").select("id", "field", "text").mapInArrow(go, f"id {kind}, field string, token string")


def _core(token: str) -> str:
    return token.strip(".,;:!?()[]\"'/")


def _clean_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens to clean words: those whose characters sit together as in any language."""
    for batch in batches:
        words, counts = [], []
        for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in {token, _core(token)}:
                if not w.isascii() and REPLACED not in w and not oddness(w):
                    words.append(w)
                    counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])


def _spell(letters: tuple[str, ...]):
    """Odd tokens to what their characters spell; ``letters`` are the characters of the clean words, at most those of Unicode."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = character_forms(letters)
        for batch in batches:
            tokens, originals, counts = [], [], []
            for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if REPLACED not in token and oddness(token):
                    original = spelled(token, tables)
                    if original is not None:
                        tokens.append(token)
                        originals.append(original)
                        counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(originals, pa.string()), pa.array(counts, pa.int64())], ["token", "original", "n"])

    return go


def _garble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], [], [], []]
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w_odd = oddness(word)
            for form, (chain, proof) in garbled_forms(word).items():
                f_odd = oddness(form)
                if f_odd >= w_odd:
                    for column, x in zip(out, (form, word, chain, proof, n, f_odd - w_odd)):
                        column.append(x)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["form", "word", "chain", "proof", "n", "odder"])


EDGES = r"^[.,;:!?()\[\]\"'/]+|[.,;:!?()\[\]\"'/]+$"
#: How many times commoner than its garbled form an original must be where both look equally sound.
COMMONER = 4


def garbled_tokens(fields: DataFrame, more_words: DataFrame | None = None) -> DataFrame:
    """(id, field, token, original) of each garbled token; the original is null
    where it is lost.  ``more_words`` (column ``text``) only adds clean words.

    Only distinct tokens are garbled and joined; the occurrences are joined to
    the verified tokens at the end.
    """
    each = keep(tokens_of(fields))
    own = each.groupBy("token").agg(F.count("*").alias("n"), F.lit(1).alias("asked"))
    source = own
    if more_words is not None:
        other = tokens_of(more_words.select(F.lit(0).cast("long").alias("id"), F.lit("").alias("field"), "text")).groupBy("token").agg(F.count("*").alias("n"), F.lit(0).alias("asked"))
        source = own.unionByName(other).groupBy("token").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    source = keep(source)
    # each word has hundreds of forms: the words are spread over all tasks, and both sides of the join are shuffled by form
    tasks = int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = keep(source.select("token", "n").mapInArrow(_clean_words, "word string, n long"))
    letters = tuple(r.c for r in clean.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c >= '\u0080'").distinct().collect())
    parts = keep(source.where("asked = 1").select("token", "n").mapInArrow(_spell(letters), "token string, original string, n long"))
    restored = parts.select("n", F.explode(F.array_distinct(F.array("original", F.regexp_replace("original", EDGES, "")))).alias("word"))
    known = clean.unionByName(restored.select("word", "n")).repartition(tasks, "word").groupBy("word").agg(F.sum("n").alias("n"))
    forms = known.mapInArrow(_garble, "form string, word string, chain string, proof int, n long, odder int")
    bare = F.regexp_replace("token", EDGES, "")
    asked = source.where("asked = 1").select("token", F.col("n").alias("seen"), F.explode(F.array_distinct(F.array(F.col("token"), bare))).alias("form"))
    hits = asked.hint("merge").join(forms, "form").where(F.col("token") != F.col("word"))
    # a single character is too little to tell one 8-bit encoding from another
    weighty = F.length("form") >= 2
    likely = (F.col("proof") == 1) & (F.col("odder") > 0) | weighty & ((F.col("odder") >= 2) & (F.col("n") * COMMONER >= F.col("seen")) | (F.col("n") >= COMMONER * F.col("seen")))
    best = hits.where(likely).groupBy("token").agg(F.max_by(F.struct("form", "word"), F.struct("proof", "odder", "n", "word")).alias("b"))
    # a form can begin or end with the marks that surround the token
    whole = best.select("token", F.replace(F.col("token"), F.col("b.form"), F.col("b.word")).alias("original"), F.lit(2).alias("rank"))
    parts = parts.select("token", "original", F.lit(1).alias("rank"))
    lost = own.where(F.contains(F.col("token"), F.lit(REPLACED))).select("token", F.lit(None).cast("string").alias("original"), F.lit(0).alias("rank"))
    bad = whole.unionByName(parts).unionByName(lost).groupBy("token").agg(F.max_by("original", "rank").alias("original"))
    return each.hint("merge").join(bad, "token").select("id", "field", "token", "original")


def restore(fields: DataFrame, found: DataFrame) -> DataFrame:
    """(id, field, ``restored``): the affected fields with the originals in place, as far as they survive."""
    swaps = found.where("original is not null").groupBy("id", "field").agg(F.collect_set(F.struct("token", "original")).alias("swaps"))
    rows = fields.join(found.select("id", "field").distinct(), ["id", "field"], "left_semi").dropDuplicates(["id", "field"]).join(swaps, ["id", "field"], "left")
    swap = F.expr(r"array_join(transform(split(text, '(?<=[ \\t\\r\\n])|(?=[ \\t\\r\\n])'), t -> coalesce(try_element_at(map_from_entries(coalesce(swaps, array())), t), t)), '')")
    return rows.select("id", "field", swap.alias("restored"))
