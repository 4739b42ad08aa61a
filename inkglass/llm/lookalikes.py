"""One form for strings that look alike.

Pairs of alike strings (rules over the character database, and letters of
other scripts drawn alike) are joined to classes by union-find, over single
code points and longer strings; the representative of a class is its member
that the corpus has most of; texts are rewritten by an automaton of all other
members, longest first, until nothing changes.

Alike: width forms, joined letter pairs, composed and combining accents,
characters that do not show, kinds of blanks, letters of other scripts.  Not
alike: case, visible accents, punctuation, raised or fraction signs.

Fixed meaning: null and empty strings have no form and are in no pair.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata as U
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, keep

# Letters of other scripts that are drawn like a Latin one.
SAME_DRAWING = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈͿᎫ",
    "K": "ΚКᏦ", "L": "Ꮮ", "M": "ΜМᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "R": "Ꮢ", "S": "ЅՏᏚ",
    "T": "ΤТᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "р",
    "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
    "Г": "Γ", "П": "Π", "Ф": "Φ", "μ": "µ",
}
#: Characters that do not show, besides those of category Cf.
_HIDDEN = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ" + "".join(chr(c) for c in [*range(0xFE00, 0xFE10), *range(0, 9), 11, 12, *range(14, 32), *range(127, 160)])


class _Union:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = sorted((self.find(a), self.find(b)), key=lambda s: (len(s), s))
        self.up[b] = a


@cache
def alike_pairs() -> list[tuple[str, str]]:
    """Pairs of strings that look the same, by rule."""
    pairs = [(a, b) for a, others in SAME_DRAWING.items() for b in others]
    composed = []
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        kind = U.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        tag, _, rest = U.decomposition(c).rpartition(">") if U.decomposition(c).startswith("<") else ("", "", U.decomposition(c))
        to = "".join(chr(int(x, 16)) for x in rest.split())
        if kind == "Zs":
            pairs.append((" ", c))
        elif kind == "Cf" or c in _HIDDEN:
            pairs.append(("", c))
        elif tag in ("<wide", "<narrow"):
            pairs.append((to, c))
        elif tag == "<compat" and len(to) > 1 and to.isalpha() and c.isalpha():
            pairs.append((to, c))
        elif not tag and len(to) == 1:
            pairs.append((to, c))
        elif not tag and to:
            composed.append((c, to))
    pairs += [("", c) for c in _HIDDEN if ord(c) < 0x80]
    # an accent on any letter drawn like the base is drawn like the composed letter
    base = _Union()
    for a, b in pairs:
        if len(a) == len(b) == 1:
            base.join(a, b)
    members = defaultdict(list)
    for x in list(base.up):
        members[base.find(x)].append(x)
    for c, to in composed:
        for full in {to, U.normalize("NFD", c)}:
            pairs += [(c, b + full[1:]) for b in {full[0], *(members[base.find(full[0])] if full[0] in base.up else ())}]
    return pairs


@cache
def _countable() -> frozenset[str]:
    return frozenset(x for pair in alike_pairs() for x in pair if x)


def count_members(texts: DataFrame, column: str = "text") -> dict[str, int]:
    """Occurrences, in all texts, of the members of look-alike classes: one
    pass, added up per task; the table is bounded by the character database."""

    wanted = _countable()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        pairs = [x for x in wanted if len(x) > 1 and x.isascii()]
        marked = {x for x in wanted if len(x) > 1 and not x.isascii()}
        ascii_count = np.zeros(128, np.int64)
        for batch in batches:
            plain, other = [], []
            for t in batch.column(0).to_pylist():
                if t:
                    (plain if t.isascii() else other).append(t)
            joined = "\n".join(plain)
            ascii_count += np.bincount(np.frombuffer(joined.encode(), np.uint8), minlength=128)[:128]
            rest = "\n".join(other)
            codes, n = np.unique(np.frombuffer(rest.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            total.update({chr(c): int(k) for c, k in zip(codes, n)})
            for x in pairs:
                total[x] += joined.count(x) + rest.count(x)
            if any(U.combining(chr(c)) for c in codes):
                for k in range(1, len(rest)):
                    if U.combining(rest[k]):
                        for n_back in (1, 2):
                            if rest[k - n_back : k + 1] in marked:
                                total[rest[k - n_back : k + 1]] += 1
        total.update({chr(c): int(k) for c, k in enumerate(ascii_count) if k})
        keep = [(x, n) for x, n in total.items() if x in wanted]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.string()), pa.array([n for _, n in keep], pa.int64())], ["member", "n"])

    counted = texts.select(column).mapInArrow(go, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))
    return {r.member: r.n for r in counted.collect()}


def rewrites(counts: dict[str, int]) -> dict[str, str]:
    """Every member of a look-alike class that is not its representative, with
    the representative.  Ties go to the lowest code points; characters that do
    not show are left out."""
    union, hidden = _Union(), []
    for a, b in alike_pairs():
        if a == "":
            hidden.append(b)
        else:
            union.join(a, b)
    members = defaultdict(list)
    for x in list(union.up):
        members[union.find(x)].append(x)
    table = {}
    for group in members.values():
        best = min(group, key=lambda x: (-counts.get(x, 0), len(x) > 1 and not x.isascii(), x))
        table.update({x: best for x in group if x != best})
    return table | {x: "" for x in hidden}


class Rewriter:
    """Greedy rewriting by an automaton over all patterns."""

    def __init__(self, table: dict[str, str]):
        import ahocorasick

        self.table = table
        self.automaton = ahocorasick.Automaton()
        for x, to in table.items():
            self.automaton.add_word(x, (len(x), to))
        self.automaton.make_automaton()
        # a text without any of these has no pattern
        self.signs = frozenset(x[-1] if x.isascii() or not x[-1].isascii() else next(c for c in x if not c.isascii()) for x in table)
        self.ascii_stays = not any(x.isascii() and x.isprintable() for x in table)

    def __call__(self, text: str) -> str:
        if text.isascii() and self.ascii_stays and text.isprintable():
            return text
        if self.signs.isdisjoint(text):
            return text if text.isascii() else U.normalize("NFC", text)
        for _ in range(len(text) + 8):  # a rewrite can make room for another
            out, at = [], 0
            for end, (size, to) in self.automaton.iter_long(text):
                out += (text[at : end + 1 - size], to)
                at = end + 1
            if not out:
                break
            text = "".join(out) + text[at:]
        else:
            raise RuntimeError("rewriting does not come to an end")
        return text if text.isascii() else U.normalize("NFC", text)


_REWRITERS: dict[int, Rewriter] = {}


def rewriter(table: dict[str, str]) -> Rewriter:
    """The worker's automaton for a table."""
    key = hash(frozenset(table.items()))
    if key not in _REWRITERS:
        _REWRITERS[key] = Rewriter(table)
    return _REWRITERS[key]


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def canonical(texts: DataFrame, table: dict[str, str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(src, id, ``form``) of every non-empty text; ``texts`` has column ``src`` too."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = rewriter(table)
        for batch in batches:
            forms = [fold(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.string())], ["src", "id", "form"])

    rows = texts.where(F.col(text_col) != "").select("src", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(go, f"src string, id {_kind(texts, id_col)}, form string")


def alike_rows(texts: DataFrame, table: dict[str, str]) -> DataFrame:
    """(src, id, raw, form): 16-byte digests of each string and of its form."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = rewriter(table)
        digest = lambda s: hashlib.md5(s.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        for batch in batches:
            raw, form = [], []
            for t in batch.column(2).to_pylist():
                f = fold(t)
                raw.append(digest(t))
                form.append(raw[-1] if f == t else digest(f))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(form, pa.binary())], ["src", "id", "raw", "form"])

    return texts.where("text <> ''").select("src", "id", "text").mapInArrow(go, f"src string, id {_kind(texts, 'id')}, raw binary, form binary")


#: Parts that the strings of one form are spread over when they are paired.
SHARES = 16


def classes(texts: DataFrame, table: dict[str, str]) -> DataFrame:
    """(src, id, class_id, strings, links): each string that looks like a different
    one, with the least id of its class, how many different strings the class
    has, and how many rows with another string it is linked to; two
    aggregations, no pairs."""
    rows = alike_rows(texts, table).distinct()
    strings = cut(rows.groupBy("src", "form", "raw").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    forms = strings.groupBy("src", "form").agg(F.min("first").alias("class_id"), F.count("*").alias("strings"), F.sum("copies").alias("rows")).where("strings > 1")
    counted = strings.join(forms, ["src", "form"]).select("src", "form", "raw", "class_id", "strings", (F.col("rows") - F.col("copies")).alias("links"))
    return rows.join(counted, ["src", "form", "raw"]).select("src", "id", "class_id", "strings", "links")


def alike_pairs_of(texts: DataFrame, table: dict[str, str]) -> DataFrame:
    """(src, id_a, id_b), id_a < id_b: strings that differ but look the same.

    Different strings of a form are paired first (copies stay together), then
    each pair of strings gets the ids of both sides; so no row is made that is
    not a result, and copies of one string are never compared.
    """
    rows = keep(alike_rows(texts, table).distinct())
    strings = rows.groupBy("src", "form", "raw").agg(F.lit(1).alias("one"))
    mixed = strings.groupBy("src", "form").count().where("count > 1").select("src", "form")
    few = rows.join(mixed, ["src", "form"], "left_semi").groupBy("src", "form", "raw", "id").agg(F.lit(1).alias("one")).drop("one")
    # a form that many strings share is spread: each string meets all others of its form, in the task of its own share
    left = few.select("src", "form", F.col("raw").alias("raw_a")).distinct()
    share = F.pmod(F.xxhash64("raw_a"), F.lit(SHARES))
    right = left.select("src", "form", F.col("raw_a").alias("raw_b"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    both = left.withColumn("share", share.cast("int")).join(right, ["src", "form", "share"]).where("raw_a < raw_b")
    a = few.select("src", "form", F.col("raw").alias("raw_a"), F.col("id").alias("x"))
    b = few.select("src", "form", F.col("raw").alias("raw_b"), F.col("id").alias("y"))
    pairs = both.join(a, ["src", "form", "raw_a"]).join(b, ["src", "form", "raw_b"])
    return pairs.where("x <> y").select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
