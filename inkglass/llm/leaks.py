"""Passages of held-out test items inside a corpus.

Words (case, punctuation and look-alike differences folded) become template
words: numbers, units and names are replaced by typed placeholders.  Windows
of template words are hash-joined; the slots of each hit are then checked:
equal values are a leaked passage, values that differ by one consistent
mapping are the same question with other parameters.

Fixed meaning: null, empty and shorter texts than a window have no passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalikes import rewriter

WINDOW = 10
#: Items whose windows are kept by every task up to this many (8 bytes each); beyond, all windows are shuffled to the join.
FILTER_ROWS = 2_000_000
WORD = r"[\p{L}\p{N}]+"
# Words for units.
UNITS = frozenset(
    "mm cm m km inch inches foot feet mile miles g kg mg ton tons gram grams pound pounds ounce ounces l ml litre litres liter liters "
    "second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees euro euros dollar dollars "
    "sekunde sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre meter kilometer prozent grad "
    "seconde secondes heure heures jour jours semaine semaines mois an ans mètre mètres pour cent "
    "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años metro metros grados".split()
)
_MASK = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` codes (order matters)."""
    n = len(codes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        x = codes[k : k + n]
        x = (x ^ (x >> np.uint64(29))) * _ODD
        out = (out << np.uint64(7) | out >> np.uint64(57)) ^ (out * np.uint64(3)) ^ x
        out = out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k + 1)
    return out


class _Reader:
    """Texts to words, hashes of words, and hashes of template words."""

    def __init__(self, table: dict[str, str], names: frozenset[str]):
        self.fold, self.names, self.cut = rewriter(table), names, regex.compile(WORD).findall
        self.known: dict[str, tuple[int, int]] = {}
        self.slots = {k: word_hash(f"<{k}>") for k in ("number", "unit", "name")}

    def _codes(self, word: str) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            exact = word_hash(word)
            kind = "number" if word.isnumeric() else "unit" if word in UNITS else "name" if word in self.names else None
            got = (exact, self.slots[kind] if kind else exact)
            if len(self.known) < 1_000_000:
                self.known[word] = got
        return got

    def __call__(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        words = self.cut(self.fold(text).casefold())
        codes = np.array([self._codes(w) for w in words], np.uint64).reshape(-1, 2)
        return words, codes[:, 0], codes[:, 1]


def item_names(items: DataFrame, text_col: str = "text") -> frozenset[str]:
    """Words of the items written with a capital wherever they stand inside a
    sentence and never without: the candidates for name slots.  Read from the
    items only, and so bounded by them."""
    words = items.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?<=[\p{Ll},] )(\p{L}+)"), 1)).alias("w"))
    low = words.groupBy(F.lower("w").alias("w")).agg(F.min(F.col("w").rlike(r"^\p{Lu}\p{Ll}").cast("int")).alias("capital"))
    return frozenset(r.w.casefold() for r in low.where("capital = 1").select("w").collect())


def _window_rows(texts: DataFrame, id_col: str, text_col: str, table, names, size: int, only=None) -> DataFrame:
    """(id, at, template, exact, slots) of each window; with ``only``, a
    broadcast sorted array, of those whose template is in it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader(table, names)
        for batch in batches:
            ids, ats, templates, exacts, slots = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                words, exact, template = read(text)
                if len(words) < size:
                    continue
                t = windows(template, size)
                at = np.arange(len(t))
                if only is not None:
                    known = only.value
                    at = np.nonzero(known[np.minimum(np.searchsorted(known, t), len(known) - 1)] == t)[0]
                if not len(at):
                    continue
                e = windows(exact, size)
                slot = exact != template
                for k in at.tolist():
                    ids.append(i)
                    ats.append(k)
                    slots.append([w for w, s in zip(words[k : k + size], slot[k : k + size]) if s])
                templates.append(t[at].view(np.int64))
                exacts.append(e[at].view(np.int64))
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(ats, pa.int32()), cat(templates), cat(exacts), pa.array(slots, pa.list_(pa.string()))], ["id", "at", "template", "exact", "slots"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.where(F.col(text_col) != "").select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(go, f"id {kind}, at int, template long, exact long, slots array<string>")


def template_hits(docs: DataFrame, items: DataFrame, table: dict[str, str], size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, doc_at, item_at, exact, mapping) of each window of a
    document that has the template of a window of an item."""
    names = item_names(items)
    known = _window_rows(items, "item_id", "text", table, names, size).persist()
    n = known.count()
    only = None
    if 0 < n <= FILTER_ROWS:
        templates = known.select("template").distinct().toPandas()["template"].to_numpy(np.int64).view(np.uint64)
        only = docs.sparkSession.sparkContext.broadcast(np.sort(templates))
    found = _window_rows(docs, "doc_id", "text", table, names, size, only).withColumnsRenamed({"id": "doc_id", "at": "doc_at", "exact": "e", "slots": "s"})
    wanted = known.withColumnsRenamed({"id": "item_id", "at": "item_at"}).dropDuplicates(["item_id", "item_at"])
    wanted = F.broadcast(wanted) if n <= FILTER_ROWS // 20 else wanted
    joined = found.join(wanted, "template")
    # slots are consistent if one value never stands for two others, either way round
    pairs = F.array_distinct(F.arrays_zip(F.col("slots").alias("i"), F.col("s").alias("d")))
    one = (F.size(F.array_distinct("slots")) == F.size(pairs)) & (F.size(F.array_distinct("s")) == F.size(pairs))
    return joined.select("doc_id", "item_id", "doc_at", "item_at", ((F.col("e") == F.col("exact")) & (F.col("slots") == F.col("s"))).alias("exact"), one.alias("consistent"))


def leaked(docs: DataFrame, items: DataFrame, table: dict[str, str], size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id): at least ``size`` consecutive words of the item stand in the document."""
    return template_hits(docs, items, table, size).where("exact").select("doc_id", "item_id").distinct()


def reparameterised(docs: DataFrame, items: DataFrame, table: dict[str, str], size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, windows): only the template of the item stands in the
    document, with other but consistent values in its slots."""
    hits = template_hits(docs, items, table, size).groupBy("doc_id", "item_id").agg(F.max("exact").alias("exact"), F.count_if("consistent").alias("windows"))
    return hits.where("not exact and windows > 0").select("doc_id", "item_id", "windows")
