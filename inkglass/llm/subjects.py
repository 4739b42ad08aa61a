"""Subjects of documents, by an accuracy-learning model over labelling functions.

Labelling functions say, of a document and a subject, how strongly they see it:

* lexicon - lines and sentences with a word of the subject's lexicon,
* section - a word of the lexicon in the heading or title line,
* address - a word of the lexicon in a web or mail address or a path,
* source  - the folder the document comes from.

The lexicon starts from the names of the subjects and what the table of subjects
says they are about, in four languages, and is grown from the corpus: a word
joins a subject's lexicon if, over all documents, it stands mostly where that
subject is known (by the lexicon so far, or by a label of the document).  How
far each function can be trusted is learned without labels by expectation
maximisation over the counts of vote patterns, and each document gets the
subjects of posterior above one half that it comes back to, i.e. that more than
one of its lines or sentences names.

Texts are read once: what later steps read are 64-bit hashes of the words of
each line or sentence.

Fixed meaning: null and empty texts have no subject; a document may have none.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, keep
from .lookalikes import rewriter, rewrites

# The names of the subjects and the words of their descriptions, in English, German, French and Spanish.
SEEDS = {
    "medicine": "medicine health treatment medizin gesundheit behandlung pflege médecine santé traitement soins medicina salud tratamiento",
    "law": "law court courts contract contracts legal claim claims recht gericht gerichte vertrag verträge klage droit tribunal tribunaux contrat contrats juridique derecho tribunal contrato contratos demanda",
    "finance": "finance money bank banking tax taxes finanzen geld steuer steuern argent banque impôt impôts finanzas dinero banco impuesto impuestos",
    "travel": "travel journey journeys lodging border borders reise reisen unterkunft grenze grenzen voyage voyages hébergement frontière frontières viaje viajes alojamiento frontera fronteras",
    "cooking": "cooking food kochen essen speise cuisine nourriture cocina comida",
    "sport": "sport sports games training competition competitions spiel spiele wettkampf wettkämpfe jeux entraînement compétition compétitions deporte juegos entrenamiento competición competiciones",
    "software": "software program programs computer computers programm programme rechner logiciel ordinateur ordinateurs programa programas ordenador ordenadores",
    "schooling": "schooling school study exam exams schule studium prüfung prüfungen école études examen examens escuela estudio exámenes",
    "housing": "housing home homes renting rent repairs wohnen wohnung miete reparaturen logement loyer réparations vivienda alquiler reparaciones",
    "vehicles": "vehicle vehicles car cars driving fahrzeug fahrzeuge auto autos fahren véhicule véhicules voiture voitures conduite vehículo vehículos coche coches conducción",
    "science": "science research nature wissenschaft forschung natur recherche ciencia investigación naturaleza",
    "gardening": "gardening plant plants garden pflanze pflanzen garten gartenarbeit jardinage plante plantes jardin jardinería planta plantas jardín",
}

WORD = re.compile(r"[^\W\d_]{3,}")
UNIT = re.compile(r"\n+|(?<=[.!?;])\s+")
ADDRESS = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\w+|\b\w+(?:[-.]\w+)+\.(?:example|com|org|net|test|invalid)\S*|(?:\w+/){2,}\w*")
#: A word joins a lexicon with at least this many documents of known subject and this share of them in the subject.
MIN_DOCS, MIN_SHARE, MIN_LEAD = 4, 0.40, 2.0
#: ... and this many standard deviations above what chance would give.
MIN_SIGMAS = 5.0
#: The lexicon grows until a round changes less than this share of it, for so many rounds at most.
STILL, ROUNDS = 0.01, 8


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _places(text: str, units: list[tuple[str, set[str]]]) -> tuple[set[str], set[str]]:
    """Words of headings, and of addresses."""
    head, address, begun = set(), set(), 0
    for unit, words in units:
        if not words:
            continue
        # the first short line is a heading; a line of a clock or a greeting may stand before it
        if unit.startswith("#") or begun == 0 and len(unit) < 90:
            head |= words
        if not (begun == 0 and len(unit) < 25):
            begun = 1
    if "@" in text or "/" in text or "www." in text or ".example" in text:
        for found in ADDRESS.findall(text):
            address.update(WORD.findall(found.casefold()))
    return head, address


def read_words(docs: DataFrame) -> DataFrame:
    """``docs`` with hashes of words instead of the text: ``words`` of all lines
    and sentences, each word once in each, ``ends`` where each line or sentence
    ends among them, and the words of ``head`` and ``address``."""
    alike = rewrites({})
    kept = [c for c in docs.columns if c != "text"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, code = rewriter(alike), {}

        def coded(words: set[str]) -> list[int]:
            out = []
            for w in words:
                c = code.get(w)
                if c is None:
                    c = code[w] = _code(w)
                out.append(c)
            return out

        for batch in batches:
            words, ends, heads, addresses = [], [], [], []
            for text in batch.column(len(kept)).to_pylist():
                text = fold(text)
                units = [(u, set(WORD.findall(u.casefold()))) for u in UNIT.split(text)]
                every, upto = [], []
                for _, own in units:
                    every += coded(own)
                    upto.append(len(every))
                head, address = _places(text, units)
                words.append(every)
                ends.append(upto)
                heads.append(coded(head))
                addresses.append(coded(address))
            if len(code) > 1_000_000:
                code.clear()
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(words, longs), pa.array(ends, pa.list_(pa.int32())), pa.array(heads, longs), pa.array(addresses, longs)], [*kept, "words", "ends", "head", "address"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, "text").mapInArrow(go, f"{schema}, words array<long>, ends array<int>, head array<long>, address array<long>")


def _known(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """Documents with the number of their label's subject, or -1.  Labels that disagree say nothing."""
    clean = labels.where("subject is not null").select("doc_id", F.lower(F.trim("subject")).alias("s"))
    number = F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (s.lower(), i)])
    one = clean.groupBy("doc_id").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a = b").select("doc_id", F.try_element_at(number, F.col("a")).alias("label"))
    return docs.join(one, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))


class Lexicon:
    """Sorted hashes of words and the subject of each: 12 bytes a word, sent to every task."""

    def __init__(self, words: dict[int, int]):
        self.codes = np.array(sorted(words), np.int64)
        self.subject = np.array([words[c] for c in self.codes.tolist()], np.int32)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The subject of each word, or -1."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.subject[at], -1)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    return values, np.repeat(np.arange(len(column)), sizes)


def _named(words: pa.Array, ends: pa.Array, lexicon: Lexicon, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and rows of all words; of each row and subject, how many units and how many different words name it."""
    codes, row = _flat(words)
    starts = np.zeros(len(words), np.int64)
    np.cumsum(np.diff(words.offsets.to_numpy())[:-1], out=starts[1:])
    upto, unit_row = _flat(ends)
    s = lexicon.find(codes)
    hit = np.nonzero(s >= 0)[0]
    unit = np.searchsorted(upto + starts[unit_row], hit, side="right")
    units, different = np.zeros((len(words), n), np.int64), np.zeros((len(words), n), np.int64)
    pairs = np.unique(unit * n + s[hit])
    np.add.at(units, (unit_row[pairs // n], pairs % n), 1)
    seen = np.unique(np.stack([row[hit], codes[hit], s[hit]]), axis=1)
    np.add.at(different, (seen[0], seen[2]), 1)
    return codes, row, units, different


def _count_words(docs: DataFrame, lexicon: Lexicon, n: int) -> DataFrame:
    """(word, n0, ...): in how many documents of each subject the word stands, and last in how many of known subject; added up per batch before the shuffle."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, row, units, different = _named(batch.column(0), batch.column(1), lexicon, n)
            # known by two words at least: no word makes itself known
            by = ((units >= 2) & (different >= 2)).astype(np.int64)
            label = np.array(batch.column(2).to_pylist(), np.int64)
            told = np.nonzero(label >= 0)[0]
            by[told, label[told]] = 1
            by = np.concatenate([by, by.any(axis=1, keepdims=True).astype(np.int64)], axis=1)
            use = by[row, n] > 0
            pairs = np.unique(np.stack([codes[use], row[use]]), axis=1)
            words, at = np.unique(pairs[0], return_inverse=True)
            total = np.zeros((len(words), n + 1), np.int64)
            np.add.at(total, at.ravel(), by[pairs[1]])
            yield pa.RecordBatch.from_arrays([pa.array(words), *(pa.array(total[:, k]) for k in range(n + 1))], ["word", *names])

    names = [f"n{k}" for k in range(n + 1)]
    counted = docs.select("words", "ends", "label").mapInArrow(go, "word long, " + ", ".join(f"{c} long" for c in names))
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in names]).where(F.col(names[-1]) >= MIN_DOCS)


def grow(docs: DataFrame, lexicon: dict[int, int], seeds: dict[int, int], n: int) -> dict[int, int]:
    """The next lexicon: words that pass, and first words that the corpus says
    too little about.  Words are judged in Spark; what comes to the driver are
    hashes of the words of one subject."""
    counts = keep(_count_words(docs, Lexicon(lexicon), n))
    base = counts.agg(*[F.max(f"n{i}").alias(f"n{i}") for i in range(n + 1)]).first()  # the commonest words stand in nearly all documents
    prior = [max(base[i] or 0, 1) / max(base[n] or 1, 1) for i in range(n)]
    total = F.col(f"n{n}")
    share = [F.col(f"n{i}") / total for i in range(n)]
    # clearly more than the subject's share of all documents; where that is large, nearly always
    each = F.array(*[F.struct((x / F.lit(p)).alias("score"), x.alias("share"), F.lit(i).alias("s"), F.lit(p).alias("prior"), F.lit(max(MIN_SHARE, min(3 * p, 0.9))).alias("needed")) for i, (x, p) in enumerate(zip(share, prior))])
    ranked = counts.select("word", total.alias("all"), F.reverse(F.array_sort(each)).alias("r"))
    top, second = F.col("r")[0], F.coalesce(F.try_element_at("r", F.lit(2))["score"], F.lit(0.0))
    sigmas = (top["share"] - top["prior"]) * F.col("all") / F.greatest(F.sqrt(F.col("all") * top["prior"] * (1 - F.least(top["prior"], F.lit(0.99)))), F.lit(1e-9))
    good = (top["share"] >= top["needed"]) & (top["score"] >= MIN_LEAD * second) & (sigmas >= MIN_SIGMAS)
    rows = ranked.select("word", top["s"].alias("s"), good.alias("good")).where(F.col("good") | F.col("word").isin(list(seeds))).collect()
    counts.unpersist()
    out = {w: s for w, s in seeds.items() if w not in {r.word for r in rows}}
    return out | {r.word: r.s for r in rows if r.good}


LEVELS = (4, 2, 2, 2)  # votes of each function: lexicon 0, 1, 2, 3 and more; the others no or yes


def _patterns(docs: DataFrame, lexicon: Lexicon, favoured: dict[str, int], n: int) -> DataFrame:
    """(doc_id, subject, pattern, named) of subjects that any function but the source sees."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, named, _ = _named(batch.column(2), batch.column(3), lexicon, n)
            votes = []
            for k in (4, 5):
                codes, row = _flat(batch.column(k))
                s, seen = lexicon.find(codes), np.zeros((batch.num_rows, n), bool)
                seen[row[s >= 0], s[s >= 0]] = True
                votes.append(seen)
            source = np.array([favoured.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            row, s = np.nonzero((named > 0) | votes[0] | votes[1])
            count = named[row, s]
            pattern = ((np.minimum(count, 3) * 2 + votes[0][row, s]) * 2 + votes[1][row, s]) * 2 + (source[row] == s)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(s, pa.int32()), pa.array(pattern, pa.int32()), pa.array(count, pa.int32())], ["doc_id", "s", "pattern", "named"])

    return docs.select("doc_id", "source", "words", "ends", "head", "address").mapInArrow(go, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, s int, pattern int, named int")


def learn(counts: pd.DataFrame, n_docs: int, n: int, rounds: int = 60) -> np.ndarray:
    """Posterior of each (subject, pattern) by expectation maximisation; the
    functions are taken as independent given the truth, each with one accuracy
    for all subjects, and each subject with its own share of documents."""
    size = int(np.prod(LEVELS))
    votes = np.array(np.unravel_index(np.arange(size), LEVELS))
    c = np.zeros((n, size))
    np.add.at(c, (counts.s.to_numpy(int), counts.pattern.to_numpy(int)), counts.n.to_numpy(float))
    c[:, 0] += np.maximum(n_docs - c.sum(1), 0)
    q = np.tile(np.where(votes[0] >= 2, 0.9, 0.02), (n, 1))
    for _ in range(rounds):
        total = []
        for weight in (q, 1 - q):
            log = np.log(np.maximum((c * weight).sum(1), 1e-6))[:, None] + np.zeros(size)
            for k, levels in enumerate(LEVELS):
                p = np.array([(c * weight)[:, votes[k] == v].sum() + 0.5 for v in range(levels)])
                log = log + np.log(p / p.sum())[votes[k]]
            total.append(log)
        q = 1 / (1 + np.exp(np.clip(total[1] - total[0], -50, 50)))
    return q


def lexicon_of(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> tuple[DataFrame, dict[int, int]]:
    n = len(subjects)
    at = {s.lower(): i for i, s in enumerate(subjects)}
    found: dict[int, set] = defaultdict(set)
    for s, i in at.items():
        for w in f"{s} {SEEDS.get(s, '')}".split():
            found[_code(w.casefold())].add(i)
    seeds = {w: next(iter(x)) for w, x in found.items() if len(x) == 1}
    known, lexicon = _known(cut(read_words(docs.where("text <> ''").select("doc_id", "source", "text"))), labels, subjects), seeds
    for _ in range(ROUNDS):
        last, lexicon = lexicon, grow(known, lexicon, seeds, n)
        if len(last.items() ^ lexicon.items()) <= STILL * len(lexicon):
            break
    return known, lexicon


def assign(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, subject) of every subject that a document deals with."""
    n = len(subjects)
    if not n:
        return docs.select("doc_id", F.lit(None).cast("string").alias("subject")).limit(0)
    known, lexicon = lexicon_of(docs, labels, subjects)
    # a folder favours the subject that labels give most of its documents, if they do so clearly
    per = known.where("label >= 0").groupBy("source", "label").count().groupBy("source").agg(F.max_by("label", "count").alias("s"), F.max("count").alias("top"), F.sum("count").alias("all"))
    favoured = {r.source: r.s for r in per.where("all >= 20 and top >= 0.5 * all").collect()}
    patterns = cut(_patterns(known, Lexicon(lexicon), favoured, n))
    counts = patterns.groupBy("s", "pattern").agg(F.count("*").alias("n")).toPandas()
    post = learn(counts, known.count(), n)
    yes = [s * post.shape[1] + p for s in range(n) for p in range(post.shape[1]) if post[s, p] > 0.5]
    names = F.array(*[F.lit(s) for s in subjects])
    chosen = patterns.where((F.col("s") * post.shape[1] + F.col("pattern")).isin(yes) & (F.col("named") >= 2))
    return chosen.select("doc_id", names[F.col("s")].alias("subject")).distinct()
