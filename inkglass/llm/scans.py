"""Noise of scanned pages: found, and repaired into readable paragraphs.

Words are counted once over the whole corpus.  For each word that the clean
part of the corpus does not have, candidates for what stood on the page are all
known words no further than ``FAR`` from it, found by joining keys of which two
such words always share one (see ``keys_of``); a gradient-boosted ranker, fitted on bounded samples that label themselves
(digits and signs inside words; pairs of known words), chooses among them.

Lines are classified in pairs, each by a booster of its own: a title with the
same line on other pages of its file, a number with those of other pages and
with the title beside it, and the two lines of a word cut in two, over what the
corpus says of the word with and without the mark.

Fixed meaning: null and empty texts are no noise; repeated rows count once; a
word that the corpus gives no known original for is left as it is; a line
without a number has no neighbours; lines of one page whose numbers are more
than ``CONTEXT`` apart are no neighbours.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, keep
from .boosting import Booster

# Letters and signs that recognition takes for each other have one shape; then pairs of shapes that look like one.
PAIRS = (("rn", "m"), ("nn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ri", "n"), ("li", "h"), ("fi", "h"))
ONE_SHAPE = {"o": "0oaQöóòôáàâäåqg9", "e": "ceéèêëç€¢", "l": "l1i!|ítjïîìf†", "s": "s5$ß§z2", "b": "b6h8k", "u": "uvüúùûy", "n": "nñ"}
SHAPE_PAIRS = (("rn", "m"), ("nn", "m"), ("el", "d"), ("rl", "n"), ("ll", "u"), ("uu", "w"))
#: The other order, for words where one pair hides another.
OTHER_PAIRS = (("ll", "u"), ("rl", "n"), ("uu", "w"), ("el", "d"), ("rn", "m"), ("nn", "m"))
_SHAPE = {c: k for k, letters in ONE_SHAPE.items() for c in letters}
MARKS = "-‐‑¬\xad"
_STRIP = ".,;:!?()[]{}\"“”„«»…–—•*<>/"
_STRIP_LEFT = _STRIP.replace("!", "").replace("|", "")
_END = regex.compile(rf"(\p{{L}}[\p{{L}}\p{{N}}!|]*)[{MARKS}]$")
_START = regex.compile(r"^[\p{L}\p{N}!|]+")
_ROMAN = regex.compile(r"^(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
# Forms of a line that is a page number and says so.
_NUMBERED = regex.compile(r"^(?:[-–—~*•|\[(<]+\s*[\divxlcIl!|Oo]{1,5}\s*[-–—~*•|\])>]+|[\dIl!|Oo]{1,4}\s*/\s*[\dIl!|Oo]{1,4}|\d{1,4}\s+(?i:of|von|de|sur)\s+\d{1,4})$")
_NAMED = regex.compile(r"^(\p{L}[\p{L}\d!|]*\.?)\s*[\dIlOo!|]{1,5}(?:\s*(?i:[o0][ft]|von|de|sur|/)\s*[\dIlOo!|]{1,5})?$")
PAGE_WORDS = "page pagina página seite pag pág pg pp p s"
_PLAIN = regex.compile(r"^\d{1,4}$")
_SIDE = regex.compile(r"\s{2,}")
#: A page goes to a task in parts of this many line numbers; each part also has the lines that stand this near on either side.
PART, CONTEXT = 400, 24
#: Known words: this share of all words of clean text, or of scanned pages, and three times at least.
CLEAN_SHARE, SCAN_SHARE = 2e-6, 1e-4
#: Samples that the boosters are fitted on at most, taken by hash.
SAMPLE = 4000


def shape(word: str, pairs=SHAPE_PAIRS) -> str:
    """The word with everything recognition confuses made the same."""
    w = "".join([_SHAPE.get(c, c) for c in word.casefold()])
    for _ in range(2):
        for a, b in pairs:
            w = w.replace(a, b)
    return w


def says_number(text: str) -> bool:
    """A page number in a form that says so, perhaps misread."""
    if _NUMBERED.match(text):
        return True
    m = _NAMED.match(text)
    return bool(m) and shape(m[1].rstrip(".")) in _PAGE_WORDS


_PAGE_WORDS = frozenset(shape(w) for w in PAGE_WORDS.split())


@lru_cache(100_000)
def title_shape(line: str) -> str:
    """A running line without the page number at its side."""
    parts = [p for p in _SIDE.split(line.strip()) if p]
    if len(parts) > 1:
        kept = [p for p in parts if not (says_number(p) or _PLAIN.match(p) or _ROMAN.match(p.casefold()))]
        parts = kept or parts
    return "".join(c for c in shape(" ".join(parts)) if c.isalnum() or c == "ſ")


def tokens_of(line: str, first_half: bool, second_half: bool) -> list[str]:
    """The whole tokens of a line, without halves of cut words."""
    tokens = line.replace("'", " ").replace("’", " ").split()
    if first_half and tokens:
        tokens.pop()
    if second_half and tokens:
        tokens.pop(0)
    return tokens


def word_of(token: str) -> str | None:
    """The word inside a token, if there is one."""
    w = token.rstrip(_STRIP).lstrip(_STRIP_LEFT)
    return w if sum(map(str.isalpha, w)) >= 2 and not any(c in "@_/\\=+#&%" for c in w) else None


def pages(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, grp, page, part, own, upto, no, rec, text) with the lines of a page,
    or of a block that keeps its lines, in order: one shuffle of the lines, which
    also drops repeated rows.  A long page is several parts; lines before ``own``
    and from ``upto`` on are those of the neighbouring parts."""
    number = F.col("line_no")
    at = F.floor(number / PART).cast("int")
    near = F.when((F.pmod(number, F.lit(PART)) < CONTEXT) & (number >= PART), F.array(at, at - 1)).when(F.pmod(number, F.lit(PART)) >= PART - CONTEXT, F.array(at, at + 1)).otherwise(F.array(at))
    # lines without a number stand alone, spread over many parts
    parts = F.coalesce(near, F.array((-1 - F.pmod(F.xxhash64("line_id"), F.lit(4096))).cast("int")))
    line = F.struct(F.coalesce(number, F.lit(-1)).alias("no"), F.col("line_id").alias("rec"), F.col("text").alias("text"))
    each = lines.where("text is not null").select(F.coalesce("file_id", F.lit(-1)).alias("grp"), F.coalesce("page", F.lit(-1)).alias("page"), F.explode(parts).alias("part"), line.alias("line"))
    by_page = each.groupBy("grp", "page", "part").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    text_line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("no"), F.col("block_id").alias("rec"), x.alias("text")))
    by_block = blocks.where("text <> ''").select(F.coalesce("section_id", F.lit(-1)).alias("grp"), F.coalesce("block_no", F.lit(-1)).alias("page"), F.lit(0).alias("part"), text_line.alias("lines"))
    all_pages = by_page.select(F.lit("line").alias("src"), "*").unionByName(by_block.select(F.lit("block").alias("src"), "*"))
    is_part = (F.col("src") == "line") & (F.col("part") >= 0)
    below = F.when(is_part, F.size(F.filter("lines", lambda x: x["no"] < F.col("part") * PART))).otherwise(0)
    above = F.when(is_part, F.size(F.filter("lines", lambda x: x["no"] >= (F.col("part") + 1) * PART))).otherwise(0)
    field = lambda name: F.transform("lines", lambda x: x[name]).alias(name)
    return all_pages.select("src", F.col("grp").cast("long").alias("grp"), F.col("page").cast("int").alias("page"), "part", below.alias("own"), (F.size("lines") - above).alias("upto"), field("no"), field("rec"), field("text")).where("own < upto")


def _wrapped(texts: list[str]) -> bool:
    """Lines of a scanned page rather than of a list or of fields."""
    if len(texts) < 3:
        return False
    plain = [t for t in texts if t and not t.lstrip().startswith(("•", "-", "*", "☐", "["))]
    running_on = sum(1 for a, b in zip(texts, texts[1:]) if a and b and a[-1] not in ".!?:" and (b[0].islower() or b[0].isdigit()))
    return len(plain) >= 0.7 * len(texts) and running_on >= 0.3 * (len(texts) - 1) and max(map(len, texts)) <= 110


_KIND = "t string, src string, grp long, page int, no int, rec long, a string, b string, n long, foot int"
#: Of numbers inside pages, which show what page numbers are not, one in so many is taken.
INSIDE = 4


def read_pages(all_pages: DataFrame) -> DataFrame:
    """One pass over all lines.  Rows, by ``t``: 'word' (a: word, n: times on
    scanned pages, grp: in clean text), 'edge' (a line at the head or foot of a
    page, or of a scanned block: a: its shape, b: the text), 'inner' (a: shape of
    a line inside a page that could be a title), 'number' and 'inside' (a number
    at the edge or inside; b: form, n: value), 'cut' (a: first half and mark; b:
    what the next lines begin with), 'top' (a: what a page's first lines begin with)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, clean = Counter(), Counter()
        names = [x.split()[0] for x in _KIND.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

        def words():
            count: dict[str, list[int]] = {}
            for k, tokens in enumerate((scan, clean)):
                for token, n in tokens.items():
                    w = word_of(token)
                    if w:
                        count.setdefault(w.lower(), [0, 0])[k] += n
                tokens.clear()
            return batch_of([("word", None, b, None, None, None, w, None, a, None) for w, (a, b) in count.items()])

        def starts(texts, nos, recs):
            """What lines begin with, up to the first that can only be text."""
            for t, no, rec in zip(texts, nos, recs):
                t = t.strip()
                m = _START.match(t)
                yield m[0] if m else "", no, rec
                if t and t[0].islower():
                    return

        def read(rows, src, grp, page, part, own, upto, nos, recs, texts):
            is_line, n = src == "line", len(texts)
            half = own > 0 and (t := texts[own - 1].strip()) and t[-1] in MARKS and bool(_END.search(t))
            for k in range(own, upto):
                text = texts[k].strip()
                cut_here = _END.search(text) if text and text[-1] in MARKS else None
                scan.update(tokens_of(text, bool(cut_here), half))
                half = bool(cut_here)
                if not text or part < 0:
                    continue
                edge, foot = not is_line or k < 3 or k >= n - 3, k >= n - 3
                place = (src, grp, page, nos[k], recs[k])
                form = None
                if text[-1] in _NUMBER_ENDS and (edge or k % INSIDE == 0):
                    low = text.casefold()
                    form = "said" if says_number(text) else "plain" if _PLAIN.match(text) else "roman" if _ROMAN.match(low) else None
                first = text[0]
                title_like = not first.islower() and text[-1] not in _NO_TITLE
                if form:
                    digits = regex.search(r"\d+", text)
                    value = _roman(low) if form == "roman" else int(digits[0][-18:]) if digits else -1
                    rows.append(("number" if edge else "inside", *place, None, form, value, int(foot)))
                elif is_line and (k < 2 or k >= n - 2) or not is_line and title_like:
                    s = title_shape(text)
                    if 5 <= len(s):
                        rows.append(("edge", *place, s, text, None, int(foot)))
                elif title_like and len(text) <= 50 and first.isupper() and text.count(" ") <= 5:
                    rows.append(("inner", *place, title_shape(text), None, None, None))
                if cut_here:
                    nexts = "\n".join(f"{no}\t{word}\t{rec}" for word, no, rec in starts(texts[k + 1 :], nos[k + 1 :], recs[k + 1 :]))
                    rows.append(("cut", *place, cut_here[1] + text[-1], nexts, None, int(foot)))
            if is_line and part >= 0 and own == 0:
                rows.extend(("top", src, grp, page, no, rec, word, None, None, None) for word, no, rec in starts(texts, nos, recs))

        for batch in batches:
            rows = []
            for src, grp, page, part, own, upto, nos, recs, texts in zip(*(batch.column(k).to_pylist() for k in range(9))):
                if src == "line" or _wrapped(texts):
                    read(rows, src, grp, page, part, own, upto, nos, recs, texts)
                else:
                    for t in texts:
                        clean.update(tokens_of(t, False, False))
            if rows:
                yield batch_of(rows)
            if len(scan) + len(clean) > 400_000:
                yield words()
        yield words()

    return all_pages.mapInArrow(go, _KIND)


_NUMBER_ENDS = frozenset("0123456789ivxlcIVXLC!|Oo])>-–—~*•")
_NO_TITLE = frozenset(".,;:!?" + MARKS)


def _roman(s: str) -> int:
    v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def _sample(rows: DataFrame, yes: Column, no: Column, order: Column, *columns: str) -> tuple[np.ndarray, np.ndarray]:
    """Up to SAMPLE rows that say yes and as many that say no, the least by ``order``, in one job."""
    some = [rows.where(c).orderBy(order).limit(SAMPLE).select(F.lit(y).alias("y"), F.array(*[F.col(x).cast("double") for x in columns]).alias("f")) for y, c in ((1.0, yes), (0.0, no))]
    got = some[0].unionByName(some[1]).toPandas()
    return np.array(got.f.to_list(), float).reshape(-1, len(columns)), got.y.to_numpy(float)


def _judged(rows: DataFrame, model: Booster, keys: str, *features: str) -> DataFrame:
    """The ``keys`` (a schema) of the rows that the model finds likely."""
    names = [k.split()[0] for k in keys.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([batch.column(len(names) + k).to_numpy(zero_copy_only=False) for k in range(len(features))], float).T
            good = pa.array(model.probability(f) >= 0.5) if len(f) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(names))], names).filter(good)

    return rows.select(*names, *[F.col(x).cast("double").alias(x) for x in features]).mapInArrow(go, keys)


def running_lines(rows: DataFrame) -> DataFrame:
    """(src, no, rec, grp, page) of titles that recur from page to page: each
    line at an edge is paired with the same line on other pages of its file; how
    many pages have it, how densely, and how often such lines stand inside pages
    is what the classifier judges by."""
    lines = rows.where("t in ('edge', 'inner')").withColumn("edge", F.col("t") == "edge")
    of_line = F.col("src") == "line"
    shapes = lines.where("edge").groupBy("src", "grp", "a").agg(F.min("page").alias("p"), F.max("page").alias("q"), F.count_distinct("page").alias("n"), F.avg("foot").alias("foot"))
    places = lines.where(of_line).groupBy("a").agg(F.sum(F.when(F.col("edge"), 0).otherwise(1)).alias("inner"), F.sum(F.when(F.col("edge"), 1).otherwise(0)).alias("outer")).where("inner > 0")
    each = shapes.join(places, "a", "left").fillna(0, ["inner", "outer"])
    known = cut(each.withColumns({"dense": F.col("n") / (F.col("q") - F.col("p") + 1), "size": F.length("a"), "table": F.log1p("inner") - F.log1p("outer"), "pages": F.log1p("n")}))
    by = ("dense", "pages", "table", "foot", "size")
    again = known.where("p < q")
    yes = (F.col("inner") == 0) & (F.col("n") >= 2) & (F.col("dense") >= 0.25)
    no = (F.col("inner") > F.col("outer")) | (F.col("dense") < 0.25)
    model = Booster().fit(*_sample(again, yes, no, F.xxhash64("grp", "a"), *by))
    ways = _judged(again, model, "src string, grp long, a string", *by)
    # other misreadings of a title, anywhere in its file
    near = near_titles(known.where("inner <= outer").select("src", "grp", "a").join(ways, ["src", "grp", "a"], "left_anti"), ways)
    found = lines.where("edge").join(ways.unionByName(near), ["src", "grp", "a"])
    return found.select("src", "no", "rec", "grp", "page").distinct()


def near_titles(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """(src, grp, a) of asked lines that are nearly a title of their file: one
    letter in six of the title may differ, at least one.

    That is one letter in five of the line at most.  A line is split into one
    piece more than that, so one piece at least is whole in the title, moved by
    no more places than letters may differ; only such pairs are compared."""
    few = lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 6)).cast("int")
    pieces = lambda c, starts, long: F.transform(starts, lambda at: F.struct(at.alias("at"), F.substring(c, at + 1, long).alias("piece")))
    lines = asked.join(titles.select("src", "grp").distinct(), ["src", "grp"], "left_semi").withColumn("line", F.xxhash64("a"))
    known = titles.withColumnRenamed("a", "known").withColumn("title", F.xxhash64("known"))
    split = lines.withColumn("many", F.greatest(F.lit(2), F.floor(F.length("a") / 5) + 1).cast("int")).withColumn("size", F.floor(F.length("a") / F.col("many")).cast("int"))
    starts = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda k: k * F.col("size"))
    of_lines = split.select("src", "grp", "line", F.length("a").alias("n"), F.explode(pieces("a", starts, F.col("size"))).alias("x")).select("src", "grp", "line", "n", "x.*")
    each = F.concat(*[pieces("known", F.sequence(F.lit(0), F.length("known") - k), F.lit(k)) for k in (2, 3, 4)])
    of_titles = known.select("src", "grp", "title", F.length("known").alias("m"), few("known").alias("few"), F.explode(each).alias("x")).select("src", "grp", "title", "m", "few", F.col("x.at").alias("known_at"), "x.piece")
    met = of_lines.join(of_titles, ["src", "grp", "piece"]).where((F.abs(F.col("at") - F.col("known_at")) <= F.col("few")) & (F.abs(F.col("n") - F.col("m")) <= F.col("few")))
    pairs = met.select("src", "grp", "line", "title").distinct().join(lines, ["src", "grp", "line"]).join(known, ["src", "grp", "title"])
    return pairs.where(F.levenshtein("a", "known") <= few("known")).select("src", "grp", "a").distinct()


def page_numbers(rows: DataFrame, running: DataFrame) -> DataFrame:
    """(src, no, rec, grp, page) of lines with only a page number.  Numbers are
    paired with those of other pages of the file, with which they keep step, and
    with the running line beside them; forms that say so show the classifier what
    page numbers are like, numbers inside pages what they are not."""
    numbers = rows.where("t in ('number', 'inside')").withColumn("off", F.col("n") - F.col("page"))
    pace = numbers.where("src = 'line' and t = 'number'").groupBy("grp", "off").agg(F.count_distinct("page").alias("pages"))
    steady = pace.groupBy("grp").agg(F.max_by("off", F.struct("pages", "off")).alias("steady"), F.max("pages").alias("pages"))
    beside = running.where("src = 'block'").select("src", "rec", F.explode(F.array(F.col("no") - 1, F.col("no") + 1)).alias("no")).distinct().withColumn("beside", F.lit(1))
    line, said = F.col("src") == "line", F.col("b") == "said"
    joined = numbers.join(steady, "grp", "left").join(beside, ["src", "rec", "no"], "left")
    step = line & (F.col("off") == F.col("steady")) & (F.col("pages") >= 2)
    alone = line & (F.coalesce("pages", F.lit(0)) < 2)
    known = cut(joined.select("t", "src", "no", "rec", "grp", "page", line.alias("line"), said.alias("said"), F.coalesce(step, F.lit(False)).alias("step"), alone.alias("alone"), (alone & (F.col("off") == 0)).alias("same"), F.coalesce("beside", F.lit(0)).alias("beside")))
    by = ("line", "said", "step", "alone", "same", "beside")
    yes = (F.col("t") == "number") & ((F.col("src") == "block") & (F.col("said") | (F.col("beside") == 1)) | line & (F.col("step") | F.col("said") & F.col("alone") | F.col("same")))
    no = (F.col("t") == "inside") | (F.col("src") == "block") & ~F.col("said") & (F.col("beside") == 0) | line & ~F.col("step") & ~F.col("alone")
    x, y = _sample(known, yes, no, F.xxhash64("rec", "no"), *by)
    model = Booster(rounds=25).fit(x, y)
    return _judged(known.where("t = 'number'"), model, "src string, no int, rec long, grp long, page int", *by).distinct()


def word_table(rows: DataFrame) -> DataFrame:
    """(word, scan, clean): small-letter words with their counts."""
    return rows.where("t = 'word'").groupBy(F.lower("a").alias("word")).agg(F.sum("n").alias("scan"), F.sum("grp").alias("clean"))


@lru_cache(100_000)
def shape_grams(word: str) -> tuple[frozenset[str], ...]:
    """The 3-grams of a word's two shapes."""
    shapes = ["^" + shape(word, pairs) + "$" for pairs in (SHAPE_PAIRS, OTHER_PAIRS)]
    return tuple(frozenset(s[i : i + 3] for i in range(max(1, len(s) - 2))) for s in shapes)


def shared_grams(word: str, known: str) -> float:
    """The share of a word's 3-grams that the other has, by the shapes that are nearer."""
    return max(len(a & b) / len(a) for a, b in zip(shape_grams(word), shape_grams(known)))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words to the 3-grams of their two shapes; of words marked few, some by a
    fixed order.  Candidates are not found by these, which leave pairs out."""
    for batch in batches:
        words, grams, counts = [], [], []
        for w, few in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for v, own in enumerate(shape_grams(w)):
                some = sorted(own, key=hash_of)[: max(5, int(0.5 * len(own)) + 1)] if few else own
                for g in some:
                    words.append(w)
                    grams.append(f"{v}{g}")
                    counts.append(len(some))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int32())], ["word", "gram", "size"])


def hash_of(s: str) -> int:
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h ^ h >> 15


#: Words further apart than this are not compared any more (a little more than 2.2, for sums of costs are rounded).
FAR = 2.2 + 1e-9
#: No more steps than this fit into FAR, the least costing 0.3, so lengths differ by no more, either.
_WIDE = 7


def distance(word: str, other: str) -> float:
    """Cost of turning a word into another, FAR or more if it is too much; confusions of recognition cost little."""
    a, b = word.casefold(), other.casefold()
    n, m = len(a), len(b)
    if abs(n - m) > _WIDE:
        return 99.0
    row, below, third = ([99.0] * (m + 1) for _ in range(3))
    row[0] = 0.0
    for i in range(n + 1):
        least = 99.0
        for j in range(max(0, i - _WIDE), min(m, i + _WIDE) + 1):
            now = row[j]
            if now > FAR:
                continue
            least = min(least, now)
            if i < n and j < m:
                x, y = a[i], b[j]
                c = now if x == y else now + (0.3 if _SHAPE.get(x, x) == _SHAPE.get(y, y) else 1.0)
                if c < below[j + 1]:
                    below[j + 1] = c
            if i < n and now + 1.2 < below[j]:
                below[j] = now + 1.2
            if j < m and now + 1.2 < row[j + 1]:
                row[j + 1] = now + 1.2
            for one in _TWO.get(a[i : i + 2], ()):
                if b.startswith(one, j) and now + 0.3 < third[j + 1]:
                    third[j + 1] = now + 0.3
            if i < n:
                for one in _TWO.get(b[j : j + 2], ()):
                    if a[i] == one and now + 0.4 < below[j + 2]:
                        below[j + 2] = now + 0.4
        if i == n:
            break
        if least > FAR and min(below) > FAR:
            return 99.0
        row, below, third = below, third, [99.0] * (m + 1)
    return row[m]


_TWO: dict[str, tuple[str, ...]] = {}
for _pair, _single in PAIRS:
    _TWO[_pair] = (*_TWO.get(_pair, ()), _single)

#: What is left of a letter when all that recognition confuses is made equal, letter by letter: no step of ``distance`` below 1 changes it.
_CORE = {c: "" for k in "lub" for c in ONE_SHAPE[k]} | {c: k for k in "oesn" for c in ONE_SHAPE[k]} | {"w": "", "r": "n", "m": "nn", "d": "e"}
#: Known words up to this length are found by what is left without one or two letters, longer ones by a third of them.
SHORT = 10
_PRIME = (1 << 61) - 1


def keys_of(word: str, looked: bool) -> set[str]:
    """Keys of which a word that is looked up and a known word share one at least
    if they are no further than FAR from each other.

    FAR has room for one step of 1 or more and some below, or for two and then
    none below, of which one at most is a letter more or less.  In the first case
    the cores before and after that step are the same.  In the second the words
    are the same without a letter or two, and without two steps' letters one of
    three parts of the known word is untouched, moved by one place at most."""
    w = word.casefold()
    n = len(w)
    core = [_CORE.get(c, c) for c in w]
    add = lambda h, letters: reduce(lambda g, c: (g * 1_000_003 + ord(c)) % _PRIME, letters, h)
    heads = list(accumulate(core, add, initial=1))  # hashes, so that a long word costs no more than its length
    tails = list(accumulate([c[::-1] for c in reversed(core)], add, initial=1))[::-1]
    keys = {f"{heads[i]}|{tails[j]}" for i in range(n + 1) for j in (i, i + 1) if j <= n}
    if n <= SHORT + looked:
        less = {w[:i] + w[i + 1 :] for i in range(n)}
        keys |= {f"-{x}" for x in less} | {f"-{x[:i]}{x[i + 1:]}" for x in less for i in range(n - 1)}
    for m in (n - 1, n, n + 1) if looked else (n,):
        if m > SHORT:
            at = (0, m // 3, 2 * m // 3, m)
            keys |= {f"{m}.{k}.{w[at[k] + d : at[k + 1] + d]}" for k in range(3) for d in {0, n - m} if at[k] + d >= 0 and at[k + 1] + d <= n}
    return keys


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and whether they are looked up, to their keys."""
    for batch in batches:
        found = [(w, k) for w, looked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k in keys_of(w, looked)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([k for _, k in found], pa.string())], ["word", "key"])


def near_words(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(word, known): every asked word with other known words that may be within FAR; whoever is left out is further away."""
    keyed = lambda df, looked: df.select("word", F.lit(looked).alias("looked")).mapInArrow(_keys, "word string, key string").select("word", F.xxhash64("key").alias("key"))
    hits = keyed(asked, True).join(keyed(known, False).withColumnRenamed("word", "known"), "key")
    return hits.where((F.col("word") != F.col("known")) & (F.abs(F.length("word") - F.length("known")) <= _WIDE)).select("word", "known").distinct()


def features(word: str, known: str, scan: int, clean: int, known_scan: int, known_clean: int) -> list[float] | None:
    """What the ranker judges a pair by, none if the two are too far apart."""
    cost = distance(word, known)
    if cost > FAR:
        return None
    shared = shared_grams(word, known)
    edits = sum(x != y for x, y in zip(word, known)) + abs(len(word) - len(known))
    log = math.log10
    return [log((scan + 0.5) / (known_scan + 0.5)), log((clean + 0.5) / (known_clean + 1)), cost, float(edits), float(len(known)), shared, log(known_scan + known_clean + 1), cost / max(len(known), 1)]


def _feature_rows(pairs: DataFrame) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(6)]
            f = pa.array([features(*row) for row in zip(*cols)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), f], ["word", "known", "scan", "clean", "f"]).filter(f.is_valid())

    return pairs.select("word", "known", "scan", "clean", "known_scan", "known_clean").mapInArrow(go, "word string, known string, scan long, clean long, f array<double>")


def _levels(table: DataFrame) -> tuple[int, int]:
    """From how many times on a word of clean text, and of scanned pages, is known."""
    total = table.agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan")).first()
    return max(3, math.ceil(CLEAN_SHARE * (total.clean or 0))), max(3, math.ceil(SCAN_SHARE * (total.scan or 0)))


def corrections(table: DataFrame, clean_min: int, scan_min: int) -> DataFrame:
    """(word, ``known``): misread words and what they most likely were.
    ``table`` is the word table; only words, never lines, are joined here."""
    is_known = (F.col("clean") >= clean_min) | (F.col("scan") >= scan_min)
    letters = F.col("word").rlike(r"^\p{L}[\p{L}-]*\p{L}$")
    known = table.where(is_known & letters)
    odd = F.regexp_like("word", F.lit(r"\p{L}[\d!|]|[\d!|]\p{L}"))
    roman = F.col("word").rlike(_ROMAN.pattern)  # numbers of pages and chapters
    asked = table.where((F.col("clean") < clean_min) & ~roman)
    # pairs of known words show what is no misreading
    peers = known.where((F.col("clean") >= clean_min) & (F.pmod(F.xxhash64("word"), F.lit(8)) == 0))
    near = near_words(asked.select("word").unionByName(peers.select("word")), known)
    pairs = near.join(table, "word").join(table.select(F.col("word").alias("known"), F.col("scan").alias("known_scan"), F.col("clean").alias("known_clean")), "known")
    rows = cut(_feature_rows(pairs))
    order = F.xxhash64("word", "known")
    f = lambda k: F.col("f")[k]
    flat = rows.where("scan + clean > 0").select("*", *[f(k).alias(f"f{k}") for k in range(8)])
    names = [f"f{k}" for k in range(8)]
    yes = odd & (f(7) <= 0.25) & (f(0) < 0)
    x, y = _sample(flat, yes, (F.col("clean") >= clean_min) & ~odd, order, *names)
    far, _ = _sample(flat, F.lit(False), (F.col("clean") == 0) & (f(2) >= 1.5), order, *names)
    model = Booster().fit(np.concatenate([x, far]), np.concatenate([y, np.zeros(len(far))]))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array(batch.column(2).to_pylist(), float).reshape(-1, 8)
            p = model.probability(f) if len(f) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array(f[:, 2], pa.float64())], ["word", "known", "p", "cost"])

    ranked = rows.where(f"clean < {clean_min}").select("word", "known", "f").mapInArrow(rank, "word string, known string, p double, cost double")
    best = ranked.groupBy("word").agg(F.max_by("known", F.struct("p", -F.col("cost"), "known")).alias("known"), F.max("p").alias("p"))
    return best.where("p >= 0.5").select("word", "known")


def misread_words(all_pages: DataFrame, table: DataFrame, clean_min: int, fixes: DataFrame, cuts: DataFrame) -> DataFrame:
    """(src, rec, word, known) of misread words.
    Words that the table knows are skipped where they are read, as long as they
    are few enough to send to every task (counted first; the rows are the same);
    the others are joined to the fixes, but for second halves of cut words."""
    known = table.where(f"clean >= {clean_min}").select("word")
    few = known.count() <= SKIPPED
    skip = all_pages.sparkSession.sparkContext.broadcast(frozenset(r.word for r in known.toLocalIterator()) if few else frozenset())

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = skip.value
        word: dict[str, str | None] = {}

        def rare(token: str) -> str | None:
            """The small-letter word of a token that the table does not know."""
            if token not in word:
                w = word_of(token)
                w = w and w.lower()
                word[token] = None if not w or w in known_words else w
            return word[token]

        for batch in batches:
            out_src, recs, numbers, words = [], [], [], []
            for src, own, upto, nos, ids, texts in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if src == "block" and not _wrapped(texts):
                    continue
                half = own > 0 and (t := texts[own - 1].strip()) and t[-1] in MARKS and bool(_END.search(t))
                for k in range(own, upto):
                    text = texts[k].strip()
                    cut_here = bool(text and text[-1] in MARKS and _END.search(text))
                    for w in set(map(rare, tokens_of(text, cut_here, half))):
                        if w:
                            out_src.append(src)
                            recs.append(ids[k])
                            numbers.append(nos[k])
                            words.append(w)
                    half = cut_here
            if len(word) > 1_000_000:
                word.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out_src, pa.string()), pa.array(recs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(words, pa.string())], ["src", "rec", "no", "word"])

    rare = all_pages.select("src", "own", "upto", "no", "rec", "text").mapInArrow(go, "src string, rec long, no int, word string")
    halves = cuts.select("src", F.col("rec_2").alias("rec"), F.col("no_2").alias("no"), F.lower("second").alias("word"))
    return rare.join(fixes, "word").join(halves, ["src", "rec", "no", "word"], "left_anti").select("src", "rec", "word", "known").distinct()


#: Known words up to this many are sent to all tasks.
SKIPPED = 400_000


def halves(rows: DataFrame, furniture: DataFrame) -> DataFrame:
    """(src, rec, no, first, second, rec_2, no_2, whole, double, l, r, mark) of lines
    that end in a mark and what follows.  The second half is looked for past
    running lines and page numbers, on the next page too."""
    key = ["src", "rec", "no"]
    away = furniture.select(*key).withColumn("away", F.lit(1))
    cuts = rows.where("t = 'cut'").select(*key, "grp", "page", F.col("a").alias("first"), F.posexplode(F.split(F.concat(F.concat_ws("\t", "no", F.lit(""), "rec"), F.lit("\n"), F.col("b")), "\n")).alias("nth", "x"))
    part = lambda k: F.try_element_at(F.split("x", "\t"), F.lit(k))
    after = cuts.select(*key, "grp", "page", "first", "nth", part(1).try_cast("int").alias("no_2"), part(2).alias("second"), part(3).try_cast("long").alias("rec_2")).where("no_2 is not null")
    kept = after.join(away.withColumnsRenamed({"no": "no_2", "rec": "rec_2"}), ["src", "rec_2", "no_2"], "left")
    # the line itself is the first of its rows: none of a title's words is looked at
    found = kept.groupBy(*key, "grp", "page", "first").agg(F.max(F.when(F.col("nth") == 0, F.col("away"))).alias("title"), F.min_by(F.struct("second", "rec_2", "no_2"), F.when((F.col("nth") > 0) & F.col("away").isNull(), F.col("nth"))).alias("s"))
    own = found.where("title is null")
    tops = rows.where("t = 'top'").select(*key, "grp", "page", F.col("a").alias("second")).join(furniture.select(*key), key, "left_anti")
    over = tops.groupBy("src", "grp", (F.col("page") - 1).alias("page")).agg(F.min_by(F.struct("second", F.col("rec").alias("rec_2"), F.col("no").alias("no_2")), "no").alias("over"))
    ends = own.where("s is null").join(over, ["src", "grp", "page"]).select(*key, "first", F.col("over").alias("s"))
    pairs = own.where("s is not null").select(*key, "first", "s").unionByName(ends).select(*key, "first", "s.*").where("second <> ''")
    stem = F.expr("lower(substring(first, 1, length(first) - 1))")
    second = F.lower("second")
    return pairs.withColumns({"whole": F.concat(stem, second), "double": F.concat(stem, F.lit("-"), second), "l": stem, "r": second, "mark": F.substring("first", -1, 1)})


def with_wholes(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The word table with the words that are only read cut in two, counted as never seen, so that their misreadings are looked up, too."""
    wholes = pairs.select(F.col("whole").alias("word")).distinct().join(table, "word", "left_anti")
    return table.unionByName(wholes.select("word", F.lit(0).cast("long").alias("scan"), F.lit(0).cast("long").alias("clean")))


def cut_words(pairs: DataFrame, table: DataFrame, fixes: DataFrame) -> DataFrame:
    """(src, rec, no, rec_2, no_2, first, second, whole, mended) of the ``halves`` that are words cut at a line's end."""
    # the counts of all four, and what the whole is a misreading of, by one join
    told = table.select("word", (F.col("scan") + F.col("clean")).alias("count"), F.lit(None).cast("string").alias("known")).unionByName(fixes.select("word", F.lit(0).cast("long").alias("count"), "known"))
    asked = pairs.select(F.explode(F.array("whole", "double", "l", "r")).alias("word"), "whole", "double", "l", "r").distinct()
    counts = asked.join(told, "word").groupBy("whole", "double", "l", "r").agg(*[F.max(F.when(F.col("word") == F.col(c), F.col("count"))).alias(f"n_{c}") for c in ("whole", "double", "l", "r")], F.max(F.when(F.col("word") == F.col("whole"), F.col("known"))).alias("mended"))
    pairs = pairs.join(counts, ["whole", "double", "l", "r"], "left")
    zero = F.lit(0)
    logs = {f"f_{c}": F.log1p(F.coalesce(f"n_{c}", zero).cast("double")) for c in ("whole", "double", "l", "r")}
    x = cut(pairs.withColumns(logs | {"f_lead": logs["f_whole"] - logs["f_double"], "f_mark": (F.col("mark") != "-").cast("double"), "f_small": F.col("second").rlike(r"^\p{Ll}").cast("double"), "f_len": F.length("r").cast("double"), "f_mended": F.col("mended").isNotNull().cast("double")}))
    fs = [f"f_{c}" for c in ("lead", "whole", "double", "l", "r", "mark", "small", "len", "mended")]
    train, y = _sample(x, F.expr("f_whole > 1 and f_double = 0"), F.expr("f_double > 1 and f_double > f_whole"), F.xxhash64("first", "second"), *fs)
    # the words again as if the corpus did not have them whole, and as if a misreading were known: so that rare and misread words can be judged, too
    unseen, misread = train.copy(), train[y == 1].copy()
    unseen[y == 1, :2] = misread[:, :2] = 0
    misread[:, 8] = 1
    model = Booster().fit(np.concatenate([train, unseen, misread]), np.concatenate([y, y, np.ones(len(misread))]))
    return _judged(x, model, "src string, rec long, no int, rec_2 long, no_2 int, first string, second string, whole string, mended string", *fs)


def half_misread(cuts: DataFrame) -> DataFrame:
    """(src, rec): the half of a cut word that has the wrong characters."""
    n = F.length("first") - 1
    same_first = F.substring("mended", F.lit(1), n) == F.lower(F.expr("substring(first, 1, length(first) - 1)"))
    same_second = F.expr("right(mended, length(second))") == F.lower("second")
    bad = cuts.where("mended is not null")
    return bad.where(~same_first).select("src", "rec").unionByName(bad.where(~same_second).select("src", F.col("rec_2").alias("rec"))).distinct()


def analyse(lines: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    """All findings over the two tables, by name."""
    all_pages = keep(pages(lines, blocks))
    rows = cut(read_pages(all_pages))
    running = cut(running_lines(rows))
    numbers = page_numbers(rows, running)
    furniture = cut(running.withColumn("kind", F.lit("running")).unionByName(numbers.withColumn("kind", F.lit("page_number"))))
    table = cut(word_table(rows))
    clean_min, scan_min = _levels(table)
    pairs = cut(halves(rows, furniture))
    fixes = cut(corrections(cut(with_wholes(table, pairs)), clean_min, scan_min))
    cuts = cut(cut_words(pairs, table, fixes))
    words = misread_words(all_pages, table, clean_min, fixes, cuts)
    return {"pages": all_pages, "furniture": furniture, "fixes": fixes, "cuts": cuts, "words": words, "misread": words.select("src", "rec").unionByName(half_misread(cuts)).distinct()}


def noise(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, rec_id, noise) of every noisy record."""
    found = analyse(lines, blocks)
    rec = F.col("rec").alias("rec_id")
    each = [found["furniture"].select("src", rec, F.col("kind").alias("noise")), found["cuts"].select("src", rec, F.lit("broken_word").alias("noise")), found["misread"].select("src", rec, F.lit("misread").alias("noise"))]
    return reduce(DataFrame.unionByName, each).distinct()


def _mended(text: str, swaps: dict[str, str]) -> str:
    """A line with its misread words replaced, in the case they were written in."""
    out = []
    for piece in regex.split(r"(['’\s]+)", text):
        w = word_of(piece) if piece.strip() else None
        known = swaps.get(w.lower()) if w else None
        if known:
            loud = sum(map(str.isupper, w)) > len(w) / 2
            known = known.upper() if loud and len(w) > 1 else known[0].upper() + known[1:] if w[0].isupper() or not w[0].isalpha() and not out else known
            piece = piece.replace(w, known)
        out.append(piece)
    return "".join(out)


def paragraphs(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, grp, page, para, text): what stands on the pages as continuous
    paragraphs, without running lines and page numbers, cut words whole again
    and misread words replaced.

    A paragraph is a block of text on one page (for lines: of one ``para``);
    a word cut at a page's end is whole on the first page.
    """
    found = analyse(lines, blocks)
    key = ["src", "no", "rec"]
    own = lambda c: F.slice(c, F.col("own") + 1, F.col("upto") - F.col("own")).alias(c)
    each = found["pages"].select("src", "grp", "page", "part", own("no"), own("rec"), own("text")).select("src", "grp", "page", "part", F.explode(F.arrays_zip("no", "rec", "text")).alias("l")).select("src", "grp", "page", "part", "l.no", "l.rec", "l.text")
    kept = each.join(found["furniture"].select(*key), key, "left_anti")
    para = lines.groupBy(F.col("line_id").alias("rec")).agg(F.max("para").alias("para")).withColumn("src", F.lit("line"))
    swaps = found["words"].groupBy("src", "rec").agg(F.collect_list(F.struct("word", "known")).alias("swaps"))
    whole = F.coalesce("mended", "whole")
    firsts = found["cuts"].groupBy("src", "rec").agg(F.collect_set(F.struct("first", "second", whole.alias("whole"))).alias("firsts"))
    seconds = found["cuts"].groupBy("src", F.col("rec_2").alias("rec")).agg(F.collect_set("second").alias("seconds"))
    rows = kept.join(para, ["src", "rec"], "left").join(swaps, ["src", "rec"], "left").join(firsts, ["src", "rec"], "left").join(seconds, ["src", "rec"], "left")
    line = F.struct("part", "no", "rec", "text", "swaps", "firsts", "seconds")
    packed = rows.groupBy("src", "grp", "page", F.coalesce("para", F.lit(0)).alias("para")).agg(F.array_sort(F.collect_list(line), lambda a, b: F.when((a["part"] < b["part"]) | ((a["part"] == b["part"]) & (a["no"] < b["no"])), -1).otherwise(1)).alias("lines"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for own in batch.column(4).to_pylist():
                out: list[str] = []
                for x in own:
                    text = x["text"].strip()
                    lead = _START.match(text)
                    if lead and lead[0] in (x["seconds"] or ()):  # its word stands whole in the line before
                        text = text[lead.end() :].lstrip()
                    tail = next((f for f in x["firsts"] or () if text.endswith(f["first"])), None)
                    text = _mended(text[: len(text) - len(tail["first"])] if tail else text, {w["word"]: w["known"] for w in x["swaps"] or ()})
                    if tail:
                        text += tail["first"][0] + tail["whole"][1:]
                    if text:
                        out.append(text)
                texts.append(" ".join(out))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(texts, pa.string())], ["src", "grp", "page", "para", "text"])

    return packed.mapInArrow(go, "src string, grp long, page int, para int, text string")
