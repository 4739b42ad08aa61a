"""Personal details inside free text: found by kind and place, and replaced.

How strongly a term reveals a protected entity is estimated from what it
stands beside in the whole corpus, in bits (pointwise mutual information):

* numbers - every word around a number and every trait of its form speaks for or
  against a phone number, a number that identifies a person, or any other; the
  estimate starts from numbers beside a few words of one kind and is carried on
  to all words and forms that keep company with them, and only the sum of these
  bits decides;
* names - e-mail addresses, which disclose themselves, name persons: words never
  written small that the names of addresses have more often than the corpus
  would let expect, and words that stand before family names known from others,
  are given names; initials may stand between given and family name;
* addresses and e-mail addresses disclose themselves by their form.

Mentions above the threshold become typed placeholders; in the sanitised text
any other word that reveals a person's name is generalised, too.

Fixed meaning: null and empty texts have no mention; repeated rows count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Words that stand with each kind of number, in four languages.
CUES = {
    "phone": "phone telephone tel fax mobile cell call calls text sms ring rang telefon handy rückruf anruf téléphone joignable portable appeler teléfono móvil llamar",
    "id_number": "passport identity id licence license holder ssn social security insurance national tax steuer steuernummer steueridentifikationsnummer personalausweis ausweis reisepass führerschein dni nie nif "
    "passeport identité sécurité sociale permis fiscal pasaporte identidad seguridad conducir",
    "other": "order orders invoice parcel tracking shipment part parts serial lot ticket item article batch sheet version model bestellung rechnung sendung seriennummer artikel commande facture colis pedido factura paquete serie",
}
STREET = r"(?:Street|St\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Close|Drive|Dr\b\.?|Court|Ct\b\.?|Avenue|Ave\b\.?|Boulevard|Blvd\b\.?|Way|Place|Pl\b\.?|Square|Sq\b\.?|Terrace|Walk|Hill|Gardens|Crescent|Row|Park|Mews|Grove)"
WORD = r"\p{Lu}[\p{L}'’]+(?:-\p{L}+)*"
#: Forms of addresses: street and house number, then the town.
ADDRESS = (
    rf"(?<![\p{{L}}\p{{N}}])\d{{1,4}}[a-zA-Z]?,? (?:{WORD} ){{1,3}}{STREET},?\s(?:(?:Apt|Flat|Unit|Suite|No)\b\.? ?\w+,?\s)?(?:\d{{4,5}}\s)?{WORD}"
    rf"|(?<![\p{{L}}\p{{N}}])\d{{1,4}}(?: ?bis| ?ter)?,? (?i:rue|avenue|boulevard|impasse|place|chemin|allée|quai|route|cours|square|passage)\s(?:(?i:du|de la|des|de|aux?)\s|(?i:de l'|d'|l'))?(?:(?:d'|l'|de |du |la )?{WORD}\s?){{1,4}},?\s(?:\d{{5}}\s)?{WORD}"
    rf"|(?<![\p{{L}}\p{{N}}])\p{{Lu}}[\p{{L}}-]*(?i:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer)\s\d{{1,4}}[a-z]?,\s(?:\d{{5}}\s)?{WORD}"
    rf"|(?<![\p{{L}}\p{{N}}])(?:{WORD}\s)?(?:Straße|Strasse|Str\.|Weg|Allee|Gasse|Platz|Ring)\s\d{{1,4}}[a-z]?,\s(?:\d{{5}}\s)?{WORD}"
    rf"|(?<![\p{{L}}\p{{N}}])(?i:calle|avenida|avda?\.|plaza|paseo|camino|carrer)\s(?:(?:de la|del|de los|de las|de|la|el)\s)?(?:{WORD}\s?){{1,3}},?\s(?:n\.?º\s?)?\d{{1,4}},\s(?:\d{{5}}\s)?{WORD}"
)
EMAIL = (
    r"(?<![\w.+-])[\w](?:[\w.+-]*[\w+-])?(?: ?@ ?| ?[\[({<]\s?(?:at|AT|arroba)\s?[\])}>] ?| (?:at|AT|arroba) (?=[\w-]+ (?:dot|DOT|punto|punkt|point) ))"
    r"[\w](?:[\w-]*\w)?(?:(?:\.| ?[\[({<]\s?(?:dot|DOT|punto|punkt|point)\s?[\])}>] ?| (?:dot|DOT|punto|punkt|point) )\w(?:[\w-]*\w)?)+"
)
#: Forms of numbers, the longest first.
NUMBER = (
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?:\+33|0033) ?(?:\(0\) ?)?\d(?:[ .]?\d{2}){4}(?!\d)|(?:\+34|0034) ?\d{3}(?: ?\d{3}){2}(?!\d)"
    r"|(?:\+44|0044) ?(?:\(0\) ?)?\d{4} ?\d{3} ?\d{3}(?!\d)|(?:\+49|0049) ?(?:\(0\) ?)?\d{2,4}[ /-]?\d{4,8}(?:[ -]\d{3})?(?!\d)|\+\d{2,3}(?:[ .-]?\(?\d{2,4}\)?){3,4}(?!\d)"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d.-])\d{3}\.\d{3}\.\d{4}(?!\d)|(?<!\d)1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\d.-])0\d{4} ?\d{6}(?!\d)|(?<!\d)0\d(?:[ .]\d{2}){4}(?!\d)|(?<!\d)0\d{2,4}[/-]\d{5,8}(?!\d)"
    r"|(?<!\d)[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}(?!\d)|(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<![A-Z])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?![A-Z])"
    r"|(?<![A-Z\d])[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}(?![A-Z\d])|(?<![A-Z\d])[A-Z]{1,3}\d{6,9}(?![\dA-Z])|(?<![\d.])\d{8}[A-Z](?![A-Z\d])|(?<![A-Z\d])[XYZ]\d{7}[A-Z](?![A-Z\d])|(?<![A-Z\d])(?=[A-Z\d]*\d[A-Z\d]*\d[A-Z\d]*\d[A-Z\d]*\d[A-Z\d]*\d)(?=[A-Z\d]*[A-Z])[A-Z\d]{8,12}(?![A-Z\d])"
)
_NUMBERS = regex.compile(rf"(?<![\w+])(?:{NUMBER})(?!\w)")
_MAY_HAVE_MAIL = regex.compile(r"@|[\[({<]\s?(?:at|AT|arroba)|\s(?:dot|DOT|punto|punkt|point)\s")
_ADDRESSES = regex.compile(ADDRESS)
_EMAILS = regex.compile(EMAIL)
# Cheap finders of the places where the forms above can be; all forms are inside what they find.
_DIGIT_RUNS = re.compile(r"(?:[+(]|[A-Z]{1,3} ?)?\d[\dA-Z ().\-/]{4,}|[A-Z][A-Z\d]{7,}")
_HOUSE_NUMBERS = re.compile(r"(?<![\w.,:/-])\d{1,4}[a-zA-Z]?(?![\w.:/-])")
_CAPITALS = re.compile("[A-Z\u00c0-\u00de\u0100-\u03ff\u0400-\u042f][\\w'’-]+,?[ \n](?=[A-Z\u00c0-\u00de\u0100-\u03ff\u0400-\u042f])")
_WORDS = regex.compile(r"\p{L}[\p{L}'’]*")
#: A possible name: two capitalised words, the second perhaps double or both the other way round with a comma, or with initials between.
_PAIRS = regex.compile(r"(?<![\p{L}\p{N}@.+_-])(\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)?)(,?[ \n]|[ \n](?:\p{Lu}(?:\.[ \n-]?|[ \n]))+(?<=[ \n]))(?=(\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)?)(?![\p{L}\p{N}@_]))")
# Traits of numbers that are dialled from abroad; beside no telling word they help to learn.
ABROAD = ("#begins +", "#begins 00")
#: Bits of evidence from which a number counts as a mention, and a number without a telling word helps to learn.
THRESHOLD, SURE = 1.0, 4.0
#: Most bits that one term speaks with.
MOST = 4.0
#: Bits by which a word has to stand out in mail addresses, and to be beside known family names.
MAIL_BITS, COMPANY_BITS = -1.0, 1.0
# Letters with marks and what mail addresses write for them.
MARKED, BARE = "áàâäãåāăąçćčďéèêëēęěíìîïīłñńňóòôöõøōőřśšşťúùûüūůýÿźżž", "aaaaaaaaacccdeeeeeeeiiiiilnnnoooooooorssstuuuuuuyyzzz"
#: A word that is written small more often than this share of its standing in pairs of capitalised words is no name.
SMALL_SHARE = 0.1


def _addresses(text: str):
    """Addresses around each number that can be a house number."""
    upto = 0
    for n in _HOUSE_NUMBERS.finditer(text):
        if n.start() < upto:
            continue
        m = _ADDRESSES.match(text, n.start())
        if m is None and text.find(", ", n.end(), n.end() + 2) == n.end():  # the number after the street
            first = max(upto, text.rfind("\n", 0, n.start()) + 1, n.start() - 60)
            m = next((x for x in _ADDRESSES.finditer(text, first, min(len(text), n.end() + 60)) if x.start() <= n.start() < x.end()), None)
        if m is not None:
            upto = m.end()
            yield m


def _numbers(text: str):
    """Numbers in one of the forms, inside runs of digits and capitals."""
    upto = 0
    for run in _DIGIT_RUNS.finditer(text):
        for m in _NUMBERS.finditer(text, max(upto, run.start()), min(len(text), run.end() + 2)):
            upto = m.end()
            yield m


def _traits(number: str, shape: str) -> list[str]:
    """What the form of a number says, from the whole to single traits."""
    digits, letters = sum(map(str.isdigit, number)), sum(map(str.isalpha, number))
    begin = number[:2] if number[:2] == "00" else number[0] if number[0] in "+(0" else shape[0]
    return ["#" + shape, f"#begins {begin}", f"#has {digits} {letters}", f"#{begin if letters or not number[0].isdigit() else number[0]} of {digits}", "#between " + "".join(sorted(set(c for c in number if not c.isalnum())))]


def _candidates(text: str):
    """(kind, start, end, surface, terms): kind is email, address, number or pair."""
    taken = []
    if _MAY_HAVE_MAIL.search(text):
        for m in _EMAILS.finditer(text):
            taken.append((m.start(), m.end()))
            yield "email", m.start(), m.end(), m[0], []
    free = lambda a, b: all(b <= s or a >= e for s, e in taken)
    for m in _addresses(text):
        if free(m.start(), m.end()):
            taken.append((m.start(), m.end()))
            yield "address", m.start(), m.end(), m[0], []
    last = 0  # what stands before a number is not what stands after the one before it
    for m in _numbers(text):
        if free(m.start(), m.end()):
            before = _WORDS.findall(regex.split(r"[.;!?](?=\s[\p{Lu}\d]|\s?$)(?<!\b(?:no|nr|Nr|No|Nº|N°|tel|Tel)\.)|\n", text[max(0, last, m.start() - 48) : m.start()])[-1])[-4:]
            after = _WORDS.findall(regex.split(r"[.;!?](?=\s|$)|\n", text[m.end() : m.end() + 64])[0])[:8]
            taken.append((m.start(), m.end()))
            last = m.end()
            shape = regex.sub(r"[A-Z]", "A", regex.sub(r"\d", "9", m[0]))
            yield "number", m.start(), m.end(), m[0], [*_traits(m[0], shape), *("<" + w.casefold() for w in before), *(">" + w.casefold() for w in after)]
    for place in _CAPITALS.finditer(text):
        m = _PAIRS.match(text, place.start())
        if m is None:
            continue
        end = m.end() + len(m[3])
        if free(m.start(), end):
            yield "pair", m.start(), end, m[0] + m[3], [m[1].casefold(), m[2], m[3].casefold()]


def find_candidates(texts: DataFrame) -> DataFrame:
    """Candidates of each text; ``texts`` has src, rec_id and text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(7)]
            for src, i, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for kind, start, end, surface, terms in _candidates(text):
                    for column, x in zip(out, (src, i, kind, start, end, surface, terms)):
                        column.append(x)
            kinds = (pa.string(), batch.schema.field(1).type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["src", "rec_id", "kind", "start_at", "end_at", "surface", "terms"])

    kind = texts.schema["rec_id"].dataType.simpleString()
    return texts.where("text <> ''").select("src", "rec_id", "text").mapInArrow(go, f"src string, rec_id {kind}, kind string, start_at int, end_at int, surface string, terms array<string>")


def small_words(texts: DataFrame) -> DataFrame:
    """(word, small): how often each word is written without a capital, added up per task first."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        find = re.compile(r"[^\W\d_]{2,}").findall
        small = lambda: [(w, n) for w, n in total.items() if w[0].islower()]

        def rows():
            out = small()
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(find(_EMAILS.sub(" ", text) if _MAY_HAVE_MAIL.search(text) else text))
            if len(total) > 500_000:
                yield rows()
        yield rows()

    rows = texts.where("text <> ''").select("text").mapInArrow(go, "word string, n long")
    return rows.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("small"))


def disclosure(contexts: DataFrame) -> DataFrame:
    """(term, phone, id_number, other): bits by which each term speaks for each
    kind of number; ``contexts`` has terms, n and kind (null where unknown)."""
    known = contexts.where("kind is not null")
    total = {r.kind: r.n for r in known.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # three numbers
    everything = sum(total.values()) or 1
    share = {k: max(total.get(k, 0), 0.5) / everything for k in CUES}
    counts = known.select("kind", "n", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in CUES])
    seen = reduce(lambda x, y: x + y, [F.col(k) for k in CUES])
    odds = lambda k: total.get(k, 0) / max(everything - total.get(k, 0), 1) or 1.0
    bits = lambda k: F.log2((F.col(k) + share[k]) / (seen - F.col(k) + 1 - share[k]) / odds(k))
    return counts.select("term", *[F.greatest(F.lit(-MOST), F.least(F.lit(MOST), bits(k))).alias(k) for k in CUES])


def _scores(contexts: DataFrame, bits: DataFrame) -> DataFrame:
    """``contexts`` with the bits of all their terms added up by kind."""
    # what stands before a number says more than what comes after; the traits of its form overlap
    weight = F.when(F.startswith("term", F.lit("<")), 1.0).when(F.startswith("term", F.lit(">")), 0.5).otherwise(0.6)
    each = contexts.select("terms", F.explode(F.array_distinct("terms")).alias("term")).hint("merge").join(bits, "term")
    return contexts.hint("merge").join(each.groupBy("terms").agg(*[F.sum(F.col(k) * weight).alias(k) for k in CUES]), "terms", "left").fillna(0.0, list(CUES))


def judge_numbers(candidates: DataFrame) -> DataFrame:
    """Numbers whose surroundings and form disclose a phone or a person's number."""
    kind_of = {w: k for k, words in CUES.items() for w in words.split()}
    cue = F.create_map(*[F.lit(x) for w, k in kind_of.items() for x in (w, k)])
    kinds = F.array_distinct(F.filter(F.transform("terms", lambda t: F.try_element_at(cue, F.substring(t, 2, 100))), lambda k: k.isNotNull()))
    numbers = candidates.where("kind = 'number'")
    contexts = cut(numbers.groupBy("terms").agg(F.count("*").alias("n")).withColumn("kind", F.when(F.size(kinds) == 1, kinds[0]).when((F.size(kinds) == 0) & F.arrays_overlap("terms", F.lit(list(ABROAD))), "phone")))
    first = _scores(contexts, disclosure(contexts))
    best = F.greatest(*[F.col(k) for k in CUES])
    guess = F.when(best >= SURE, F.when(F.col("phone") == best, "phone").when(F.col("id_number") == best, "id_number").otherwise("other"))
    learned = cut(first.select("terms", "n", F.coalesce("kind", guess).alias("kind")))
    told = _scores(learned.select("terms", "n"), disclosure(learned))
    best = F.greatest("phone", "id_number")
    mention = F.when((best >= THRESHOLD) & (best >= F.col("other")), F.when(F.col("phone") == best, "phone").otherwise("id_number"))
    kept = told.select("terms", mention.alias("as")).where("as is not null")
    return numbers.hint("merge").join(kept, "terms").select("src", "rec_id", F.col("as").alias("kind"), "start_at", "end_at")


def mail_words(candidates: DataFrame) -> DataFrame:
    """(bare, mails): words of the names of mail addresses, and in how many addresses they stand."""
    name = F.translate(F.lower(F.regexp_extract("surface", r"^[\p{L}\p{N}._+-]+", 0)), MARKED, BARE)
    words = F.array_distinct(F.filter(F.split(name, r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    return candidates.where("kind = 'email'").select(name.alias("name"), words.alias("words")).distinct().select(F.explode("words").alias("bare")).groupBy("bare").agg(F.count("*").alias("mails"))


def judge_names(candidates: DataFrame, small: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of capitalised words that are a given and a family name, and (word, bits): the words that reveal a name."""
    terms = F.col("terms")
    pairs = candidates.where("kind = 'pair'").select("src", "rec_id", "start_at", "end_at", terms[0].alias("first"), F.startswith(terms[1], F.lit(",")).alias("comma"), F.contains(terms[1], F.lit("\n")).alias("broken"), terms[2].alias("second"))
    two = pairs.groupBy("first", "comma", "broken", "second").agg(F.count("*").alias("n"))
    # words that are often written small are no names; each part of a double word counts
    parts = two.select("n", F.explode(F.array("first", "second")).alias("word")).groupBy("word").agg(F.sum("n").alias("n")).select("word", "n", F.explode(F.split("word", "-")).alias("part"))
    never = parts.join(small, parts["part"] == small["word"], "left").groupBy(parts["word"]).agg(F.max(F.coalesce("small", F.lit(0)) / F.col("n")).alias("small")).where(F.col("small") <= SMALL_SHARE).select("word")
    sound = cut(two.join(never.withColumnRenamed("word", "first"), "first", "left_semi").join(never.withColumnRenamed("word", "second"), "second", "left_semi"))
    turned = sound.where("not broken").select(F.when(F.col("comma"), F.col("second")).otherwise(F.col("first")).alias("given"), F.when(F.col("comma"), F.col("first")).otherwise(F.col("second")).alias("family"), "comma", "n")
    # how often each word stands in either place, and in how many addresses
    mails = mail_words(candidates)
    places = turned.select("n", F.explode(F.array(F.struct(F.col("given").alias("word"), F.lit(1).alias("as")), F.struct(F.col("family").alias("word"), F.lit(0).alias("as")))).alias("p")).groupBy("p.word").agg(F.sum(F.col("n") * F.col("p.as")).alias("before"), F.sum(F.col("n") * (1 - F.col("p.as"))).alias("after"))
    words = cut(places.withColumn("bare", F.translate("word", MARKED, BARE)).join(mails, "bare", "left").fillna(0, ["mails"]))
    total = words.agg(F.sum("mails").alias("mails"), F.sum(F.col("before") + F.col("after")).alias("seen")).first()
    mail_bits = F.log2((F.col("mails") + 0.5) / (F.col("before") + F.col("after") + 0.5) * (float(total.seen or 1) / float(total.mails or 1)))
    told = words.withColumn("in_mail", (F.col("mails") > 0) & (mail_bits >= MAIL_BITS)).select("word", "in_mail", "before", "after")
    first_names = told.where("in_mail and before > after").select("word")
    last_names = told.where("in_mail and before <= after").select("word")
    # family names are known from addresses or from standing after given names; with how many others than the word itself?
    two_ways = turned.join(first_names.withColumnRenamed("word", "given"), "given", "left_semi").groupBy("family").agg(F.count_distinct("given").alias("ways"), F.min("given").alias("only"))
    families = two_ways.join(last_names.select(F.col("word").alias("family"), F.lit(1).alias("mail")), "family", "full")
    beside = turned.where("not comma").select("given", "family").distinct().join(families, "family", "left")
    elsewhere = (F.col("mail") == 1) | (F.col("ways") >= 2) | (F.col("ways") == 1) & (F.col("only") != F.col("given"))
    titled = F.col("family").isNotNull() & F.col("title").isNotNull()
    marked = beside.join(first_names.select(F.col("word").alias("family"), F.lit(1).alias("title")), "family", "left")
    company = marked.groupBy("given").agg(F.count("*").alias("all"), F.count(F.when(elsewhere, 1)).alias("known"), F.count(F.when(titled, 1)).alias("titled"))
    sums = company.agg(F.sum("all").alias("all"), F.sum("known").alias("known")).first()
    base = min(0.5, max(0.02, float(sums.known or 0) / float(sums["all"] or 1)))
    company_bits = F.log2((F.col("known") + 0.5) / (F.col("all") + 1) / base)
    # a word before given names is a title or a greeting
    judged = told.join(company.withColumnRenamed("given", "word"), "word", "left").fillna(0, ["all", "known", "titled"]).withColumn("bits", company_bits + F.when(F.col("in_mail"), 3.0).otherwise(0.0))
    given = cut(judged.where((F.col("titled") <= 0.1 * F.col("all")) & (F.col("before") > F.col("after")) & (F.col("in_mail") | (F.col("known") >= 3)) & (F.col("bits") >= COMPANY_BITS)).select("word", "bits"))
    g1 = given.select(F.col("word").alias("first"), F.lit(1).alias("g1"))
    g2 = given.select(F.col("word").alias("second"), F.lit(1).alias("g2"))
    # a name broken over two lines, or turned round without a comma, needs a family name that is known from elsewhere
    whole = turned.join(given.select(F.col("word").alias("given")), "given", "left_semi").select("family").distinct()
    known_1, known_2 = whole.select(F.col("family").alias("first"), F.lit(1).alias("f1")), whole.select(F.col("family").alias("second"), F.lit(1).alias("f2"))
    roles = sound.join(g1, "first", "left").join(g2, "second", "left").join(known_1, "first", "left").join(known_2, "second", "left")
    straight = "not comma and g1 = 1 and (not broken or f2 = 1)"
    turned_round = "g2 = 1 and g1 is null and (comma and (not broken or f1 = 1) or not comma and not broken and f1 = 1)"
    marked = roles.where(f"({straight}) or ({turned_round})").select("first", "comma", "broken", "second")
    found = pairs.join(marked, ["first", "comma", "broken", "second"], "left_semi").select("src", "rec_id", F.lit("name").alias("kind"), "start_at", "end_at")
    return found, given.select("word").unionByName(whole.select(F.col("family").alias("word"))).distinct()


def _found(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    candidates = cut(find_candidates(texts))
    direct = candidates.where("kind in ('email', 'address')").select("src", "rec_id", "kind", "start_at", "end_at")
    names, revealing = judge_names(candidates, small_words(texts))
    return direct.unionByName(judge_numbers(candidates)).unionByName(names).distinct(), revealing


def mentions(texts: DataFrame) -> DataFrame:
    """(src, rec_id, kind, start_at, end_at) of each mention."""
    return _found(texts)[0]


def sanitised(texts: DataFrame) -> DataFrame:
    """(src, rec_id, ``clean``): every text, mentions replaced by placeholders
    such as ``[phone]``; a single word that reveals a name becomes ``[name]``."""
    found, revealing = _found(texts)
    spans = found.groupBy("src", "rec_id").agg(F.array_sort(F.collect_set(F.struct("start_at", "end_at", "kind"))).alias("spans"))
    capital = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)?"), F.lit(0)))).alias("as")
    single = texts.where("text <> ''").select("src", "rec_id", capital).distinct().withColumn("word", F.lower("as")).join(revealing, "word")
    telling = single.groupBy("src", "rec_id").agg(F.concat(F.lit(r"(?<![\p{L}\p{N}\[])(?:"), F.array_join(F.array_sort(F.collect_set("as")), "|"), F.lit(r")(?![\p{L}\p{N}])")).alias("telling"))
    rows = texts.where("text <> ''").dropDuplicates(["src", "rec_id"]).join(spans, ["src", "rec_id"], "left").join(telling, ["src", "rec_id"], "left")
    step = lambda acc, s: F.when(s["start_at"] < acc["upto"], acc).otherwise(
        F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["upto"] + 1, s["start_at"] - acc["upto"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end_at"].alias("upto"))
    )
    clean = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start_at:int,end_at:int,kind:string>>")), F.struct(F.lit("").alias("out"), F.lit(0).alias("upto")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["upto"] + 1, F.length("text"))))
    shown = rows.select("src", "rec_id", clean.alias("clean"), "telling")
    return shown.select("src", "rec_id", F.when(F.col("telling").isNull(), F.col("clean")).otherwise(F.regexp_replace("clean", F.col("telling"), F.lit("[name]"))).alias("clean"))
