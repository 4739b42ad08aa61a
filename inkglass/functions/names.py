"""File names: do they say what a file is, and how to write clear ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of names that cameras, apps and downloads give.
MACHINE_NAMES = (
    r"(?i)^(img|vid|pxl|dsc|dscn|dscf|dcim|mvimg|pano|burst|photo|image|video|mov|gopr|gp|dji|sam|wp|p|pic|picture|snapchat|received|fb_img|inshot|capture|cam|camera)[-_ ]?[0-9].*$",
    r"(?i)^(screenshot|screen[-_ ]?shot|screen[-_ ]?recording|screenrecord|screenrecorder|record|recording|voice|audio|aud|ptt|call|rec|sound|memo)[-_ ]?.*[0-9]{4,}.*$",
    r"(?i)^(img|vid|aud|doc|ptt|stk)-[0-9]{8}-wa[0-9]+.*$",
    r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}.*$",
    r"(?i)^[0-9a-f]{16,}$",
    r"^[0-9 _\-.()]+$",
    r"(?i)^[a-z]{0,4}[_-]?[0-9]{5,}([_-][0-9a-z]+)*$",
    r"(?i)^[a-z0-9]{20,}$",
)
# Words that say nothing of the content.
GENERIC_WORDS = (
    "download downloads downloaded document documents doc docs file files scan scanned scanner camscanner image images img photo photos picture pic copy "
    "final new untitled unnamed attachment attachments pdf page pages screenshot screen shot video vid audio recording record voice memo temp tmp test "
    "export exported output print printed data info item misc stuff sheet book draft version ver edit edited resized cropped compressed share shared "
    "received sent whatsapp telegram signal messenger snapchat instagram facebook fb note notes text noname blank the and for from with wa mp jpg "
    "jpeg png mp4 mp3 docx xlsx pptx zip apk original large small thumb thumbnail cover clip movie track song sound app application invoice_id"
).split()
# Words for a sort of document that do not say which one.
VAGUE_WORDS = (
    "receipt receipts invoice invoices statement statements bill bills letter form forms report list contract agreement summary details confirmation order ticket tickets "
    "booking application contacts contact invite invitation event calendar backup archive photo scan document presentation spreadsheet slides table chart image screenshot"
).split()
COPY_SUFFIX = r"(?i)\s*(\(\d+\)|-\s*copy(\s*\d+)?|\s+copy(\s*\d+)?|_\d{1,2}|-\d{1,2})$"
#: Stacked copy suffixes that are taken off at most.
SUFFIX_ROUNDS = 4
_EDGE = ". -_,"
# Short words that stay small inside a title.
SMALL_WORDS = ("of", "and", "the", "for", "to", "in", "on", "at", "a", "an", "or")


def words(c: Column) -> Column:
    """Words of a name, also where only a capital begins one."""
    return F.filter(F.split(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), r"[^\p{L}\p{N}']+"), lambda w: F.btrim(w) != "")


def strip_copy_suffix(c: Column) -> Column:
    c = F.btrim(c)
    for _ in range(SUFFIX_ROUNDS):
        # one element arrays keep the expression from doubling with each round
        c = F.transform(F.array(c), lambda b: F.coalesce(F.nullif(F.btrim(F.regexp_replace(b, COPY_SUFFIX, "")), F.lit("")), b))[0]
    return c


def _real_word(w: Column) -> Column:
    low = F.lower(w)
    letters = F.regexp_replace(low, r"[^\p{L}]", "")
    wordlike = letters.rlike("[ɐ-\U0010ffff]") | letters.rlike("[aeiouyàáâãäåèéêëìíîïòóôõöùúûüý]") & (F.regexp_count(low, F.lit(r"\d")) <= F.length(letters))
    return (F.length(low) >= 3) & (letters != "") & ~low.isin(*GENERIC_WORDS) & wordlike


def is_meaningful(name: Column) -> Column:
    """Whether a name without its extension tells what the file is.  False for null and empty names."""
    by_name = lambda base: F.transform(F.array(F.filter(words(base), _real_word)), lambda real: _judge(base, real))[0]
    return F.coalesce(F.transform(F.array(strip_copy_suffix(name)), by_name)[0], F.lit(False))


def _judge(base: Column, real: Column) -> Column:
    machine = F.lit(False)
    for p in MACHINE_NAMES:
        machine = machine | base.rlike(p)
    clear = F.exists(real, lambda w: ~F.lower(w).isin(*VAGUE_WORDS))
    one = (F.size(real) == 1) & (F.length(F.try_element_at(real, F.lit(1))) >= 4) & (F.regexp_count(base, F.lit(r"\p{L}")) >= F.regexp_count(base, F.lit(r"\d")))
    return (base != "") & ~machine & clear & ((F.size(real) >= 2) | one)


def sanitize(c: Column, size: int = 90) -> Column:
    """A name that any file system takes, cut at a word beyond ``size`` characters."""
    edge = F.lit(_EDGE)
    c = F.btrim(F.btrim(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\p{Cntrl} ]', " "), r"\s+", " ")), edge)

    def cut(s: Column) -> Column:
        head = F.left(s, F.lit(size))
        blank = F.length(head) - F.instr(F.reverse(head), " ")
        return F.when(F.length(s) <= size, s).otherwise(F.btrim(F.when((F.instr(head, " ") > 0) & (blank > size // 2), F.left(head, blank)).otherwise(head), edge))

    return F.transform(F.array(c), cut)[0]


def tidy_case(c: Column) -> Column:
    """Texts all in capitals to title case; others stay."""
    loud = (F.regexp_count(c, F.lit(r"\p{L}")) >= 4) & ~c.rlike(r"\p{Ll}")
    first = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1000))
    title = first(F.array_join(F.transform(F.split(F.lower(c), " "), lambda w: F.when(w.isin(*SMALL_WORDS), w).otherwise(first(w))), " "))
    return F.when(loud, title).otherwise(c)


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"\.([^.]*)$", 1))


def day(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def day_and_time(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd HH.mm")
