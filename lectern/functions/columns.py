"""Column builders: text, numbers, dates, identifiers, redaction. All are JVM expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of the engine's languages and what they fold to.
ACCENTED, PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc"
#: The check letters of Spanish personal tax ids, by the number modulo 23.
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: The letters that company tax ids begin with, and control letters by digit.
CIF_LETTERS, CIF_CONTROL = "ABCDEFGHJKLMNPQRSUVW", "JABCDEFGHI"
#: Spanish month names.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value being computed once. An expression that is used twice is otherwise there twice, and nested ones outgrow what the JVM compiles."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the folded text; null for null."""
    return F.regexp_extract_all(fold(c), F.lit("([a-z0-9]+)"), 1)


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-cased text with single spaces; a shorter text is its own n-gram."""
    t = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n))))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= n, F.array(t)).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays' distinct elements; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def doc_number(c: Column) -> Column:
    """A document number without white space, dashes, dots and slashes, in lower case; empty for null."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\-./]", ""))


def amount(c: Column, locale: str = "es") -> Column:
    """A number out of text, rounded to cents, or null. In es, it, de and fr a dot parts thousands and a comma decimals; in en the other way."""
    whole = lambda t: F.replace(t, F.lit("."), F.lit(""))
    point = lambda t: F.replace(t, F.lit(","), F.lit("."))
    if locale[:2] in ("es", "it", "de", "fr"):
        clean = lambda t: (
            F.when(t.contains(",") & t.contains("."), point(whole(t)))
            .when(t.contains(","), F.when(t.rlike(r"^[^,]*,[^,]{1,2}$"), point(t)).otherwise(F.replace(t, F.lit(","), F.lit(""))))
            .when(t.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3})+$"), whole(t))
            .otherwise(t)
        )
    else:
        clean = lambda t: bound(F.replace(t, F.lit(","), F.lit("")), lambda bare: F.when(t.rlike(r"\..*,"), whole(bare)).otherwise(bare))
    number = lambda n: F.round(F.when(n.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), n).try_cast("double"), 2)
    slow = lambda x: bound(F.regexp_replace(x, "[\\s ]", ""), lambda t: bound(clean(t), number))
    if locale[:2] not in ("es", "it", "de", "fr"):
        return slow(c)
    plain = lambda x: x.rlike(r"\A-?[0-9][0-9.]*,[0-9]{1,2}\z")  # noqa: E731  what papers mostly say; the steps above give the same
    return bound(c, lambda x: F.when(plain(x), F.round(point(whole(x)).try_cast("double"), 2)).otherwise(slow(x)))


def date_es(c: Column) -> Column:
    """A date of d/m/y (also with - or .), or of "15 de junio de 2026"; two-digit years below 70 are of this century; null if it isn't one."""
    numeric = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})"
    wordy = r"(?i)(\d{1,2})\s+de\s+([a-zé]+)\s+(?:de|del)\s+(\d{4})"
    y = F.regexp_extract(c, numeric, 3)
    year = F.when(F.length(y) == 2, F.when(y.try_cast("int") < 70, F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))).otherwise(y)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(c, wordy, 2)))
    of = lambda d, m, y: F.to_date(F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")))
    return F.when(F.regexp_extract(c, numeric, 1) != "", of(F.regexp_extract(c, numeric, 1), F.regexp_extract(c, numeric, 2), year)).when(
        month > 0, of(F.regexp_extract(c, wordy, 1), month.cast("string"), F.regexp_extract(c, wordy, 3))
    )


def nif_valid(c: Column) -> Column:
    """Whether eight digits are followed by their check letter; false for null."""
    t = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), " ", ""))
    want = F.substring(F.lit(NIF_LETTERS), (F.substring(t, 1, 8).try_cast("int") % 23 + 1), F.lit(1))
    return t.rlike("^[0-9]{8}[A-Z]$") & F.coalesce(F.substring(t, 9, 1) == want, F.lit(False))


def cif_valid(c: Column) -> Column:
    """Whether a letter and seven digits are followed by their control, a digit or a letter; false for null."""
    t = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), " ", ""))
    digit = lambda i: F.substring(t, i, 1).try_cast("int")
    total = F.lit(0)
    for i in range(2, 9):
        twice = digit(i) * 2
        total = total + (F.when(twice > 9, twice - 9).otherwise(twice) if i % 2 == 0 else digit(i))
    control = (10 - total % 10) % 10
    ok = (F.substring(t, 9, 1) == control.cast("string")) | (F.substring(t, 9, 1) == F.substring(F.lit(CIF_CONTROL), control + 1, F.lit(1)))
    return t.rlike(f"^[{CIF_LETTERS}][0-9]{{7}}[0-9A-Z]$") & F.coalesce(ok, F.lit(False))


#: What is redacted, in order.
EMAIL, LONG_NUMBER, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"\b[0-9]{16}\b", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
REDACTIONS = ((EMAIL, "[EMAIL]"), (LONG_NUMBER, "[ACCOUNT]"), (IP, "[IP]"))


def redact(c: Column) -> Column:
    for pattern, to in REDACTIONS:
        c = F.regexp_replace(c, pattern, to)
    return c


def text_quality(c: Column) -> Column:
    """0.55 times the share of letters and digits plus 0.45 times the length up to 500, between 0 and 1; 0 for empty text."""
    n = F.length(c)
    dense = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) / n
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 0.55 * dense + 0.45 * F.least(n / 500.0, F.lit(1.0))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null if their lengths differ or one is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)
