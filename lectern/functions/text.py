"""Column builders for text: normal forms, headings, languages, numbers, dates, identifiers, redaction. JVM expressions unless a docstring says otherwise."""

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions import columns as C


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda a, p: F.regexp_replace(a, p[0], p[1]), pairs, c)


def _first(*options: tuple[Column, Column]) -> Column:
    """The value of the first condition that holds, else null."""
    return reduce(lambda a, o: a.when(o[0], o[1]), options[1:], F.when(*options[0]))


# normal forms


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Lower case, compatibility decomposition, ASCII only; null for null. Python, in Arrow batches: the JVM functions know no decomposition."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t.lower()).encode("ascii", "ignore").decode())


def plain_tokens(t: str) -> list[str]:
    """ascii_tokens() of a string."""
    t = t.lower()
    return re.findall("[a-z0-9]+", t if t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def ascii_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of ascii_fold()."""
    return F.regexp_extract_all(ascii_fold(c), F.lit("([a-z0-9]+)"), 1)


def token_grams(token: Column) -> Column:
    """A token's 3-grams, each marked "ng:"; a token of up to three characters is its own."""
    grams = F.transform(F.sequence(F.lit(1), F.length(token) - 2), lambda i: F.concat(F.lit("ng:"), F.substring(token, i, F.lit(3))))
    return F.when(F.length(token) <= 3, F.array(F.concat(F.lit("ng:"), token))).otherwise(grams)


def collapse(c: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def path_words(c: Column) -> Column:
    """A path in lower case with slashes one way, _ and - as spaces, and single spaces."""
    return F.trim(_replaced(F.lower(c), (r"\\", "/"), ("[_-]", " "), (r"\s+", " ")))


def slashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def without_nul(c: Column) -> Column:
    return F.translate(c, "\x00", "")


def subject(c: Column) -> Column:
    """A subject without reply and forward marks, in lower case."""
    return F.trim(F.lower(F.regexp_replace(F.trim(c), r"(?i)^(?:(?:re|fw|fwd|rv|enc)\s*:\s*)+", "")))


def word_set(c: Column) -> Column:
    """Distinct lower-cased words of two or more letters, digits or underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), 1))


def overlap(query: Column, text: Column) -> Column:
    """The share of the query's white-space tokens that the text has, without case; 0 for an empty query."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    q = words(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, words(text))) / F.size(q))


def agreement(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two readings; 0.5 if either has none."""
    x, y = word_set(a), word_set(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | x.isNull() | y.isNull(), F.lit(0.5)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def numeric_conflict(a: Column, b: Column, b_confidence: Column) -> Column:
    """Whether both readings have numbers, none of them in common, and the second is to be trusted (0.5 or more)."""
    x, y = (F.regexp_extract_all(c, F.lit("([0-9]+(?:[.,][0-9]+)*)"), 1) for c in (a, b))
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y) & (b_confidence >= 0.5), F.lit(False))


def table_shape(html: Column) -> Column:
    """(rows, columns) of a text's HTML table rows, columns being those of the widest; null without rows."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)(<tr\b.*?</tr>)"), 1)
    widest = F.array_max(F.transform(rows, lambda r: F.regexp_count(r, F.lit(r"(?i)<t[dh]\b")).cast("long")))
    return F.when(F.size(rows) > 0, F.struct(F.size(rows).cast("long").alias("rows"), widest.alias("columns")))


# structure of lines


def heading(line: Column) -> Column:
    """The heading that a line is, else null: Markdown marks, a short label that ends in a colon, or a short line of capitals."""
    t = F.trim(line)
    marked = F.regexp_extract(t, r"^#{1,6}\s+(\S.*)$", 1)
    label = F.regexp_extract(t, r"^(\p{Lu}[^:|]{1,58}):$", 1)
    capitals = t.rlike(r"^[\p{Lu}\p{N} .,/()-]{4,60}$") & t.rlike(r"\p{Lu}{3,}") & ~t.rlike(r"[.;,]$")
    return _first((marked != "", marked), (label != "", label), (capitals, t))


def aligned_line(line: Column) -> Column:
    """Whether a line of 120 characters at most has a gap of a tab or of two spaces or more between its columns."""
    return (F.length(line) <= 120) & line.rlike(r"\S(?:\t+| {2,}|\s*\t\s*)\S")


#: Ranges of code points that tell a language by its script, in order.
SCRIPTS = (("ja", "\\u3040-\\u30FF"), ("zh", "\\u4E00-\\u9FFF"), ("ru", "\\u0400-\\u04FF"), ("ar", "\\u0600-\\u06FF"), ("hi", "\\u0900-\\u097F"))


def script_hint(c: Column) -> Column:
    """A language told by its script alone, else null."""
    return _first(*[(c.rlike(f"[{block}]"), F.lit(lang)) for lang, block in SCRIPTS])


#: Very frequent words of four languages.
STOP_WORDS = {
    "de": "der die das und ist nicht mit von den ein eine zu auf für im dem des sich auch als",
    "en": "the of and to in is that for it with as on by at be this are was from or",
    "es": "el los las del que y en un una con por para es se no su al lo como más",
    "fr": "le les des et est dans que pour une sur pas par au avec ce il qui ne se du",
}


def language(c: Column, least: int = 40) -> Column:
    """The script's language, else that of which the text has most very frequent words (first by name if equal); null below least characters or without any."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), 1)
    of = lambda ws: F.size(F.filter(words, lambda w: w.isin(ws.split())))
    votes = [F.struct(of(ws).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, ws) in enumerate(sorted(STOP_WORDS.items()))]
    best = F.array_max(F.array(*votes))
    return F.when(F.length(c) >= least, F.coalesce(script_hint(c), F.when(best["n"] > 0, best["lang"])))


def looks_spanish(c: Column) -> Column:
    """Whether a text of any length is Spanish by language(); false for null."""
    return F.coalesce(language(c, 0) == "es", F.lit(False))


# numbers: each parser has rules of its own


def money(c: Column) -> Column:
    """A price of strict shape; of two kinds of separators the right-most is the decimal one, a lone comma is decimal, a lone dot stays; else null."""
    t = F.trim(c)
    shaped = t.rlike(r"^-?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?$")
    dots, commas = F.translate(t, ".", ""), F.translate(t, ",", "")
    both = t.contains(",") & t.contains(".")
    plain = _first((both & t.rlike(r"\..*,"), F.replace(dots, F.lit(","), F.lit("."))), (both, commas), (t.contains(","), F.replace(t, F.lit(","), F.lit("."))), (F.lit(True), t))
    return F.round(F.when(shaped, plain.try_cast("double")), 2)


def quantity(c: Column) -> Column:
    """A number with at most one separator, a comma or a dot before decimals; else null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^-?\d+(?:[.,]\d+)?$"), F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def measure(c: Column, has_unit: bool) -> Column:
    """A measure: with a unit 1.234 is a decimal, without one it has thousands; d,ddd has thousands either way; other commas are decimal."""
    t = F.trim(c)
    thousands = t.rlike(r"^\d{1,3}(?:,\d{3})+$") | (t.rlike(r"^\d{1,3}(?:\.\d{3})+$") if not has_unit else F.lit(False))
    return F.when(thousands, F.translate(t, ".,", "").try_cast("double")).when(t.contains(",") & t.contains("."), money(t)).otherwise(F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def work_number(c: Column) -> Column:
    """A number whose right-most separator is decimal; a lone comma is decimal."""
    t = F.regexp_replace(c, r"\s", "")
    european = t.rlike(r",[^.]*$")
    return F.when(european, F.replace(F.translate(t, ".", ""), F.lit(","), F.lit("."))).otherwise(F.translate(t, ",", "")).try_cast("double")


#: Letters that character recognition takes for digits, and the digits.
LOOK_ALIKE, DIGITS = "OoIlSBZ", "0011582"


def separators(c: Column) -> Column:
    """The number's text with a dot for decimals and no thousands: ,d or ,dd at the end is European, .d or .dd is English, else all separators go. Signs of currency go."""
    t = F.trim(F.translate(F.trim(c), "€$", ""))
    whole = lambda: F.translate(F.regexp_replace(t, r"[.,]\d{1,2}$", ""), ".,", "")
    return F.when(t.rlike(r"[.,]\d{1,2}$"), F.concat(whole(), F.lit("."), F.regexp_extract(t, r"(\d{1,2})$", 1))).otherwise(F.translate(t, ".,", ""))


def recognised_number(c: Column) -> Column:
    """separators() after letters between digits or separators have become the digits that they look like."""
    t = c
    for letter, digit in zip(LOOK_ALIKE, DIGITS, strict=True):
        t = F.regexp_replace(t, rf"(?<=[0-9.,]){letter}(?=[0-9.,])", digit)
    return separators(t)


#: Metres in a unit.
METRES = {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "inches": 0.0254, "feet": 0.3048, "yards": 0.9144}


def metres(value: Column, unit: Column) -> Column:
    """A length in metres; null for an unknown or null unit."""
    return value * _first(*[(F.lower(F.trim(unit)) == name, F.lit(f)) for name, f in METRES.items()])


def thickness_cm(c: Column) -> Column:
    """The first thickness that a text names, in centimetres; null if it names none."""
    pattern = r"(?i)\b(?:espesor|grosor|e(?=\s*=))\s*[:=]?\s*(?:de\s*)?(\d+(?:[.,]\d+)?)\s*(mm|cm|m)\b"
    return F.round(quantity(F.regexp_extract(c, pattern, 1)) * _first(*[(F.lower(F.regexp_extract(c, pattern, 2)) == u, F.lit(100 * METRES[u])) for u in ("mm", "cm", "m")]), 4)


def currency(c: Column) -> Column:
    """EUR for the euro's sign and names, else null."""
    return F.when(F.lower(F.trim(c)).isin("€", "eur", "euro", "euros"), "EUR")


def field_confidence(document: Column, present: Column, has_lines: Column) -> Column:
    """0.35 and 0.11 a field and 0.10 for lines, averaged with the document's confidence if there is one, within 0.35 and 0.98."""
    own = 0.35 + 0.11 * present + F.when(has_lines, 0.10).otherwise(0.0)
    return F.least(F.greatest(F.coalesce((own + document) / 2, own), F.lit(0.35)), F.lit(0.98))


_AMOUNT = r"(-?\d{1,3}(?:[.\s]\d{3})+(?:,\d{1,2})?|-?\d+(?:[.,]\d{1,2})?)"


def labelled_amount(c: Column, label: str) -> Column:
    """The amount on the line of a label, in Spanish form; null if there is none."""
    return C.amount(F.regexp_extract(c, rf"(?im)^[ \t]*(?:{label})[ \t]*[:#-]?[ \t]*{_AMOUNT}[ \t]*(?:€|eur|euros)?", 1))


#: How a document names its total, the surest first.
TOTALS = (r"total\s+(?:presupuesto|pedido|factura)", r"importe\s+total", r"total\s+a\s+pagar", r"total\s+(?:general|eur|euros)", "total", "importe")


def total_amount(c: Column) -> Column:
    """The last amount of the first of TOTALS that the text has."""
    last = lambda label: F.try_element_at(F.regexp_extract_all(c, F.lit(rf"(?im)^[ \t]*{label}[ \t]*[:#-]?[ \t]*{_AMOUNT}"), 1), F.lit(-1))
    return F.coalesce(*[C.amount(last(label)) for label in TOTALS])


def labelled_line(c: Column, label: str) -> Column:
    """What follows a label on its line, or, if nothing does, the next line; null without the label."""
    own = F.trim(F.regexp_extract(c, rf"(?im)^[ \t]*(?:{label})[ \t]*[:#][ \t]*([^\n]*)$", 1))
    below = F.trim(F.regexp_extract(c, rf"(?im)^[ \t]*(?:{label})[ \t]*[:#]?[ \t]*\n[ \t]*([^\n]+)$", 1))
    filled = lambda x: F.when(x != "", x)
    return F.coalesce(C.bound(own, filled), C.bound(below, filled))


def first_with_digit(c: Column, patterns: list[str]) -> Column:
    """The capture of the first pattern whose capture holds a digit."""
    return F.coalesce(*[C.bound(F.regexp_extract(c, p, 1), lambda x: F.when(x.rlike("[0-9]"), x)) for p in patterns])


#: What a status says, by words that mean it; refusals first.
STATUS_WORDS = (("rejected", "no aceptad|rechazad|rejected"), ("accepted", "aceptad|accepted|aprobad"), ("pending", "pendiente|pending"))


def stated_status(c: Column) -> Column:
    """The status that a labelled line states; null without the label."""
    return C.bound(F.lower(labelled_line(c, "estado|status")), lambda v: _first(*[(v.rlike(words), F.lit(name)) for name, words in STATUS_WORDS]))


# dates

#: Spanish months, long and short.
MONTH_NAMES = {name: k for k, name in enumerate(C.MONTHS, 1)} | {name[:3]: k for k, name in enumerate(C.MONTHS, 1)} | {"sept": 9, "setiembre": 9}
_NUMERIC = r"(?<!\d)(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?!\d)"
_WORDY = r"(?i)(?<!\d)(\d{1,2})\s+(?:de\s+)?(" + "|".join(sorted(MONTH_NAMES, key=len, reverse=True)) + r")\.?\s+(?:del?\s+)?(\d{4})(?!\d)"


def _date_of(found: Column, numeric: bool) -> Column:
    if numeric:
        last = lambda x: F.substring_index(x, "-", -1)
        return C.bound(F.translate(found, "/.", "--"), lambda x: C.bound(last(x), lambda y: _day(y, last(F.substring_index(x, "-", 2)), F.substring_index(x, "-", 1))))
    part = lambda k: F.regexp_extract(found, _WORDY, k)
    month = F.element_at(F.create_map(*[F.lit(x) for kv in MONTH_NAMES.items() for x in kv]), F.lower(part(2))).cast("string")
    return _day(part(3), month, part(1))


def _day(y: Column, m: Column, d: Column) -> Column:
    """The date of a year of two or four digits, a month and a day; null if there is none."""
    year = F.when(F.length(y) == 2, F.concat(F.when(y.try_cast("int") < 70, F.lit("20")).otherwise(F.lit("19")), y)).otherwise(y)
    return F.concat(year, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")


def dates(c: Column) -> Column:
    """All dates of a text, the numeric ones (d/m/y) first, then those in words; years of two digits below 70 are of this century; impossible dates are left out."""
    found = lambda p: F.regexp_extract_all(c, F.lit(p), 0)
    both = F.concat(F.transform(found(_NUMERIC), lambda x: _date_of(x, True)), F.transform(found(_WORDY), lambda x: _date_of(x, False)))
    return F.filter(both, lambda d: d.isNotNull())


def first_date(c: Column, labels: str = "") -> Column:
    """The first date after one of the labels (a pattern), if there is one, else the first date of the text: of dates(), of which the first numeric one, if it is a date, is the first."""
    numeric = lambda t: C.bound(F.regexp_extract(t, _NUMERIC, 0), lambda x: _date_of(x, True))
    first = lambda t: F.coalesce(numeric(t), F.get(dates(t), F.lit(0)))
    return F.coalesce(C.bound(F.regexp_extract(c, rf"(?is)(?:{labels})(.*)$", 1), first), first(c)) if labels else first(c)


def iso_dates(c: Column) -> Column:
    """The text with each d/m/y whose day is above 12, and so can't be a month, in ISO form; two-digit years pivot at 50."""
    month, day = r"0?([1-9]|1[0-2])", r"(1[3-9]|[2-9][0-9])"
    t = F.regexp_replace(c, rf"\b{day}[/-]{month}[/-](\d{{4}})\b", "$3-0$2-$1")
    t = F.regexp_replace(t, rf"\b{day}[/-]{month}[/-]([0-4]\d)\b", "20$3-0$2-$1")
    t = F.regexp_replace(t, rf"\b{day}[/-]{month}[/-]([5-9]\d)\b", "19$3-0$2-$1")
    return F.regexp_replace(t, r"\b(\d{4})-0(\d{2})-(\d{2})\b", "$1-$2-$3")


def sent_at(c: Column) -> Column:
    """The moment of a mail header's date, else midnight UTC of a Spanish date; null if it is neither."""
    mail = F.try_to_timestamp(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(mail, F.get(dates(c), F.lit(0)).cast("timestamp"))


# identifiers

#: Lengths of bank account numbers by country.
IBAN_LENGTHS = {
    "ES": 24, "PT": 25, "FR": 27, "DE": 22, "IT": 27, "GB": 22, "NL": 18, "BE": 16, "AT": 20, "CH": 21,
    "IE": 22, "SE": 24, "NO": 15, "DK": 18, "FI": 18, "PL": 28, "CZ": 24, "RO": 24, "HU": 28, "GR": 27,
}


def nif_repaired(c: Column) -> Column:
    """The tax id of a person in normal form if its letter is right, also where a look-alike digit stands for it; else null."""
    t = F.upper(F.translate(F.trim(c), " ", ""))
    want = F.substring(F.lit(C.NIF_LETTERS), F.substring(t, 1, 8).try_cast("int") % 23 + 1, F.lit(1))
    got = F.translate(F.substring(t, 9, 1), "58", "SB")
    return F.when(t.rlike("^[0-9]{8}[A-Z0-9]$") & (got == want), F.concat(F.substring(t, 1, 8), want))


def iban_valid(c: Column) -> Column:
    """Whether an account number has its country's length (any, for countries not in the table) and leaves 1 modulo 97; false for null.

    The remainder is folded digit by digit, so no number grows large.
    """
    t = F.upper(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[ -]", ""))
    moved = F.concat(F.substring(t, 5, 64), F.substring(t, 1, 4))
    values = F.transform(F.split(moved, ""), lambda ch: F.when(ch.rlike("^[0-9]$"), ch.try_cast("int")).otherwise(F.ascii(ch) - 55))
    rest = F.aggregate(values, F.lit(0), lambda a, v: (F.when(v > 9, a * 100).otherwise(a * 10) + v) % 97)
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    size = F.coalesce(F.try_element_at(lengths, F.substring(t, 1, 2)), F.length(t))
    return t.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,60}$") & (F.length(t) == size) & (rest == 1)


# redaction

#: Placeholders, and what they stand for, in the order in which they are looked for.
HIDDEN_AMOUNT, HIDDEN_DATA = "[IMPORTE OCULTO]", "[DATO OCULTO]"
AMOUNT_LABELS = r"total|importe|precio(?:\s+unitario)?|base\s+imponible|iva|subtotal|descuento|margen|beneficio|coste|costo|condiciones\s+comerciales"
AMOUNT_PATTERNS = (
    (rf"(?i)\b({AMOUNT_LABELS})\s*[:#-]?\s*\d{{1,3}}(?:[.\s]\d{{3}})*(?:[,.]\d{{2}})?\s*(?:€|eur|euros)?", "$1 " + HIDDEN_AMOUNT),
    (r"(?i)\b(margen|beneficio|descuento)\s*[:#-]?\s*\d{1,3}(?:[,.]\d{1,2})?\s*%", "$1 " + HIDDEN_AMOUNT),
    (r"(?i)\b(?:\d{1,3}(?:[.\s]\d{3})+(?:[,.]\d{2})?|\d+[,.]\d{2}|\d+)\s*(?:€|eur|euros)(?=\s|$|[.,;:!?])", HIDDEN_AMOUNT),
)
PERSONAL_PATTERNS = (
    r"(?i)\b(?:ES[\s-]?)?\d{2}(?:[\s-]?\d{4}){5}\b",
    r"\b[XYZ]?\d{7,8}[A-Z]\b",
    r"\b[ABCDEFGHJUV]\d{8}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"(?:\+34[\s-]?)?\b[6789]\d{8}\b",
)
#: Kinds of sensitive data, their patterns and how sure a finding is.
SENSITIVE = (
    ("iban", r"(?i)\b[A-Z]{2}\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{0,4}\b", 0.9),
    ("nif_cif", r"(?i)\b[0-9]{8}[A-Z]\b|\b[A-Z][0-9]{7}[A-Z0-9]\b", 0.8),
    ("phone", r"(?<!\d)(?:\+?34[\s-]?)?[6-9]\d{2}[\s.-]?\d{3}[\s.-]?\d{3}(?!\d)", 0.7),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.95),
    ("account_number", r"\b\d{4}[\s.-]?\d{4}[\s.-]?\d{4}[\s.-]?\d{4}\b", 0.6),
    ("amount", r"(?:\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?\s*(?:EUR|€|USD|\$|GBP|£)|(?:EUR|€|USD|\$|GBP|£)\s*\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)", 0.85),
)


def hide_amounts(c: Column) -> Column:
    """Labelled amounts, margins in per cent, then amounts with a currency; empty for null."""
    return _replaced(F.coalesce(c, F.lit("")), *AMOUNT_PATTERNS)


def hide_personal(c: Column) -> Column:
    """Accounts, tax ids of persons and companies, addresses, phones, in this order; empty for null."""
    return _replaced(F.coalesce(c, F.lit("")), *[(p, HIDDEN_DATA) for p in PERSONAL_PATTERNS])


def hide_all(c: Column) -> Column:
    """Amounts first, so that groups of digits in accounts aren't taken for them twice, then personal data."""
    return hide_personal(hide_amounts(c))


def sensitive(c: Column) -> Column:
    """array<struct<kind, value, start, stop, confidence>> of sensitive data, by start, then kind; code points from 0, stop exclusive.

    A kind's findings are placed by cutting the text at them: the pieces' lengths give the offsets.
    """
    t = F.coalesce(c, F.lit(""))
    empty = F.array().cast("array<struct<kind:string,value:string,start:long,stop:long,confidence:double>>")
    kinds = []
    for kind, pattern, sure in SENSITIVE:
        values, gaps = F.regexp_extract_all(t, F.lit(f"({pattern})"), 1), F.split(t, pattern)
        # gaps[i] precedes values[i]; a running sum of both lengths places each
        zipped = F.arrays_zip(F.slice(F.transform(gaps, lambda g: F.length(g)), F.lit(1), F.size(values)).alias("gap"), values.alias("value"))
        start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
        placed = F.aggregate(zipped, start, _placing(kind, sure), lambda a: a["out"])
        kinds.append(F.when(F.size(values) > 0, placed).otherwise(empty))
    return F.array_sort(F.concat(*kinds), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0))


def _placing(kind: str, sure: float):
    """Adds a finding to those so far, and moves on behind it."""

    def step(a: Column, x: Column) -> Column:
        begin = (a["at"] + x["gap"]).cast("long")
        end = begin + F.length(x["value"])
        found = F.struct(F.lit(kind).alias("kind"), x["value"].alias("value"), begin.alias("start"), end.alias("stop"), F.lit(sure).alias("confidence"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(found)).alias("out"))

    return step


def redact_kinds(c: Column, amounts: bool = True, personal: bool = True) -> Column:
    """Each kind's findings become [KIND_REDACTED], kind after kind, so that overlapping findings don't spoil one another."""
    return _replaced(c, *[(p, f"[{kind.upper()}_REDACTED]") for kind, p, _ in SENSITIVE if (amounts if kind == "amount" else personal)])


#: Attempts to direct a model from inside a document: name, pattern, score.
INJECTIONS = (
    ("ignore_previous_instructions", r"(?i)\b(?:ignora|ignore|disregard|olvida|forget)\b[^\n]{0,40}\b(?:instrucciones?|instructions?|preceding|anterior|previo)\b", 0.95),
    ("you_are_now", r"(?i)\b(?:you are now|ahora eres|from now on|a partir de ahora)\b[^\n]{0,80}\b(?:assistant|chatbot|jailbreak|DAN|evil|unrestricted)\b", 0.90),
    ("system_role_marker", r"(?i)\b(?:^|\n)\s*(system|assistant|user)\s*:\s*[A-Z]", 0.85),
    ("openai_chat_ml", r"<\|(?:im_start|im_end|endoftext|system|user|assistant)\|>", 0.99),
    ("tool_call_marker", r"\{[^{}]*?[\"']?(?:name|function|arguments|tool)[\"']?\s*:", 0.85),
    ("output_secrets", r"(?i)\b(?:output|print|reveal|expose|return|dump|leak)\b[^\n]{0,40}\b(?:api[_\s]?key|secret|password|token|credential|system[_\s]?prompt)\b", 0.90),
    ("bypass_safety", r"(?i)\b(?:bypass|jailbreak|skip|disable|override)\b[^\n]{0,40}\b(?:safety|filter|guardrail|restriction|policy|rule)\b", 0.85),
    ("fake_tool_invocation", r"(?i)\b(?:call|invoke|run|execute)\b[^\n]{0,30}\b(?:tool|function|action)\b[^\n]{0,30}\b(?:with|using)\b[^\n]{0,80}", 0.80),
    ("system_prompt_exfiltration", r"(?i)\b(?:output|print|reveal|expose|dump|leak|repeat|copy)\b[^\n]{0,40}\b(?:system[_\s]?prompt|developer[_\s]?policy|hidden[_\s]?instructions)\b", 0.80),
    ("exfiltrate_data", r"(?i)\b(?:send|email|post|upload|transmit)\b[^\n]{0,40}\b(?:to|at)\b[^\n]{0,80}\b(?:http|https|@|\.com|attacker)\b", 0.85),
)
#: Least score to act on, by sensitivity.
SENSITIVITY = {"low": 0.95, "medium": 0.80, "high": 0.50}


def injection_score(c: Column, sensitivity: str = "medium") -> Column:
    """The greatest score of the attempts in a text, 0 below the sensitivity's least."""
    score = F.coalesce(F.array_max(F.array(*[F.when(c.rlike(p), F.lit(s)).otherwise(0.0) for _, p, s in INJECTIONS])), F.lit(0.0))
    return F.when(score >= SENSITIVITY[sensitivity], score).otherwise(0.0)


def without_injections(c: Column, sentinel: str = "[REMOVED]") -> Column:
    return _replaced(c, *[(p, sentinel) for _, p, _ in INJECTIONS])


def csv_cell(c: Column) -> Column:
    """A cell that a spreadsheet won't take for a formula: those that begin with =, +, -, @, a tab or CR get an apostrophe."""
    return F.when(F.regexp_replace(c, "^ +", "").rlike("^[=+@\t\r-]"), F.concat(F.lit("'"), c)).otherwise(c)


# arrays and hashes


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def fitted(v: Column, size: int) -> Column:
    """The vector cut or filled with zeros to a size; null for null."""
    d = v.cast("array<double>")
    return F.concat(F.slice(d, 1, size), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), size - F.size(d))))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts in order, null as empty, with U+0001 between."""
    return F.sha2(F.concat_ws("\x01", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def fuzzy_match(a: Column, b: Column, least: float = 0.6) -> Column:
    """Equal or one within the other without case, numbers within 0.01, or the share least of the fewer words in common."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    p, q = x.try_cast("double"), y.try_cast("double")
    u, v = word_set(x), word_set(y)
    words = F.size(F.array_intersect(u, v)) / F.greatest(F.lit(1), F.least(F.size(u), F.size(v)))
    return F.coalesce((x == y) | x.contains(y) | y.contains(x) | F.coalesce(F.abs(p - q) <= 0.01, F.lit(False)) | (words >= least), F.lit(False))
