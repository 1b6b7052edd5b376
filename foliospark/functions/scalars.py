"""Scalar functions over text, numbers and dates as column expressions; no function here leaves the JVM."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: French month names with and without accents
MONTHS = {
    "janvier": "01", "février": "02", "fevrier": "02", "mars": "03", "avril": "04", "mai": "05", "juin": "06", "juillet": "07",
    "août": "08", "aout": "08", "septembre": "09", "octobre": "10", "novembre": "11", "décembre": "12", "decembre": "12",
}
DECIMAL = "decimal(20,6)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; without it Catalyst would copy the value into each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def present(c: Column) -> Column:
    """The value, or null if it is null or an empty string."""
    return F.when(c != "", c)


def is_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def parse_decimal(c: Column) -> Column:
    """The number in a text whose last ``.`` or ``,`` separates the decimals; null if it spans lines, has no digit or an inner minus.

    Digits beyond six decimals are rounded; more than fourteen before the separator give null. A plain number, which nothing would be taken out of, is cast at once.
    """
    kept = F.regexp_replace(c, r"[^0-9.,\-]", "")
    one_sign = F.regexp_replace(kept, "^-+", "-")
    one_separator = F.translate(F.regexp_replace(one_sign, "[.,](?=.*[.,])", ""), ",", ".")
    return F.when(c.rlike(r"^-?[0-9]+(?:\.[0-9]+)?\z"), c.try_cast(DECIMAL)).when(~c.rlike(r"[\n\r]"), one_separator.try_cast(DECIMAL))


def parse_date(c: Column) -> Column:
    """The date in one of five shapes; the first shape that fits decides, and an impossible date is null."""
    text = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    spelled = r"(?U)^(\d{1,2})\s+(\p{L}+)\s+(\d{4})\z"
    months = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    month = F.try_element_at(months, F.lower(F.regexp_extract(text, spelled, 2)))
    # each other shape is turned into y-m-d, which no later pattern matches
    iso = text
    for pattern, order in ((r"^(\d{2})(\d{2})(\d{2})\z", "20$3-$2-$1"), (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\z", "$3-$2-$1"), (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2})\z", "20$3-$2-$1")):
        iso = F.regexp_replace(iso, pattern, order)
    named = F.concat_ws("-", F.right(text, F.lit(4)), month, F.regexp_extract(text, r"^(\d+)", 1))
    return F.try_to_date(F.when(month.isNotNull(), named).otherwise(iso), "yyyy-M-d")


def format_ddmmyy(c: Column) -> Column:
    return F.date_format(c, "ddMMyy")


def format_amount(c: Column) -> Column:
    """Three decimals, ties to the even digit."""
    return F.bround(c.cast(DECIMAL), 3).cast("decimal(18,3)").cast("string")


def format_quantity(c: Column) -> Column:
    """As an amount, without trailing zeros."""
    return F.rtrim(F.rtrim(format_amount(c), F.lit("0")), F.lit("."))


def compact(c: Column) -> Column:
    """Upper case without white space, slashes, dashes and dots; null becomes empty."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s/\-.]", ""))


#: Complete case folding, derived from Python's: characters that fold to one character, and those that fold to several.
_FOLDED = {chr(i): chr(i).casefold() for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and chr(i).casefold() != chr(i)}
_SINGLE = {k: v for k, v in _FOLDED.items() if len(v) == 1}
_SEVERAL = {k: v for k, v in _FOLDED.items() if len(v) > 1}
_PAIRS = "array(" + ", ".join(f"named_struct('a', '{k}', 'b', '{v}')" for k, v in _SEVERAL.items()) + ")"


def casefold(c: Column) -> Column:
    """The text with all differences of case removed, whatever stands around a character: ligatures and the sharp s become letters, every sigma the same one, the dotted I an i and a dot. Not by locale."""
    plain = F.translate(c, "".join(_SINGLE), "".join(_SINGLE.values()))
    some = F.when(c.rlike("[" + "".join(_SEVERAL) + "]"), F.expr(_PAIRS)).otherwise(F.array().cast("array<struct<a:string,b:string>>"))
    full = F.aggregate(some, plain, lambda text, p: F.replace(text, p["a"], p["b"]))
    return F.when(c.rlike(r"[^\x00-\x7F]"), full).otherwise(F.lower(c))


def fold(c: Column) -> Column:
    """Without white space and differences of case: the form in which values are looked for in a text."""
    return casefold(F.regexp_replace(c, r"(?U)\s", ""))


def occurs(value: Column, folded_text: Column) -> Column:
    """Whether a value that isn't blank stands in a folded text."""
    return F.coalesce((F.length(fold(value)) > 0) & folded_text.contains(fold(value)), F.lit(False))


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def labelled(severity: Column, where: Column, message: Column) -> Column:
    return F.format_string("[%s] %s: %s", F.upper(severity), where, message)


def label_suffix(snippet: Column, most: int = 4) -> Column:
    """The longest run of up to ``most`` last words that reads as a label: letters and few marks, no digit, 2 to 40 characters."""
    words = F.filter(F.split(snippet, r"(?U)\s+"), lambda w: w != "")
    tails = F.transform(F.sequence(F.lit(most), F.lit(1), F.lit(-1)), lambda n: F.when(n <= F.size(words), F.array_join(F.slice(words, -n, n), " ")))
    good = F.filter(tails, lambda t: t.isNotNull() & t.rlike(r"^[A-Za-zÀ-ÿ .:'/-]{2,40}$"))
    return F.try_element_at(good, F.lit(1))


def line_context(text: Column, value: Column) -> Column:
    """Struct ``before, after``: what stands beside the value's first place on its line, or else on the line above or below; null if absent."""
    at = F.position(value, text)
    head, tail = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(value), F.length(text))
    above, below = F.split(head, "\n"), F.split(tail, "\n")
    trim = lambda c: F.regexp_replace(c, r"^[ :|\t]+|[ :|\t]+$", "")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    before, after = trim(F.element_at(above, -1)), trim(F.element_at(below, 1))
    before = F.when((before == "") & (F.size(above) > 1), strip(F.try_element_at(above, F.lit(-2)))).otherwise(before)
    after = F.when((after == "") & (F.size(below) > 1), strip(F.try_element_at(below, F.lit(2)))).otherwise(after)
    return F.when((at > 0) & (F.length(value) > 0), F.struct(F.coalesce(before, F.lit("")).alias("before"), F.coalesce(after, F.lit("")).alias("after")))


def pick_label(context: Column) -> Column:
    """A label after the value, else before it, else whatever stands there."""
    before, after = context["before"], context["after"]
    return F.coalesce(label_suffix(after), label_suffix(before), present(after), present(before))
