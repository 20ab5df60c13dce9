"""Column expressions for single values; all run inside the JVM.

Patterns are matched against whole values with \\A and \\z, since `rlike` finds and
`$` also matches before a last line break.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of values.  \\w of Unicode text is [\p{L}\p{N}_].
EMAIL = r"[\p{L}\p{N}_.+%-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+?\(?[0-9]{1,4}\)?(?:[\s.-]?\(?[0-9]{1,4}\)?){2,5}"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
ISSUED_SSN = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"
NINO = r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]"
NINO_UNUSED = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
NAME_WORD = rf"[A-ZÀ-ÖØ-Þ]{LETTER}*(?:['’-]{LETTER}+)*\.?"
NAME = rf"{NAME_WORD}(?: (?:van|von|de|der|da|di|del|la|le|bin|al|{NAME_WORD})){{0,3}}"
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
THOUSANDS = r"[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?"
LEADING_ZERO = r"\A[+-]?0[0-9]"
ISO_TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?(?:Z|[+-](?:[01][0-9]|2[0-3]):?[0-5][0-9])?"
ISO_MOMENT = rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:[T ]{ISO_TIME})?"
ISO_DATE_START = r"(?s)\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ].*)?\z"
COUNTRY_CODE = r"[A-Z]{2,3}"


def whole(value: Column, pattern: str) -> Column:
    return value.rlike(rf"\A(?:{pattern})\z")


def finite(value: Column) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(F.abs(value.cast("double")) < float("inf"), value.cast("double"))


def is_email(value: Column) -> Column:
    return value.contains("@") & whole(value, EMAIL)


def is_phone(value: Column) -> Column:
    """9 to 15 digits in groups, with a plus before or two separators at least; no address, no security number."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    separators = F.length(F.regexp_replace(value, r"[^ .\-()]", ""))
    return F.length(value).between(9, 30) & whole(value, PHONE) & ~whole(value, IPV4) & ~whole(value, SSN) & digits.between(9, 15) & (value.startswith("+") | (separators >= 2))


def has_phone(value: Column) -> Column:
    found = F.regexp_extract_all(value, F.lit(rf"((?<![\p{{L}}\p{{N}}_.]){PHONE}(?![\p{{L}}\p{{N}}_]))"), F.lit(1))
    return F.exists(found, is_phone)


def has_contact(value: Column) -> Column:
    return (value.contains("@") & value.rlike(EMAIL)) | has_phone(value)


def is_us_ssn(value: Column) -> Column:
    return whole(value, ISSUED_SSN)


def is_uk_nino(value: Column) -> Column:
    compact = F.replace(value, F.lit(" "), F.lit(""))
    return whole(compact, NINO) & ~F.substring(compact, 1, 2).isin(*NINO_UNUSED)


def is_iban(value: Column) -> Column:
    """Shape and the checksum modulo 97; letters count from A = 10."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    digits = F.transform(F.split(turned, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(digits, F.lit(0), lambda a, x: F.pmod(F.when(x >= 10, a * 100 + x).otherwise(a * 10 + x), F.lit(97)))
    return F.when(F.length(compact).between(15, 34) & whole(compact, IBAN), rest == 1).otherwise(F.when(value.isNotNull(), False))


def is_person_name(value: Column) -> Column:
    return (F.length(value) <= 60) & whole(value, NAME)


def word_count(value: Column) -> Column:
    """Runs of letters."""
    return F.regexp_count(value, F.lit(rf"{LETTER}+"))


def stripped(value: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(value, r"(?U)\A\s+|\s+\z", "")


def is_number_text(value: Column) -> Column:
    return whole(stripped(value), f"{NUMBER}|{THOUSANDS}")


def has_leading_zero(value: Column) -> Column:
    return stripped(value).rlike(LEADING_ZERO)


def is_iso_moment(value: Column) -> Column:
    """An ISO 8601 date that exists, alone or with a time of day."""
    return whole(value, ISO_MOMENT) & F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd").isNotNull()


def looks_like_date(value: Column) -> Column:
    return value.rlike(ISO_DATE_START)


def day_of(value: Column, kind: str) -> Column:
    """The calendar day of a date, a moment (in UTC) or ISO text; null where none exists."""
    if kind == "string":
        return F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")
    return F.to_date(value)


def ordinal(value: Column, kind: str) -> Column:
    """Microseconds since 1970 as a number; null where text is no moment."""
    if kind == "string":
        value = F.coalesce(F.try_to_timestamp(value), F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd").cast("timestamp"))
    return F.unix_micros(value.cast("timestamp")).cast("double")


def has_blank(value: Column) -> Column:
    return value.rlike(r"(?U)\s")


def label_text(value: Column, kind: str) -> Column:
    text = value.cast("string")
    return F.initcap(text) if kind == "boolean" else text
