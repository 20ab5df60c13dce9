"""What a column's name alone says; names are metadata, so this runs on the driver."""

from __future__ import annotations

import re

# Name rules, each list in natural order.
ID_WORD = re.compile(r"(?:^|[^a-z0-9])(?:id|uuid|guid|key)$", re.IGNORECASE)
ID_CAMEL = re.compile(r"[a-z0-9](?:Id|ID)$")
EMAIL_WORDS = {"email", "emails", "mail"}
PHONE_WORDS = {"fax", "mobile", "msisdn", "phone", "phones", "tel", "telephone"}
NATIONAL_ID_WORDS = {"iban", "nino", "passport", "ssn"}
NATIONAL_ID_PAIRS = ({"national", "id"}, {"national", "insurance"}, {"social", "security"}, {"tax", "id"})
NOT_A_VALUE_WORDS = {
    "brand", "calls", "carrier", "charge", "charges", "cost", "count", "data", "domain", "flag", "has", "is", "length", "make", "minutes", "model", "opt", "optin",
    "os", "plan", "price", "provider", "rate", "sent", "service", "status", "template", "type", "usage", "valid", "verified",
}
NAME_QUALIFIERS = {"family", "first", "full", "given", "last", "maiden", "middle", "sur"}
NAME_WORDS = {"familyname", "firstname", "fname", "forename", "fullname", "givenname", "lastname", "lname", "middlename", "surname"}
FREE_TEXT_WORDS = {"bio", "comment", "comments", "complaint", "complaints", "feedback", "message", "messages", "narrative", "note", "notes", "remark", "remarks", "review", "reviews", "transcript"}


def words_of(name: str) -> frozenset[str]:
    """Lower-case words of a name, cut at camel humps and at everything but letters and digits."""
    return frozenset(re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower()))


def is_identifier_name(name: str) -> bool:
    return any(p.search(name) for p in (ID_WORD, ID_CAMEL))


def _value_of(words: frozenset[str], wanted: set[str], pairs=()) -> bool:
    return words.isdisjoint(NOT_A_VALUE_WORDS) and (not words.isdisjoint(wanted) or any(p <= words for p in pairs))


def is_email_name(name: str) -> bool:
    return _value_of(words_of(name), EMAIL_WORDS)


def is_phone_name(name: str) -> bool:
    return _value_of(words_of(name), PHONE_WORDS)


def is_national_id_name(name: str) -> bool:
    return _value_of(words_of(name), NATIONAL_ID_WORDS, NATIONAL_ID_PAIRS)


def is_free_text_name(name: str) -> bool:
    return not words_of(name).isdisjoint(FREE_TEXT_WORDS)


def person_name_kind(name: str) -> str | None:
    """"person" for the name of a person's name, "bare" for just `name`, else None."""
    words = words_of(name)
    plain = words & {"name", "names"}
    if words & NAME_WORDS or plain and words & NAME_QUALIFIERS:
        return "person"
    return "bare" if plain and words == plain else None
