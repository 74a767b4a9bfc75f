"""Checks of numbers and dates as SQL over one string, for either dialect."""

from __future__ import annotations

from maskwright.functions.dialect import Spark

# Weights of the tax number's check digits.
INN_PERSON_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_PERSON_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_ORGANIZATION = (2, 4, 10, 3, 5, 9, 4, 6, 8)
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def _digit(s: str, i: int) -> str:
    return f"TRY_CAST(substr({s}, {i}, 1) AS INT)"


def _check_digit(s: str, weights: tuple[int, ...]) -> str:
    return "((" + " + ".join(f"{w} * {_digit(s, i + 1)}" for i, w in enumerate(weights)) + f") % 11 % 10 = {_digit(s, len(weights) + 1)})"


def luhn(d: Spark, s: str) -> str:
    """13 to 19 digits whose Luhn sum ends in 0."""
    return f"(CASE WHEN {d.like(s, r'\A[0-9]{13,19}\z')} THEN {d.luhn(s)} ELSE false END)"


def card(d: Spark, s: str) -> str:
    return luhn(d, d.digits(s))


def inn_person(d: Spark, s: str) -> str:
    """12 digits with both check digits of a person's tax number."""
    return f"(CASE WHEN {d.like(s, r'\A[0-9]{12}\z')} THEN {_check_digit(s, INN_PERSON_11)} AND {_check_digit(s, INN_PERSON_12)} ELSE false END)"


def inn_organization(d: Spark, s: str) -> str:
    """10 digits with the check digit of an organisation's tax number."""
    return f"(CASE WHEN {d.like(s, r'\A[0-9]{10}\z')} THEN {_check_digit(s, INN_ORGANIZATION)} ELSE false END)"


def calendar(y: str, m: str, day: str) -> str:
    """Whether year, month and day (integers) are a date of the Gregorian calendar."""
    leap = f"({y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0))"
    return f"({y} >= 1 AND {m} BETWEEN 1 AND 12 AND {day} >= 1 AND {day} <= CASE WHEN {m} IN (4, 6, 9, 11) THEN 30 WHEN {m} = 2 THEN CASE WHEN {leap} THEN 29 ELSE 28 END ELSE 31 END)"


def numeric_date(d: Spark, s: str) -> str:
    """Three numbers with one separator that are a date in any of four orders."""
    a, b, c = (f"TRY_CAST({d.extract(s, p, 1)} AS INT)" for p in (r"\A([0-9]+)", r"\A[0-9]+[./-]([0-9]+)", r"([0-9]+)\z"))
    orders = " OR ".join(calendar(*x) for x in ((c, b, a), (c, a, b), (a, b, c), (a, c, b)))
    return f"({d.like(s, r'\A[0-9]+(?:\.[0-9]+\.|-[0-9]+-|/[0-9]+/)[0-9]+\z')} AND ({orders}))"


def textual_date(d: Spark, s: str) -> str:
    """Day, month name and year; a closing word for year must follow a blank."""
    month = "CASE " + " ".join(f"WHEN {d.like(s, '(?i)' + m)} THEN {i + 1}" for i, m in enumerate(MONTHS)) + " END"
    day, year = (f"TRY_CAST({d.extract(s, p, 1)} AS INT)" for p in (r"\A([0-9]+)", r"[\t\n\f\r ]([0-9]{4})"))
    return f"({d.like(s, r'(?i)(?:[0-9]| года)\z')} AND {calendar(year, month, day)})"


def email(d: Spark, s: str) -> str:
    """Local part and domain labels: not empty, no hyphen at an end, no dot at an end or twice."""
    label = r"[A-Za-z0-9_%+](?:[A-Za-z0-9_%+-]*[A-Za-z0-9_%+])?"
    local = r"(?:[A-Za-z0-9_%+](?:(?:[A-Za-z0-9_%+-]|\.[A-Za-z0-9_%+-])*(?:[A-Za-z0-9_%+]))?)"
    return d.like(s, rf"\A{local}@{label}(?:\.{label})*\z")


def phone(d: Spark, s: str) -> str:
    """Parentheses that close."""
    return d.like(s, r"\A[^()]*(?:\([^()]*\)[^()]*)?\z")


def not_zero(d: Spark, s: str) -> str:
    return f"({s} <> '000000')"


def name_like(d: Spark, s: str) -> str:
    """Two words, or three to four that are each upper case or a capital and lower case in every hyphenated part."""
    part = r"(?:\p{Lu}+|\p{Lu}\p{Ll}*)"
    word = rf"{part}(?:-{part})*"
    return f"({d.like(s, r'\A[^ \t]+[ \t]+[^ \t]+\z')} OR {d.like(s, rf'\A{word}(?:[ \t]+{word}){{2,3}}\z')})"
