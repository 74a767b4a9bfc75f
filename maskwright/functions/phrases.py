"""Phrases around a span, as SQL over one string for either dialect. Word bytes are ASCII letters, digits and all beyond ASCII."""

from __future__ import annotations

from maskwright.functions.dialect import Spark
from maskwright.functions.rules import NOT_WORD_BYTE

# Words and phrases of the context rules.
NEGATIONS, AUXILIARIES = ("не", "никогда"), ("был", "была", "были", "было", "быть")
CONNECTIVES = (
    "г", "город", "городе", "города", "ул", "улица", "проспект", "пр-т", "д", "дом", "корп", "корпус", "стр", "строение", "кв", "квартира", "область", "край", "республика", "индекс", "в",
)
DATE_PHRASES = (("дата рождения", "BIRTH_DATE"), ("родился", "BIRTH_DATE"), ("родилась", "BIRTH_DATE"), ("дата выдачи", "PASSPORT_ISSUE_DATE"), ("паспорт выдан", "PASSPORT_ISSUE_DATE"))
ISSUED, PASSPORT = "выдан", "паспорт"
ADDRESS_PHRASES = ("адрес регистрации", "адрес проживания", "адрес", "проживает", "зарегистрирован")
PLACE_PHRASES = (("место рождения", "BIRTH_PLACE"), ("родился в", "BIRTH_PLACE"), ("родилась в", "BIRTH_PLACE"), *((p, "ADDRESS") for p in ADDRESS_PHRASES))
CLIENT = ("клиент", "заявитель", "заёмщик", "пользователь", "владелец", "гражданин", "фио")
POSITIVE = ("дата рождения", "адрес регистрации", "место рождения")
ORGANIZATION = ("ооо", "ао", "пао", "банк", "филиал", "отделение", "юридический адрес", "инн организации")
ORGANIZATION_INN = ("инн организации", "инн юрлица")
PUBLIC = ("поэт", "писатель", "автор", "биография", "стихотворение")

_NO = NOT_WORD_BYTE
_NEGATED = rf"(?:\A|{_NO})(?:{'|'.join(NEGATIONS)})[ \t]+(?:(?:{'|'.join(AUXILIARIES)})[ \t]+)*"
_BETWEEN = r"[ \t\n,:;.]"


def present(d: Spark, s: str, phrases: tuple[str, ...]) -> str:
    """Whether one of the phrases stands in lower-case ``s`` as words of their own."""
    return d.like(s, rf"(?:\A|{_NO})(?:{'|'.join(p.replace('.', r'\.') for p in phrases)})(?:{_NO}|\z)")


def present_not_negated(d: Spark, s: str, phrases: tuple[str, ...]) -> str:
    """As ``present``, leaving out those that a negation before them turns."""
    return present(d, d.replace_all(s, rf"({_NEGATED})(?:{'|'.join(phrases)})", 1, "#"), phrases)


def applies(d: Spark, s: str, phrase: str) -> str:
    """Whether the last ``phrase`` in lower-case ``s`` is not negated and only connecting words follow it."""
    pattern = rf"(?s)\A(.*{_NO}|){phrase}({_NO}.*|)\z"
    follows = rf"\A{_BETWEEN}*(?:(?:{'|'.join(CONNECTIVES)})(?:{_BETWEEN}+|\z))*\z"
    return f"({d.like(s, pattern)} AND NOT {d.like(d.extract(s, pattern, 1), _NEGATED + chr(92) + 'z')} AND {d.like(d.extract(s, pattern, 2), follows)})"


def clause(d: Spark, s: str) -> str:
    """The last clause of ``s``."""
    return d.extract(s, r"[^;.!?\n]*\z")


def promoted_type(d: Spark, kind: str, left: str) -> str:
    """The type after context: dates and places become one of the final types or null; ``left`` is up to 60 characters before, on the line."""
    near, in_clause = f"lower(right({left}, 40))", f"lower(right({clause(d, left)}, 40))"
    issued = f"WHEN {applies(d, in_clause, ISSUED)} AND {present(d, in_clause, (PASSPORT,))} THEN 'PASSPORT_ISSUE_DATE'"
    dates = " ".join(f"WHEN {applies(d, near, p)} THEN '{t}'" for p, t in DATE_PHRASES)
    places = " ".join(f"WHEN {applies(d, near, p)} THEN '{t}'" for p, t in PLACE_PHRASES)
    return f"CASE {kind} WHEN 'DATE' THEN (CASE {dates} {issued} END) WHEN 'LOCATION' THEN (CASE {places} END) ELSE {kind} END"


def addressed(d: Spark, left: str) -> str:
    """Whether an address phrase applies to what follows ``left``."""
    return "(" + " OR ".join(applies(d, f"lower({left})", p) for p in ADDRESS_PHRASES) + ")"
