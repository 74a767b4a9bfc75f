"""Rules: what a span looks like and what must stand around it.

A rule finds its pattern from the left without overlaps; a match that fails a
check still uses its text up. ``left`` and ``right`` are tests of what stands
before and after (pattern, wanted); ``before_value`` is one of all that stands
before the value, which is group 1 at the pattern's end where ``group`` is 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from maskwright.functions import checks

ALNUM = r"[\p{L}\p{Nd}]"
WORD_BYTE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
NOT_WORD_BYTE = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]"
NOT_ASCII = r"[\x{80}-\x{10FFFF}]"
_DIGIT_EDGE_LEFT, _DIGIT_EDGE_RIGHT = (rf"{ALNUM}\z", False), (rf"\A{ALNUM}", False)


@dataclass(frozen=True)
class Rule:
    """One span generator."""

    name: str
    type: str
    pattern: str
    hint: str  # a text without it has no match
    group: int = 0
    validated: bool = True
    left: tuple[tuple[str, bool], ...] = ()
    before_value: tuple[tuple[str, bool], ...] = ()
    right: tuple[tuple[str, bool], ...] = ()
    stops: tuple[str, ...] = ()  # words at which the value ends
    strip: str = ""  # characters taken off the value's end
    words: tuple[int, int] = (0, 1 << 30)
    check: object = None
    window: bool = False  # the postal code's other condition: an address word near by


def context(*phrases: str) -> tuple[str, bool]:
    """One of the phrases stands right before, but for blanks and colons."""
    return rf"(?i)(?:\A|[^\p{{L}}\p{{Nd}}])(?:{'|'.join(p.replace('.', r'\.') for p in phrases)})[ \t:]*\z", True


def _ended(stops: tuple[str, ...]) -> tuple[str, bool]:
    return rf"(?i)\A[ \t]*(?:\z|\n|\p{{P}}|(?:{'|'.join(stops)})(?:[ \t]|\z))", True


# Words and phrases that the rules look for.
_PASSPORT_STOPS = ("паспорт", "кем", "выдан", "орган", "дата", "выдачи", "код", "подразделения", "место", "рождения", "пол", "фамилия", "имя", "отчество")
_HOLDER_STOPS = ("cvv", "cvc", "pin", "expiry", "exp", "valid", "thru", "bank", "срок", "действия", "действует", "до", "банк", "код", "безопасности", "пин", "пин-код")
_ADDRESS_STOPS = ("г", "город", "ул", "улица", "проспект", "пр-т", "д", "дом", "корп", "корпус", "стр", "строение", "кв", "квартира", "область", "край", "республика", "индекс")
ADDRESS_NEAR = (*_ADDRESS_STOPS, "почтовый индекс", "адрес")
_DRIVER = ("водительское удостоверение", "водительские права", "ву")
_INN_PERSON = ("инн", "инн физлица", "инн физического лица", "инн физ. лица", "инн человека", "инн гражданина")
_INN_ORGANIZATION = ("инн организации", "инн юрлица", "инн юридического лица", "инн компании", "инн фирмы", "инн ооо", "инн оао", "инн зао")
_NAME = r"(?:[А-ЯЁа-яё]+(?:-[А-ЯЁа-яё]+)*|[A-Za-z]+(?:-[A-Za-z]+)*)"
_WORDS = r"[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)?(?:[ \t]+[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)?)*"
_NUMBER = r"[0-9]+[A-Za-zА-Яа-яЁё]?"
_DATE_EDGES = {"left": ((r"[\p{L}\p{Nd}./-]\z", False),), "right": ((r"\A[\p{L}\p{Nd}./-]", False),)}
_DIGIT_EDGES = {"left": (_DIGIT_EDGE_LEFT,), "right": (_DIGIT_EDGE_RIGHT,)}
_NEAR_EDGES = {"left": ((rf"{NOT_ASCII}\z", False),), "right": ((rf"\A{NOT_ASCII}", False),)}


def _digits(name: str, kind: str, pattern: str, *phrases: str, validated: bool = False) -> Rule:
    return Rule(name, kind, pattern, f"(?i){'|'.join(phrases)}", validated=validated, left=(_DIGIT_EDGE_LEFT, context(*phrases)), right=(_DIGIT_EDGE_RIGHT,))


def _marked(name: str, kind: str, markers: str, value: str) -> Rule:
    return Rule(name, kind, rf"(?i)(?:{markers})[ \t]*({value})", rf"(?i)(?:{markers})", 1, left=((rf"{NOT_ASCII}\z", False),), stops=_ADDRESS_STOPS, strip=r" \t")


# The patterns and hints of the rules.
RULES = (
    Rule(
        "email", "EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@", validated=False, left=((r"[A-Za-z0-9._%+-]\z", False),), right=((r"\A(?:[A-Za-z0-9_%+-]|\.[A-Za-z0-9._%+-])", False),), check=checks.email
    ),
    Rule(
        "phone", "PHONE", r"(?:\+7|8)[ \t-]*\(?[0-9]{3}\)?[ \t-]*[0-9]{3}[ \t-]*[0-9]{2}[ \t-]*[0-9]{2}", r"(?:\+7|8)[ \t-]*\(?[0-9]{3}", validated=False, left=((r"[0-9+()-]\z", False),), right=((r"\A[0-9+()-]", False),), check=checks.phone
    ),
    _digits("passport", "PASSPORT_NUMBER", r"[0-9]{2}[ \t][0-9]{2}[ \t][0-9]{6}", "паспорт"),
    Rule(
        "passport_explicit", "PASSPORT_NUMBER", r"(?i)(?:паспорт[ \t]*:?[ \t]*(?:серия[ \t]*:?[ \t]*)?|серия[ \t]*:?[ \t]*)(?:№[ \t]*)?([0-9]{4}[ \t]+(?:(?:номер|№)[ \t]*)?[0-9]{6})", r"(?i)(?:паспорт|серия)", 1, False,
        left=(_DIGIT_EDGE_LEFT,), before_value=(_DIGIT_EDGE_LEFT,), right=(_DIGIT_EDGE_RIGHT,),
    ),
    _digits("division_code", "PASSPORT_DIVISION_CODE", "[0-9]{3}-[0-9]{3}", "код подразделения"),
    _digits("driver_license_4_6", "DRIVER_LICENSE_NUMBER", r"[0-9]{4}[ \t][0-9]{6}", *_DRIVER),
    _digits("driver_license_2_2_6", "DRIVER_LICENSE_NUMBER", r"[0-9]{2}[ \t][0-9]{2}[ \t][0-9]{6}", *_DRIVER),
    Rule(
        "citizenship", "CITIZENSHIP", rf"(?i)гражданство[ \t:—-]+({_NAME}(?:[ \t]+{_NAME}){{0,3}})", "(?i)гражданство", 1, False, left=(_DIGIT_EDGE_LEFT,), stops=_PASSPORT_STOPS, strip=r" \t,;.", words=(1, 4), right=(_ended(_PASSPORT_STOPS),)
    ),
    Rule(
        "issuer", "PASSPORT_ISSUER", r"(?i)(?:кем[ \t]+выдан|орган[ \t]*,[ \t]*выдавший[ \t]+паспорт|паспорт[ \t]+выдан)[ \t:—-]+([^\t\n\f\r ;]+(?:[ \t]+[^\t\n\f\r ;]+)*)", "(?i)выда", 1, False,
        left=(_DIGIT_EDGE_LEFT,), stops=_PASSPORT_STOPS, strip=r" \t,;.", words=(1, 1 << 30),
    ),
    Rule(
        "card", "BANK_CARD_NUMBER", r"[0-9]{13,19}|[0-9]{4}(?:[ \t-][0-9]{4}){2,3}(?:[ \t-][0-9]{1,4})?", "[0-9]{4}", left=((r"(?:[0-9]|[0-9 \t-][ \t-])\z", False),), right=((r"\A(?:[0-9]|[ \t-][0-9 \t-])", False),), check=checks.card
    ),
    Rule("inn_person", "INN_PERSON", "[0-9]{12}", "[0-9]{12}", left=(_DIGIT_EDGE_LEFT, (context(*_INN_ORGANIZATION)[0], False), context(*_INN_PERSON)), right=(_DIGIT_EDGE_RIGHT,), check=checks.inn_person),
    Rule("date_numeric", "DATE", r"[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}|[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}", "[0-9]{2}[./-][0-9]{2}", check=checks.numeric_date, **_DATE_EDGES),
    Rule("date_textual", "DATE", rf"(?i)[0-9]{{1,2}}[\t\n\f\r ]+(?:{'|'.join(checks.MONTHS)})[\t\n\f\r ]+[0-9]{{4}}(?:[\t\n\f\r ]+года)?", rf"(?i)(?:{'|'.join(checks.MONTHS)})", check=checks.textual_date, **_DATE_EDGES),
    Rule("postal", "ADDRESS_POSTAL_CODE", "[0-9]{6}", "[0-9]{6}", check=checks.not_zero, window=True, **_DIGIT_EDGES),
    Rule("country", "ADDRESS_COUNTRY", "(?i)Российская Федерация|Россия|РФ", "(?i)Росси|РФ", **_NEAR_EDGES),
    Rule("region_suffix", "ADDRESS_REGION", r"(?i)[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)?[ \t]+(?:область|край)", "(?i)область|край", **_NEAR_EDGES),
    Rule("region_republic", "ADDRESS_REGION", r"(?i)Республика[ \t]+[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)?", "(?i)Республика", **_NEAR_EDGES),
    _marked("city", "ADDRESS_CITY", r"г\.|город", _WORDS),
    _marked("street", "ADDRESS_STREET", r"ул\.|улица|проспект|пр-т", _WORDS),
    _marked("house", "ADDRESS_HOUSE", r"д\.|дом", _NUMBER),
    _marked("building", "ADDRESS_BUILDING", r"корп\.|корпус|стр\.|строение", _NUMBER),
    _marked("apartment", "ADDRESS_APARTMENT", r"кв\.|квартира", _NUMBER),
    _digits("cvv", "CARD_CVV", "[0-9]{3}", "cvv", "cvc", "cvv-код", "код безопасности", validated=True),
    _digits("pin", "CARD_PIN", "[0-9]{4}", "pin", "пин", "пин-код", validated=True),
    Rule(
        "cardholder", "CARDHOLDER_NAME", rf"(?i)(?:cardholder name|cardholder|держатель карты|имя держателя|владелец карты|имя на карте)[ \t:]+({_NAME}(?:[ \t]+{_NAME}){{1,3}})", "(?i)cardholder|держател|владелец карты|имя на карте", 1,
        left=(_DIGIT_EDGE_LEFT,), stops=_HOLDER_STOPS, strip=r" \t", words=(2, 4), right=(_ended(_HOLDER_STOPS),), check=checks.name_like,
    ),
)
BY_NAME = {r.name: r for r in RULES}
POSTAL_CONTEXT = context("индекс", "почтовый индекс")
