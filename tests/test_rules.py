"""Spans of the rules against values written by hand: what each rule finds, and what it must not."""

import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions.rules import BY_NAME, RULES
from maskwright.functions.spans import with_candidates

# type -> text -> the values found in it, in order
FOUND = {
    "EMAIL": {
        "email: ivanov@example.com": ["ivanov@example.com"], "IVANOV@EXAMPLE.COM": ["IVANOV@EXAMPLE.COM"], "ivan%tag@example.com": ["ivan%tag@example.com"], "user@example.com.": ["user@example.com"], "ivan@sub.example.com": ["ivan@sub.example.com"],
        "Contact ivanov@example.com!": ["ivanov@example.com"], "a@b.ru, c@d.ru": ["a@b.ru", "c@d.ru"],
        "user@localhost": [], "user@-bad.example.com": [], "user@bad-.example.com": [], "user@example..com": [], "@example.com": [],
    },
    "PHONE": {
        "Телефон: +7 900 123-45-67": ["+7 900 123-45-67"], "8 (900) 123-45-67": ["8 (900) 123-45-67"], "+79001234567": ["+79001234567"], "тел. 8-900-123-45-67.": ["8-900-123-45-67"],
        "+7 900 123-45-678": [], "9+7 900 123-45-67": [], "+7 (900 123-45-67": [], "+7 900) 123-45-67": [], "+7 900 123-45-6": [],
    },
    "PASSPORT_NUMBER": {
        "паспорт 00 00 000000": ["00 00 000000"], "Паспорт: 00 00 000000": ["00 00 000000"], "паспорт 0000 000000": ["0000 000000"], "паспорт: серия 0000 номер 000000": ["0000 номер 000000"], "серия 1234 №567890": ["1234 №567890"],
        "паспорт № 1234 567890": ["1234 567890"], "ПАСПОРТ: СЕРИЯ 0000 НОМЕР 000000": ["0000 НОМЕР 000000"],
        "00 00 000000": [], "паспорт 00 00 0000000": [], "паспорт 000 000000": [], "загранпаспорт 00 00 000000": [], "паспорт 00000 000000": [], "паспорт 0000 0000000": [], "загранпаспорт 0000 000000": [], "паспорт 0000 000000A": [],
        "паспорт A0000 000000": [],
    },
    "PASSPORT_DIVISION_CODE": {
        "код подразделения 000-000": ["000-000"], "Код подразделения: 770-001, далее": ["770-001"],
        "000-000": [], "код подразделения 000-00": [], "код подразделения 0000-000": [],
    },
    "DRIVER_LICENSE_NUMBER": {
        "водительское удостоверение 7777 123456": ["7777 123456"], "ВУ: 7777 123456": ["7777 123456"], "водительское удостоверение 77 77 123456": ["77 77 123456"], "водительские права: 77 77 123456": ["77 77 123456"],
        "7777 123456": [], "водительское удостоверение 7777 1234567": [], "водительское удостоверение номер 7777 123456": [],
    },
    "CITIZENSHIP": {
        "гражданство: Российская Федерация": ["Российская Федерация"], "гражданство: РФ.": ["РФ"], "Гражданство — РФ": ["РФ"], "гражданство: Российская Федерация паспорт 00 00 000000": ["Российская Федерация"], "гражданство: РФ; код": ["РФ"],
        "гражданство: Российская Федерация\nпаспорт 00 00 000000": ["Российская Федерация"],
        "гражданство:": [], "гражданство: 123": [], "гражданство: Российская Федерация Российская Федерация Российская": [], "гражданствоподтверждение: Российская Федерация": [], "1гражданство: Российская Федерация": [],
    },
    "PASSPORT_ISSUER": {
        "кем выдан: ОВД района": ["ОВД района"], "орган, выдавший паспорт: ОВД": ["ОВД"], "кем выдан: ОВД района код подразделения 000-000": ["ОВД района"], "кем выдан: ГУ МВД России по г. Москве; код": ["ГУ МВД России по г. Москве"],
        "кем выдан: ОВД, код подразделения: 000-000": ["ОВД"], "кем выдан: ГУ МВД России по г. Москве дата выдачи: 01.01.2020": ["ГУ МВД России по г. Москве"],
        "кем выдан:": [], "загранпаспорт выдан: ОВД": [],
    },
    "BANK_CARD_NUMBER": {
        "Карта 4111111111111111": ["4111111111111111"], "378282246310005": ["378282246310005"], "4222222222222": ["4222222222222"], "4111111111111111110": ["4111111111111111110"], "4111 1111-1111 1111": ["4111 1111-1111 1111"],
        "Карта 4111111111111111 и 5555 5555 5555 4444": ["4111111111111111", "5555 5555 5555 4444"],
        "4111111111111112": [], "411111111111": [], "41111111111111111111": [], "4111  1111 1111 1111": [], "94111111111111111": [], "94111 1111 1111 1111": [],
    },
    "INN_PERSON": {
        "ИНН физлица 123456789047": ["123456789047"], "ИНН 123456789047": ["123456789047"], "Данные: ИНН физ. лица 123456789047": ["123456789047"],
        "ИНН организации 123456789047": [], "ИНН юридического лица 123456789047": [], "123456789047": [], "ИНН физлица 123456789057": [], "ИНН физлица 123456789048": [],
    },
    "DATE": {
        "01.02.1990": ["01.02.1990"], "«01.02.1990»": ["01.02.1990"], "2020.31.12": ["2020.31.12"], "29.02.2024": ["29.02.2024"], "1 февраля 1990 года": ["1 февраля 1990 года"], "1990-12-31": ["1990-12-31"], "6 июня 1799": ["6 июня 1799"],
        "29.02.2023": [], "01.02-1990": [], "13.13.2020": [], "1 января 0000": [], "31 апреля 2020": [], "101.02.1990": [], "a01.02.1990": [],
    },
    "ADDRESS_POSTAL_CODE": {
        "индекс 101000": ["101000"], "почтовый индекс 101000": ["101000"], "г. Москва, 101000, ул. Ленина": ["101000"],
        "г. Москва\n123456": [], "123456\nул. Ленина": [], "номер 123456": [], "индекс 000000": [], "индекс 1234567": [],
    },
    "ADDRESS_COUNTRY": {"Россия": ["Россия"], "живу в РФ": ["РФ"], "Российская Федерация": ["Российская Федерация"], "Россиянин": [], "КРФ": []},
    "ADDRESS_REGION": {"Московская область": ["Московская область"], "Краснодарский край": ["Краснодарский край"], "Республика Татарстан": ["Республика Татарстан"], "область": [], "Московская областью": []},
    "ADDRESS_CITY": {"г. Москва": ["Москва"], "город Москва": ["Москва"], "Адрес: г. Москва, ул. Ленина": ["Москва"], "пригород Москва": [], "г. 5": []},
    "ADDRESS_STREET": {"ул. Ленина": ["Ленина"], "проспект Мира": ["Мира"], "пр-т Мира": ["Мира"], "ул. Ленина д. 5": ["Ленина"], "переулица Ленина": [], "ул. 5": []},
    "ADDRESS_HOUSE": {"д. 5": ["5"], "дом 5а": ["5а"], "д. Пять": [], "народ 5": [], "роддом 5": []},
    "ADDRESS_BUILDING": {"корп. 2": ["2"], "корпус 2": ["2"], "стр. 1": ["1"], "строение 1": ["1"], "корп. два": [], "перестроение 1": []},
    "ADDRESS_APARTMENT": {"кв. 12": ["12"], "квартира 12": ["12"], "кв. двенадцать": [], "микв. 12": []},
    "CARD_CVV": {
        "CVV: 123": ["123"], "cvc 123": ["123"], "КОД БЕЗОПАСНОСТИ 123": ["123"], "cvv-код: 123": ["123"], "CVV:\t123": ["123"], "CVV: 123 CVV: 123": ["123", "123"],
        "кабинет 123": [], "CVV: 1234": [], "CVV: 12": [], "XCVV: 123": [],
    },
    "CARD_PIN": {"PIN: 4567": ["4567"], "пин 4567": ["4567"], "ПИН-код: 4567": ["4567"], "код подтверждения 4567": [], "PIN: 45678": [], "PIN: 456": [], "XPIN: 4567": []},
    "CARDHOLDER_NAME": {
        "Держатель карты: Иван Иванов": ["Иван Иванов"], "Имя держателя: Анна-Мария Петрова": ["Анна-Мария Петрова"], "CARDHOLDER NAME: IVAN IVANOV": ["IVAN IVANOV"], "Cardholder: Ivan Ivanov Petrov Sidorov": ["Ivan Ivanov Petrov Sidorov"],
        "cardholder: иван иванов": ["иван иванов"], "Cardholder: Ivan Ivanov, CVV: 123": ["Ivan Ivanov"], "Cardholder: Ivan Ivanov CVV 123": ["Ivan Ivanov"],
        "Иван Иванов": [], "Cardholder: Ivan": [], "mycardholder Ivan Ivanov": [], "cardholderivan ivanov": [], "Cardholder: ivan ivanov petrov": [], "Cardholder: ivan ivanov petrov sidorov ivanov": [], "Cardholder: Ivan CVV 123": [],
        "Cardholder: ИвАН Иванов Петров": [],
    },
}
CASES = [(kind, text, want) for kind, texts in FOUND.items() for text, want in texts.items()]


@pytest.fixture(scope="module")
def found(spark):
    rows = with_candidates(spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "doc_id long, text string"))
    rows = rows.select("doc_id", "text", F.explode("candidates").alias("c")).select("doc_id", "text", "c.*").collect()
    out = {}
    for r in rows:
        raw = r.text.encode()
        value = raw[r.start : r.end].decode()
        assert value == r.text[r.cstart : r.cend] and r.confidence == 1.0
        out.setdefault((r.doc_id, r.type), []).append((r.start, value))
    return {k: [v for _, v in sorted(set(x))] for k, x in out.items()}


def test_every_type_of_the_rules_is_here():
    assert {r.type for r in RULES} == set(FOUND)
    for texts in FOUND.values():
        assert sum(bool(w) for w in texts.values()) >= 1 and sum(not w for w in texts.values()) >= 2


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: f"{CASES[i][0]}-{i}")
def test_values(found, i):
    kind, _, want = CASES[i]
    assert found.get((i, kind), []) == want


def test_windows_of_bytes_hold_whole_characters(spark):
    """Both sides, cut within characters of one to four bytes and between them, against the characters one by one."""
    import random

    from pyspark.sql import functions as F

    from maskwright.functions.dialect import SPARK

    rnd = random.Random(7)
    texts = ["".join(rnd.choice("aж€🙂 ") for _ in range(rnd.randrange(12))) for _ in range(300)]

    def plain(side, s, top):
        k = max(k for k in range(len(s) + 1) if len((s[len(s) - k :] if side == "right" else s[:k]).encode()) <= top)
        inside = s[len(s) - k :] if side == "right" else s[:k]
        mark = "§" if len(s.encode()) > top > len(inside.encode()) else ""
        return mark + inside if side == "right" else inside + mark

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.expr(SPARK.window("left", "t", 9)).alias("l"), F.expr(SPARK.window("right", "t", 9)).alias("r"))
    assert "sequence" not in SPARK.window("left", "t", 9)  # no character of the window is tried by itself
    for r in rows.collect():
        assert (r.l, r.r) == (plain("left", r.t, 9), plain("right", r.t, 9)), r.t


def test_rules_of_digits_are_not_searched_without_their_phrases():
    for name in ("passport", "division_code", "driver_license_4_6", "driver_license_2_2_6", "cvv", "pin"):
        assert not re.search(BY_NAME[name].hint, "order 123 4567 of 12-34, 4510 123456") and re.search(BY_NAME[name].hint, "Паспорт, код подразделения, ВУ, CVV, PIN")


def test_offsets_of_few_and_many_matches(spark):
    counts = (0, 1, 2, 3, 255, 256, 257, 600)
    texts = spark.createDataFrame([(n, "".join(f"ж a{i}@example.com" for i in range(n))) for n in counts], "doc_id long, text string")
    for r in with_candidates(texts, (BY_NAME["email"],)).collect():
        raw = r.text.encode()
        assert [raw[c.start : c.end].decode() for c in r.candidates] == [r.text[c.cstart : c.cend] for c in r.candidates] == [f"a{i}@example.com" for i in range(r.doc_id)]


def test_a_rule_takes_no_step_it_has_no_use_for():
    """Each step is interpreted for every match, which is most of the time of detection."""
    from maskwright.functions.spans import _found

    assert not any("arrays_zip" in _found(r, "text") for r in RULES)
    assert not any("'cut'" in _found(r, "text") for r in RULES if not r.stops and not r.strip)
