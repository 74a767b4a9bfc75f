"""Russian test text built from numeric keys, the same way in Spark SQL and DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.checks import INN_PERSON_11, INN_PERSON_12
from maskwright.functions.spans import bound
from maskwright.sources.tables import spread, table


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


def _sum(s: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr({s}, {i + 1}, 1) AS INT)" for i, w in enumerate(weights)) + ")"


def _inn_base(k: str) -> str:
    return _pad(f"({k} * 7919 + 1234567) % 10000000000", 10)


def _inn_eleven(base: str) -> str:
    return f"({base} || CAST({_sum(base, INN_PERSON_11)} % 11 % 10 AS STRING))"


def _inn_twelve(eleven: str) -> str:
    return f"({eleven} || CAST({_sum(eleven, INN_PERSON_12)} % 11 % 10 AS STRING))"


def _card_base(k: str) -> str:
    return f"('4' || {_pad(f'({k} * 104729 + 17) % 100000000000000', 14)})"


def _card(base: str) -> str:
    double = lambda d: f"(2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END)"
    digit = lambda i: f"CAST(substr({base}, {i}, 1) AS INT)"
    total = " + ".join(double(digit(i)) if i % 2 else digit(i) for i in range(1, 16))
    return f"({base} || CAST((10 - ({total}) % 10) % 10 AS STRING))"


_LAST = "CASE {k} % 5 WHEN 0 THEN 'Иванов' WHEN 1 THEN 'Петрова' WHEN 2 THEN 'Сидоров' WHEN 3 THEN 'Кузнецова' ELSE 'Пушкин' END"
_FIRST = "CASE {k} % 7 WHEN 0 THEN 'Иван' WHEN 1 THEN 'Мария' WHEN 2 THEN 'Пётр' WHEN 3 THEN 'Анна' WHEN 4 THEN 'Олег' WHEN 5 THEN 'Ольга' ELSE 'Александр' END"


def _name(k: str) -> str:
    return f"({_LAST.format(k=k)} || ' ' || {_FIRST.format(k=k)})"


def _phone(k: str) -> str:
    return f"('+7 9' || {_pad(f'{k} % 100', 2)} || ' ' || {_pad(f'{k} * 7 % 1000', 3)} || '-' || {_pad(f'{k} % 90', 2)} || '-' || {_pad(f'{k} * 3 % 100', 2)})"


def text_sql(k: str, name: str, phone: str, inn: str, card: str) -> str:
    """The text of key ``k`` and its parts: twelve templates, each with variants that must not match."""
    bad = f"(CAST(floor({k} / 12) AS BIGINT) % 4 = 0)"
    nl = "chr(10)"
    cases = [
        f"'Клиент ' || {name} || ', телефон ' || {phone} || CASE WHEN {bad} THEN '9' ELSE '' END || ', email test' || CAST({k} AS STRING) || CASE WHEN {bad} THEN '@-bad.example.com' ELSE '@example.com.' END",
        f"CASE WHEN {bad} THEN 'загранпаспорт' ELSE 'Паспорт: ' END || ' 45 ' || {_pad(f'{k} % 100', 2)} || ' ' || {_pad(f'{k} * 11 % 1000000', 6)} || ', код подразделения 770-' || {_pad(f'{k} % 1000', 3)} || ', гражданство Российская Федерация, паспорт серия 4511 номер ' || {_pad(f'{k} % 1000000', 6)}",
        f"'Паспорт выдан Отделом УФМС по городу Москве, дата выдачи ' || {_pad(f'{k} % 28 + 1', 2)} || '.04.' || CASE WHEN {bad} THEN '0000' ELSE '2020' END || '; код подразделения 770-001'",
        f"'Водительское удостоверение' || CASE WHEN {bad} THEN ' номер ' ELSE ': ' END || '77 ' || {_pad(f'{k} % 100', 2)} || ' ' || {_pad(f'{k} % 1000000', 6)} || ', ' || {name} || ', ВУ 7788 ' || {_pad(f'{k} * 3 % 1000000', 6)}",
        f"'Заявитель ' || {name} || ', ИНН ' || CASE WHEN {bad} THEN '1' ELSE '' END || {inn}",
        f"'ИНН организации ' || {inn} || ', ООО Ромашка, филиал, Россия, Московская область'",
        f"CASE WHEN {bad} THEN 'Почта: ' ELSE 'адрес регистрации: ' END || {_pad(f'{k} % 900000 + 100000', 6)} || ', Россия, г. Москва, ул. Ленина, д. ' || CAST({k} % 90 + 1 AS STRING) || 'а, корп. 2, кв. ' || CAST({k} % 300 + 1 AS STRING)",
        f"'Отделение банка: г. Казань, ул. Тестовая, д. ' || CAST({k} % 50 + 1 AS STRING) || CASE WHEN {bad} THEN ', Республика Татарстан' ELSE '' END || {nl} || 'почтовый индекс ' || {_pad(f'{k} % 2 * 420000', 6)}",
        f"'Карта ' || {card} || CASE WHEN {bad} THEN '7' ELSE '' END || ', CVV: ' || {_pad(f'{k} % 1000', 3)} || ', PIN ' || {_pad(f'{k} % 10000', 4)}",
        f"CASE WHEN {bad} THEN 'держатель карты: иван петрович сидоров' ELSE 'Держатель карты: IVAN PETROV' END || ', код безопасности ' || {_pad(f'{k} % 1000', 3)} || ', карта ' || substr({card}, 1, 4) || '-' || substr({card}, 5, 4) || '-' || substr({card}, 9, 4) || '-' || substr({card}, 13, 4)",
        f"'Александр Пушкин — поэт, родился ' || CAST({k} % 30 + 1 AS STRING) || CASE WHEN {bad} THEN ' февраля 1799  года' ELSE ' июня 1799 года' END || ' в Москве, биография. ' || {name}",
        f"'Клиент: ' || {name} || ', тел. ' || {phone} || {nl} || 'Отделение банка: +7 900 765-43-21, дата рождения 01.02.1990, встреча ' || {_pad(f'{k} % 28 + 1', 2)} || '-05-2025' || {nl} || 'никогда не была родилась 1999.12.31, место рождения г. Тула'",
    ]
    return f"CASE {k} % 12 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


def ru_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of each customer; the parts of a text are made once, one after the other."""
    rows = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")))
    for parts in ({"_inn": _inn_base("doc_id"), "_card": _card_base("doc_id"), "_name": _name("doc_id"), "_phone": _phone("doc_id")}, {"_inn": _inn_eleven("_inn"), "_card": _card("_card")}, {"_inn": _inn_twelve("_inn")}):
        for name, value in parts.items():
            rows = bound(rows, name, F.expr(value))
    return bound(rows, "text", F.expr(text_sql("doc_id", "_name", "_phone", "_inn", "_card"))).select("doc_id", "text")


def ru_docs_sql() -> str:
    k = "c_custkey"
    return f"(SELECT c_custkey AS doc_id, {text_sql(k, _name(k), _phone(k), _inn_twelve(_inn_eleven(_inn_base(k))), _card(_card_base(k)))} AS text FROM customer)"


def load_pool(rows: DataFrame, key: str) -> DataFrame:
    """(payload_id, payload) of a request for load tests per row of ``rows``, made from its number ``key``; each is another text."""
    text = F.format_string("Клиент Тестов Тест Тестович, телефон +7 900 123-45-%02d, email test%d@example.com", F.col(key) % 100, F.col(key))
    return rows.select(F.format_string("load-%d", key).alias("payload_id"), text.alias("payload"))
