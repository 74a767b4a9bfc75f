import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from maskwright.functions.crypto import hmac_sql
from maskwright.functions.dialect import SPARK
from maskwright.operators import entities as E
from maskwright.operators import scoring, vault

KEY = bytes(range(32))
CASES = {
    "Клиент Иванов Иван, телефон +7 900 123-45-67, email ivanov@example.com": [("PHONE", 51, 67, "person-1", 0.9), ("EMAIL", 75, 93, "person-1", 0.9)],
    "Карта 4111111111111111, CVV: 123, PIN 1234": [("BANK_CARD_NUMBER", 11, 27, "person-1", 0.7), ("CARD_CVV", 34, 37, "person-1", 0.7), ("CARD_PIN", 43, 47, "person-1", 0.7)],
    "адрес регистрации: 101000, г. Москва, ул. Ленина, д. 5, кв. 12": [("ADDRESS", 35, 96, "person-1", 0.9)],
    "Клиент: тел. +7 900 123-45-67\nОтделение банка: +7 900 765-43-21": [("PHONE", 22, 38, "person-1", 0.9), ("PHONE", 70, 86, "person-2", 0.7)],
    "Отделение банка: г. Москва, ул. Тестовая, д. 1": [("ADDRESS_CITY", 35, 47, "organization-1", 0.9), ("ADDRESS_STREET", 55, 71, "organization-1", 0.9), ("ADDRESS_HOUSE", 77, 78, "organization-1", 0.9)],
    "г. Москва, ул. Ленина, д. 5": [("ADDRESS_CITY", 4, 16, "", 0.3), ("ADDRESS_STREET", 24, 36, "", 0.3), ("ADDRESS_HOUSE", 42, 43, "", 0.3)],
    "дата рождения 01.02.1990, встреча 05.05.2025": [("BIRTH_DATE", 26, 36, "person-1", 0.9)],
    "ИНН организации 123456789047": [],
    "ИНН 123456789047": [("INN_PERSON", 7, 19, "person-1", 0.7)],
    "паспорт 00 00 000000": [("PASSPORT_NUMBER", 15, 27, "person-1", 0.9)],
    "загранпаспорт 00 00 000000": [],
    "паспорт: серия 0000 номер 000000": [("PASSPORT_NUMBER", 27, 49, "person-1", 0.9)],
    "ВУ: 7777 123456": [("DRIVER_LICENSE_NUMBER", 6, 17, "person-1", 0.7)],
    "29.02.2023 и 01.02-1990 и 13.13.2020": [],
    "": [],
}


@pytest.fixture(scope="module")
def owned(spark):
    rows = [(i, t) for i, t in enumerate(CASES)]
    return E.detect(spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")).withColumn("scope", F.lit("s")).cache()


def test_golden_vectors(owned):
    found = {}
    for r in E.rows(owned).collect():
        found.setdefault(r.doc_id, []).append((r.type, r.start_byte, r.end_byte, r.owner_id, r.score))
    for i, want in enumerate(CASES.values()):
        assert sorted(found.get(i, []), key=lambda x: x[1]) == want, list(CASES)[i]
    assert 99 not in found


def test_masks_keep_the_rest(owned):
    masked = {r.doc_id: r.masked for r in E.masked(owned).select("doc_id", "masked").collect()}
    texts = list(CASES)
    assert masked[0] == "Клиент Иванов Иван, телефон <PHONE>, email <EMAIL>"
    assert masked[5] == texts[5] and masked[14] == ""


def test_tokens_come_back(owned):
    tokenized = vault.tokenize(owned, KEY)
    restored = {r.doc_id: r for r in vault.detokenize(tokenized, vault.mappings(owned, KEY)).collect()}
    for i, text in enumerate(CASES):
        assert (restored[i].restored, restored[i].n_unresolved) == (text, 0)
    none = vault.mappings(owned, KEY).where("false")
    assert {r.restored for r in vault.detokenize(tokenized, none, strict=True).where("doc_id = 0").collect()} == {None}


def test_hmac(spark):
    got = spark.range(1).select(F.hex(F.expr(hmac_sql(SPARK, KEY, "encode('яб', 'UTF-8')")))).first()[0]
    assert got.lower() == hmac.new(KEY, "яб".encode(), hashlib.sha256).hexdigest()


def test_policy_reports_what_it_switches_off(spark, owned):
    docs = owned.select("doc_id", "text").where("doc_id = 0")
    rows = {r.type: r for r in E.rows(E.detect(docs, ("EMAIL",))).collect()}
    assert rows["EMAIL"].personal and not rows["PHONE"].personal
    assert rows["PHONE"].reasons.endswith("type_disabled_by_policy") and rows["PHONE"].owner_id == ""


def test_scores_of_hard_cases(spark):
    schema = "case_id string, type string, start int, end int"
    truth = spark.createDataFrame([("a", "EMAIL", 0, 5), ("b", "EMAIL", 0, 5)], schema)
    found = spark.createDataFrame([("a", "EMAIL", 0, 5), ("a", "EMAIL", 0, 5), ("b", "PHONE", 0, 5)], schema)
    rows = {r.type: r for r in scoring.detection_metrics(truth, found, found).collect()}
    assert (rows["EMAIL"].tp, rows["EMAIL"].fp, rows["EMAIL"].fn, rows["EMAIL"].recall) == (1, 0, 1, 0.5)
    assert (rows["PHONE"].fp, rows["PHONE"].fp_on_hard_negative, rows["PHONE"].recall_defined) == (1, 1, False)


def test_vault_at_rest_opens_only_for_its_token(spark):
    from maskwright.functions.crypto import seal, unseal

    rows = spark.createDataFrame([("x", "aad")], "v string, a string").select(seal(F.col("v"), KEY, F.col("a")).alias("s"), "a")
    assert tuple(rows.select(unseal(F.col("s"), KEY, F.col("a")), unseal(F.col("s"), KEY, F.lit("other"))).first()) == ("x", None)
