import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from maskwright.functions.rules import RULES
from maskwright.plans import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
# Each of these takes DuckDB or Spark long to plan (entities of models joined in); ALL_QUERIES=1 runs them too.
SLOW = {"detect_with_models", "block_linkage", "classify_dates", "classify_locations", "exact_duplicate_merge", "drop_contained_addresses", "detect_all", "model_doc_confirmation", "model_label_resolution", "model_offsets_bytes", "classified_candidates", "merge_winners"}
SINGLE = {f"{r.name}_spans" for r in RULES}  # all of them are in all_rule_candidates
NAMES = sorted(set(engine.CATALOG.sql) - (set() if os.environ.get("ALL_QUERIES") else SLOW | SINGLE))


def values(df):
    cols = sorted(df.columns)
    show = lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or x != x else f"{float(x):.6g}" if isinstance(x, float) else str(x)
    return cols, sorted(tuple(map(show, r)) for r in df[cols].astype(object).values.tolist())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert values(entry.queries()[name](spark, SF).toPandas()) == values(con.execute(entry.oracle_sql()[name]).df())


def test_entry_and_names(spark):
    assert os.path.isdir(SF) and entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert SLOW | SINGLE <= set(engine.CATALOG.queries)
