"""Registered queries against DuckDB on the smallest data, and streams against their batch twins."""

import duckdb
import pytest

import __spark_entry__ as entry
from paperlens.catalog import load
from tools_check import TABLES, key, norm

SF = "/root/testdata/sf0.001"
FAST = ["src_text_blocks", "str_sentences", "str_headings", "str_table_grid", "str_citations", "elm_elements", "rul_run", "num_all", "fig_references", "gat_review_rules", "mod_merge", "rev_triage", "ret_search", "dlg_truncate", "eva_latency", "lif_quota", "lif_quota_stream", "src_intake_stream"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(key(tuple(norm(x) for x in r)) for r in df.select(*cols).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    exp = sorted(key(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == exp and got


def test_registry_is_complete():
    own, qs, sqls = load(), entry.queries(), entry.oracle_sql()
    assert {n for n, (_, text) in own.items() if not text} == {"rev_review_compare", "eva_ablation", "ret_context_packing"}
    assert set(own) <= set(qs) and set(sqls) <= set(qs)


def test_rules_only_review_has_no_shuffle_of_its_own(spark):
    from paperlens.operators.structure import frame
    from paperlens.plans.review import review
    from paperlens.sources.intake import overlay_blocks, read

    plan = review(frame(overlay_blocks(read(spark, SF, "documents"))), demote=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 20
