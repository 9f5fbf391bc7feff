import os

import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"


def test_names_match():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_runs(spark):
    df = e.entry(spark)
    assert df.columns == ["doc", "model", "grams", "neg_log2"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["s06_utterances", "p_23_sentence_preset", "t03_rule_sentences", "e07_naive_bayes", "c09_argmax", "u05_token_dictionary", "g01_sn_grams"])
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    df = e.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    a = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    b = sorted(tuple(map(show, r)) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({e.oracle_sql()[name]})").fetchall())
    assert a == b and a


SCORED = ["l10_prob_seq", "c10_posterior", "k06_isotonic", "e16_confusion", "c07_joint_proba", "e12_one_vs_one", "k07_calibration_curve", "l11_entropy", "c09_argmax", "e16_weighted_f1", "e17_report"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", SCORED)
def test_texts_are_not_broadcast(spark, monkeypatch, name):
    """Keys of texts, whose number Spark can't tell from the files, are joined by shuffles in all that a query runs."""
    from rhetorica.plans import model_queries

    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    stored, plans = model_queries.stored, []
    monkeypatch.setattr(model_queries, "stored", lambda df, label: (plans.append(plan_of(df)), stored(df, label))[1])
    plans.append(plan_of(e.queries()[name](spark, DATA)))
    assert not any("BroadcastHashJoin [k1" in p for p in plans) and any("SortMergeJoin [k1" in p for p in plans)
