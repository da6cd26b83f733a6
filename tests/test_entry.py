"""Driver contract and a few registered queries end to end on sf0.001."""

from conftest import SF001

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["task2", "n_docs", "hits", "avg_total"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_some_queries_run(spark):
    qs = E.queries()
    for k in ["clean_text", "ppmi", "mine_collocations", "valence_scores", "classification_report"]:
        assert qs[k](spark, SF001).count() >= 0


def test_sink_round_trip(spark):
    df = E.queries()["sink_features"](spark, SF001)
    assert set(df.columns) == {"id", "name", "value"}
    assert df.count() > 0


def test_stream_wiring(spark):
    from textmill.streaming import clean_stream
    df = clean_stream(spark, SF001)
    assert df.isStreaming
    assert df.columns == ["doc_id", "tokens"]
