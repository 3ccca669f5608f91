"""Registered text queries on the smallest tables."""
import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from bourselake.llm import queries  # noqa: E402
from compare import check, connect  # noqa: E402
from conftest import SMALL  # noqa: E402

RUNS, SQL = queries.queries(), queries.oracle_sql()


def test_names():
    assert [n for n in RUNS if n.startswith("op")] and len(RUNS) == 14 and set(SQL) <= set(RUNS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    assert check(spark, connect(SMALL), SMALL, name, RUNS[name], SQL[name]) is None


def test_toxicity_held_out(spark):
    marked = pd.read_parquet(f"{SMALL}/labels.parquet")
    got = RUNS["op7_toxicity"](spark, SMALL).toPandas().merge(marked, on="doc_id")
    clean = got[(got.toxic == 0) & got.held_out]
    assert len(got) and (clean.predicted == 0).mean() >= 0.97 and got.score.nunique() > 1
    texts = pd.read_parquet(f"{SMALL}/documents.parquet").set_index("doc_id").text
    # labels hold noise: of the texts with one of the commoner insults nearly all are found
    rude = got[(got.toxic == 1) & got.doc_id.map(lambda d: any(w in texts[d].lower() for w in ("moron", "loser", "scum", "disgusting")))]
    assert len(rude) >= 5 and (rude.predicted == 1).mean() >= 0.9


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        from bourselake.llm.common import written
        docs = written(docs)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] and sizes[-1] > 0.7 * sizes[0]
    texts = [r.text for r in docs.collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert not any(brute.secrets(t) for t in texts)
    assert not any(brute.leaks(t, bench)[1] for t in texts[:40])
    assert len({brute.fingerprint(t) for t in texts}) > 0.98 * len(texts)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == len(texts)
