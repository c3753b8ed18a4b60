"""What a task may hold: training of the toxicity chain, batches of BPE."""

import tracemalloc

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from accountlens.llm import common, toxicity  # noqa: E402
from accountlens.llm.linear import fit_logistic  # noqa: E402


def test_chain_is_fitted_with_one_copy_of_the_matrix():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, 500), np.float32) * (rnd.random((4000, 500)) < 0.1)
    y = (x[:, :2] + rnd.random((4000, 2)) > 0.9).astype(np.float32)
    tracemalloc.start()
    weights = toxicity.fit_chain(x, y, np.arange(4000) % 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(w) for w in weights] == [501, 502]
    assert peak < 1.6 * x.nbytes


def test_rows_and_more_columns_are_those_of_a_matrix_put_together():
    rnd = np.random.default_rng(2)
    x, more = rnd.random((900, 20), np.float32), rnd.random((900, 1), np.float32)
    y, rows = (x[:, 0] + more[:, 0] > 1).astype(np.float32), np.arange(900) % 3 != 0
    whole = fit_logistic(np.concatenate([x, more], axis=1)[rows], y[rows])
    assert np.array_equal(fit_logistic(x, y, more=more, rows=rows), whole)


def test_large_batches_are_worked_on_in_parts(spark):
    def make():
        return lambda batch: [batch.column(0), [batch.num_rows] * batch.num_rows]

    got = common.map_arrow(spark.range(0, 2500, 1, 1), make, "id long, n int", most_rows=1000).collect()
    assert [r.id for r in got] == list(range(2500))
    assert {r.n for r in got} == {1000, 500}


def test_words_of_late_stay_with_the_worker():
    import pickle

    chain = toxicity.Chain(["toxic"], {"=bad": 0}, [])
    x, full = chain.rows(["bad day", ""], chain.known)
    assert x[:, 0].tolist() == pytest.approx([0.5**0.5, 0.0]) and full.tolist() == [True, False]
    assert chain.known and not pickle.loads(pickle.dumps(chain)).known
