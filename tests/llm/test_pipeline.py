import brute
import corpus_pipeline as cp
from conftest import SMALL

from keyfold.llm import queries as q


def test_stages_are_the_brute_force_ones(spark):
    docs = q.documents(spark, SMALL)
    state = {r.doc_id: r.text for r in docs.collect()}
    name, f = cp.STAGES[0]
    df = f(spark, docs, SMALL)
    assert df.columns == docs.columns
    kept = {r.doc_id for r in df.collect()}
    assert kept <= {i for i, t in state.items() if not brute.quality(t)[5]}
    state = {i: state[i] for i in kept}
    df = cp.STAGES[1][1](spark, df, SMALL)
    assert df.columns == docs.columns
    state = {i: state[i] for i, v in brute.exact(state.items()).items() if v[2]}
    assert {r.doc_id for r in df.collect()} == set(state)
    df = cp.STAGES[2][1](spark, df, SMALL)
    state = {i: state[i] for i, v in brute.near(list(state.items()), 4, 5).items() if v[1] == i}
    assert {r.doc_id for r in df.collect()} == set(state)
    df = cp.STAGES[3][1](spark, df, SMALL)
    assert df.columns == docs.columns
    mixed = {r.doc_id for r in df.collect()}
    assert mixed < set(state)
    packed = {r.doc_id for r in cp.run(spark, SMALL).collect()}
    assert packed == mixed
