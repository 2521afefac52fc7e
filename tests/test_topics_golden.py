"""Hand-sized cases whose values were computed apart from this code."""

import pytest

from opinara.operators.corpus import corpus_from_counts
from opinara.operators.priors import SymmetricDirichlet
from opinara.operators.robust import RobustPlsa
from opinara.operators.topics import Plsa

TOLERANCE = 2e-6
COUNTS = [(1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "c", 1)]
PHI = {"a": (0.5, 0.2), "b": (0.3, 0.3), "c": (0.2, 0.5)}

CASES = {
    "plsa": (
        Plsa(2, 1),
        [(0.642857, 0.357143), (0.392857, 0.607143)],
        [(0.526316, 0.368421, 0.105263), (0.25, 0.4375, 0.3125)],
        [3.038860, 2.711973],
    ),
    "plsa2": (
        Plsa(2, 2),
        [(0.728309, 0.271691), (0.265829, 0.734171)],
        [(0.582502, 0.351623, 0.065874), (0.182876, 0.457554, 0.359570)],
        [3.038860, 2.711973, 2.495745],
    ),
    "dir": (
        Plsa(2, 1, theta_prior=SymmetricDirichlet(1.5), phi_prior=SymmetricDirichlet(1.1)),
        [(0.607143, 0.392857), (0.428571, 0.571429)],
        [(0.507109, 0.364929, 0.127962), (0.259669, 0.425414, 0.314917)],
        [2.014600, 1.852474],
    ),
    "sparse": (
        Plsa(2, 1, theta_prior=SymmetricDirichlet(0.5), phi_prior=SymmetricDirichlet(0.8)),
        [(0.714286, 0.285714), (0.285714, 0.714286)],
        [(0.581081, 0.378378, 0.040541), (0.220339, 0.474576, 0.305085)],
        [3.026283, 2.316718],
    ),
    "robust": (
        RobustPlsa(2, 1),
        [(0.644622, 0.355378), (0.390836, 0.609164)],
        [(0.534114, 0.359455, 0.106431), (0.254589, 0.428341, 0.317070)],
        [3.023278, 2.733455],
    ),
    "robust2": (
        RobustPlsa(2, 2),
        [(0.731193, 0.268807), (0.261258, 0.738742)],
        [(0.592607, 0.340302, 0.067092), (0.185054, 0.444746, 0.370200)],
        [3.023278, 2.733455, 2.550066],
    ),
}
BACKGROUND = {"robust": (0.381705, 0.428141, 0.190154), "robust2": (0.376908, 0.447143, 0.175950)}
NOISE = {
    "robust": {(1, "a"): 0.640212, (1, "b"): 0.359788, (2, "b"): 0.529070, (2, "c"): 0.470930},
    "robust2": {(1, "a"): 0.767684, (1, "b"): 0.232316, (2, "b"): 0.383649, (2, "c"): 0.616351},
}


def make_corpus(spark, broadcast_bytes=None):
    counts = spark.createDataFrame(COUNTS, "doc_id bigint, token string, n bigint")
    limit = {} if broadcast_bytes is None else {"broadcast_bytes": broadcast_bytes}
    corpus = corpus_from_counts(counts, **limit)
    rows = [(token, *p) for token, p in PHI.items()]
    start = spark.createDataFrame(rows, "token string, p0 double, p1 double")
    phi = corpus.vocabulary.frame.join(start, "token").select("word_id", "p0", "p1")
    return corpus, phi


def theta_of(result):
    return [(r.t0, r.t1) for r in result.theta.orderBy("doc_id").collect()]


# With limit 0 nothing is broadcast, every word goes the shuffled way.
@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("name", CASES)
def test_fit(spark, name, limit):
    trainer, theta, phi, perplexities = CASES[name]
    corpus, start = make_corpus(spark, limit)
    model = trainer.fit(corpus, start)
    for got, wanted in zip(theta_of(model), theta, strict=True):
        assert got == pytest.approx(wanted, abs=TOLERANCE)
    rows = model.phi.orderBy("token").collect()
    assert [r.p0 for r in rows] == pytest.approx(phi[0], abs=TOLERANCE)
    assert [r.p1 for r in rows] == pytest.approx(phi[1], abs=TOLERANCE)
    assert model.perplexities == pytest.approx(perplexities, abs=TOLERANCE)
    if name in BACKGROUND:
        background = [r.bg for r in model.background.orderBy("token").collect()]
        assert background == pytest.approx(BACKGROUND[name], abs=TOLERANCE)
        noise = {(r.doc_id, r.token): r.noise for r in model.noise.collect()}
        assert noise == pytest.approx(NOISE[name], abs=TOLERANCE)


def test_fold_in_keeps_phi(spark):
    corpus, start = make_corpus(spark)
    trainer = Plsa(2, 0)
    model = trainer.fit(corpus, start)
    trainer.iterations = 1
    folded = model.fold_in(corpus)
    for got, wanted in zip(theta_of(folded), CASES["plsa"][1], strict=True):
        assert got == pytest.approx(wanted, abs=TOLERANCE)
    assert folded.perplexities == pytest.approx([3.038860, 2.851100], abs=TOLERANCE)
