"""Published numbers of small models, computed by the kernel without Spark."""

import numpy as np
import pytest

from thema.functions.rng import random_row
from thema.operators.kernel import Batch, likelihood_sums, occurrences, plain, transactions
from thema.operators.phi_regularizers import BitermsPhi, DecorrelatorPhi, NetPlsaPhi, SmoothSparsePhi, total
from thema.operators.theta_regularizers import SmoothSparseTheta, TopicSelectionTheta, TopicSegmentationPtdw
from thema.plans.model import Matrices, normalized, random_matrix
from thema.sources.vw import parse_line

D = "@default_class"


class Small:
    """Documents as lists of (class, token, weight[, transaction, type])."""

    def __init__(self, docs, topics, titles=None, names=None):
        self.keys = sorted({(x[0], x[1]) for d in docs for x in d})
        at = {k: i for i, k in enumerate(self.keys)}
        classes, tokens = (np.array(x, object) for x in zip(*self.keys))
        p = random_matrix(classes, tokens, topics)
        self.m = Matrices(classes, tokens, names or [f"topic_{i}" for i in range(topics)], p, p.copy())
        flat = [x for d in docs for x in d]
        self.batch = Batch(
            np.array([at[x[0], x[1]] for x in flat]), np.array([float(x[2]) for x in flat]), np.append(0, np.cumsum([len(d) for d in docs])), titles or [str(i) for i in range(len(docs))], np.ones(len(docs)),
            np.array([x[3] if len(x) > 3 else 0 for x in flat]), np.ones(len(flat)),
        )
        self.topics = topics

    def uniform(self):
        return np.full((self.batch.docs, self.topics), 1 / self.topics)

    def step(self, passes, regs=(), agents=None, kernel=plain):
        got = kernel(self.batch, self.m.pwt, self.uniform(), passes, agents)
        got = got[0] if isinstance(got, tuple) else got
        sums = likelihood_sums(self.batch, self.m.pwt, got.theta)
        self.m.nwt = np.zeros_like(self.m.nwt)
        self.m.nwt[got.rows] = got.nwt
        self.m.pwt = normalized(self.m.classes, self.m.nwt, total(list(regs), self.m))
        return np.exp(-sums["raw"] / sums["normalizer"]), got.theta

    def rows(self, tokens):
        return self.m.pwt[[self.m.tokens.tolist().index(t) for t in tokens]]


@pytest.mark.parametrize("c,t,want", [("class_id_1", "", 0.245338), ("1_class_id", "", 0.319662), ("", "token_1", 0.341962), ("", "1_token", 0.315842), ("class_id_1", "token_1", 0.318573), ("class_id_2", "token_2", 0.410061)])
def test_start_values(c, t, want):
    assert abs(random_row(c, t, 3)[0] - want) < 1e-6


def test_plsa():
    docs = [[(D, f"token_{w}", ((d + w) % 5 + 1 if w >= 40 else 0) + (10 if w < 40 and w % 10 == d % 10 else 0)) for w in range(60)] for d in range(100)]
    s = Small([[x for x in d if x[2]] for d in docs], 10)
    got = [s.step(10)[0] for _ in range(10)]
    assert np.allclose(got, [54.616, 38.472, 28.655, 24.362, 22.355, 21.137, 20.808, 20.791, 20.746, 20.581], atol=1e-3)


SAME = [[(D, "aaa", 1), (D, "bbb", 2), (D, "ccc", 3)]] * 4


def test_decorrelator():
    s = Small(SAME, 5)
    s.step(1, [DecorrelatorPhi(1.0)])
    want = [[0.32, 0.95, 0.20, 0.55, 0.32], [0.33, 0.00, 0.68, 0.35, 0.63], [0.35, 0.05, 0.12, 0.10, 0.05]]
    assert np.allclose(s.rows(["ccc", "bbb", "aaa"]), want, atol=0.01)
    s.step(1, [DecorrelatorPhi(1.0, topic_pairs={"topic_0": {"topic_1": 100.0, "topic_2": 100.0}})])
    want = [[0, 0.94, 0.22, 0.58, 0.35], [0, 0, 0.63, 0.30, 0.58], [0, 0.06, 0.15, 0.12, 0.07]]
    assert np.allclose(s.rows(["ccc", "bbb", "aaa"]), want, atol=0.01)


def test_net_plsa():
    c = "@time_class"
    docs = [[(D, "aaa", 6), (D, "bbb", 3), (D, "ccc", 2), (c, "time_1", 1)], [(D, "aaa", 2), (D, "bbb", 9), (D, "ccc", 3)], [(D, "aaa", 1), (D, "bbb", 2), (D, "ccc", 7), (c, "time_2", 1)], [(D, "aaa", 7), (D, "bbb", 4), (D, "ccc", 5), (c, "time_2", 1)]]
    s = Small(docs, 5)
    r = NetPlsaPhi(1.0, class_id=c, vertices={"time_1": 1.0, "time_2": 2.0}, edges={("time_1", "time_2"): 3.0, ("time_2", "time_1"): 2.0}, classes=[c])
    for _ in range(3):
        s.step(1, [r])
    want = [[0.098, 0.892, 0.099, 0.389, 0.184], [0.145, 0.004, 0.618, 0.334, 0.684], [0.757, 0.104, 0.283, 0.277, 0.132], [0.06, 0, 0.092, 0, 0], [0.94, 1, 0.908, 1, 1]]
    assert np.allclose(s.rows(["ccc", "bbb", "aaa", "time_1", "time_2"]), want, atol=1e-3)


def test_biterms_without_weight():
    docs = [[(D, "A", 2), (D, "C", 4), (D, "D", 1), (D, "A", 1)], [(D, "B", 3), (D, "C", 2), (D, "A", 4), (D, "D", 1)], [(D, "A", 2), (D, "B", 1), (D, "D", 1)], [(D, "A", 6), (D, "D", 2)]]
    s = Small(docs, 3)
    assert abs(s.rows(["A"])[0, 0] - 0.2109) < 1e-4
    s.step(1, [BitermsPhi(0.0, cooc={(D, "A", "D"): 5.0})])
    want = [[0.380308, 0.659777, 0.429884], [0.330372, 0.012429, 0.081726], [0.277840, 0.020186, 0.334808], [0.011480, 0.307608, 0.153582]]
    assert np.allclose(s.rows("ABCD"), want, atol=1e-5)


def test_topic_selection():
    b = 0
    tokens = [i for i in range(5) if i == 0 or (i + b + (i + 1) * (b + 1)) % 3 == 0]
    s = Small([[(D, f"token{i}", 1) for i in range(5) if i in tokens]], 10)
    full = random_matrix(np.array([D] * 5, object), np.array([f"token{i}" for i in range(5)], object), 10)
    s.m.pwt = full[tokens]
    for _ in range(3):
        theta = s.step(10, agents=[TopicSelectionTheta(0.5, np.arange(10) / 10)])[1]
    assert np.allclose(theta[0], [0.41836, 0.262486, 0.160616, 0.0845677, 0.032849, 0.022987, 0.0103793, 0.0040327, 0.00267936, 0.00104289], atol=1e-4)


def test_smooth_sparse_theta_by_document():
    s = Small(SAME, 5, [f"title_{i}" for i in range(4)])
    r = SmoothSparseTheta(-1000.0, titles=["title_0", "title_3"], multipliers=[[-1, 1, 0, 0, -1], [0, 1, 0, -1, 0]])
    theta = s.step(1, agents=[r])[1]
    want = [[0.499311, 0.146202, 0.146202, 0.000873], [0, 0.247351, 0.247351, 0], [0.000556, 0.185883, 0.185883, 0.001110], [0.000617, 0.206015, 0.206015, 0.996735], [0.499516, 0.214550, 0.214550, 0.001282]]
    assert np.allclose(theta.T, want, atol=1e-5)


def test_relative_regularization():
    s = Small([[(D, f"token{i}", 1) for i in range(50)]] * 100, 50)
    got = []
    for _ in range(20):
        s.step(10, [SmoothSparsePhi(-0.5, 0.5)])
        got.append((s.m.pwt < 1e-37).mean())
    assert np.allclose(got, [0.244, 0.380, 0.478, 0.544, 0.588, 0.627, 0.665, 0.694, 0.716, 0.734, 0.750, 0.768, 0.781, 0.790, 0.804, 0.814, 0.824, 0.830, 0.836, 0.839], atol=1e-3)


def test_segmentation():
    names = ["aaaa0", "bbbb1", "cccc2", "dddd3", "eeee4", "ffff5"]
    s = Small([[(D, names[i], 1) for i in (0, 1, 2, 0, 3, 2, 1, 4, 5)]], 5)
    cut = TopicSegmentationPtdw(3, 0.2, (0, 1))
    for _ in range(4):
        s.step(0)
    p = occurrences(s.batch, s.m.pwt, s.uniform(), 0, editors=[cut])[1]
    assert p.argmax(axis=1).tolist() == [0] * 7 + [4] * 2 and set(p.ravel()) == {0.0, 1.0}


VW = """doc1 |class_1 token_1:1 ||trans1 |class_1 token_1:1 |class_2 token_2:1 ||
doc2 |class_1 token_2:1 ||trans1 |class_1 token_2:1 |class_2 token_3:1 ||
doc3 ||@default_transaction |class_1 token_3 ||trans1 |class_1 token_3:1 |class_2 token_4 ||
doc4 |class_1 token_1:1 ||trans1 |class_1 token_1:1 |class_2 token_2:1 ||
doc5 ||@default_transaction |class_1 token_2:1 ||trans1 |class_1 token_2:1 |class_2 token_3  ||
doc6 |class_1 token_3:1 ||trans1 |class_1 token_3 |class_2 token_4:1  ||
doc7 |class_3 token_5:1 ||trans2 |class_4 token_5 |class_1 token_2:1 |class_2 token_2:1 ||
doc8 ||trans1 |class_1 token_1:1 |class_2 token_2 || |class_1 token_2:1 |class_2 token_3:1 || ||@default_transaction |class_1 token_1:1"""


def test_transactions():
    docs = [[(c, t, w, x, k) for x, k, c, t, w in parse_line(line)[1]] for line in VW.split("\n")]
    s = Small(docs, 3)
    before = np.inf
    for _ in range(5):
        got, z = transactions(s.batch, s.m.pwt, s.uniform(), 10)
        perplexity = np.exp(-np.log(z).mean())
        assert perplexity < before
        before = perplexity
        s.m.nwt = np.zeros_like(s.m.nwt)
        s.m.nwt[got.rows] = got.nwt
        s.m.pwt = normalized(s.m.classes, s.m.nwt)
    z = transactions(s.batch, s.m.pwt, s.uniform(), 10)[1]
    assert np.allclose(z, [1, 1, 1, 0.75, 1, 1, 1, 1, 1, 0.75, 1, 1, 1, 0.25, 0.67, 0.25, 0.67], atol=0.02)


def test_transaction_grammar():
    one = parse_line("doc1 hello world:2 ||trans1 |user mel-lain:3 |action click:3 || |user mel-lain |action show ||")[1]
    assert [x[4] for x in one] == [1, 2, 3, 3, 1, 1] and [x[0] for x in one] == [0, 1, 2, 2, 3, 3]
    two = parse_line("doc2 |author mel-lain ||trans1 hello:5 |action show:5 |qualifier twice:5 || world |action click |qualifier first || ||@default_transaction world")[1]
    assert [x[4] for x in two] == [1, 5, 5, 5, 1, 1, 1, 1] and [x[0] for x in two] == [0, 1, 1, 1, 2, 2, 2, 3]
    assert [x[1] for x in two] == ["@default_transaction"] + ["trans1"] * 6 + ["@default_transaction"]
