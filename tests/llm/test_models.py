"""The learned models against enumeration, finite differences and grid search; no Spark."""

import itertools

import numpy as np
import pytest

from twinframe.llm import op1_quality, op5_toxicity, op7_language


def _field(passage):
    none = np.zeros(1)
    return op5_toxicity.Field(np.zeros(0, np.uint64), none, none, none, np.zeros(1), passage, np.zeros(4))


def _enumerated(emission, passage):
    """Marginals of state 1 and expected passages of one chain, over all its paths."""
    total, high, expected = 0.0, np.zeros(len(emission)), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=len(emission)):
        weight = np.exp(sum(e * s for e, s in zip(emission, path)) + sum(passage[a, b] for a, b in zip(path, path[1:])))
        total += weight
        high += weight * np.array(path)
        for a, b in zip(path, path[1:]):
            expected[a, b] += weight
    return high / total, expected / total


@pytest.mark.parametrize("chain", [64, 3])
def test_marginals_equal_all_paths(monkeypatch, chain):
    """Documents of 1 to 8 tokens; with a chain of 3, every piece of 3 tokens by itself."""
    monkeypatch.setattr(op5_toxicity, "CHAIN", chain)
    random = np.random.default_rng(11)
    for _ in range(10):
        sizes = [1, 8, 3, *random.integers(1, 9, 4)]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        emission, passage = random.normal(0, 2, len(doc)), random.normal(0, 1.5, (2, 2))
        step, at, n = op5_toxicity._chains(doc)
        high, expected = _field(passage).marginals(emission, step, at, n, pairs=True)
        pieces = [emission[doc == d][i : i + chain] for d in range(len(sizes)) for i in range(0, sizes[d], chain)]
        want = [_enumerated(p, passage) for p in pieces]
        np.testing.assert_allclose(high, np.concatenate([w[0] for w in want]), atol=1e-12)
        np.testing.assert_allclose(expected, sum(w[1] for w in want), atol=1e-10)


def test_marginals_of_no_tokens():
    step, at, n = op5_toxicity._chains(np.zeros(0, np.int64))
    high, expected = _field(np.zeros((2, 2))).marginals(np.zeros(0), step, at, n, pairs=True)
    assert len(high) == 0 and not expected.any()


def test_slopes_equal_finite_differences():
    random = np.random.default_rng(12)
    wide, hidden, gates = 5, 4, 3
    shapes = [(wide, hidden), (hidden,), (hidden, gates), (hidden, gates), (gates,), (hidden,), (1,)]
    weights = [random.normal(0, 0.7, s) for s in shapes]
    owner = np.repeat(np.arange(6), [1, 4, 2, 3, 1, 5])
    x = random.normal(size=(len(owner), wide))
    y, weight = random.integers(0, 2, 6), random.uniform(0.5, 2, 6)
    model = op1_quality.Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 1.0, weights)

    def loss():
        score, _ = model.forward(x, owner, 6)
        miss = -(weight * np.where(y == 1, np.log(score), np.log(1 - score))).mean()
        return miss + 0.5e-4 * sum((weights[i] ** 2).sum() for i in (0, 2, 3, 5))

    for value, slope in zip(weights, op1_quality._slopes(model, x, owner, y, weight)):
        for place in np.ndindex(value.shape):
            kept = value[place]
            value[place] = kept + 1e-5
            above = loss()
            value[place] = kept - 1e-5
            below = loss()
            value[place] = kept
            assert slope[place] == pytest.approx((above - below) / 2e-5, abs=1e-8, rel=1e-5)


def test_scores_are_the_attention_weighted_passages():
    """Document by document, passage by passage, in plain loops."""
    random = np.random.default_rng(13)
    shapes = [(5, 4), (4,), (4, 3), (4, 3), (3,), (4,), (1,)]
    w0, b0, v, u, a, c, b = weights = [random.normal(size=s) for s in shapes]
    owner = np.repeat(np.arange(4), [1, 3, 2, 6])
    x = random.normal(size=(len(owner), 5))
    found, (_, _, _, attention, _) = op1_quality.Model(np.zeros(0), np.zeros(0), 0.0, 1.0, weights).forward(x, owner, 4)
    for d in range(4):
        encoded = [np.tanh(row @ w0 + b0) for row in x[owner == d]]
        energy = [(np.tanh(h @ v) / (1 + np.exp(-(h @ u)))) @ a for h in encoded]
        share = np.exp(energy) / np.exp(energy).sum()
        bag = sum(s * h for s, h in zip(share, encoded))
        np.testing.assert_allclose(attention[owner == d], share, atol=1e-12)
        assert found[d] == pytest.approx(1 / (1 + np.exp(-(bag @ c + b[0]))), abs=1e-12)


def _languages():
    """Four made-up languages of their own syllables, and texts drawn from them."""
    random = np.random.default_rng(14)
    syllables = {"aa": "ba do ki lu", "bb": "sch ung ein cht", "cc": "eau ois que ent", "dd": "zzy wra plo xim"}
    words = {k: ["".join(random.choice(v.split(), 3)) for _ in range(60)] for k, v in syllables.items()}
    draw = lambda k, n: " ".join(random.choice(words[k], n))
    chance = np.full((4, 1 << op7_language.BITS), op7_language.SMOOTH)
    for i, k in enumerate(sorted(words)):
        np.add.at(chance[i], op7_language.grams(draw(k, 4000)), 1.0)
    return op7_language.Model(sorted(words), chance / chance.sum(axis=1, keepdims=True)), draw


def test_shares_equal_a_grid_search():
    model, draw = _languages()
    for first, second in ((30, 10), (20, 20), (37, 3)):
        chance = model.chance[:2, op7_language.grams(draw("aa", first) + " " + draw("bb", second))]
        share, fit = model.shares(chance)
        grid = np.linspace(0, 1, 1001)
        fits = np.array([np.log(s * chance[0] + (1 - s) * chance[1]).sum() for s in grid[1:-1]])
        best = grid[1:-1][fits.argmax()]
        assert share[0] == pytest.approx(best, abs=0.01)
        assert fit == pytest.approx(fits.max(), abs=0.05)


@pytest.mark.parametrize("parts", [{"aa": 40}, {"bb": 25, "dd": 25}, {"aa": 20, "cc": 20, "dd": 20}, {"cc": 60, "aa": 15}])
def test_language_set_equals_the_best_of_all_sets(parts):
    """Every set of languages is fitted and penalised; the operator must pick the best of them."""
    model, draw = _languages()
    text = " ".join(draw(k, n) for k, n in parts.items())
    found = op7_language.grams(text)
    penalty = 0.5 * np.log(len(found))
    fits = {}
    for size in range(1, 5):
        for rows in itertools.combinations(range(4), size):
            chance = model.chance[np.array(rows)][:, found]
            fit = np.log(chance[0]).sum() if size == 1 else model.shares(chance)[1]
            fits[rows] = fit / op7_language.GRAM - penalty * size
    best = max(fits, key=fits.get)
    lang, score, listed = model.judge(text)
    assert {row["lang"] for row in listed} == {model.languages[r] for r in best} == set(parts)
    assert lang == listed[0]["lang"] and 0 < score <= 1
    assert sum(row["share"] for row in listed) == pytest.approx(1.0)
