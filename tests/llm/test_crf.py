"""Forward-backward marginals against enumeration and against one long recursion."""

import itertools

import numpy as np
import pytest

from stagewise.llm import toxicity


def _tokens(lengths):
    tokens = toxicity.Tokens.__new__(toxicity.Tokens)
    tokens.doc = np.zeros(sum(lengths), int)
    tokens._order(np.cumsum([0, *lengths[:-1]]))
    return tokens


@pytest.mark.parametrize("piece", [64, 3, 1])
def test_marginals_against_enumeration(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE_WORDS", piece)
    rng, lengths = np.random.default_rng(0), [1, 2, 3, 7, 10, 1]
    emission, transitions = rng.normal(size=sum(lengths)) * 2, rng.normal(size=(2, 2))
    marginal, pairs, _ = toxicity._marginals(_tokens(lengths), emission, transitions, pairs=True)
    expected, counts, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        e, total, own, steps = emission[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=n):
            p = np.exp(e @ np.array(states) + sum(transitions[a, b] for a, b in zip(states, states[1:])))
            total, own = total + p, own + p * np.array(states)
            for a, b in zip(states, states[1:]):
                steps[a, b] += p
        expected += list(own / total)
        counts, at = counts + steps / total, at + n
    assert np.allclose(marginal, expected) and np.allclose(pairs, counts)


def test_sentences_longer_than_a_piece():
    rng, lengths = np.random.default_rng(1), [64, 65, 1, 200, 192, 5000, 3]
    emission, transitions = rng.normal(size=sum(lengths)) * 2, rng.normal(size=(2, 2))
    step, expected, at = np.exp(transitions), [], 0
    for n in lengths:
        local = np.stack([np.ones(n), np.exp(emission[at : at + n])], axis=1)
        forward, backward = local.copy(), np.ones((n, 2))
        for t in range(1, n):
            forward[t] = (forward[t - 1] @ step) * local[t]
            forward[t] /= forward[t].sum()
        for t in range(n - 2, -1, -1):
            backward[t] = step @ (backward[t + 1] * local[t + 1])
            backward[t] /= backward[t].sum()
        both = forward * backward
        expected += list(both[:, 1] / both.sum(axis=1))
        at += n
    assert np.allclose(toxicity._marginals(_tokens(lengths), emission, transitions), expected)
