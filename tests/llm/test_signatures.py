"""PartEnum signatures: linked sets share as many as either one needs; the self-join against all pairs."""

import random

import numpy as np
import pytest

from stagewise.llm import ngram_jaccard as nj


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_what_they_need(percent):
    rng, checked = np.random.default_rng(percent), 0
    for _ in range(400):
        n = int(rng.choice([4, 5, 6, 7, 8, 9, 11, 14, 20, 40, 100, 300]))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(5):
            y = np.unique(np.concatenate([rng.permutation(x)[rng.integers(0, n // 4 + 1) :], rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 1), dtype=np.uint64)]))
            common = len(np.intersect1d(x, y))
            if 100 * common < percent * (len(x) + len(y) - common) or len(x) == len(y) == common:
                continue
            who, signature, scheme = nj.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), percent)
            own = [{s & 0xFFFF: s >> 16 for s in scheme[who == d].tolist()} for d in (0, 1)]
            held = lambda d, s: set(signature[(who == d) & (scheme & 0xFFFF == s)].tolist())  # noqa: B023, E731
            assert any(len(held(0, s) & held(1, s)) >= max(own[0][s], own[1][s]) for s in own[0].keys() & own[1].keys())
            checked += 1
    assert checked > 100


def test_groups_of_many_near_copies_and_repeats(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(words, k=12))
    base = rng.choices(words, k=60)
    texts = []
    for i in range(150):
        copy = list(base)
        for k in rng.sample(range(60), rng.randint(0, 3)):
            copy[k] = f"x{rng.randint(0, 30)}"
        texts.append(" ".join(copy))
    texts += [line + " " + " ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(150)] + ["a b c d e f g", "a b c d e f g h", "a b", "a b", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, "no one else says this at all")]
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())) for i, w in ((i, (t or "").split()) for i, t in rows)]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    expected = sorted(key((i, len(s), least.get(root(a)) if s else i)) for a, (i, s) in enumerate(sets))
    got = nj.ngram_jaccard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 5, 80).collect()
    assert sorted(key((r.doc_id, r.n_shingles, r.component_id)) for r in got) == expected
