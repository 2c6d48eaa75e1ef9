"""Both dictionaries of a pair hold the same ordinary strings, so chance does not tell windows apart."""

import random

import numpy as np

from faultline.llm import toxicity

from .test_operators import words


def test_pairs_differ_only_behind_their_common_part():
    bad, r = ["vilewort", "grimsnark", "foulbeast"], random.Random(8)
    texts, kinds = [], []
    for k in range(1500):
        w = words(r.randrange(40, 300), k, 4000).split()
        if k % 3 == 0:
            w.insert(r.randrange(len(w)), r.choice(bad))
        texts.append(" ".join(w))
        kinds.append(int(k % 3 == 0))
    model = toxicity.train(texts, kinds)
    for ordinary, toxic in model.pairs:
        common = next((i for i, (x, y) in enumerate(zip(ordinary, toxic)) if x != y), min(len(ordinary), len(toxic)))
        assert common >= 0.5 * len(ordinary)
    fresh = [words(200, 10_000 + k, 4000) for k in range(60)]
    plain = np.concatenate([model.margins(t) for t in fresh])
    marked = np.concatenate([model.margins(b + " " + " ".join(t.split()[:11])) for t in fresh for b in bad])
    assert (marked > np.quantile(plain, 0.99)).mean() > 0.9
