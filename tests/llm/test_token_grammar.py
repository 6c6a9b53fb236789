import numpy as np

from firnline.llm import tokenstore


def expanded(rules, seq, terminals):
    out = []
    stack = seq.tolist()[::-1]
    while stack:
        x = stack.pop()
        if x < terminals:
            out.append(x)
        else:
            stack += rules[x - terminals].tolist()[::-1]
    return out


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 40_000, 500)
    ids = np.concatenate([np.concatenate([passage, rng.integers(0, 40_000, 700)]) for _ in range(64)]).astype(np.uint32)
    starts = np.arange(0, len(ids), 1200)
    rules, seq, first = tokenstore.compress(ids, starts, 40_000)
    assert expanded(rules, seq, 40_000) == ids.tolist()
    begins = np.zeros(len(seq), dtype=bool)
    begins[first[:-1]] = True
    pairs = (seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:])[~begins[1:]]
    assert np.unique(pairs, return_counts=True)[1].max() < 16
    assert len(seq) < 64 * 705  # a passage is a symbol or a few
