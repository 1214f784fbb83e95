"""Parts of the operators without Spark: attribution of tokens, gradients, evidence of runs."""

import random

import numpy as np
import pytest

from waymark.llm import gru_language, kn_toxicity, token_counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_go_to_sections_by_the_rule(rule):
    pick = random.Random(4)
    for _ in range(300):
        sizes = [pick.randint(1, 6) for _ in range(pick.randint(0, 12))]
        n = sum(sizes)
        ends = sorted({n, *(pick.randint(1, n) for _ in range(pick.randint(0, 5)))}) if n else [0]
        section = [next(k for k, end in enumerate(ends) if i < end) for i in range(n)]
        counts, crossing, at = [0] * len(ends), [0] * len(ends), 0
        for size in sizes:
            own = section[at : at + size]
            at += size
            chosen = own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=own.count)
            counts[chosen] += 1
            crossing[chosen] += own[0] != own[-1]
        got = token_counts.attribute(np.array(sizes, np.int64), np.array(ends, np.int64), rule)
        assert [x.tolist() for x in got] == [counts, crossing]


def test_backpropagation_gives_the_slopes_of_the_loss():
    rng = np.random.default_rng(2)
    units = gru_language.UNITS
    w = (rng.normal(size=(3 * units, 256)) * 0.2).astype(np.float32)
    w[: 2 * units] += 0.5
    u = (rng.normal(size=(3 * units, units)) * 0.2).astype(np.float32)
    steps = rng.integers(97, 101, size=(6, 4)).astype(np.uint8)
    towards = rng.normal(size=(6, units, 4)).astype(np.float32)
    loss = lambda: float((gru_language._forward(w, u, steps)[0].astype(np.float64) * towards).sum())
    _, kept = gru_language._forward(w, u, steps, keep=True)
    d_w, d_u = np.zeros_like(w), np.zeros_like(u)
    gru_language._backward(u, steps, kept, towards, d_w, d_u)
    for weights, slopes, columns in ((w, d_w, (97, 98, 99, 100)), (u, d_u, range(units))):
        for i in range(0, 3 * units, 3):
            for j in columns:
                was, step = weights[i, j], 2e-3
                weights[i, j] = was + step
                up = loss()
                weights[i, j] = was - step
                down = loss()
                weights[i, j] = was
                assert abs((up - down) / (2 * step) - slopes[i, j]) < 0.02 + 0.02 * abs(slopes[i, j])


def test_evidence_is_the_ratio_of_the_text_and_of_its_most_toxic_run():
    pick = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    ratios = {w: pick.uniform(-1, 6) for w in words}
    names = kn_toxicity.hashes_of([f"0{w}" for w in words])
    lookup = kn_toxicity.Lookup.of(names, np.array([ratios[w] for w in words], np.float32), np.zeros(len(words), np.float32))
    scorer = kn_toxicity.Scorer(lookup, kn_toxicity.Scale([0.0, 0.0, 0.0], np.zeros(2), 0.0))
    texts = [" ".join(pick.choice(words) for _ in range(n)) for n in (1, 2, 3, 5, 17, 33, 70, 200)] + ["", None, "12 !", "zz unseen words"]
    for text, (mean, run) in zip(texts, scorer.features(texts), strict=True):
        own = [ratios.get(w, 0.0) for w in (text or "").split() if w.isalpha()]
        runs = [sum(own[i : i + n]) / (n + kn_toxicity.PRIOR) for n in {*kn_toxicity.RUNS, len(own)} if 0 < n <= len(own) for i in range(len(own) - n + 1)]
        assert abs(mean - (sum(own) / len(own) if own else 0)) < 1e-4 and abs(run - (max(runs) if runs else 0)) < 1e-4
