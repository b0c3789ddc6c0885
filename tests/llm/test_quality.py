"""The quality classifier against a plain version: statistics by loops, ridge by least squares, isotonic regression by its minimax formula."""

import math
import random
import statistics as plain
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import quality

KINDS = ["0123456789", "!", "?", ".", ",", "|", "#$%&*@^~+=<>_", "()[]{}", "\"'`", ":;/\\-"]


def plain_statistics(text):
    data, words, lines = text.encode(), text.split(), text.split("\n")
    count = Counter(data)
    n, n_words, n_lines = max(len(data), 1), max(len(words), 1), len(lines)
    upper, lower = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data)
    sizes = [len(w) for w in words] or [0]
    seen = set(lines)
    out = [math.log1p(len(data)), math.log1p(len(words)), math.log1p(n_lines), upper / max(upper + lower, 1), (upper + lower) / n, sum(b >= 128 for b in data) / n, count[32] / n]
    out += [sum(count[ord(c)] for c in kind) / n for kind in KINDS]
    out += [-sum(c / n * math.log(c / n) for c in count.values()), plain.fmean(sizes), plain.pstdev(sizes), sum(s <= 3 for s in sizes) / len(sizes), sum(s >= 12 for s in sizes) / len(sizes)]
    out += [len(set(words)) / n_words, len(seen) / n_lines, sum(map(len, seen)) / max(sum(map(len, lines)), 1), sum(not w[-1].isalnum() for w in words) / n_words]
    out += [sum(w[0].isupper() for w in words) / n_words, sum(w.isupper() and len(w) > 1 for w in words) / n_words, math.log1p(len(text) / n_lines)]
    return out


def plain_isotonic(scores, labels):
    """Centres and values of the pools: the fit at i is max over a <= i of min over b >= i of the mean of a..b."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    fit = [max(min(y[a : b + 1].mean() for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    xs, ys, at = [], [], 0
    while at < len(y):
        end = at
        while end < len(y) and abs(fit[end] - fit[at]) < 1e-12:
            end += 1
        xs.append(s[at:end].mean())
        ys.append(fit[at])
        at = end
    return np.array(xs), np.array(ys)


def corpus():
    draw = random.Random(12)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(80)]
    rows, labels = [], []
    for i in range(150):
        text = " ".join(draw.choice(words).capitalize() if draw.random() < 0.2 else draw.choice(words) for _ in range(draw.randint(0, 60)))
        good = draw.random() < 0.6
        if not good:
            text = text.upper().replace(" ", draw.choice([" ! ", " 7|", "\n"])) + " éü"
        rows.append((i, text))
        if draw.random() < 0.8:
            labels.append((i, int(good if draw.random() < 0.9 else not good)))
    return [*rows, (200, ""), (201, None), (None, "no id at all.")], labels


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_scores_equal_the_plain_version(spark):
    rows, labels = corpus()
    stats = {d: plain_statistics(t or "") for d, t in rows}
    every = np.array(list(stats.values()))
    mean, scale = every.mean(0), every.std(0)
    scale[scale <= 1e-9] = 1.0
    draw = np.random.default_rng(20_240_501)
    directions = draw.standard_normal((every.shape[1], quality.N_FEATURES)) / math.sqrt(every.shape[1])
    phases = draw.uniform(0, 2 * math.pi, quality.N_FEATURES)

    def features(x):
        z = np.clip((np.array(x) - mean) / scale, -6, 6)
        return np.array([*(math.sqrt(2 / quality.N_FEATURES) * math.cos(z @ directions[:, j] + phases[j]) for j in range(quality.N_FEATURES)), 1.0])

    known = [(d, y) for d, y in labels if fold(d) != 0]
    fit, held = [(d, y) for d, y in known if fold(d) != quality.CALIBRATION_FOLD], [(d, y) for d, y in known if fold(d) == quality.CALIBRATION_FOLD]
    z, y = np.array([features(stats[d]) for d, _ in fit]), np.array([float(v) for _, v in fit])
    # ridge as a least-squares problem with one more row for each coefficient
    weight = np.sqrt([1e-3 * len(fit) / quality.N_FEATURES] * quality.N_FEATURES + [1e-9])
    ridge = np.linalg.lstsq(np.vstack([z, np.diag(weight)]), np.concatenate([y, np.zeros(len(weight))]), rcond=None)[0]
    raw = np.array([features(stats[d]) @ ridge for d, _ in held])
    knots = plain_isotonic(raw, np.array([float(v) for _, v in held]))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string")
    found = quality.scored(docs, spark.createDataFrame([(d, v, 0) for d, v in labels], "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(rows)
    for r in found:
        want = float(np.clip(np.interp(features(stats[r.doc_id]) @ ridge, *knots), 0, 1))
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and fold(r.doc_id) == 0)


def test_statistics_equal_plain_ones():
    for _, text in corpus()[0]:
        assert quality.statistics(text or "") == pytest.approx(plain_statistics(text or ""), abs=1e-12)


def test_features_approximate_a_gaussian_kernel():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(40, quality.N_STATISTICS))
    model = quality.Model(np.zeros(quality.N_STATISTICS), np.ones(quality.N_STATISTICS))
    z = model.features(x)[:, :-1]
    apart = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-apart / (2 * quality.N_STATISTICS))).max() < 0.25


@pytest.mark.parametrize("seed", range(8))
def test_isotonic_equals_the_minimax_formula(seed):
    draw = np.random.default_rng(seed)
    scores, labels = draw.normal(size=30), draw.integers(0, 2, 30).astype(float)
    (x, y), (px, py) = quality.isotonic(scores, labels), plain_isotonic(scores, labels)
    grid = np.linspace(-3, 3, 101)
    assert np.interp(grid, x, y) == pytest.approx(np.interp(grid, px, py), abs=1e-9)
