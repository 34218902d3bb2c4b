"""The quality classifier by definition: vectors, pools, network, temperature, score and verdict."""

import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from rillweave.llm import quality_classifier as qc

SPACE = qc.Space(buckets=64, dim=8, seed=11)


def plain_vectors(texts, space):
    places, signs = space.index()
    sums = np.zeros((space.buckets, space.dim))
    for t in texts:
        ids = [space.bucket(w) for w in (t or "").encode().lower().split()]
        for i, a in enumerate(ids):
            for far in range(-qc.WINDOW, qc.WINDOW + 1):
                if far and 0 <= i + far < len(ids):
                    for k in range(qc.NONZERO):
                        sums[a, (places[ids[i + far], k] + far) % space.dim] += signs[ids[i + far], k]
    out = np.zeros((space.buckets, space.dim))
    for b in range(space.buckets):
        damped = [math.copysign(math.log1p(abs(v)), v) for v in sums[b]]
        length = math.sqrt(sum(v * v for v in damped))
        own = np.zeros(space.dim)
        own[places[b]] = signs[b] / math.sqrt(qc.NONZERO)
        out[b] = np.array(damped) / max(length, 1e-9) + 0.5 * own
    return out


def plain_pools(text, vectors, space):
    rows = [vectors[space.bucket(w)] for w in (text or "").encode().lower().split()]
    if not rows:
        return np.zeros(3 * space.dim)
    mean = sum(rows) / len(rows)
    deviation = np.sqrt(np.maximum(sum(r * r for r in rows) / len(rows) - mean**2, 0))
    pairs = sum((a * b for a, b in zip(rows, rows[1:], strict=False)), np.zeros(space.dim)) / len(rows)
    return np.concatenate([mean, deviation, pairs])


def corpus():
    draw = random.Random(5)
    good, bad = ["tree", "river", "walks", "slowly", "the", "a"], ["buy", "NOW", "cheap", "click", "the", "a"]
    texts = [(i, " ".join(draw.choices(good if i % 3 else bad, k=draw.randint(1, 30))), int(i % 3 > 0)) for i in range(150)]
    return [*texts, (150, None, 1), (151, "", 0), (152, "zzz unseen", None)]


def test_scores_by_definition(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, id string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    learnt, fit = [], qc.fit
    monkeypatch.setattr(qc, "fit", lambda x, y: learnt.append((x, y)) or fit(x, y))
    trained = qc.train(docs, labels, space=SPACE)
    vectors = plain_vectors([t for _, t, _ in rows], SPACE)
    assert np.allclose(trained.vectors, vectors, atol=1e-5)
    # What is learnt from: the labelled rows that aren't held out, by their pools.
    (x, y), want = learnt[0], [(label, plain_pools(t, vectors, SPACE)) for i, t, label in rows if label is not None and crc32(str(i).encode()) % 5]
    assert len(x) == len(want) and sum(y) == sum(label for label, _ in want)
    assert all(any(label == own and np.allclose(row, pools, atol=1e-4) for label, pools in want) for own, row in zip(y, x, strict=True))
    net, right = fit(x, y), 0
    got = {r.doc_id: r for r in qc.quality_scores(docs, labels, space=SPACE).collect()}
    for i, t, label in rows:
        logit = float(np.maximum((plain_pools(t, vectors, SPACE) - net.mean) / net.scale @ net.w1 + net.b1, 0) @ net.w2 + net.b2)
        assert abs(got[i].score - 1 / (1 + math.exp(-logit / net.temperature))) < 1e-3
        assert got[i].predicted == (got[i].score >= 0.3) and got[i].held_out == (crc32(str(i).encode()) % 5 == 0)
        right += label is not None and t not in (None, "") and got[i].predicted == label
    assert right >= 140


def test_training_is_gradient_descent_on_the_log_loss():
    """The loss falls to what the data allow, from any start; one class or no rows give the smoothed share."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(4000, 6))
    y = (draw.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = qc.fit(x, y, hidden=8)
    z = net.logits(x)
    best = np.mean(np.logaddexp(0, 2 * x[:, 0]) - y * 2 * x[:, 0])
    assert np.mean(np.logaddexp(0, z) - y * z) < best + 0.03
    assert np.allclose(qc.fit(x, np.ones(4000)).probability(x), 4001 / 4002)
    assert np.allclose(qc.fit(np.zeros((0, 6)), np.zeros(0)).probability(x), 0.5)
    assert qc.fit(x[:2], np.array([0.0, 1.0])).temperature == 1.0  # too few to hold any out


@pytest.mark.parametrize("stretch", [0.4, 1.0, 3.0])
def test_temperature_undoes_a_stretch(stretch):
    draw = np.random.default_rng(4)
    logit = draw.normal(size=20_000) * 2
    y = (draw.random(20_000) < 1 / (1 + np.exp(-logit))).astype(float)
    found = qc.fitted_temperature(logit * stretch, y)
    assert abs(found / stretch - 1) < 0.1
    share = defaultdict(list)
    for p, truth in zip(1 / (1 + np.exp(-logit * stretch / found)), y, strict=True):
        share[int(p * 10)].append((p, truth))
    assert all(abs(np.mean([p for p, _ in s]) - np.mean([t for _, t in s])) < 0.05 for s in share.values())


def test_temperature_stays_inside_where_classes_come_apart():
    draw = np.random.default_rng(5)
    y = (np.arange(2000) % 4 > 0).astype(float)
    x = draw.normal(size=(2000, 10)) + 3 * y[:, None]
    net = qc.fit(x, y)
    assert qc.TEMPERATURES[0] * 2 < net.temperature < qc.TEMPERATURES[-1] / 2
    fresh = (np.arange(1000) % 4 > 0).astype(float)
    p = net.probability(draw.normal(size=(1000, 10)) + 3 * fresh[:, None])
    assert np.mean((p < 1e-6) | (p > 1 - 1e-6)) < 0.5 and len(set(p.tolist())) > 900  # scores rank
    assert np.mean((p >= 0.3) == fresh) > 0.99


def test_probabilities_keep_order_and_never_overflow():
    net = qc.Network(np.zeros(1), np.ones(1), np.ones((1, 1)), np.zeros(1), np.ones(1), -1000.0)
    p = net.probability(np.array([[0.0], [1.0], [900.0], [1000.0], [1100.0], [5000.0]]))
    assert (np.diff(p) >= 0).all() and 0 <= p[0] < p[2] < p[3] == 0.5 < p[4] <= p[5] == 1
