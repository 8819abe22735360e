import numpy as np
import pytest

from dealtide.llm import lm


def test_words_outside_the_frequent_ones_are_told_apart(spark):
    random = np.random.default_rng(5)
    # Each first word has its own second word; none of the 120 words is frequent.
    texts = [" ".join(f"a{k} b{k}" for k in random.integers(0, 60, 500)) for _ in range(600)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = [r for r in lm.score_documents(frame, classes=2).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in got)
    gain = sum(r.score - r.base_score for r in got) / tokens
    # One shared symbol for them can at most learn that a and b alternate: log10(2).
    assert gain > 0.4


def test_units_follow_the_vocabulary():
    size = []
    for words in (10_000, 160_000):
        n, total = np.zeros((2, 64), np.int64)
        n[:3] = words, words // 4, words // 16
        total[:3] = n[:3] * [1, 2, 5]
        size.append(len(lm.Units.start([(b"the", 5000)], n + (np.arange(64) == 12), total + 5000 * (np.arange(64) == 12))))
    assert size[1] > 3 * size[0]


def test_classes_and_units_are_normalised():
    counts = 1e5 / np.arange(1, 2001)
    model = lm.Model.start(counts)
    assert 10 < len(model.heads) <= 23
    random = np.random.default_rng(2)
    trainer = lm.Trainer(model, counts / counts.sum(), 1)
    for _ in range(5):
        trainer.step(*random.integers(0, 2000, (3, 500)))
    scorer = lm.Scorer(trainer.model)
    for a, b in ((0, 2000), (7, 1999), (2000, 2000)):
        log = scorer(np.full(2000, a), np.full(2000, b), np.arange(2000))
        assert (10**log).sum() == pytest.approx(1, abs=1e-5)


def test_scores_equal_a_plain_model():
    """Two softmax layers, written out for every context, target and class of a small vocabulary."""
    counts = 1e4 / np.arange(1, 61)
    random = np.random.default_rng(4)
    trainer = lm.Trainer(lm.Model.start(counts), counts / counts.sum(), 1)
    for _ in range(20):
        trainer.step(*random.integers(0, 60, (3, 400)))
    m = trainer.model
    last, before, target = random.integers(0, 60, (3, 500))
    got = lm.Scorer(m)(last, before, target)
    for a, b, t, log in zip(last, before, target, got, strict=True):
        h = [
            float(m.vectors[a][k] * m.mixing[0][k] + m.vectors[b][k] * m.mixing[1][k]) for k in range(lm.SIZE)
        ]

        def total(rows, bias):
            return sum(np.exp(sum(x * float(y) for x, y in zip(h, r, strict=True)) + float(s)) for r, s in zip(rows, bias, strict=True))

        c = int(np.searchsorted(m.first, t, "right")) - 1
        own = slice(m.first[c], m.first[c + 1])
        p = total(m.heads[c : c + 1], m.head_bias[c : c + 1]) / total(m.heads, m.head_bias)
        p *= total(m.targets[t : t + 1], m.bias[t : t + 1]) / total(m.targets[own], m.bias[own])
        assert log == pytest.approx(np.log10(p), abs=1e-4)


def test_steps_count_their_events_and_learn():
    counts = np.array([50.0, 30.0, 20.0])
    trainer = lm.Trainer(lm.Model.start(counts), counts / counts.sum(), 1)
    contexts = np.array([1, 2, 1, 0]), np.array([3, 1, 2, 2])
    target = np.array([0, 1, 2, 0])
    trainer.step(*contexts, target)
    assert trainer.tokens == 4
    assert trainer.events.tolist() == [[1, 3, 3, 1], [2, 1, 1, 0]]
    for _ in range(300):
        trainer.step(*contexts, target)
    assert (10 ** lm.Scorer(trainer.model)(*contexts, target) > 0.9).all()


def test_what_is_learned_does_not_depend_on_the_layout(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gains = []
    for partitions in (1, 16, 64):
        got = lm.score_documents(documents.repartition(partitions)).where("held_out")
        score, base, tokens = got.selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
        gains.append((score - base) / tokens)
    assert min(gains) > 0.14
    assert max(gains) - min(gains) < 1e-6


def test_several_groups_and_rounds_learn(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score_documents(documents, group=100_000, rounds=2).where("held_out")
    score, base, tokens = got.selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
    assert (score - base) / tokens > 0.03


def test_scores_of_any_size_are_summed():
    """Sums that overflow or vanish in single precision."""
    h = np.array([[1.0, 1.0], [-1.0, 1.0], [0.0, 1.0]], np.float32)
    targets = np.array([[200.0, 0.0], [198.0, 0.0], [150.0, 1.0]], np.float32)
    want = [200 + np.log1p(np.exp(-2) + np.exp(-49)), -150 + 1 + np.log1p(np.exp(-49)), np.log(2 + np.e)]
    assert lm._log_total(h, targets) == pytest.approx(want, rel=1e-5)


def test_a_step_moves_as_its_definition():
    """Noise classes are drawn anew and so are noise units: the step is written out with the same draws."""
    counts = 1e4 / np.arange(1, 121)
    start, noise = lm.Model.start(counts), counts / counts.sum()
    random = np.random.default_rng(6)
    last, before, target = random.integers(0, 120, (3, 300))
    trainer = lm.Trainer(start, noise, 7)
    trainer.step(last, before, target)
    draws = np.random.default_rng(7)
    order = np.argsort(target, kind="stable")
    last, before, target = last[order], before[order], target[order]
    m, cls = start, start.class_of()[target]
    class_noise = np.add.reduceat(noise, m.first[:-1])
    pull = lambda x: 1 / (1 + np.exp(x))
    drawn = np.searchsorted(np.cumsum(class_noise), draws.random(lm.NOISE) * class_noise.sum(), "right")
    h = m.vectors[last] * m.mixing[0] + m.vectors[before] * m.mixing[1]
    g_h, g_heads, g_targets = np.zeros_like(h), np.zeros_like(m.heads), np.zeros_like(m.targets)
    for t in range(300):
        for c, real in [(cls[t], True), *((c, False) for c in drawn)]:
            s = h[t] @ m.heads[c] + m.head_bias[c] - np.log(lm.NOISE * class_noise[c])
            g = pull(s) if real else -pull(-s)
            g_h[t] += g * m.heads[c]
            g_heads[c] += g * h[t]
    runs = np.unique(cls)
    shifts = [draws.random(len(runs)) for _ in range(lm.WORD_NOISE)]
    for k, c in enumerate(runs):
        own = np.flatnonzero(cls == c)
        if len(own) == 1 or m.first[c + 1] - m.first[c] == 1:
            continue
        for p, t in enumerate(own):
            away = [1 + int(x[k] * (len(own) - 1)) for x in shifts]
            for u, real in [(target[t], True), *((target[own[(p + x) % len(own)]], False) for x in away)]:
                s = h[t] @ m.targets[u] + m.bias[u] - np.log(lm.WORD_NOISE * noise[u] / class_noise[c])
                g = pull(s) if real else -pull(-s)
                g_h[t] += g * m.targets[u]
                g_targets[u] += g * h[t]
    g_vectors = np.zeros_like(m.vectors)
    np.add.at(g_vectors, last, g_h * m.mixing[0])
    np.add.at(g_vectors, before, g_h * m.mixing[1])
    for name, g in (("heads", g_heads), ("targets", g_targets), ("vectors", g_vectors)):
        want = getattr(m, name) + lm.RATE * g / np.sqrt(1 + g * g)
        assert getattr(trainer.model, name) == pytest.approx(want, abs=1e-4)


def test_orders_by_halves_are_stable():
    numbers = np.random.default_rng(3).integers(0, 70_000, 5000) // 3 * 3
    for some in (numbers, numbers << 15, numbers[:0], numbers % 9):
        assert (lm._order(some) == np.argsort(some, kind="stable")).all()
