"""The learned operators against slow versions: word vectors, pooling, training, temperature, rule growing and verdicts."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import classifier, rules
from framewise.llm.common import prepare


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def some_texts(n=40):
    rng = random.Random(8)
    words = ["Alpha", "beta", "gamma9", "###", "x", "The", "the", "delta-two", "Z" * 130, "日本語", "é", "12,5"]
    return ["", None, "one", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n))]


def slow_rows(text):
    """(row of word, row of shape) of each piece, from the definitions."""
    pieces = [w[k : k + 64] for w in (text or "").split() for k in range(0, len(w), 64)]
    out = []
    for i, w in enumerate(pieces):
        shape = "".join("X" if re.fullmatch(r"[^\W\d_]", c) and c.isupper() else "x" if re.fullmatch(r"[^\W\d_]", c) else "9" if c.isdigit() else c for c in w)
        shape = re.sub(r"(.)\1+", r"\1", shape)
        mark = "\x02again" if w in pieces[max(0, i - 6) : i] else "\x01" + shape
        out.append(tuple(zlib.crc32(x.encode()) % classifier.ROWS for x in (w, mark)))
    return out


def test_word_vectors_and_pooling(spark):
    texts = some_texts()
    index = classifier.index_vectors()
    assert (np.abs(index).sum(1) == classifier.NONZERO).all() and set(np.unique(index)) == {-1, 0, 1}
    sums = np.zeros((classifier.ROWS, classifier.DIMS))
    for t in texts:
        both = slow_rows(t)
        for i, rows in enumerate(both):
            for j in range(max(0, i - classifier.WINDOW), min(len(both), i + classifier.WINDOW + 1)):
                if j != i:
                    for r in rows:
                        sums[r] += index[both[j][0]] + index[both[j][1]]
    want = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, index)
    want = want / np.linalg.norm(want, axis=1, keepdims=True)
    got = classifier.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(got, want, atol=1e-6)
    rows = classifier.pooled(texts, got, classifier.Tokens())
    for t, x in zip(texts, rows, strict=True):
        both = slow_rows(t)
        if not both:
            assert not x.any()
            continue
        assert np.allclose(x[: classifier.DIMS], np.mean([want[w] for w, _ in both], axis=0), atol=1e-5)
        assert np.allclose(x[classifier.DIMS : -1], np.mean([want[s] for _, s in both], axis=0), atol=1e-5) and x[-1] == 1


def test_training_steps_follow_the_loss():
    """Adam on the numeric gradient of the weighted loss gives the same network."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 4)), rng.random(30) < 0.4
    hidden, decay, rate = 3, 1e-3, 0.02
    net = classifier.train(x, y, hidden=hidden, steps=3, rate=rate, decay=decay, seed=7)
    rng = np.random.default_rng(7)
    p = [rng.normal(0, 1 / 2, (4, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    z = (x - x.mean(0)) / (x.std(0) + 1e-3)
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def loss(q):
        logit = np.tanh(z @ q[0] + q[1]) @ q[2] + q[3][0]
        return np.mean(weight * (np.logaddexp(0, logit) - y * logit)) + decay / 2 * ((q[0] ** 2).sum() + (q[2] ** 2).sum())

    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, 4):
        gradients = []
        for i, a in enumerate(p):
            g = np.zeros_like(a)
            for at in np.ndindex(a.shape):
                up, down = [b.copy() for b in p], [b.copy() for b in p]
                up[i][at] += 1e-5
                down[i][at] -= 1e-5
                g[at] = (loss(up) - loss(down)) / 2e-5
            gradients.append(g)
        for i, g in enumerate(gradients):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(net.w1, p[0], atol=1e-5) and np.allclose(net.w2, p[2], atol=1e-5) and np.allclose(net.b1, p[1], atol=1e-5)


def test_temperature_calibrates():
    """No temperature of the grid gives a smaller loss on the rows that were held back, and it repairs an overconfident network."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6))
    y = rng.random(600) < 1 / (1 + np.exp(-x[:, 0]))
    net = classifier.train(x, y, hidden=24, steps=400, decay=0.0)
    held = np.arange(600) % 5 == 4
    logit = net.logit(x[held])
    loss = lambda t: np.mean(np.logaddexp(0, logit / t) - y[held] * logit / t)
    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.geomspace(0.2, 10, 80))
    assert net.temperature > 1 and loss(net.temperature) < loss(1.0)
    assert np.allclose(net.score(x), 1 / (1 + np.exp(-np.clip(net.logit(x) / net.temperature, -30, 30))))


def test_first_threshold_is_the_best():
    """The first test of a rule has the largest information gain among all its cuts, by trying them all."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = {"a": rng.integers(0, 12, 80).astype(float), "b": rng.random(80)}
        bad = (x["a"] > 7) ^ (rng.random(80) < 0.2)
        rule = rules.grow(x, bad, 1)
        before = np.log2((bad.sum() + 1) / 82)
        best = -np.inf
        for name, v in x.items():
            for t in np.unique(np.quantile(v[bad], np.linspace(0, 1, 33))):
                for held in (v >= t, v < t):
                    p, n = (held & bad).sum(), held.sum()
                    if p:
                        best = max(best, p * (np.log2((p + 1) / (n + 2)) - before))
        held = rule.holds(x)
        p, n = (held & bad).sum(), held.sum()
        assert abs(p * (np.log2((p + 1) / (n + 2)) - before) - best) < 1e-9


def slow_statistics(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, chars = len(words), sum(map(len, words))
    counts = {"n_words": n, "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", t or "")), "n_dup_lines": dup, "n_repeat_words": len(inside),
              "n_upper": sum(c.isupper() for c in t or ""), "n_marks": sum(c in "!?" for c in t or "")}
    return counts | {r: counts[a] / counts[b] if counts[b] else 0.0 for r, (a, b) in rules.RATIOS.items()}


def slow_verdict(x, learned):
    if x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]:
        return False, 0
    for i, rule in enumerate(learned, 1):
        if all((x[n] >= t) if up else (x[n] < t) for n, up, t in rule.tests):
            return False, i
    return True, None


def test_verdicts_by_hand(spark):
    """The conditional expression against the rules read one by one over statistics counted by hand, on every document."""
    directory = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{directory}/{n}.parquet") for n in ("documents", "labels"))
    learned = rules.fit_rules(docs, labels)
    assert learned
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rules.quality_rules(docs, labels).collect():
        assert (r["kept"], r["rule"]) == slow_verdict(slow_statistics(given[r["doc_id"]]), learned), r["doc_id"]
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for i, rule in enumerate(learned, 1):  # what each rule newly rejects is bad by labels
        hits = [quality[d] for d, t in given.items() if d in quality and slow_verdict(slow_statistics(t), learned)[1] == i]
        assert len(hits) >= 3 and np.mean([q == 0 for q in hits]) >= 0.9


def test_repeated_ids_keep_samples_bounded(spark):
    """50,000 rows of one labelled id: no more than the bound is learned from."""
    docs = spark.range(50_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("text of many words "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert rules.labelled_counts(docs, labels, 300).count() == 300
    vectors, net = classifier.fit(docs, labels, 300)
    assert net is None and vectors.shape == (classifier.ROWS, classifier.DIMS)
