"""corpus_pipeline.run on a small table against a chain of slow versions, with null, empty and repeated rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import classifier, ngrams, rules
from framewise.llm.common import new_path, prepare
from framewise.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, piece_model

from .test_learning import slow_rows, slow_statistics, slow_verdict

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def slow_score(text, vectors, net):
    both = slow_rows(text)
    x = np.zeros(2 * classifier.DIMS + 1)
    if both:
        x[: classifier.DIMS] = np.mean([vectors[w] for w, _ in both], axis=0)
        x[classifier.DIMS : -1] = np.mean([vectors[s] for _, s in both], axis=0)
        x[-1] = 1
    logit = float(np.tanh((x - net.mean) / net.scale @ net.w1 + net.b1) @ net.w2 + net.b2)
    return 1 / (1 + np.exp(-logit / net.temperature))


def slow_classes(rows):
    """One row of each class of rows: that of the smallest id (null last), then text digest."""
    sets = []
    for r in rows:
        w = (r[1] or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    name = lambda r: (ngrams.LAST if r[0] is None else r[0], hashlib.md5((r[1] or "").encode()).hexdigest())
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[find(i) if sets[i] else ("wordless", *name(r))].append(r)
    return [min(c, key=name) for c in classes.values()]


def slow_mixture(rows):
    """Water-filling, one round of full children at a time, then prefixes in hash order."""

    def leaf_of(r):
        digits = re.search(r"(\d+)$", r[3] or "")
        return (f"domain{int(digits[1]) % 4}" if digits else "other", r[2] or "", r[3] or "")

    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    tokens, tree = defaultdict(int), defaultdict(set)
    for r in rows:
        leaf = leaf_of(r)
        tokens[leaf] += words(r)
        for k in range(3):
            tree[leaf[:k]].add(leaf[: k + 1])
    capacity = lambda node: MIX_EPOCHS * sum(v for k, v in tokens.items() if k[: len(node)] == node)

    def spread(node, budget, out):
        if len(node) == 3:
            out[node] = budget
            return out
        weights = MIX_WEIGHTS.get(("domain", "lang", "source")[len(node)], {})
        left = {c: weights.get(c[-1], weights.get("*", 1)) for c in tree[node]}
        given = {}
        while left:
            total = sum(left.values())
            full = [c for c, w in left.items() if capacity(c) * total <= budget * w]
            if not full:
                given |= {c: budget * w // total for c, w in left.items()}
                break
            for c in full:
                given[c] = capacity(c)
                del left[c]
            budget -= sum(given[c] for c in full)
        for c, b in given.items():
            spread(c, b, out)
        return out

    taken = []
    for leaf, budget in spread((), sum(tokens.values()), {}).items():
        if not tokens[leaf]:
            continue
        whole, rest = divmod(budget, tokens[leaf])
        order = lambda r: (hashlib.md5(f"{MIX_SEED}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), str(r[0]), words(r))  # noqa: B023, E731
        upto = 0
        for r in sorted((r for r in rows if leaf_of(r) == leaf), key=order):
            upto += words(r)
            taken += [r] * (whole + (upto <= rest))
    return taken


def test_run_against_slow_chain(spark):
    import sentencepiece

    prepare(spark)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(*COLUMNS)
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    few = [r["text"] for r in docs.orderBy("doc_id").limit(3).collect()]
    odd = [(90_001, None, "en", "src1", 0), (90_002, "", None, None, None), (90_003, few[0], "en", "src2", 1), (90_003, few[0], "en", "src2", 1),
        (None, few[1], None, "no number", 2), (90_004, "word " * 3_000, "de", "src1", 3)]
    path = new_path(spark, "small")
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]

    vectors, net = classifier.fit(docs, labels)
    rows = [r for r in rows if slow_score(r[1], vectors, net) >= 0.5]
    learned = rules.fit_rules(docs, labels)
    rows = [r for r in rows if slow_verdict(slow_statistics(r[1]), learned)[0]]
    assert 30 < len(rows)
    rows = slow_classes(rows)
    rows = slow_mixture(rows)
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = []
    for r in rows:
        ids = [1, *lib.encode(r[1] or ""), 2]
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_stages_on_odd_tables(spark):
    """Null, empty and repeated rows, an extra column, and the empty table, through every stage on its own."""
    prepare(spark)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(*COLUMNS)
    odd = [(None, None, None, None, None)] * 2 + [(7, "", "en", "src1", 0), (7, "a b " * 400, "xx", None, 1)]
    given = docs.limit(60).unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == given.columns, name
            assert not out.subtract(given).count(), name
        else:
            assert out.count() == given.count()
        assert stage(spark, given.limit(0), DIR).count() == 0, name
