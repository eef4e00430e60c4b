"""Hard negatives, periodic runs and packing against brute force and round trips."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import negatives, packing, periods
from framewise.llm.common import prepare
from framewise.llm.queries import op12_periodic_runs, queries

DIR = "/root/testdata/sf0.001"
SPACE = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("most", [0, 3, 100, 2**10, 2**20, 2**26])
@pytest.mark.parametrize("dims", [0, 1, 3, 64])
def test_packed_products_are_exact(most, dims):
    rng = np.random.default_rng(most + dims)
    a, c = rng.integers(-most, most + 1, (7, dims)), rng.integers(-most, most + 1, (11, dims))
    assert (negatives.packed_scores(a, c) == a @ c.T).all()


def test_several_candidates_share_a_wide_integer():
    assert negatives.plan_packing(1_700, -160, 160).fields == 2 and negatives.plan_packing(300, -20, 20).fields == 3
    assert negatives.plan_packing(2**40, -(2**20), 2**20).limbs > 1


def slow_negatives(rows, scale=256.0, positives=5, k=3, low=50, high=95):
    kept = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v], label))
    out = set()
    for a, v, label in kept:
        if a % 50:
            continue
        scored = {(-sum(x * y for x, y in zip(v, u, strict=True)), i, other) for i, u, other in kept if len(u) == len(v)}
        for s, i in sorted({(s, i) for s, i, other in scored if other == label and i != a})[:positives]:
            fits = sorted({(t, j) for t, j, other in scored if other != label and low * -s <= 100 * -t <= high * -s})[:k]
            out |= {(a, i, n + 1, j, -s, -t) for n, (t, j) in enumerate(fits)}
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 4096), (3, 20)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, blocks):
    """With nulls, non-finite components, other lengths, empty vectors, ties and repeated rows, in one block and in many."""
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", blocks[0])
    monkeypatch.setattr(negatives, "LEAST_ROWS", blocks[1])
    monkeypatch.setattr(negatives, "TILE_ROWS", blocks[1])
    rng = random.Random(3)
    rows = [(i * (1 if i % 3 else 5), [rng.choice([-0.25, 0.5, 0.125, rng.random()]) for _ in range(6)], rng.randrange(3)) for i in range(260)]
    rows += rows[:40]  # repeated
    rows += [(None, [0.1] * 6, 1), (50, None, 1), (100, [0.2] * 6, None), (150, [None] + [0.1] * 5, 1), (200, [math.nan] * 6, 1), (300, [math.inf] + [0.0] * 5, 1)]
    rows += [(50 * i, [0.5, 0.25 * (i % 3)], i % 2) for i in range(12)] + [(50 * i, [], i % 2) for i in range(5)] + [(50, [0.5] * 6, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("uid", F.lit("clash")).withColumn("v", F.lit(1)).repartition(3)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = negatives.mine_hard_negatives(df, F.col("vec_id") % 50 == 0)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == columns
    # an anchor id with several vectors gives rows for each; the brute force joins them in one set
    assert sorted({tuple(r) for r in got.collect()}) == slow_negatives(single)


def test_hard_negatives_of_nothing_and_of_huge_components(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine_hard_negatives(empty, F.col("vec_id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 2)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        negatives.mine_hard_negatives(huge, F.col("vec_id") % 50 == 0).count()


def slow_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def sorted_runs(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def odd_word_lists():
    rng = random.Random(4)
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    out = [list(fib[-1]), ["ab"[bin(i).count("1") % 2] for i in range(300)], ["x"] * 200, list("abcab" * 40), list(("a" * 31 + "b") * 6), ["x"] * 11, ["x"] * 12]
    for _ in range(150):
        w = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            if len(w) > 4:
                p, a, e = rng.randint(1, len(w) // 2), rng.randrange(len(w)), len(w)
                for i in range(a + p, rng.randint(min(a + p, e), e)):
                    w[i] = w[i - p]
        out.append(w)
    return out


@pytest.mark.parametrize("tile_words", [16, 1 << 16])
def test_periodic_runs_match_brute_force(spark, tile_words):
    """In one tile and in many, with nulls, other white space, null and repeated ids and an extra column."""
    texts = [" ".join(w) for w in odd_word_lists()] + [None, "", " \t\n", "a b " * 9, "\x0ba\x0c b\r\n" * 30, "é ü " * 20, "\0 " * 15]
    rows = [(None if i % 50 == 7 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("uid", F.lit("clash"))
    got = periods.periodic_runs(df, tile_words=tile_words).collect()
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = slow_runs(words)
        want.append((i, len(words), [tuple(r) for r in sorted_runs(runs)], collapsed(words, runs)))
    shown = lambda x: (x[0] is None, x[0] or 0, x[3], x[1])
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_sha256"]) for r in got), key=shown) == sorted(want, key=shown)


def test_periodic_runs_of_a_very_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    words[20_000:90_000] = (words[20_000:20_000 + 9_973] * 8)[:70_000]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    one, many = (periods.periodic_runs(df, tile_words=t).first()["runs"] for t in (1 << 18, 1 << 12))
    assert one == many and (20_000, 70_000, 9_973) in [tuple(r) for r in one]


def test_periodic_runs_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periods.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError, match="fewer than 10"):
        periods.periodic_runs(empty, least=9)


def test_periodic_runs_query(spark):
    """Against the contract, word by word."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op12_periodic_runs(spark, DIR).collect()}
    planted = 0
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        words = text.encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            planted += 1
        if n > 1500:
            continue  # the brute force is quadratic
        runs = slow_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in sorted_runs(runs)).encode()).hexdigest()
        assert r["collapsed_sha256"] == collapsed(words, runs)
    assert planted > 5


def check_packing(rows, texts, size=2048, end_id=1):
    """Every token in one piece, every sequence gapless and without padding; ids by the public tokenizer."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for i, own in pieces.items():
        ids = [*lib.encode(texts[i] or "", add_special_tokens=False).ids, end_id]
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))] and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        total = sum(r["length"] for r in own)
        assert total <= size and total & (total - 1) == 0
    return sequences


def test_packing_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    texts |= {-1: None, -2: "", -3: "<|endoftext|> a <|endoftext|>", -4: "日本 😀\0 é" * 3000, -5: "x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("tail", F.lit(1)).withColumn("uid", F.lit("clash")).repartition(3)
    for known, shard in ((ranks(), packing.SHARD_TOKENS), (None, 20_000)):
        rows = packing.pack(df, tokenizer(), known, shard_tokens=shard).collect()
        sequences = check_packing(rows, texts)
        assert any(len({r["doc_id"] for r in s}) > 1 for s in sequences.values())


def test_packing_of_nothing_and_of_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, tokenizer(), ranks()).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a b")] * 3 + [(7, "c")] * 2, "doc_id long, text string"), tokenizer(), ranks()).collect()
    assert sum(r["length"] for r in rows) == 3 * 3 + 2 * 2 and sorted(r["offset"] for r in rows if r["offset"] == 0) == [0] * len({r["sequence_id"] for r in rows})


def test_ids_are_the_tokenizers():
    """Very long runs, white space of all kinds, contractions, special strings and control characters."""
    fast, slow = packing.encoder(tokenizer(), ranks()), packing.encoder(tokenizer(), None)
    rng = random.Random(8)
    letters = ["a", "b", "é", "日", "😀", "1", "'s", "'t", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", ".", "#", "_", "\0", "e\u0301", "²", "\ufeff"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3_000)]
    for text in [*texts, "", "a" + " " * 1_000_000 + "b", *(x * (packing.LONG_CHARS - 1) for x in (" ", "\n", "a", "#", "\u3000")), "ab1é" * 40_000, "\n" * 300_000, "#$%" * 50_000, "<|endoftext|> a"]:
        assert np.array_equal(fast(text), slow(text)), repr(text[:80])


def test_index_scores_are_bm25():
    rng = np.random.default_rng(6)
    tails = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(50)] + [np.array([3, 3, 3])] * 2
    index = packing.Index(tails)
    n, mean = len(tails), sum(map(len, tails)) / len(tails)
    for i in range(0, n, 7):
        score = np.zeros(n)
        for t in set(tails[i].tolist()):
            df = sum(t in set(x.tolist()) for x in tails)
            idf = math.log((n - df + 0.5) / (df + 0.5))
            if idf > 0:
                for k, x in enumerate(tails):
                    tf = int((x == t).sum())
                    score[k] += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean)) if tf else 0
        used = np.arange(n) % 5 == i % 5
        want = sorted(np.flatnonzero((score > 0) & ~used).tolist(), key=lambda k: (-round(score[k], 9), k))
        assert [round(score[k], 6) for k in index.neighbours(i, used)] == [round(score[k], 6) for k in want] and set(index.neighbours(i, used)) == set(want)


def test_windows_take_neighbours_of_their_seed():
    rng = np.random.default_rng(7)
    topics = [np.arange(100 * t, 100 * t + 40) for t in range(4)]
    tails = [rng.choice(topics[i % 4], 50) for i in range(80)]  # four topics, dealt in turn
    windows = list(packing.fill_windows(tails, 500))
    assert [sum(n for _, _, n in w) for w in windows] == [500] * 8
    mixed = sum(len({i % 4 for i, _, _ in w}) > 1 for w in windows)
    assert mixed <= 3
    assert [sum(n for _, _, n in s) for s in packing.in_powers([(0, 0, 700), (1, 5, 811)])] == [1024, 256, 128, 64, 32, 4, 2, 1]


def test_new_queries_are_registered():
    assert {"op11_hard_negatives", "op12_periodic_runs", "op13_packing"} <= set(queries())
