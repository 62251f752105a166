"""Whitening, source divergence and token counts against brute force."""

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from messy_docs import sentence
from pyspark.sql import functions as F

from capledger.llm import divergence, tokens, whitening
from capledger.llm.queries import QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# whitening


@pytest.mark.parametrize(
    "a",
    [np.diag([3.0, 3, 3, 1, 1, 0]), np.eye(5), np.ones((6, 6)), np.zeros((4, 4)), np.diag([1e9, 1.0, 1e-3]), np.array([[7.0]])]
    + [(m := np.random.default_rng(n).standard_normal((n, n + 3))) @ m.T for n in (2, 3, 17, 64, 150)],
)
def test_eigen(a):
    values, vectors = whitening.eigen(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * max(1, np.abs(a).max()))
    assert np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-13)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * len(a) * max(1e-300, np.linalg.norm(a))


def test_polar_factor():
    m = np.random.default_rng(4).standard_normal((30, 30))
    a = m + m.T
    w, q = np.linalg.eigh(a)
    assert np.allclose(whitening.polar(a), (q * np.sign(w)) @ q.T, atol=1e-12)
    assert whitening.polar(np.zeros((3, 3)) + np.diag([1.0, 0, 2])) is None


@pytest.mark.parametrize("scale", [1, 10**7, 10**11, 1 << 40])
def test_exact_moments(scale):
    y = np.random.default_rng(2).integers(-scale, scale + 1, (700, 5))
    big = y.astype(object)
    assert whitening.exact_sum(y).tolist() == big.sum(axis=0).tolist()
    assert whitening.exact_gram(y).tolist() == (big.T @ big).tolist()


def brute_whitening(vectors):
    """Usable whole vectors, their deviations, whitened components up to sign, explained shares."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.astype(object).sum(axis=0)
    mean = np.array([s / n for s in total])
    cov = (fit - mean).T @ (fit - mean) / n
    w, q = np.linalg.eigh(cov)
    w, q = w[::-1], q[:, ::-1]
    k = min(16, int((w > len(w) * 1e-15 * np.trace(cov)).sum()))
    deviation = [int(((n * row.astype(object) - total) ** 2).sum()) for row in x]
    return n, deviation, (x - mean) @ q[:, :k] / np.sqrt(w[:k]), w[:k] / np.trace(cov)


def check_whitening(result, vectors):
    whitened, fitted, error = result
    rows = sorted(whitened.collect(), key=lambda r: r[0])
    n, deviation, want, explained = brute_whitening(vectors)
    got = np.array([r.whitened for r in rows])
    assert fitted.n == n and [r.deviation for r in rows] == deviation
    sign = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * sign, atol=1e-7) and np.allclose(fitted.explained, explained, rtol=1e-9) and error < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(6)
    good = [(rng.standard_normal(20) * np.linspace(1, 3, 20)).astype(np.float32).tolist() for _ in range(300)]
    good += [good[0]] * 150
    bad = [None, [], [None] * 20, [float("nan")] + good[0][1:], good[0][:19] + [float("inf")], good[0][:5], good[1][:19] + [None], good[0][:19] + [1e20]]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(1000 + i, v, "x") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string").repartition(5)
    check_whitening(whitening.whiten(df), good)


def test_whitening_without_rows_or_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None), (2, [])]):
        whitened, fitted, _ = whitening.whiten(spark.createDataFrame(rows, schema))
        assert whitened.columns == ["vec_id", "deviation", "whitened"] and whitened.count() == 0 and fitted is None
    whitened, fitted, error = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (None, [0.5, 1.0])], schema))
    assert listed(whitened) == [(1, 0, []), (None, 0, [])] and fitted.n == 1 and error == 0
    flat = [(i, [float(i), 2.0, float(-i)]) for i in range(9)]
    whitened, fitted, error = whitening.whiten(spark.createDataFrame(flat, schema))
    assert len(fitted.values) == 1 and error < 1e-12


def test_whitening_query(spark, sf):
    rows = QUERIES["op11_whitening"](spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, want, explained = brute_whitening([r.embedding for r in table])
    rows.sort(key=lambda r: (r.vec_id, r.component))
    got = np.array([r.whitened for r in rows]).reshape(len(table), -1)
    assert [r.deviation for r in rows[::16]] == deviation and {r.n for r in rows} == {n}
    assert np.allclose(got, want * np.sign((got * want).sum(axis=0)), atol=1e-7)
    assert np.allclose([r.explained for r in rows[:16]], explained, rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


# divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(docs, least=10, top=10):
    docs = [tuple(x or "" for x in d) for d in docs]
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = [s for a, s in counts if a == lang]

        def shares(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // total for t in kept}

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            p = own[s]
            pair = [(sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept), o) for o, q in own.items() if o != s]
            term = [((p[t] - whole[t]) ** 2 // (p[t] + whole[t]), t) for t in kept if counts[lang, s][t] and p[t] > whole[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out, key=repr)


def test_divergence_on_messy_rows(messy, rows):
    docs = [(r[2], r[3], r[1]) for r in rows]
    for least in (1, 2, 10):
        assert listed(divergence.divergence(messy, least=least)) == brute_divergence(docs, least), least


@pytest.mark.parametrize("cells", [1 << 20, 40])
def test_divergence_of_long_terms_and_many_sources(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    rng = random.Random(8)
    terms = [c * n for n in (1, 7, 8, 9, 15, 16, 17, 18, 40, 2000) for c in ("a", "Z", "é", "\U0001f600", "ab", "ba")] + ["É", "abcdefghé"]
    docs = [("xy"[i % 2], f"s{rng.randrange(8) if i % 3 else 0}", rng.choice([" ", "_", "1\n"]).join(rng.choices(terms, k=rng.randrange(30)))) for i in range(250)]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(4)
    assert listed(divergence.divergence(df)) == brute_divergence(docs)


def test_divergence_without_rows_or_terms(spark, empty):
    assert divergence.divergence(empty).count() == 0
    docs = [("a", "s", "one"), ("a", "t", None), ("a", None, "12 34"), (None, None, None)]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    assert listed(divergence.divergence(df)) == brute_divergence(docs) and len(brute_divergence(docs)) == 6


def test_shares_of_huge_counts(spark):
    cases = [(0, 0, 1), (7, 7, 1), (10**15, 4 * 10**15, 10**14), (3 * 10**15 + 1, 8 * 10**15, 5), (2, 9 * 10**15 - 20, 10)]
    df = spark.createDataFrame(cases, "n long, total long, kept long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * kept) for n, total, kept in cases]


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(3)
    high, low = rng.integers(0, 4, 900).astype(np.uint64) << np.uint64(50), rng.integers(0, 1 << 63, 900).astype(np.uint64) % np.uint64(97)
    assert (divergence.radix_order([high, low]) == np.lexsort((low, high))).all()


# token counts


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "piece_bpe_32k.model"])
def counted(request):
    path = tokens.tokenizer_path(request.param)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return path, lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return path, lambda text: len(model.encode(text, add_special_tokens=False).ids)


def test_token_counts(spark, messy, pairs, counted):
    path, count = counted
    more = [(900, "a <|endoftext|> b</s><s>"), (901, "日本 \U0001f600 x"), (902, "  \t\n")]
    df = messy.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = [(i, len((t or "").encode()), n := count(t or ""), n > 50) for i, t in pairs + more]
    assert listed(tokens.count_tokens(df, tokenizer=path, limit=50)) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counter_equals_the_library(name):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path(name)
    model, count, rng = Tokenizer.from_file(path), tokens.counter(path), random.Random(12)
    assert tokens.cuts_before_blanks(model) == (name == "byte_bpe_50k.json")
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "ñandú", "'s", "12", "!", "\u00a0", "\u3000", "\x1c", "\x85", "日本", "<|endoftext|>", "<|startoftext|>", "\r", "don't", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000)]
    assert count(texts) == [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def test_cache_is_filled_by_distinct_misses(spark, folder):
    rng = random.Random(1)
    texts = [sentence(rng, 20) for _ in range(40)]
    path = tokens.tokenizer_path()
    store = tokens.TokenCache(spark, folder, tokens.tokenizer_version(path))

    def run(some):
        rows = [(i % 7 or None, t) for i, t in enumerate(some)]
        return tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), cache=folder)

    def stored():
        return spark.read.parquet(f"{store.folder}/*").count()

    first = run(texts[:30] * 3)
    assert first.count() == 90 and store.counts().count() == 30 and 30 <= stored() <= 90
    once = stored()
    assert run(texts[:30] + texts[:5]).count() == 35 and stored() == once
    assert run(texts).count() == 40 and store.counts().count() == 40 and stored() <= once + 60
    # A count that the cache holds is the one that is used; another tokenizer version has a cache of its own.
    digest = store.counts().orderBy("_digest").first()._digest
    store.append(spark.createDataFrame([(digest, 99_999)], tokens.COUNTS))
    assert run(texts).agg(F.max("n_tokens")).first()[0] == 99_999
    other = tokens.count_tokens(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), tokenizer=tokens.tokenizer_path("word_bpe_49k.json"), cache=folder)
    assert other.first().n_tokens < 99_999


def test_token_counts_of_nothing(empty):
    assert tokens.count_tokens(empty).count() == 0


def test_token_count_query(spark, sf):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.tokenizer_path())
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_token_counts"](spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        n = len(model.encode(text[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text[r.doc_id] or "").encode()), n, n > 1024)
