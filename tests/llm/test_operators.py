"""Each operator against brute force on messy rows, and on no rows."""

import heapq
import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from messy_docs import sentence
from pyspark.sql import functions as F

from capledger.llm import boosting, contamination, exact, graph, language, lines, near, packing, pii, sharding, toxicity, urls
from capledger.llm.queries import URL_RULES
from capledger.session import stage


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# exact dedup


def test_exact_groups(messy, pairs):
    assert listed(exact.exact_groups(messy)) == brute.exact(pairs)


def test_exact_drop_keeps_whole_rows(messy, pairs):
    kept = exact.drop_exact_copies(messy)
    assert kept.columns == messy.columns
    assert sorted((r.doc_id, brute.lower(r.text)) for r in kept.where("doc_id is not null").collect()) == sorted(
        (i, t) for t in {brute.lower(t) for _, t in pairs} if (i := max((j for j, u in pairs if brute.lower(u) == t and j is not None), default=None)) is not None
    )
    assert kept.count() == len({brute.lower(t) for _, t in pairs})


def test_exact_separates_colliding_hashes(spark, monkeypatch):
    real = F.md5
    monkeypatch.setattr(exact.F, "md5", lambda c: F.substring(real(c), 1, 2))
    rows = [(i, f"text {i % 300}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact.collided(df).count() > 0
    assert listed(exact.exact_groups(df)) == brute.exact(rows)
    assert exact.drop_exact_copies(df).count() == 300


# near dedup


def test_near_groups(messy, pairs):
    got = listed(near.near_groups(messy))
    assert [r[:3] for r in got] == brute.near(pairs)
    by_class = {}
    for _, name, size, kept in got:
        by_class.setdefault((name, size), []).append(kept)
    assert sum(r[3] for r in got) == near.drop_near_copies(messy).count()
    assert near.drop_near_copies(messy).columns == messy.columns


def test_near_links_across_a_chain(spark):
    """Neighbours link, ends do not: one class, though the hub reaches only some."""
    rng = random.Random(3)
    words = sentence(rng, 300).split()
    rows = [(i, " ".join(words[6 * i : 6 * i + 150])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[:3] for r in listed(near.near_groups(df))] == brute.near(rows)


def test_near_random_edits(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        words = sentence(rng, 120).split()
        for _ in range(8):
            w = list(words)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r[:3] for r in listed(near.near_groups(df))]
    want = brute.near(rows)
    assert sum(a == b for a, b in zip(got, want)) >= 0.98 * len(want)


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(1)
    shingle = rng.integers(1, 1 << 63, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    text = np.repeat([0, 1], 60)
    sig = near.signatures(text, np.concatenate([shingle, shingle]), np.concatenate([a, b]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (200, 200)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = dict(listed(graph.components(df)))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# decontamination


@pytest.fixture(scope="module")
def items(pairs):
    long = next(t for i, t in pairs if i == 6).split()
    return [(1, " ".join(long[500:530])), (2, "shared LINE"), (3, None), (4, ""), (5, "absent words only"), (None, "no id"), (1, " ".join(long[520:560])), (11, "one")]


def test_contamination(spark, messy, pairs, items):
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n_words string")
    assert listed(contamination.contamination(messy, benchmark)) == brute.contamination(pairs, items)
    clean = [i for i, *_, bad in brute.contamination(pairs, items) if not bad]
    kept = contamination.drop_contaminated(messy, benchmark)
    assert kept.columns == messy.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(clean, key=repr)


def test_contamination_without_items(spark, messy, pairs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert listed(contamination.contamination(messy, none)) == brute.contamination(pairs, [])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c x d e"), (2, "a b c d e"), (3, "e d c b a z z z")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "b c d")], "item_id long, text string")
    exact_, near_ = (listed(contamination.proximity_matches(docs, items, s).select("doc_id", "item")) for s in (0, 1))
    assert exact_ == [(2, "9")] and {r for r in near_} == {(1, "9"), (2, "9")}


def test_proximity_needs_every_word(spark):
    docs = spark.createDataFrame([(1, "alpha zzz zzz zzz beta zzz"), (2, "q alpha b x c d beta f"), (3, "alpha c b d beta f"), (None, "alpha b c d beta f")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha b c d beta f")], "item_id long, text string")
    got = {s: sorted({r.doc_id for r in contamination.proximity_matches(docs, items, s).collect()}, key=repr) for s in (0, 1, 2)}
    assert got == {0: [None], 1: [2, 3, None], 2: [2, 3, None]}


# lines


def test_line_dedup(messy, pairs):
    got = listed(lines.dedup_lines(messy).select("doc_id", "n_lines", "n_dropped", "kept_text"))
    assert got == brute.line_dedup(pairs)


def test_line_bitmaps_rebuild_the_text(messy):
    for r in lines.dedup_lines(messy, min_documents=2).join(messy.select("doc_id", "text").distinct(), "doc_id").collect():
        text = (r.text or "").split("\n")
        if len(text) == r.n_lines and r.doc_id != 13:
            assert "\n".join(x for k in r.keep_runs for x in text[k.start : k.start + k.length]) == r.kept_text


def test_first_occurrence_stays(spark):
    rows = [(1, "a\nb\na"), (2, "B\nc"), (3, "c\n\nd")]
    got = listed(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_documents=None))
    assert [(r[0], r[2], r[4]) for r in got] == [(1, 1, "a\nb"), (2, 1, "c"), (3, 1, "\nd")]


# sharding


def test_sharding(messy, pairs):
    got = listed(sharding.shard(messy))
    assert len(got) == len(pairs)
    slots = {}
    for i, size, crc, law, shard, slot, grown in got:
        slots.setdefault(shard, []).append(slot)
        assert law == "key" and 0 <= shard < 16 and grown in (shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r[:3] for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 1, brute.crc(t)) for i, t in pairs), key=repr)
    assert len({(r[0], r[4], r[6]) for r in got}) == len({i for i, _ in pairs})


def test_weights_move_keys_inside_changed_subtrees_only(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    heavier = {"region0": {"rack00": {0: 3.0, 1: 1.0}, "rack01": {2: 1.0}}, "region1": {"rack10": {3: 1.0, 4: 2.0}}}
    lighter = {"region0": {"rack00": {0: 1.0, 1: 1.0}, "rack01": {2: 1.0}}, "region1": {"rack10": {3: 1.0, 4: 2.0}}}
    rows = keys.select(sharding.descend(F.col("k"), heavier).alias("a"), sharding.descend(F.col("k"), lighter).alias("b")).collect()
    share = sum(r.a == 0 for r in rows) / len(rows)
    assert abs(share - 3 / 8) < 0.03
    assert not [r for r in rows if {r.a, r.b} <= {3, 4} and r.a != r.b]


# packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(messy, pairs, tokenizer):
    pieces = packing.pack(messy).collect()
    got = {}
    for p in pieces:
        assert p.length * 4 == len(p.ids)
        got.setdefault((p.sequence_id), []).append((p.offset, p.length))
    for parts in got.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
    full = [sum(n for _, n in parts) for _, parts in sorted(got.items())]
    assert set(full[:-1]) <= {packing.WINDOW} and full[-1] <= packing.WINDOW
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in pairs]
    assert sum(full) == sum(map(len, want))
    for i, t in pairs:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = [p for p in pieces if p.doc_id == i and p.doc_tokens == len(ids) and ids.tobytes()[4 * p.start :].startswith(bytes(p.ids))]
        assert sum(p.length for p in own) % len(ids) == 0 and own
    whole = packing.sequences(packing.pack(messy)).collect()
    assert {len(r.ids) for r in whole} == {4 * packing.WINDOW}


def round_robin(totals):
    """Queue of every token, one after the other: always the queue whose next token is due first."""
    served, order = [0] * len(totals), []
    heap = [(0.5 / t, q) for q, t in enumerate(totals)]
    heapq.heapify(heap)
    while heap:
        _, q = heapq.heappop(heap)
        order.append(q)
        served[q] += 1
        if served[q] < totals[q]:
            heapq.heappush(heap, ((served[q] + 0.5) / totals[q], q))
    return np.array(order)


@pytest.mark.parametrize(
    "totals", [[10_000, 5_000, 300], [1], [4096], [700, 100_000, 52_341, 52_341, 900], [60_000] + [40 + i % 7 for i in range(150)], [1] * 70, [5000, 1, 1]]
)
@pytest.mark.parametrize("window", [64, 2048])
def test_schedule_is_the_round_robin(totals, window):
    s = packing.Schedule(np.array(totals), window)
    order = round_robin(totals)
    w = np.arange(s.windows + 1)
    want = np.array([np.bincount(order[: k * window], minlength=len(totals)) for k in w])
    assert (s.served(w) == want).all() and (s.served(w[1:2]) == want[1:2]).all()
    due = np.minimum(float(window) * w, sum(totals))[:, None] * np.array(totals) / sum(totals)
    assert (np.abs(want - due) <= 0.5 + len(totals) / 2 * np.array(totals) / sum(totals) + 1e-9).all()


def test_no_source_waits_for_the_end(spark):
    """Many small sources beside a large one: each stands in its share of the windows, wherever it has tokens left."""
    rng = random.Random(3)
    rows = [(i, sentence(rng, 4), "big") for i in range(3000)] + [(5000 + i, sentence(rng, 5), f"s{i % 150}") for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = packing.pack(docs, window=64).join(docs.select("doc_id", "source"), "doc_id").collect()
    last = max(p.sequence_id for p in pieces)
    where = {}
    for p in pieces:
        where.setdefault(p.source, set()).add(p.sequence_id)
    assert len(where["big"]) == last + 1
    assert all(min(w) < last / 4 and max(w) > last * 3 / 4 for w in where.values())


def test_sources_beyond_the_queues_are_spread(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 60 if i % 3 == 0 else 3), "big" if i % 3 == 0 else f"s{i % 40}") for i in range(600)]
    rows += [(900 + i, sentence(rng, 3), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = packing.pack(docs, window=128, queues=5).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, spans, tokens = Counter(), {}, Counter()
    for p in pieces:
        sizes[p.sequence_id] += p.length
        tokens[p.doc_id] += p.length
        spans.setdefault(p.source, set()).add(p.sequence_id)
    assert set(sizes) == set(range(len(sizes))) and {n for k, n in sizes.items() if k < len(sizes) - 1} == {128}
    assert all(tokens[p.doc_id] == p.doc_tokens for p in pieces) and len(tokens) == len(rows)
    assert all(min(w) < len(sizes) / 4 and max(w) > len(sizes) * 3 / 4 for w in spans.values())


def test_encoder_equals_the_tokenizer(tokenizer):
    encoder = packing.Encoder(None)
    rng = random.Random(11)
    alphabet = ["a", "The", " ", "  ", "\n", "\t", "é", "ñandú", "'s", "12", "!", "\u00a0", "日本", "<|endoftext|>", "\r", "don't", "😀"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        assert encoder.ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], dtype="<u4").tobytes(), repr(text)


# language


def test_language(spark, messy, pairs):
    model = language.dictionaries(messy)
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(messy, model).collect()}
    assert {g[0] for g in got if g[1] == "und"} >= {3, 4, 5, 12}
    assert all(0 <= g[2] <= 1 for g in got)
    assert language.identify(messy, model).count() == len(pairs)
    assert {r.lang_pred for r in language.identify(messy, []).collect()} == {"und"}


def test_dictionaries_sample_distinct_texts_in_equal_shares(spark):
    rows = [("hot text " * 9000, "en")] * 50 + [(f"doc{i}x " + "some words " * 40, "en") for i in range(250)] + [("kurz", "de")] * 3
    (_, english, n), (_, german, m) = language.dictionaries(spark.createDataFrame(rows, "text string, lang string"))
    assert (n, m, german) == (300, 3, b"kurz")
    assert len(english) <= language.DICTIONARY_BYTES and sum(b"doc%dx " % i in english for i in range(250)) == 250
    assert 0 < english.count(b"hot text") <= 20


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language.held_out(F.col("doc_id"), 3, 1)
    found = language.identify(docs, language.dictionaries(docs.where(~out))).where(out).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


# personal data


@pytest.mark.parametrize("seed", range(6))
def test_base_spans(seed):
    rng = random.Random(seed)
    parts = ["a.b+c@x-y.org", "@", "@@", "u@v", "_", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112",
             "+1 (836) 555-9331", "+", "+12", " 491318719", "-", " ", "é", "x", "\n", "99999999999999999999", "00"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 7)))
        assert pii.listed(pii.base_spans(text)) == brute.pii(text), repr(text)


def test_pii_adds_spans_and_keeps_base(spark, sf, messy, pairs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    selector = pii.learn(docs)
    found = pii.find_pii(docs, selector).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in found:
        base = set(filter(None, brute.pii(r.text).split(",")))
        assert base == set(filter(None, r.base_spans.split(","))) and base <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(k) for b in base) for k in pii.KINDS)
    clean = [r for r in found if not re.search(r"[0-9@]", r.text or "")]
    assert clean and not any(r.spans for r in clean)
    text = "call +1 (836) 555-9331 491318719 now"
    base = pii.base_spans(text)
    assert base == [] and [text[a:b] for k, a, b in selector.added(text, base)] in (["+1 (836) 555-9331"], [])
    assert pii.find_pii(messy, selector).count() == len(pairs)
    assert pii.redact("mail a@b.org now", "email:5:12") == "mail [email] now"


def test_pii_learns_from_every_text(spark):
    """Mail addresses in texts of the larger hashes only, behind more texts than any sample held."""
    clean = spark.range(50_000).select(F.concat(F.lit("note "), F.conv(F.col("id"), 10, 26)).alias("text")).where(F.xxhash64("text") < 0)
    mails = spark.range(400).select(F.concat(F.lit("write to a"), "id", F.lit("@b.org now")).alias("text")).where(F.xxhash64("text") >= 0)
    assert clean.count() > 20_000 and mails.count() > 100
    selector = pii.learn(clean.unionByName(mails), trees=3)
    assert [t < float("inf") for t in selector.thresholds] == [True, False, False, False]


def test_pii_counts_a_text_once(spark):
    rows = [(f"host 10.1.{i % 200}.{i} and 300.1.{i % 200}.{i} or a{i}@b.org",) for i in range(120)]
    once = spark.createDataFrame(rows, "text string")
    often = spark.createDataFrame(rows + rows[:7] * 60, "text string").repartition(5)
    one, many = pii.learn(once, trees=3), pii.learn(often, trees=3)
    assert one.thresholds == many.thresholds and min(one.thresholds[:2]) < 1
    assert all(np.array_equal(getattr(one.trees, c), getattr(many.trees, c)) for c in ("feature", "cut", "value"))


def test_boosting_uses_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (3000, 3)).astype(float)
    y = ((x[:, 0] > 19) ^ (x[:, 1] > 9)).astype(int)
    rows = spark.createDataFrame([(a.tolist(), int(b), 2) for a, b in zip(x, y)], "x array<double>, label int, n long").repartition(4)
    cuts = boosting.quantile_cuts(rows, 3)
    for f, c in enumerate(cuts):
        twice = np.sort(np.repeat(x[:, f], 2))
        assert c.tolist() == sorted({twice[i * (len(twice) - 1) // boosting.CUTS] for i in range(boosting.CUTS)})
    table = stage(boosting.placed(rows, cuts), "placed")
    assert table.agg(F.sum("n")).first()[0] == 6000
    trees, binned = boosting.fit(table, cuts, 6)
    assert len(trees.value) == 6 and np.mean((trees.probability(x) > 0.5) == y) > 0.9
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    assert np.array_equal(trees.probability(x), binned.probability(bins))
    # The leaves of the first tree hold the sums of all rows.
    node = np.zeros(len(x), dtype=int)
    for _ in range(boosting.DEPTH):
        node = 2 * node + 1 + (x[np.arange(len(x)), trees.feature[0][node]] > trees.cut[0][node])
    p = np.full(len(x), 1 / (1 + np.exp(-trees.base)))
    for leaf, value in enumerate(trees.value[0]):
        at = node == leaf + 2**boosting.DEPTH - 1
        g, h = 2 * (p - y)[at].sum(), 2 * (p * (1 - p))[at].sum()
        assert value == pytest.approx(-boosting.RATE * g / (h + boosting.SHRINK), abs=1e-4)
    none, _ = boosting.fit(stage(table.where("label = 1"), "placed"), cuts)
    assert len(none.value) == 0 and none.probability(x[:1])[0] > 0.99


# toxicity


@pytest.fixture(scope="module")
def model(spark, sf):
    return toxicity.language_model(toxicity.letter_counts(spark.read.parquet(f"{sf}/documents.parquet")))


def test_restores_obfuscated_words(model):
    restore = toxicity.Restorer(model).restore
    assert restore("you id1ot, s c u m and $tup1d cl0wn") == "you idiot, scum and stupid clown"
    assert restore("idiooooot m0r0n!") == "idiot moron!"
    plain = "Plain words, 12.5 of them; a y ó la mail me.68@mail0.example.com 108.51.216.133"
    assert restore(plain) == plain
    assert restore(None) == "" and restore("") == ""
    assert len(restore("a1" * 5000)) > 1000


@pytest.mark.parametrize(
    "hidden, plain",
    [
        ("m 0 r 0 n", "moron"), ("m.0.r.0.n", "moron"), ("s t u p 1 d", "stupid"), ("5 t u p 1 d", "stupid"), ("$ c u m", "scum"),
        ("stop.m0r0n", "stop.moron"), ("stop.s.t.u.p.1.d now", "stop.stupid now"), ("no.5tupid", "no.stupid"),
        ("sstupid", "stupid"), ("idiiot", "idiot"), ("iDIiot", "idiot"), ("m00r0n", "moron"), ("m 0 0 r 0 n", "moron"), ("s t t u p 1 d", "stupid"),
    ],
)
def test_restores_mixed_forms(model, hidden, plain):
    assert toxicity.Restorer(model).restore(hidden) == plain


def test_long_tokens_have_no_border_inside():
    model = np.full((toxicity.LETTERS**3, toxicity.LETTERS), -3.0, dtype=np.float32)
    # A border costs more than a letter unless another one follows, as at the end of a token.
    model[:, 0], model[:: toxicity.LETTERS, 0] = -8.0, -0.1
    word = "abcdefgh" * 20
    assert toxicity.Restorer(model).restore(" ".join(word)) == word
    assert len(toxicity.Restorer(model).restore(" ".join(word * 200))) == len(word) * 200


def test_one_double_decodes_as_the_lattice_does(model):
    words = ["sstupid", "idiiot", "moronn", "aa", "worthless", "little", "schnell", "\u00e9\u00e9l", "see", "oothe"]
    for word in words:
        at = next(i for i in range(len(word)) if word[i] == word[i + 1])
        assert toxicity.decode_double(word, at, model) == toxicity.decode(word, model)


def test_numbers_and_addresses_stay(model):
    restore = toxicity.Restorer(model).restore
    for plain in ("3.5kg or 1.2b, 1 2 3 4", "me.68@mail0.si7e.com 108.51.216.133", "x://to.b2.com/a.y3 and x://to.b2.com"):
        assert restore(plain) == plain
    assert restore("1 " * 200_000) == "1 " * 200_000


def test_mixed_forms_score_as_toxic(spark, model):
    scorer = toxicity.Scorer({"moron": 8.0, "stupid": 8.0}, -4.0)
    texts = ["m 0 r 0 n", "m.0.r.0.n", "s t u p 1 d", "stop.m0r0n", "sstupid", "hello there"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in toxicity.drop_toxic(df, model, scorer).collect()} == {5}


def test_language_model_is_a_distribution(model):
    assert np.allclose(np.exp(model).sum(axis=1), 1, atol=1e-3)


def test_viterbi_is_the_best_path(model):
    def score(text):
        state, total = 0, 0.0
        for letter in text + "\0":
            n = toxicity.fold(letter)
            total += float(model[state, n])
            state = (state % toxicity.LETTERS**2) * toxicity.LETTERS + n
        return total

    for token in ("m0r0n", "1d10t", "l0s3r", "cl0o0wn", "s.c.u.m"):
        best = [(0.0, "")]
        for place in toxicity.lattice(token):
            best = [(c + cost, t + out) for c, t in best for out, cost in place]
        assert toxicity.decode(token, model) == max((c + score(t), t) for c, t in best)[1]


def test_toxicity_learns(spark, messy, pairs, model):
    rng = random.Random(9)
    bad = ["idiot", "moron", "scum"]
    rows = []
    for i in range(400):
        w = sentence(rng, 40).split()
        if i % 4 == 0:
            w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.learn(df, df.where("doc_id < 300"), model)
    got = toxicity.toxicity(df.where("doc_id >= 300"), model, scorer).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got) >= 98
    hidden = spark.createDataFrame([(1, "you m0r0n"), (2, "s c u m"), (3, "hello there"), (4, None), (5, "")], "doc_id long, text string")
    assert {r.doc_id for r in toxicity.toxicity(hidden, model, scorer).collect() if r.score >= 0.5} == {1, 2}
    assert {r.doc_id for r in toxicity.drop_toxic(hidden, model, scorer).collect()} == {3, 4, 5}
    assert toxicity.toxicity(messy, model, scorer).count() == len(pairs)
    none = toxicity.learn(df, df.where("toxic > 5"), model)
    assert 0 <= none.score("idiot") <= 1


# URLs

HARD = [
    None, "", "no scheme.org/x", "http://", "http://ORG", "http://org/", "https://Example.ORG/es/1", "http://a.example.org/en/1x?y",
    "http://example.org/en/", "http://notexample.org/es/", "x://com/fr/a#b", "x://a.com/de/", "x://a.com/de", "x://a.com?/de/", "x://a..org//",
    "://org/a", "x://y://org/", "x://host:80/org/", "http://x.org\n/a", "http://ÄRG.org/Ä",
]


@pytest.mark.parametrize("list_bytes", [urls.LIST_BYTES, 0])
def test_urls(spark, list_bytes):
    rows = [(i, u, "x") for i, u in enumerate(HARD)] + [(None, HARD[5], "x")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = listed(urls.judge_urls(pages, urls.rule_frame(spark, URL_RULES), list_bytes=list_bytes, shard_rows=3))
    assert got == sorted(((i, *brute.judge(u)) for i, u, _ in rows), key=repr)
    assert urls.judge_urls(pages.limit(0), urls.rule_frame(spark, URL_RULES), list_bytes=list_bytes).count() == 0


def test_equal_digests_are_told_apart():
    array = urls.DigestArray(np.frombuffer(urls.pack([(5, "org/", "allow"), (5, "com/", "block"), (-1, "net/", "block")]), np.uint8))
    digests = np.array([5, 5, 5, 2**64 - 1], dtype=np.uint64)
    assert array.find(digests, ["com/", "org/", "xyz/", "net/"]) == ["block", "allow", None, "block"]


def test_urls_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/b")], "page_id long, url string")
    assert listed(urls.judge_urls(pages, urls.rule_frame(spark, []))) == [(1, "a.org", "/b", None, "allow")]


# nothing in, nothing out


def test_empty_tables(spark, empty, model):
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    scorer = toxicity.learn(empty, labels, model)
    for df in (
        exact.exact_groups(empty), exact.drop_exact_copies(empty), near.near_groups(empty), near.drop_near_copies(empty),
        contamination.contamination(empty, benchmark), contamination.drop_contaminated(empty, benchmark), lines.dedup_lines(empty),
        sharding.shard(empty), packing.pack(empty), language.identify(empty, language.dictionaries(empty)),
        pii.find_pii(empty, pii.learn(empty)), toxicity.toxicity(empty, model, scorer), toxicity.drop_toxic(empty, model, scorer),
    ):
        assert df.count() == 0
    assert toxicity.language_model(toxicity.letter_counts(empty)).shape == (27**3, 27)


def test_texts_below_the_threshold_make_few_pairs(spark):
    """Many texts around one base: those that link with no hub are compared by what they share beyond it, not with all."""
    rng = random.Random(13)
    words = sentence(rng, 160).split()

    def edited(n):
        w = list(words)
        for at in rng.sample(range(len(w)), n):
            w[at] = f"edit{rng.randrange(10**9)}"
        return " ".join(w)

    rows = [(i, edited(rng.randint(0, 3) if i % 2 else rng.randint(4, 6))) for i in range(700)]
    # Two that link with each other through edits they share, though not with the hub.
    own = list(words)
    for at in range(3, 150, 12):
        own[at] = f"own{at}"
    rows += [(1000, " ".join(own)), (1001, " ".join(own[:-3] + ["x", "y", "z"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bodies = df.selectExpr("unhex(md5(text)) AS _node", "text AS _text").distinct()
    hub = df.where("doc_id = 1").selectExpr("unhex(md5(text)) AS _node").first()._node
    stars = bodies.where(F.col("_node") != F.lit(bytes(hub))).withColumn("_hub", F.lit(bytes(hub))).withColumn("_own", F.col("_node")).select("_hub", "_node", "_own")
    pairs = near.may_link(stars, bodies, 0.8, 5)
    bags = {bytes(r._node): brute.bag(r._text) for r in bodies.collect()}
    base, found = bags[bytes(hub)], {(bytes(r.a), bytes(r.b)) for r in pairs.collect()}

    def similar(x, y):
        return brute.similarity(x, y) >= 0.8 - 1e-12

    nodes = sorted(n for n in bags if n != bytes(hub))
    apart = {n for n in nodes if not similar(bags[n], base)}
    linked = {(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a in apart or b in apart) and similar(bags[a], bags[b])}
    assert len(apart) > 200 and len(linked) >= 1
    assert linked <= found and len(found) * 8 < len(nodes) * (len(nodes) - 1) / 2
