"""Benchmark decontamination over a positional inverted index of the training tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.llm.common import small, words
from capledger.session import stage

WINDOW = 13


def windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct phrases to search: ``phrase, n, items``.

    Each item gives every run of ``window`` words; an item of fewer words, but not none, is one phrase.
    """
    items = benchmark.select(F.col(key).alias("item"), words(F.col(text)).alias("w"))
    last = F.greatest(F.size("w") - F.lit(window), F.lit(0))
    return (
        items.where(F.size("w") > 0)
        .select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select("item", F.slice("w", F.col("at") + 1, F.lit(window)).alias("w"))
        .groupBy(F.array_join("w", " ").alias("phrase"), F.size("w").alias("n"))
        .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )


def _terms(phrases: DataFrame) -> DataFrame:
    return phrases.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("off", "term"))


def _corpus(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents by (id, hash of the text), which tells rows that repeat an id apart."""
    return docs.select(F.col(key).alias("_doc"), F.xxhash64(F.col(text)).alias("_body"), words(F.col(text)).alias("_words"))


def rarest_terms(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two rarest places of each phrase by the length of the term's posting list:
    ``phrase, n, term1, off1, term2, off2`` (NULL second term: the phrase has one word).
    Phrases with a word that the corpus lacks are left out.
    """
    vocabulary = stage(_terms(phrases).select("term").distinct(), "test-terms")
    lengths = (
        _corpus(docs, key, text)
        .select(F.explode("_words").alias("term"))
        .join(small(vocabulary), "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    ranked = (
        _terms(phrases)
        .join(lengths, "term")
        .groupBy("phrase", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "term", "off"))).alias("by"))
        .where(F.size("by") == F.col("n"))
    )
    one, two = F.col("by")[0], F.get("by", F.lit(1))
    return ranked.select(
        "phrase",
        "n",
        one["term"].alias("term1"),
        one["off"].alias("off1"),
        two["term"].alias("term2"),
        two["off"].alias("off2"),
    )


def postings(docs: DataFrame, anchors: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: (term, document, position) of every training token that anchors a phrase."""
    wanted = stage(
        anchors.select(F.explode(F.array_compact(F.array("term1", "term2"))).alias("term")).distinct(), "anchor-terms"
    )
    places = _corpus(docs, key, text).select("_doc", "_body", F.posexplode("_words").alias("pos", "term"))
    return stage(places.join(small(wanted), "term", "left_semi"), "postings")


def intersect(index: DataFrame, anchors: DataFrame, slop: int = 0) -> DataFrame:
    """Documents and starts where the two rarest terms of a phrase stand at their offsets: ``phrase, n, _doc,
    _body, start``; with ``slop``, all starts from which both are at most so many words off their places."""
    exact = F.col("pos") - F.col("off1")
    first = index.join(small(anchors), F.col("term") == F.col("term1")).select(
        "phrase", "n", "_doc", "_body", "term2", "off2",
        (F.explode(F.sequence(exact - slop, exact + slop)) if slop else exact).alias("start"),
    )
    single = first.where(F.col("term2").isNull() & (F.col("start") >= 0))
    pairs = first.where(F.col("term2").isNotNull() & (F.col("start") >= F.lit(-slop)))
    second = index.select(
        F.col("term").alias("_t"), F.col("_doc").alias("_d"), F.col("_body").alias("_b"), F.col("pos").alias("_p")
    )
    same = (
        (F.col("term2") == F.col("_t"))
        & F.col("_doc").eqNullSafe(F.col("_d"))
        & (F.col("_body") == F.col("_b"))
    )
    place = F.col("start") + F.col("off2")
    same = same & ((F.col("_p") == place) if slop == 0 else (F.abs(F.col("_p") - place) <= slop))
    columns = ["phrase", "n", "_doc", "_body", "start"]
    return single.select(*columns).unionByName(pairs.join(second, same, "left_semi").select(*columns)).distinct()


def _covered(starts: Column) -> Column:
    """Number of words inside the union of (start, length) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        F.array_sort(starts),
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["n"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
        lambda acc: acc["n"].cast("long"),
    )


def phrase_matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> tuple[DataFrame, DataFrame]:
    """(documents, phrases): every input row with ``n_words`` and its exact matches, and the phrase table.

    Candidates come from the offset-adjusted lists of the two rarest terms; the words of the document decide.
    """
    phrases = stage(windows(benchmark, item, item_text, window), "phrases")
    anchors = stage(rarest_terms(docs, phrases, key, text), "anchors")
    found = intersect(postings(docs, anchors, key, text), anchors)
    candidates = stage(
        found.groupBy(F.col("_doc").alias("_d"), F.col("_body").alias("_b")).agg(
            F.collect_list(F.struct("start", "n", "phrase")).alias("_candidates")
        ),
        "candidates",
    )
    rows = _corpus(docs, key, text).join(
        small(candidates), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_body") == F.col("_b")), "left"
    )
    exact = F.filter(
        "_candidates", lambda c: F.array_join(F.slice("_words", c["start"] + 1, c["n"]), " ") == c["phrase"]
    )
    matched = rows.select(
        "_doc", "_body", F.size("_words").cast("long").alias("n_words"), F.coalesce(exact, F.array()).alias("matches")
    )
    return matched, phrases


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, slop: int, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """``key, item, phrase, start`` wherever every word of a phrase stands within ``slop`` words of its place behind ``start``;
    exact occurrences are among them. Candidates come from the lists of the two rarest terms; the words of the
    document decide."""
    phrases = stage(windows(benchmark, item, item_text, window), "phrases")
    anchors = stage(rarest_terms(docs, phrases, key, text), "anchors")
    near = stage(intersect(postings(docs, anchors, key, text), anchors, slop), "near-candidates")
    near = near.withColumnsRenamed({"_doc": "_d", "_body": "_b"})
    same = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_body") == F.col("_b"))
    rows = _corpus(docs, key, text).distinct().join(small(near), same)

    def stands(term: Column, at: Column) -> Column:
        first, end = F.greatest(F.col("start") + at - slop, F.lit(0)), F.col("start") + at + slop + 1
        return F.array_contains(F.slice("_words", first + 1, F.greatest(end - first, F.lit(0))), term)

    places = F.transform(F.split("phrase", " "), lambda term, at: stands(term, at))
    found = rows.where(F.forall(places, lambda x: x)).select("_doc", "phrase", "start").distinct()
    return found.join(phrases.select("phrase", F.explode("items").alias("item")), "phrase").select(
        F.col("_doc").alias(key), "item", "phrase", "start"
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Per input row: ``key, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word inside any occurrence of a phrase is hit; ``n_items`` counts the distinct ids of items with an
    occurring phrase, whose list (sorted as strings) is hashed. A document is contaminated when
    at least a twentieth of its words is hit. NULL and empty texts have no words and no hits; items without
    words are never found; NULL item ids are not counted, though their phrases hit. Rows that repeat id
    and text get the same result each. Empty tables give an empty result, or no hits. Other columns play
    no part.
    """
    matched, phrases = phrase_matches(docs, benchmark, key, text, item, item_text, window)
    matched = stage(matched.withColumn("n_hit", _covered(F.col("matches"))), "matches")
    items = (
        matched.where(F.size("matches") > 0)
        .select(F.col("_doc").alias("_d"), F.col("_body").alias("_b"), F.explode(F.array_distinct(F.transform("matches", lambda m: m["phrase"]))).alias("phrase"))
        .join(phrases, "phrase")
        .groupBy("_d", "_b")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    )
    none = F.array().cast("array<string>")
    return (
        matched.drop("matches")
        .join(items, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_body") == F.col("_b")), "left")
        .withColumn("_items", F.coalesce("_items", none))
        .select(
            F.col("_doc").alias(key),
            "n_words",
            "n_hit",
            F.size("_items").cast("long").alias("n_items"),
            F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
        )
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """The rows that are not contaminated, all columns."""
    matched, _ = phrase_matches(docs, benchmark, key, text, item, item_text, window)
    hit = _covered(F.col("matches"))
    spoiled = matched.where((hit > 0) & (hit * 20 >= F.col("n_words"))).select(
        F.col("_doc").alias("__spoiled"), F.col("_body").alias("__spoiled_body")
    )
    spoiled = stage(spoiled.distinct(), "contaminated")
    same = F.col(key).eqNullSafe(F.col("__spoiled")) & (F.xxhash64(F.col(text)) == F.col("__spoiled_body"))
    return docs.join(small(spoiled), same, "left_anti")
