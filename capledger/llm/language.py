"""Language identification by compression: the dictionary that shortens a text most names its language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.llm.shingles import slices

# The sample that dictionaries are cut from: about so many distinct texts of each language, chosen by their hash,
# and so many bytes of them in equal shares.
SAMPLE_DOCUMENTS = 300
DICTIONARY_BYTES = 32 << 10
# Texts are compressed in blocks, so that a long text does not become its own dictionary.
BLOCK_BYTES = 1024
LEVEL, FINE_LEVEL = 6, 19
# A lead of fewer bytes, or of a smaller share of the best size, is rejected as narrow.
MIN_LEAD_BYTES, MIN_LEAD_SHARE = 3, 0.005
UNKNOWN = "und"


def _build(rows: pa.Table) -> pa.Table:
    """One language's raw-content dictionary: the start of every sample text, in order of their hash. All texts have
    the same share; what shorter ones leave of it goes to the others."""
    lang = rows.column("_lang")[0].as_py()
    texts = rows.sort_by([("_order", "ascending")]).column("_text").to_pylist()
    bodies = [t.lower().encode() for t in texts]
    room, share = DICTIONARY_BYTES - len(bodies) + 1, 0
    for i, size in enumerate(sorted(map(len, bodies))):
        share = max(room, 0) // (len(bodies) - i)
        if size > share:
            break
        room, share = room - size, size
    content = b"\n".join(x[:share] for x in bodies)[:DICTIONARY_BYTES]
    return pa.table({"_lang": [lang], "_content": pa.array([content], pa.binary())})


def dictionaries(train: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, bytes, int]]:
    """(language, dictionary, documents) of every language in ``train``, most frequent language first.

    Rows without a language or text teach nothing, and copies of a text count once in the sample. One row per
    language comes to the driver.
    """
    rows = train.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).where(
        "_lang IS NOT NULL AND _text IS NOT NULL"
    )
    rows = rows.withColumn("_order", F.xxhash64("_text"))
    sizes = rows.groupBy("_lang", "_order").agg(F.count("*").alias("n")).groupBy("_lang")
    counts = {r["_lang"]: (r["rows"], r["texts"]) for r in sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("texts")).collect()}
    if not counts:
        return []
    limit = F.create_map(
        *[F.lit(x) for k, (_, n) in counts.items() for x in (k, math.ceil(min(1.0, SAMPLE_DOCUMENTS / n) * (1 << 30)))]
    )
    # No text gives more than the dictionary holds.
    start = F.substring("_text", 1, DICTIONARY_BYTES)
    sample = (
        rows.where(F.pmod("_order", F.lit(1 << 30)) < limit[F.col("_lang")])
        .groupBy("_lang", "_order")
        .agg(F.min(start).alias("_text"))
    )
    built = sample.groupBy("_lang").applyInArrow(_build, "_lang string, _content binary").collect()
    found = [(r["_lang"], bytes(r["_content"]), counts[r["_lang"]][0]) for r in built]
    return sorted(found, key=lambda x: (-x[2], x[0]))


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(
        level, source_size=BLOCK_BYTES, dict_size=len(content), write_content_size=0, write_dict_id=0, write_checksum=0
    )
    if not content:
        return zstandard.ZstdCompressor(compression_params=settings)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=settings)


class Classifier:
    """Compressors of all languages, made once per worker."""

    def __init__(self, model: list[tuple[str, bytes, int]]):
        self.names = [m[0] for m in model]
        self.quick = [_compressor(m[1], LEVEL) for m in model]
        self.fine = [_compressor(m[1], FINE_LEVEL) for m in model]

    def classify(self, text: str | None) -> tuple[str, float, int | None, int | None, bool]:
        """(language, score, best size, lead, rejected)."""
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, None, None, True
        body = text.lower().encode("utf-8", "surrogatepass")
        blocks = [body[i : i + BLOCK_BYTES] for i in range(0, len(body), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.quick]
        best = min(sizes)
        tied = [i for i, s in enumerate(sizes) if s == best]
        if len(tied) > 1:
            tied.sort(key=lambda i: (sum(len(self.fine[i].compress(b)) for b in blocks), i))
        lead = min((s - best for i, s in enumerate(sizes) if i != tied[0]), default=best)
        score = 1 / sum(math.exp(-min(s - best, 500) / 2) for s in sizes)
        return self.names[tied[0]], score, best, lead, lead < max(MIN_LEAD_BYTES, MIN_LEAD_SHARE * best)


def _classify(model: list[tuple[str, bytes, int]]):
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model)
        for batch in slices(batches, "_text"):
            rows = [classifier.classify(t) for t in batch.column("_text").to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["_id", "lang_pred", "score", "size", "lead", "rejected"],
            )

    return classify


def identify(docs: DataFrame, model: list[tuple[str, bytes, int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: ``key, lang_pred, score, size, lead, rejected``.

    The whole text, lower-cased, is compressed in blocks with each language's dictionary; the smallest sum
    wins. A tie is decided at the finest level, then by the more frequent language. ``lead`` is the distance to
    the next size; a narrow one sets ``rejected``, beside the best guess. A NULL text or one without a letter,
    and every text if no language was learned, is ``und`` with score 0. Repeated rows get the same answer
    each; an empty table gives an empty result; other columns play no part.
    """
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    schema = f"_id {dict(rows.dtypes)['_id']}, lang_pred string, score double, size long, lead long, rejected boolean"
    return rows.mapInArrow(_classify(model), schema).withColumnRenamed("_id", key)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether CRC-32 of the id as text leaves ``fold`` by ``folds``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
