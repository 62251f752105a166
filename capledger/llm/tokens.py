"""Token counts from a digest cache: contents that the cache lacks are encoded once and appended to it."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.llm.common import broadcast_if_small
from capledger.llm.shingles import slices
from capledger.session import scratch_path, stage

LIMIT = 1024
# Bytes of text that one call of the tokenizer takes (at least one text).
BATCH = 1 << 18
# Digests that a worker remembers, so that rows that repeat id and text are encoded once in a task.
MEMORY = 1 << 18
# Pieces of texts whose counts a worker remembers.
PIECES = 600_000
COUNTS = "_digest binary, n_tokens long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, its library and that library's version: other counts, other digest."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{library} {__import__(library).__version__} {content}".encode()).hexdigest()


def normalised(text: Column) -> Column:
    """What is digested and counted. NULL is the empty text; nothing else leaves every tokenizer's count as it is."""
    return F.coalesce(text, F.lit(""))


def digest(text: Column) -> Column:
    """SHA-256 of a normalised content: contents of equal digest are taken as equal."""
    return F.unhex(F.sha2(text, 256))


class PieceCounts(dict):
    """Token counts of texts by a byte-level tokenizer, which cuts before blanks: the counts of pieces after a blank are
    remembered. Texts in which a cut would tear white space apart, or with an added token, are encoded whole."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([r"\s (?:\s|\Z)", *added]))

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def __missing__(self, piece: str) -> int:
        if len(self) >= PIECES:
            self.clear()
        n = self.encoded(" " + piece)
        if len(piece) < 40:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if self.whole.search(text):
            return self.encoded(text)
        first, *rest = text.split(" ")
        return self.encoded(first) + sum(map(self.__getitem__, rest))


def cuts_before_blanks(tokenizer) -> bool:
    """Whether a text's tokens are those of its pieces, cut before blanks: byte-level, by the usual pattern, nothing
    normalised and no blank put before a text."""
    made = json.loads(tokenizer.to_str())
    cut = made["pre_tokenizer"] or {}
    return cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not made["normalizer"]


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts as the tokenizer's library gives them, without added tokens, truncation or padding."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if cuts_before_blanks(tokenizer):
        pieces = PieceCounts(tokenizer)
        return lambda texts: list(map(pieces.count, texts))
    return lambda texts: [len(found) for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(path), set()
        for batch in slices(batches, "_text", BATCH):
            if len(seen) > MEMORY:
                seen.clear()
            new = {}
            for at, found in enumerate(batch.column("_digest").to_pylist()):
                if found not in seen:
                    new.setdefault(found, at)
            seen.update(new)
            texts = batch.column("_text").take(pa.array(list(new.values()), pa.int64())).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(new), pa.binary()), pa.array(count(texts), pa.int64())], names=["_digest", "n_tokens"]
            )

    return encode


class TokenCache:
    """Counts by (tokenizer version, content digest) in a shared folder.

    Each append is a folder of its own below the version's, so writers at the same time do not disturb one
    another; a digest that two of them add has the same count twice, and reading folds it.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.folder = spark, f"{folder}/{version}"

    def counts(self) -> DataFrame:
        """``_digest, n_tokens``: one row per known content."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path) or not files.listStatus(path):
            return self.spark.createDataFrame([], COUNTS)
        rows = self.spark.read.schema(COUNTS).parquet(f"{self.folder}/*")
        return rows.groupBy("_digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame) -> None:
        name = scratch_path(self.spark, "counts").rsplit("/", 1)[1]
        counts.write.parquet(f"{self.folder}/{name}")


def count_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, cache: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """One row per input row: ``key, n_bytes, n_tokens, over_limit``; ``n_bytes`` of the text in UTF-8.

    Every row is digested in place; the distinct digests that ``cache`` (a shared folder; a new one if not
    given) lacks for this tokenizer version are looked up again by one row each, the one with the least id, and only those
    texts reach the tokenizer. Counts are appended to the cache and then joined to the rows. A NULL text
    counts as empty; NULL ids are kept; repeated rows get the same count each. Very long texts are encoded whole.
    An empty table gives an empty result; other columns play no part.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    store = TokenCache(spark, cache or scratch_path(spark, "token-cache"), tokenizer_version(path))
    body = normalised(F.col(text))
    rows = docs.select(F.col(key).alias("_id"), body.alias("_text"))
    narrow = stage(rows.select("_id", digest(F.col("_text")).alias("_digest"), F.octet_length("_text").cast("long").alias("n_bytes")), "digests")
    contents = stage(narrow.groupBy("_digest").agg(F.min("_id").alias("_least")), "contents")
    missing = stage(contents.join(store.counts(), "_digest", "left_anti"), "misses").toDF("_missing", "_least")
    # A content whose ids are all NULL has a NULL least id.
    chosen = (digest(F.col("_text")) == F.col("_missing")) & F.col("_id").eqNullSafe(F.col("_least"))
    texts = rows.join(broadcast_if_small(missing), chosen).select(F.col("_missing").alias("_digest"), "_text")
    store.append(texts.mapInArrow(_encode(path), COUNTS))
    known = stage(store.counts().join(contents, "_digest", "left_semi"), "known-counts")
    counted = narrow.join(broadcast_if_small(known), "_digest")
    return counted.select(F.col("_id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
