"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed by binary search."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.session import scratch_path, stage

# A rule list of at most this many bytes of strings is shipped whole to every executor.
LIST_BYTES = 64 << 20
# Beyond it, list and candidates are cut into digest ranges of about this many rules or distinct candidates, whichever
# are more.
SHARD_ROWS = 1 << 20


def rule_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule string) pairs as a rule list."""
    return spark.createDataFrame(rules, "verdict string, rule string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for NULL or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _digested(rules: DataFrame) -> DataFrame:
    """Distinct rules with digest and shape (labels of the host, length of the path).

    A rule that is listed with both verdicts blocks. Rules without a host or with a NULL are left out.
    """
    host = F.substring_index("rule", "/", 1)
    return (
        rules.where("rule IS NOT NULL AND verdict IS NOT NULL")
        .withColumn("rule", F.concat(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)")))
        .groupBy("rule")
        .agg(F.max("verdict").alias("verdict"))
        .where("substring_index(rule, '/', 1) <> ''")
        .select(
            "rule",
            "verdict",
            F.xxhash64("rule").alias("digest"),
            F.size(F.split(F.substring_index("rule", "/", 1), r"\.")).alias("labels"),
            (F.length("rule") - F.length(F.substring_index("rule", "/", 1))).alias("path_length"),
        )
    )


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Strings that a rule fitting (host, path) can have: one per shape of the list, longest first."""
    keys = []
    labels = F.size(F.split(host, r"\."))
    for n, length in shapes:
        fits = (host != "") & (labels >= n) & (F.length(path) >= length)
        domain = F.substring_index(host, ".", -n)
        found = F.concat(domain, F.substring(path, 1, length))
        keys.append(F.when(fits, F.struct(F.length(found).alias("n"), F.length(domain).alias("d"), found.alias("key"))))
    if not keys:
        return F.array().cast("array<string>")
    return F.transform(F.sort_array(F.array_compact(F.array(*keys)), asc=False), lambda k: k["key"])


def pack(rules: list[tuple[int, str, str]]) -> bytes:
    """Sorted digest array with the strings behind it: count, digests, ends, ``verdict`` + tab + ``rule``."""
    rules = sorted((d & (2**64 - 1), r, v) for d, r, v in rules)
    texts = [f"{v}\t{r}".encode() for _, r, v in rules]
    digests = np.array([d for d, _, _ in rules], dtype=np.uint64)
    ends = np.cumsum([0, *map(len, texts)], dtype=np.uint64)
    return b"".join([np.uint64(len(rules)).tobytes(), digests.tobytes(), ends.tobytes(), *texts])


def ship(spark: SparkSession, content: bytes) -> str:
    """Write a file into the shared folder and have Spark place a copy beside every executor; its name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "digests"))
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return path.getName()


class DigestArray:
    """A packed array, as a rule memory-mapped, so that the workers of a machine share its pages."""

    def __init__(self, raw: np.ndarray):
        n = int(raw[:8].view(np.uint64)[0])
        self.digests = raw[8 : 8 + 8 * n].view(np.uint64)
        self.ends = raw[8 + 8 * n : 16 + 16 * n].view(np.uint64)
        self.text = raw[16 + 16 * n :]

    def entry(self, i: int) -> tuple[str, str]:
        verdict, _, rule = bytes(self.text[int(self.ends[i]) : int(self.ends[i + 1])]).decode().partition("\t")
        return verdict, rule

    def find(self, digests: np.ndarray, strings: list[str]) -> list[str | None]:
        """Verdict of each string, None where it is not stored. Equal digests are told apart by the string."""
        found: list[str | None] = [None] * len(strings)
        first = np.searchsorted(self.digests, digests, "left")
        last = np.searchsorted(self.digests, digests, "right")
        for k in np.flatnonzero(last > first):
            for i in range(first[k], last[k]):
                verdict, rule = self.entry(i)
                if rule == strings[k]:
                    found[k] = verdict
        return found


def _probe_mapped(name: str):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(np.memmap(SparkFiles.get(name), dtype=np.uint8, mode="r"))
        for batch in batches:
            lists, digests = batch.column("_keys"), batch.column("_digests")
            offsets = lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            strings = lists.flatten().to_pylist()
            verdicts = array.find(digests.flatten().to_numpy(zero_copy_only=False).view(np.uint64), strings)
            rule, verdict = [], []
            for a, b in zip(offsets, offsets[1:]):
                k = next((k for k in range(a, b) if verdicts[k] is not None), None)  # longest first
                rule.append(None if k is None else strings[k])
                verdict.append(None if k is None else verdicts[k])
            kept = [batch.column(c) for c in batch.schema.names if c not in ("_keys", "_digests")]
            names = [c for c in batch.schema.names if c not in ("_keys", "_digests")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*names, "_rule", "_verdict"]
            )

    return probe


def _probe_shard(key: tuple, rules: pa.Table, keys: pa.Table) -> pa.Table:
    """Look the distinct candidates of one digest range up in its part of the list."""
    columns = [rules.column(c).to_pylist() for c in ("digest", "rule", "verdict")]
    array = DigestArray(np.frombuffer(pack(list(zip(*columns))), dtype=np.uint8))
    strings = keys.column("_key").to_pylist()
    found = array.find(keys.column("_digest").to_numpy().view(np.uint64), strings)
    hit = [i for i, v in enumerate(found) if v is not None]
    return pa.table({"_key": pa.array([strings[i] for i in hit], pa.string()), "_found": pa.array([found[i] for i in hit], pa.string())})


def judge_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", list_bytes: int = LIST_BYTES,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Per input row: ``key, host, path, rule, verdict``.

    The longest rule that fits the host or one of its parent domains, and starts the path, decides; without
    one the verdict is ``default`` and the rule NULL. A list of up to ``list_bytes`` is one memory-mapped array on
    every executor. A longer list is cut into digest ranges, each of which meets the distinct
    candidates of its range once, so that a host with a third of all rows counts once there. A URL that
    is NULL, empty or without ``://`` has neither host nor path and gets the default. Repeated rows get the
    same answer each; an empty table gives an empty result, an empty list the default; other columns
    play no part.
    """
    spark = pages.sparkSession
    listed = stage(_digested(rules), "rules")
    size = listed.agg(
        F.coalesce(F.sum(F.length("rule") + 32), F.lit(0)), F.count("*"), F.collect_set(F.struct("labels", "path_length"))
    ).first()
    shapes = sorted((s["labels"], s["path_length"]) for s in size[2])
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_keys", candidates(F.col("host"), F.col("path"), shapes))
    if size[0] <= list_bytes:
        name = ship(spark, pack([tuple(r) for r in listed.select("digest", "rule", "verdict").collect()]))
        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name != "_keys"}
        schema = ", ".join(f"`{n}` {t}" for n, t in types.items()) + ", _rule string, _verdict string"
        judged = rows.withColumn("_digests", F.transform("_keys", lambda k: F.xxhash64(k))).mapInArrow(
            _probe_mapped(name), schema
        )
    else:
        distinct = stage(rows.select(F.explode("_keys").alias("_key")).distinct().withColumn("_digest", F.xxhash64("_key")), "candidates")
        shards = -(-max(size[1], distinct.count()) // shard_rows)
        hits = (
            listed.groupBy(F.pmod("digest", F.lit(shards)).alias("_range"))
            .cogroup(distinct.groupBy(F.pmod("_digest", F.lit(shards)).alias("_range")))
            .applyInArrow(_probe_shard, "_key string, _found string")
        )
        judged = _longest(rows, hits)
    return judged.select(
        F.col("_id").alias(key),
        "host",
        "path",
        F.col("_rule").alias("rule"),
        F.coalesce("_verdict", F.lit(default)).alias("verdict"),
    )


def _longest(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Attach the longest hit to each (host, path); distinct pairs are judged once."""
    pairs = rows.select("host", "path", "_keys").distinct()
    best = (
        pairs.select("host", "path", F.explode("_keys").alias("_key"))
        .join(hits, "_key")
        .groupBy(F.col("host").alias("_h"), F.col("path").alias("_p"))
        .agg(F.max_by(F.struct("_key", "_found"), F.struct(F.length("_key"), F.length(F.substring_index("_key", "/", 1)))).alias("_best"))
    )
    joined = rows.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return joined.select("_id", "host", "path", F.col("_best._key").alias("_rule"), F.col("_best._found").alias("_verdict"))
