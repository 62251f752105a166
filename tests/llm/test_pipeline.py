"""The corpus pipeline stage by stage against brute force, on planted, messy and no rows; operators on bare workers."""

import os
import random
import subprocess
import sys
import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from messy_docs import sentence

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """(folder of tables, ids of toxic documents, ids of clean ones)."""
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(i, sentence(rng, 30)) for i in range(6)]
    texts, toxic = [], set()
    for i in range(360):
        words = sentence(rng, 60).split()
        if i % 4 == 0:
            toxic.add(i)
            for _ in range(2):
                words[rng.randrange(60)] = rng.choice(["idiot", "moron", "scum"] if i % 8 else ["m0r0n", "id1ot", "s c u m"])
        texts.append(" ".join(words))
    clean = [i for i in range(360) if i not in toxic]
    for i in clean[10:20]:
        texts.append(texts[i].upper())  # equal after lower-casing
    for i in clean[20:30]:
        texts.append(texts[i] + " one more")  # near copies
    for i, (_, item) in enumerate(items):
        texts.append(sentence(rng, 40) + " " + item)  # contaminated
    texts += [None, "", "a", sentence(rng, 9000)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(360)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, toxic, items


def written(spark, df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def check_exact(before, after):
    best = {}
    for i, t in before:
        best[brute.lower(t or "")] = max(best.get(brute.lower(t or ""), i), i)
    assert sorted(i for i, _ in after) == sorted(best.values())


def check_pieces(pieces, before):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: model.encode(t or "", add_special_tokens=False).ids + [1] for i, t in before}
    parts = {}
    for p in pieces:
        ids = np.array(want[p.doc_id][p.start : p.start + p.length], dtype="<u4").tobytes()
        assert zlib.crc32(ids) == p.ids_crc32
        parts.setdefault(p.doc_id, []).append((p.start, p.length))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(parts[i]):
            assert start == at
            at += length
        assert at == len(ids)


def test_each_stage_on_planted_documents(spark, planted, tmp_path):
    folder, toxic, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, pairs_of(docs)
    docs = written(spark, STAGES["toxicity"](spark, docs, folder), tmp_path, "toxicity")
    after = pairs_of(docs)
    gone = {i for i, _ in before} - {i for i, _ in after}
    assert docs.columns == columns and gone <= toxic and len(gone) >= 0.95 * len(toxic)

    before = after
    docs = written(spark, STAGES["exact_dedup"](spark, docs, folder), tmp_path, "exact")
    after = pairs_of(docs)
    assert docs.columns == columns and len(after) < len(before)
    check_exact(before, after)

    before = after
    docs = written(spark, STAGES["near_dedup"](spark, docs, folder), tmp_path, "near")
    after = pairs_of(docs)
    assert docs.columns == columns and len(after) < len(before)
    assert sorted(i for i, _ in after) == sorted({name for _, name, _ in brute.near(before)})

    before = after
    docs = written(spark, STAGES["decontamination"](spark, docs, folder), tmp_path, "decontamination")
    after = pairs_of(docs)
    assert docs.columns == columns and len(after) <= len(before) - len(items)
    assert sorted(i for i, _ in after) == sorted(i for i, *_, bad in brute.contamination(before, items) if not bad)

    check_pieces(STAGES["packing"](spark, docs, folder).collect(), after)


def test_run_writes_what_the_stages_give(spark, planted):
    folder, toxic, _ = planted
    pieces = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert 250 < len(ids) < 375 and len(ids & toxic) <= 0.05 * len(toxic) + 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_on_messy_rows(spark, messy, planted, tmp_path):
    """NULLs in every column, repeated rows, ties and columns of clashing names come through with their columns."""
    folder, _, _ = planted
    docs = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = written(spark, stage(spark, docs, folder), tmp_path, f"messy-{name}")
        assert docs.columns == messy.columns and 0 < docs.count() <= before
    texts = [r.text for r in docs.select("text").collect()]
    assert len({brute.lower(t or "") for t in texts}) == len(texts)
    pieces = STAGES["packing"](spark, docs, folder)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_on_no_rows(spark, empty, planted):
    folder, _, _ = planted
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


BARE = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from capledger.session import configure
spark = (configure(SparkSession.builder.master("local[4]")).config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp")).getOrCreate())
from capledger.llm.queries import QUERIES
from capledger.plans.catalogue import QUERIES as OTHERS
for name in ("op1_url_filter", "op2_toxicity", "op4_near_dedup", "op6_pii", "op8_language_id", "op9_packing", "op11_whitening", "op12_divergence", "op13_token_counts"):
    assert QUERIES[name](spark, {sf!r}).count() > 0, name
for name in ("sql_version_hunks", "schema_drift", "table_listing"):
    assert OTHERS[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Started in another folder, the workers cannot import the package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "bare.py"
    script.write_text(BARE.format(root=ROOT, sf="/root/testdata/sf0.001"))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
