"""The pipeline against plain rules, stage by stage, on a small table with planted cases."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from tributary.llm import line_dedup, packing
from tributary.llm.common import tokenizer_path

from .test_decontam import plain as plain_contained
from .test_line_dedup import plain as plain_lines
from .test_simhash import plain_fingerprint


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(n // 12 + 1))
    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(20)]
    docs, toxic = [], {}
    for i in range(300):
        body = text(rng.choice([20, 150, 600]))
        toxic[i] = int(i % 5 == 0)
        if toxic[i]:
            body = body.replace(" ", f" {rng.choice(['qqvile', 'zzrude'])} ", 1)
        if i % 7 == 1:
            body += f"\nshare this page with {i} friends now"
        if i % 29 == 3:
            body += "\n" + items[i % 20][1]
        docs.append((i, body))
    docs += [(1000 + i, docs[2][1]) for i in range(4)] + [(2000, docs[4][1] + " tail"), (3000, None), (3001, ""), (3002, None)]
    path = tmp_path_factory.mktemp("sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(a, b, "en", "s", len(b or "")) for a, b in docs], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items


def expected(docs, items):
    rows = [(d, t) for d, t in docs if not {"qqvile", "zzrude"} & set((t or "").split())]
    crc = plain_lines(rows, line_dedup.LEAST_DOCUMENTS)
    dropped = {d: (n, c) for d, n, _, c in crc}
    cleaned = []
    for d, t in rows:
        lines = (t or "").split("\n")
        if dropped[d][0]:
            lines = [x for x in lines if not x.startswith("share this page")]
        out = "\n".join(lines)
        assert zlib.crc32(out.encode()) == dropped[d][1]
        cleaned.append((d, None if t is None else out))
    prints = [plain_fingerprint(t) for _, t in cleaned]
    group = list(range(len(cleaned)))
    for _ in range(3):
        for a in range(len(cleaned)):
            for b in range(len(cleaned)):
                if bin(prints[a] ^ prints[b]).count("1") <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    first = {}
    for g, (d, _) in zip(group, cleaned):
        first[g] = min(d, first.get(g, d))
    kept = [(d, t) for g, (d, t) in zip(group, cleaned) if first[g] == d]
    dirty = {d for d, *_ in plain_contained(kept, items)}
    return [(d, t) for d, t in kept if d not in dirty]


def test_run_against_plain_rules(spark, tables):
    path, docs, items = tables
    want = expected(docs, items)
    ids = {d for d, _ in want}
    assert 2 in ids and not ids & {1000, 1001, 1002, 1003, 3001, 3002} and 3000 in ids and len(ids) < 240
    tokenizer = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    pieces = []
    for d, t in want:
        own = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        pieces += [(d, n, zlib.crc32(np.array(own[a : a + 2048], "<u4").tobytes())) for n, a in enumerate(range(0, len(own), 2048))]
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in out) == sorted(pieces)


def test_stages_return_the_columns_of_documents(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").where("doc_id < 60")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables[0])
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables[0]).count() == 0
