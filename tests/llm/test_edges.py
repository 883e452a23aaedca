"""Each operator and stage on nulls in any column, empty and very long texts, repeated rows, clashing names and no rows."""

import random

import corpus_pipeline
import pytest

from tributary.llm import ctw, decontam, license_scan, line_dedup, packing, quality, simhash, toxicity, url_filter, warc
from tributary.llm.common import cleanup, materialize

CLASH = "fp string, component string, host string, template string, score string, piece string, held_out string, listed string"


def long_text(words: int) -> str:
    rng = random.Random(1)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 5000)) + ("\n" if rng.random() < 0.05 else "") for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id at all here", "en", "s", 17), (3, long_text(200_000), "en", None, 1), (4, "x", "en", "s", 1), (4, "x", "en", "s", 1), (5, " \n\t\n ", "en", "s", 5), (6, "\x00​\U0001f600 ﬁ", "en", "s", 5), (None, None, None, None, None)]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
    return spark.createDataFrame([(*r, *["clash"] * 8) for r in rows], schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, None, 1), (None, 0, 1), (4, 1, None), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None, "x"), (None, "no id at all", "x"), (2, "", "x"), (3, "X", "x"), (3, "X", "x")], "item_id long, text string, doc_id string")


PER_DOCUMENT = {
    "line_dedup": lambda d, b, l: line_dedup.report(d), "ctw": lambda d, b, l: ctw.score_texts(d, depth=3), "toxicity": lambda d, b, l: toxicity.score(d, toxicity.fit(d, l)),
    "simhash": lambda d, b, l: simhash.near_duplicates(d), "quality": lambda d, b, l: quality.judge(d),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_a_document(docs, benchmark, labels, name):
    assert PER_DOCUMENT[name](docs, benchmark, labels).count() == 9
    assert PER_DOCUMENT[name](docs.limit(0), benchmark, labels).count() == 0


def test_packing_keeps_every_piece(docs):
    out = packing.pack(docs).collect()
    assert {r.doc_id for r in out} == {None, 1, 2, 3, 4, 5, 6} and sum(r.piece == 0 for r in out) == 9
    assert max(r.piece for r in out) > 100 and packing.pack(docs.limit(0)).count() == 0


def test_searches(docs, benchmark):
    found = {(r.doc_id, r.item_id) for r in decontam.contained_items(docs, benchmark).collect()}
    assert found == {(None, None), (4, 3)}
    assert license_scan.scan(docs).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (None, "http://a.net/es/", None), (2, "http://b.org", long_text(100_000)), (2, "http://b.org", long_text(100_000)), (3, "", "")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, path string, record string")
    assert url_filter.judge(pages).count() == 5 and warc.archived_history(pages).count() == 5
    assert url_filter.judge(pages.limit(0)).count() == 0 and warc.archived_history(pages.limit(0)).count() == 0


def test_stages(spark, docs, benchmark, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    now, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)), name)
        sizes.append(now.count())
    # the empty ones and the repeated row are one each; documents that contain an item go; the long one is many pieces
    assert sizes[:2] == [9, 9] and sizes[2] == 5 and sizes[3] == 3 and sizes[4] > 100


def test_cleanup(spark):
    kept = materialize(spark.range(3), "gone")
    assert kept.count() == 3
    cleanup(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()
