"""Nulls in any column, empty and very long texts, repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import decontam, html_text, language, packing, pitman_yor, quality, sharding, simhash, token_counts, toxicity

TOKENS = public_tokenizers.path("word_bpe_49k.json")
LONG = "Some longer words of a very long text, and so on. " * 12_000
TEXTS = [(None, None), (None, "no id here"), (1, None), (2, ""), (3, " \t\n\r\x0b\x0c"), (4, LONG), (5, "x" * 100_000), (6, "Equal text of two rows"), (7, "Equal text of two rows"), (8, "a row that is there twice"), (8, "a row that is there twice"), (9, "99 !!! ###"), (10, "éÉ 日本語 \U0001f600")]
CLASHES = ["score", "predicted", "n_tokens", "n_bytes", "fp", "node", "root", "key", "tab", "print", "position", "cell", "shard", "slot", "size", "start", "length", "salt", "deal", "pack_group", "kept", "anomaly", "good", "row_id", "u", "v", "inside", "n", "at", "item", "h", "first", "stays"]


@pytest.fixture(scope="module")
def docs(spark):
    """The odd texts with columns that have the names of everything the operators use inside."""
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") < 7, "en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    return rows.withColumns({c: F.lit(None).cast("int") if i % 2 else F.lit("x") for i, c in enumerate(CLASHES)}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(None, 1, 1), (1, None, None), (2, 1, 0), (4, 1, 0), (4, 0, 1), (6, 0, 1), (7, 1, 0), (7, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(None, "null item with words of its own in it"), (1, None), (2, ""), (3, "one"), (4, "Equal text of two rows"), (4, "Equal text of two rows")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(1))


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r[0]].append(r)
    assert sum(map(len, out.values())) == len(TEXTS)
    return out


def test_token_counts(docs):
    out = by_id(token_counts.count_tokens(docs, TOKENS))
    assert [out[i][0].n_tokens for i in (1, 2, 3)] == [0, 0, 0] and out[4][0].over_limit and len(out[8]) == 2 and len(out[None]) == 2
    assert out[4][0].n_bytes == len(LONG)


def test_packing(docs):
    rows = packing.pack(docs, TOKENS).collect()
    assert sum(r.start == 0 for r in rows) == len(TEXTS)
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    seen = collections.Counter()
    for r in rows:
        seen[r.sequence_id] += r.length
    assert max(seen.values()) <= 4096
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_repeated_ids_are_dealt_over_groups(spark):
    docs = spark.createDataFrame([(1, "same words")] * 300, "doc_id long, text string")
    rows = packing.pack(docs, TOKENS, group_docs=10).collect()
    assert len(rows) == 300 and len({r.sequence_id >> 32 for r in rows}) > 10


def test_simhash(docs):
    out = by_id(simhash.near_duplicates(docs))
    zero = "0" * 16
    assert {out[i][0].fingerprint for i in (1, 2, 3)} == {zero} and {out[i][0].component_id for i in (1, 2, 3)} == {1}
    assert out[7][0].component_id == 6 and out[8][0].component_id == 8


def test_sharding(docs):
    out = by_id(sharding.shard(docs, 4))
    sizes = collections.Counter(r["shard"] for rows in out.values() for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert (out[1][0]["size"], out[1][0].text_crc32) == (8, 0) and out[4][0]["size"] == len(LONG) + 8


def test_quality(docs, labels):
    out = by_id(quality.judge(docs, labels))
    assert all(out[i][0].base_failed and not out[i][0].kept and out[i][0].n_words == 0 for i in (1, 2, 3))
    assert out[4][0].n_words == 11 * 12_000 and out[4][0].base_failed and out[5][0].word_chars == 100_000
    only = by_id(quality.judge(docs, labels.filter("false")))
    assert only[4][0].kept is False and only[6][0].n_words == 5


def test_language(docs):
    out = by_id(language.identify(docs, docs))
    assert all((out[i][0].lang_pred, out[i][0].score) == ("und", 0.0) for i in (1, 2, 3, 9))
    assert out[6][0].lang_pred == "en"
    none = by_id(language.identify(docs, docs.filter("false")))
    assert {r.lang_pred for rows in none.values() for r in rows} == {"und"}


def test_toxicity(docs, labels):
    model = toxicity.fit_toxicity(docs, labels)
    out = by_id(toxicity.score_toxicity(docs, model))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for rows in out.values() for r in rows)
    assert len({out[i][0].score for i in (1, 2, 3)}) == 1
    nothing = toxicity.fit_toxicity(docs, labels.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.score_toxicity(docs, nothing).collect()} == {0}


def test_pages(spark):
    rows = [(None, None, None), (1, None, ""), (2, "u", "<p>" + LONG), (3, "u", "<article><p>one</p></article>"), (3, "u", "<article><p>one</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    out = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    assert out[None].text == out[1].text == "" and out[1].n_chars == 0 and out[3].text == "one"
    assert out[2].n_chars == len(LONG.strip())


def test_decontamination(docs, benchmark):
    rows = decontam.contaminated(docs, benchmark, chance=0.9).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(6, 4), (7, 4)} and len(rows) == 4
    kept = decontam.without_contaminated(docs, benchmark, chance=0.9)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 2
    assert decontam.contaminated(docs, benchmark.filter("false")).count() == 0
    assert decontam.without_contaminated(docs, benchmark.filter("false")).count() == len(TEXTS)


def test_language_model(docs):
    out = by_id(pitman_yor.score_texts(docs, docs.filter("doc_id < 6")))
    assert {(r[0].n_tokens, r[0].n_known) for r in (out[1], out[2], out[3])} == {(1, 1)} and out[4][0].n_tokens == 11 * 12_000 + 1
    assert all(r.score <= 0 for rows in out.values() for r in rows)
    new = by_id(pitman_yor.score_texts(docs, docs.filter("false")))
    assert new[6][0].train_tokens == 0 and new[6][0].n_known == 0 and new[6][0].score == 0.0


def test_empty_tables(docs, labels, benchmark):
    none = docs.filter("false")
    assert token_counts.count_tokens(none, TOKENS).count() == 0
    assert packing.pack(none, TOKENS).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert quality.judge(none, labels).count() == 0
    assert language.identify(none, docs).count() == 0
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)).count() == 0
    assert decontam.contaminated(none, benchmark).count() == 0
    assert pitman_yor.score_texts(none, docs).count() == 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert html_text.extract_text(pages.filter("false")).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages(spark, docs, labels, benchmark, tmp_path, name, rows):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    given = docs if rows == "odd" else docs.filter("false")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, given, str(tmp_path))
    n = out.count()
    if name != "packing":
        assert out.columns == docs.columns and n <= given.count()
    if rows == "none":
        assert n == 0


def test_run_is_its_stages(spark, docs, labels, benchmark, tmp_path):
    clean = " ".join(f"Clean{i % 97} words{i % 89} that{i % 83} stay" for i in range(60))
    more = spark.createDataFrame([(50, clean), (51, clean + " indeed"), (52, clean)], "doc_id long, text string")
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {50}
