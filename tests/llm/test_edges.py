"""Repeated rows and doc_ids, nulls, empty tables, very long texts and columns with the operators' own names, for each operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentwire.llm import arrow_tokens, best_fit, html_blocks, language, license_digest, near_duplicates, private_data, trie_counts, wu_manber

pipeline = pytest.importorskip("corpus_pipeline")

A = "The council decided on Monday to build a new bridge over the river for the people of the town, call +1 (499) 555-6503 or write to jane.doe@example.com about it"
B = "Un autre texte qui parle de la ville et des gens qui y habitent depuis longtemps avec leurs enfants"
LONG = " ".join(f"w{k % 5000} x{k % 7}" for k in range(60_000))
ROWS = [(1, A), (1, A), (1, B), (None, B + " encore"), (None, None), (2, ""), (3, None), (4, LONG), (5, A), (6, " \n\t "), (7, LONG + " end")]
OWN = "node n text_hash registers hits items n_words n_hit lang_pred score rejected n_tokens n_pretokens key root length piece share known base spans seeds licenses private_doc kept_doc".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en" if k % 3 else "fr", "s", len(t or "")) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in OWN})


def test_near_duplicates(docs):
    got = near_duplicates.groups(docs).collect()
    assert len(got) == len(ROWS)
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id in (1, 5) and r.n_shingles == near_duplicates.shingle_sets(__import__("pyarrow").array([A]), 5)[0].size) == [(1, False), (1, True), (1, True)]
    assert {r.component_id for r in got if r.doc_id in (4, 7)} == {4} and [r.kept for r in got if r.doc_id == 7] == [False]
    assert all(r.kept and r.n_shingles == 0 for r in got if r.doc_id in (2, 3, 6))
    assert near_duplicates.groups(docs.limit(0)).count() == 0


def test_private_data(docs):
    got = private_data.extract(docs).collect()
    assert len(got) == len(ROWS) and sorted(len(r.base) for r in got if r.doc_id in (1, 5)) == [0, 2, 2, 2] and all(not r.base for r in got if r.doc_id not in (1, 5))
    masked = private_data.mask(docs)
    assert masked.columns == docs.columns and masked.count() == len(ROWS)
    assert all("[EMAIL]" in r.text and r.n_chars == len(r.text) for r in masked.filter("doc_id = 5").collect())
    assert private_data.extract(docs.limit(0)).count() == private_data.mask(docs.limit(0)).count() == 0


def test_language(docs):
    model = language.fit(docs)
    got = language.identify(docs, model)
    assert sorted(got.columns) == sorted(set(docs.columns)) and got.count() == len(ROWS)
    assert all((r.lang_pred == "und") == (not (r.text or "").strip()) for r in got.select("lang_pred", "text").collect())
    assert language.identify(docs.limit(0), model).count() == 0


def test_licenses(docs):
    got = license_digest.scan(docs).collect()
    assert len(got) == len(ROWS) and all(r.whole_license is None and r.n_notices == 0 for r in got)
    assert license_digest.scan(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(9, LONG[2000:2200], 1), (9, LONG[2000:2200], 1), (None, A, 1), (10, None, 1), (11, "", 1)], "item_id long, text string, items int")
    got = wu_manber.search_benchmark(docs, bench)
    assert sorted(got.columns) == sorted({*docs.columns, "hits", "items", "n_words", "n_hit"}) and got.count() == len(ROWS)
    hit = {r.doc_id: r for r in got.filter("n_hit > 0").collect()}
    assert set(hit) == {1, 4, 5, 7} and list(hit[4]["items"]) == ["9"] and hit[4].n_words == 120_000
    assert wu_manber.search_benchmark(docs, bench.limit(0)).filter("n_hit = 0 and size(items) = 0").count() == len(ROWS)
    assert wu_manber.search_benchmark(docs.limit(0), bench).count() == 0


def test_tokens(docs):
    stored = arrow_tokens.store_and_read(docs, length=256).collect()
    assert len(stored) == len(ROWS) and sum(r.n_tokens for r in stored if r.doc_id in (2, 3, 6)) == 3
    first = {r.doc_id: r.start for r in stored}
    assert first[2] < first[3] < first[4] < first[5] < first[6] < first[7] and min(r.start for r in stored if r.doc_id is None) == 0
    packed = best_fit.pack(docs).toPandas()
    assert packed[packed.doc_id == 5].length.sum() * 3 <= packed[packed.doc_id.isin([1, 5])].length.sum() and packed.doc_id.isna().sum() == 2
    q = packed.sort_values(["sequence_id", "offset"])
    assert (q.offset == q.groupby("sequence_id").length.cumsum() - q.length).all() and q.groupby("sequence_id").length.sum().max() <= 2048
    counted = trie_counts.count_tokens(docs)
    assert sorted(counted.columns) == sorted(set(docs.columns)) and counted.count() == len(ROWS)
    assert len({r.n_tokens for r in counted.collect() if r.text == A}) == 1 and {r.n_pretokens for r in counted.filter("doc_id in (2, 3, 6)").collect()} == {0}
    assert trie_counts.count_tokens(docs.limit(0)).count() == 0


def test_main_text(spark):
    page = "<html><body><nav><ul><li><a href='/'>Menu</a></li></ul></nav><article><h1>Head</h1>" + f"<p>{A}.</p>" * 3000 + "</article></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (2, "u", "")], "page_id long, url string, html string")
    got = html_blocks.extract(rows.withColumn("text", F.lit("old")), between="\n\n").collect()
    assert len(got) == 4 and got[0].text == got[1].text and sorted({r.text for r in got})[0] == "" and np.ptp([r.text.count(A) for r in got if r.page_id == 1]) == 0
    assert html_blocks.extract(rows.limit(0)).count() == 0


def test_stages(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    plain.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    for at in ("none", "some"):
        spark.createDataFrame([(9, "something that no document holds but for this one and then some more of it")], "item_id long, text string").write.parquet(str(tmp_path / at / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
    current = docs.withColumn("kept_hash", F.lit(8))
    for name, stage in pipeline.STAGES[:-1]:
        before = current
        current = pipeline.cut(stage(spark, before, str(tmp_path / "some")))
        assert current.columns == before.columns and {(r.score, r.hits, r.kept_doc, r.kept_hash, r.private_doc) for r in current.collect()} == {(7, 7, 7, 8, 7)}, name
        if name == "near_duplicates":
            assert sorted((r.doc_id, r.text[:3]) for r in current.collect()) == [(1, "The"), (1, "Un "), (4, "w0 ")]
    assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, current, "").collect()} == {1, 4}


def test_languages_whose_texts_repeat_are_learnt(spark):
    """20,000 rows that repeat one Polish text don't dilute the sample, and the language of few texts isn't lost."""
    from rentwire.llm import language

    rows = [(f"the house of number {k} stands on the hill and the river runs by it", "en") for k in range(1000)]
    rows += [("dom stoi na wzgórzu, a rzeka płynie obok i szumi przez cały dzień", "pl")] * 20_000
    for sample in (3, 800):
        model = language.fit(spark.createDataFrame(rows, "text string, lang string"), sample=sample)
        assert set(model.langs) == {"en", "pl"}
    got = language.identify(spark.createDataFrame([("rzeka płynie przez wzgórze i dzień",), ("the river runs on the hill",)], "text string"), model).collect()
    assert [r.lang_pred for r in got] == ["pl", "en"]


def test_vectors_of_clashing_columns_and_odd_lengths(spark):
    """``asks`` may be of any column, columns may be called as the operator's own, and vectors may be empty or long."""
    from rentwire.llm import pivot_search

    rows = [(k, [float(k % 5), 1.0], "q" if k == 3 else "c", k, 0) for k in range(20)] + [(50, [], "c", 0, 0), (51, [0.5] * 3000, "q", 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, row int, query int")
    got = [tuple(r) for r in pivot_search.top_k(df, F.col("label") == "q", k=2).orderBy("query_id", "rank").collect()]
    dot = lambda a, b: sum(int(x * 1024 // 1) * int(y * 1024 // 1) for x, y in zip(a, b))
    want = []
    for q, v, label, *_ in rows:
        if label == "q":
            best = sorted((-dot(v, w), k) for k, w, *_ in rows if k != q)[:2]
            want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert got == sorted(want)
