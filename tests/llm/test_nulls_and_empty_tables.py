"""What the docstrings of the queries say of empty tables, and of null ids and texts, empty texts, repeated rows and further columns."""

import pytest

from quillon.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, _th long, pattern long"


def tables(spark, path, docs):
    rows = [(i, t, "en", s, 0 if t is None else len(t), "k", 7, 8, 9) for i, t, s in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "What is the least number of coins that pay for twelve apples at the market in town")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"http://h.example.org/{i}", t) for i, t, _ in docs]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("nothing"), [])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    mail = "write to anna@example.org about the mit license please"
    return tables(spark, tmp_path_factory.mktemp("odd"), [(1, None, "a"), (2, "", None), (3, mail, "a"), (3, mail, "a"), (None, mail, "a"), (4, "​ \n", "b")])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_an_empty_table_gives_no_rows(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == 0


def test_the_pipeline_of_an_empty_table(spark, nothing):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert pipeline.run(spark, nothing).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op5_decontamination", "op13_html_extraction"}))
def test_every_row_has_its_result(spark, odd, name):
    out = queries.QUERIES[name](spark, odd).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == [(False, 0), (True, 1), (True, 2), (True, 3), (True, 3), (True, 4)]
    twice = [r for r in out if r.doc_id == 3]
    if name not in ("op8_binary_output", "op9_fingerprints"):  # their rows depend on their place
        assert twice[0] == twice[1]


def test_what_null_texts_get(spark, odd):
    def of(name):
        return {r.doc_id: r for r in queries.QUERIES[name](spark, odd).collect()}

    tokens, licenses, pii, near = of("op2_token_counts"), of("op4_license_scan"), of("op10_pii"), of("op6_near_duplicates")
    for i in (1, 2):
        assert (tokens[i].n_bytes, tokens[i].n_tokens, tokens[i].over_limit) == (0, 0, False)
        assert (licenses[i].n_words, licenses[i].first_word, licenses[i].base_labels, licenses[i].labels, licenses[i].score) == (0, None, "", "", 0.0)
        assert (pii[i].n_email, pii[i].spans) == (0, "")
        assert (near[i].class_id, near[i].class_size) == (1, 2)
    assert near[3].class_size == 3 and near[3].class_id is None and near[4].class_size == 1
    assert pii[3].n_email == 1 and licenses[3].base_labels == "mit"
    start = of("op8_binary_output")
    assert start[None].start == 0 and start[1].n_tokens == start[2].n_tokens == 1
    prints = of("op9_fingerprints")
    assert prints[1].n_chars == 0 and prints[2].fingerprint == prints[1].fingerprint == "" and prints[2].near_next == 1.0
    assert queries.QUERIES["op5_decontamination"](spark, odd).count() == 0
    align, drawn = of("op12_tokenizer_alignment"), of("op11_importance_resampling")
    for i in (1, 2):
        assert (align[i].n_a, align[i].n_b, align[i].n_groups, align[i].n_links, align[i].groups_sha256) == (0, 0, 0, 0, "")
        assert (drawn[i].n_features, drawn[i].weight, drawn[i].rank) == (0, 0, None)
    assert align[3].n_a > 0 and drawn[3].n_features == 19
    texts = {r.page_id: (r.text, r.n_chars) for r in queries.QUERIES["op13_html_extraction"](spark, odd).collect()}
    assert texts[1] == texts[2] == ("", 0) and texts[3][0].startswith("write to anna") and texts[4][1] == 1
