"""The registered queries: statements in SQL where there are some, and the pipeline against brute force."""

import glob
import importlib
import os

import pytest
from test_llm_pairs import linked, shingles, trimmed
from test_llm_text import report_of

import corpus_pipeline
from tallyweir.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def test_entry_lists_the_operators_and_the_pipeline():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == list(QUERIES) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_statement(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, SF)
    stated = db.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(stated.columns)
    wanted = [tuple(row[stated.columns.index(c)] for c in columns) for row in stated.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == sorted(wanted, key=str)


def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "repeated_passages", "benchmark_leaks", "tokens"]

    def after(stage, given):
        result = stages[stage](spark, given, SF)
        assert result.columns == docs.columns
        path = corpus_pipeline.stored(result, "test")
        return path, {r.doc_id: r.text for r in path.collect()}

    identified, kept = after("language_id", docs)
    assert kept == {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    single, one = after("near_duplicates", identified)
    wanted = {i for i, _, c in linked(list(kept.items())) if i == c}
    assert one == {i: kept[i] for i in wanted}
    cut, rest = after("repeated_passages", single)
    import hashlib
    for i, size, gone, _, digest in trimmed(list(one.items()), 50):
        if not gone:
            assert rest[i] == one[i]
        elif gone == size:
            assert i not in rest
        elif hashlib.sha256(rest[i].encode()).hexdigest() != digest:
            assert len(one[i].encode()) - gone - len(rest[i].encode()) <= 6 * 3  # characters cut in two
    clean, left = after("benchmark_leaks", cut)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r[0] for r in report_of(list(rest.items()), items) if r[-1]}
    assert leaks and left == {i: t for i, t in rest.items() if i not in leaks}
    final = {r.doc_id: r.decoded_sha256 for r in stages["tokens"](spark, clean, SF).collect()}
    assert final == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(final)


def test_near_duplicates_share_four_fifths_of_five_word_shingles(spark, frame, tmp_path):
    def texts(block, at):
        """A text of 104 words and its copy with a block of so many others."""
        words = [f"w{at}x{i}" for i in range(104)]
        return " ".join(words), " ".join([*words[:50], *(f"y{i}" for i in range(block)), *words[50 + block :]])

    # Of 100 shingles of five words a block changes four more than its words: 89 of 111 shared, and 88 of 112.
    docs = [t for at, block in enumerate((7, 8, 4, 20)) for t in texts(block, at)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)]
    given = frame("doc_id bigint, text string, lang string, source string, n_chars bigint", *rows)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, given, SF).collect()}
    found = [(i, shingles(t, 5)) for i, t in enumerate(docs)]
    assert kept == {i for i, s in found if not any(100 * len(s & o) >= 80 * len(s | o) for j, o in found if j < i)} == {0, 2, 3, 4, 6, 7}
    given.write.parquet(f"{tmp_path}/documents.parquet")
    components = {r.doc_id: r.component_id for r in QUERIES["op4_jaccard_join"](spark, str(tmp_path)).collect()}
    assert components == {i: i if i != 5 else 4 for i in range(8)}


def test_pipeline_on_odd_rows(spark, frame, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = frame(schema, (1, "plain words of a text", "en", "s", 21), (2, None, None, None, None), (None, "other words of a text", None, "s", 1), (1, "plain words of a text", "en", "s", 21), (3, "", "en", "s", 0))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert docs.count() <= 2
