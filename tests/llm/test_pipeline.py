"""The pipeline against its operators, stage by stage, and the registered queries."""

import collections

import pytest

pytest.importorskip("topicweave.llm")

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from topicweave.llm.common import materialise  # noqa: E402
from topicweave.llm import exact_dedup, language_id, mixing, simhash  # noqa: E402
from topicweave.llm.queries import QUERIES, tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, before, folder), "t")
        assert out.columns == columns
        after[name], before = out, out
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    known = {r["doc_id"] for r in language_id.identified(docs, tokenizer_path("piece_bpe_32k.model")).filter(f"lang_pred <> 'und' and score >= {language_id.LEAST_SCORE}").collect()}
    assert ids(after["language_id"]) == [i for i in ids(docs) if i in known]
    kept = [r["doc_id"] for r in exact_dedup.exact_groups(after["language_id"]).filter("kept").collect()]
    assert ids(after["exact_dedup"]) == sorted(kept)
    near = [r["doc_id"] for r in simhash.near_duplicates(after["exact_dedup"]).filter("doc_id = component_id").collect()]
    assert ids(after["simhash_near_dedup"]) == sorted(near)
    copies = {r["doc_id"]: r["copies"] for r in mixing.with_copies(after["simhash_near_dedup"]).collect()}
    assert collections.Counter(ids(after["mixing"])) == {i: n for i, n in copies.items() if n}
    packed = corpus_pipeline.run(spark, folder)
    first = packed.filter("piece = 0").collect()
    assert collections.Counter(r["doc_id"] for r in first) == {i: n for i, n in copies.items() if n}
    assert len({r["row_key"] for r in first}) == len(first)  # copies of a document stay apart


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), "t")
        assert docs.count() == 0


def test_every_operator_has_a_query():
    assert {int(n.split("_")[0][2:]) for n in QUERIES if n.startswith("op")} == set(range(1, 11))
    assert "pipeline" in QUERIES and set(QUERIES) <= set(__spark_entry__.queries())
