"""The stages, each against a brute-force version on its own input."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)

from test_llm_operators import brute_groups  # noqa: E402
from webquarry.llm import mixing, pii, quality, queries  # noqa: E402
from webquarry.llm.common import written  # noqa: E402


def test_stages(spark):
    from tokenizers import Tokenizer

    sf_dir = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in stages.items():
        tables.append(written(stage(spark, tables[-1], sf_dir), name))
    first, good, single, clean, mixed, ids = tables
    assert all(t.columns == columns for t in tables[:-1])
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.judged(first).where("kept").collect()}
    groups = brute_groups([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, _, kept) in groups.items() if kept}
    texts = {r.doc_id: r.text for r in single.collect()}
    assert all(r.text == pii.masked_text(texts[r.doc_id]) and r.n_chars == len(r.text) for r in clean.collect())
    plan = {r.doc_id: r.copies for r in mixing.planned(clean).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter(plan)
    library = Tokenizer.from_file(queries.WORD_BPE)
    after = {r.doc_id: r.text for r in mixed.collect()}
    rows = ids.collect()
    assert len(rows) == sum(plan.values())
    assert all(r.ids == library.encode(after[r.doc_id], add_special_tokens=False).ids for r in rows)


def test_empty_input(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
    assert docs.count() == 0
