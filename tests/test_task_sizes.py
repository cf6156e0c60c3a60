"""Work per task stays bounded: pages are read once, derived rows are dealt out, texts are laid out by their size."""

import math
import re

import pytest
from pyspark.sql import functions as F

from webquarry.functions import markup
from webquarry.operators import dom, relevance, skew, stems, structured
from webquarry.plans import derived


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_csrf_token_reads_the_page_once(spark):
    html = '<meta name="csrf-token" content=""><input name="X_nonce" value="n1"><input name="my_csrf" value="c1"><input name="csrf_token">'
    found = structured.csrf_token(spark.createDataFrame([(1, html), (2, "<p>no</p>"), (3, None)], "page_id long, html string"))
    assert [tuple(r) for r in found.collect()] == [(1, "my_csrf", "c1")]
    assert plan(found).count("regexp_extract_all(") == 2  # metas and inputs


def test_derived_rows_are_dealt_out(spark, tmp_path):
    spark.range(12000).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = derived.derive(spark, str(tmp_path), "entity_texts")
    sizes = [n for n, in rows.rdd.mapPartitions(lambda it: [(sum(1 for _ in it),)]).collect()]
    assert sum(sizes) == 12000 and max(sizes) <= derived.ROWS_PER_TASK


@pytest.mark.parametrize("kind", ["tokens", "texts", "terms"])
def test_texts_are_laid_out_by_size(spark, monkeypatch, kind):
    monkeypatch.setattr(skew, "PART_BYTES", 1000)
    pages = spark.range(100).selectExpr("id as page_id", "id as doc_id", "repeat('<p>some words</p>', 20) as html", "repeat('some words ', 32) as text")
    if kind == "tokens":
        assert ", 34), REPARTITION_BY_NUM" in plan(dom.html_tokens(pages))
    elif kind == "texts":
        text = plan(dom.select_elements(pages, {"p": ("p:first-child", None)}))
        assert text.count(", 34), REPARTITION_BY_NUM") == text.count("Exchange hashpartitioning") == 3
    else:
        assert ", 36), REPARTITION_BY_NUM" in plan(relevance.term_frequencies(pages))


@pytest.mark.parametrize("name", ["microdata", "listing_cards"])
def test_elements_are_found_once(spark, name):
    """What is read several times is written first: no token is taken apart in the rest of the plan."""
    html = '<div itemscope itemtype="T" data-asin="A"><h2><a href="/dp/1"><span itemprop="n">x</span></a></h2><p itemprop="m" itemscope><b itemprop="k">y</b></p></div>'
    found = getattr(structured, name)(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert "posexplode(" not in plan(found)
    assert found.count() == (4 if name == "microdata" else 1)


@pytest.mark.parametrize("tok,name,value,present", [
    ("<a HREF='x'>", "href", "x", True), ("<a b=href>", "href", None, False), ("<a href>", "href", None, True), ("<a>", "href", None, False), (None, "href", None, None),
])
def test_attributes_without_the_pattern(spark, tok, name, value, present):
    rows = spark.createDataFrame([(tok,)], "tok string")
    assert tuple(rows.select(markup.attr(F.col("tok"), name), markup.has_attr(F.col("tok"), name)).first()) == (value, present)


@pytest.mark.parametrize("kind", ["tfidf", "stemmed"])
def test_term_lookups_are_laid_out_by_size(spark, monkeypatch, kind):
    """Joins and groups behind the texts have as many tasks as the texts, whatever the session's width."""
    monkeypatch.setattr(skew, "PART_BYTES", 1000)
    docs = spark.range(100).selectExpr("id as doc_id", "concat(repeat('lamps lamp ', 32), 'word', id) as text")
    parts = relevance.parts_of(docs, "text")
    assert parts > 30
    shown = plan(relevance.tfidf(docs, stemmed=kind == "stemmed"))
    assert len(re.findall(rf"hashpartitioning\(term#\d+, __salt#\d+, {parts}\)", shown)) >= (4 if kind == "stemmed" else 2)
    if kind == "stemmed":
        assert len(re.findall(rf"hashpartitioning\(doc_id#\d+L, {parts}\)", shown)) >= 2
    assert relevance.tfidf(docs, stemmed=kind == "stemmed").count() == (200 if kind == "stemmed" else 300)


@pytest.mark.parametrize("parts", [None, 8])
def test_only_hot_keys_of_a_counted_lookup_are_repeated(spark, parts):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(900)] + [(None, -1)], "term string, id int")
    counts = rows.where("term is not null").groupBy("term").agg(F.count("*").alias("c"), F.max("id").alias("v"))
    got = skew.salted_lookup(rows, counts, "term", "id", "left", count="c", parts=parts)
    assert got.columns == ["term", "id", "v"]
    assert {tuple(r) for r in got.collect()} == {("hot", i, 899) if i % 3 else (f"k{i}", i, i) for i in range(900)} | {(None, -1, None)}
    assert got.count() == 901 and "Generate explode" in plan(got)
    assert "sequence(0, 15" not in plan(got)  # not every key 16 times


def test_sentences_without_a_stem_of_the_task_leave_before_the_lookup(spark):
    docs = spark.createDataFrame([(1, "Connected lamps. Red chairs stand there! Connecting connection lamps?"), (2, "Chairs and tables."), (3, None)], "doc_id long, text string")
    tf = relevance.term_frequencies(docs)
    known = stems.counted_stems(relevance.tokens(docs))
    idf = relevance.inverse_frequencies(relevance.stemmed_frequencies(tf, known=known), docs)
    found = relevance.segment_similarity(docs, idf, "connects", stemmed=True)
    assert "posexplode(" not in plan(found)  # the sentences were written
    rows = sorted((r.doc_id, r.segment, round(r.similarity, 6)) for r in found.collect())
    assert [r[:2] for r in rows] == [(1, 0), (1, 2)] and rows[0][2] < rows[1][2]
    again = relevance.segment_similarity(docs, idf, "connects", stemmed=True, known=known)
    assert sorted((r.doc_id, r.segment, round(r.similarity, 6)) for r in again.collect()) == rows
    assert relevance.segment_similarity(docs, idf, "sofas", stemmed=True).count() == 0


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_segments_of_relevant_entities_stay_with_their_texts(spark, monkeypatch, broadcast):
    """Sentences do not travel: they are cut and deduplicated where their text is, in as many tasks as the texts fill."""
    monkeypatch.setattr(skew, "PART_BYTES", 1000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        chairs = "concat('Chairs stand there. ', repeat(concat('Sofas of house', id, ' wait! '), 20), case when id % 10 = 2 then concat('Blue lamp costs $', id, ' today.') else '' end)"
        docs = spark.range(100).selectExpr("id as doc_id", f"case when id % 10 = 1 then concat('Blue lamp $', id) when id != 7 then {chairs} end as text")
        parts = relevance.parts_of(docs, "text")
        assert parts > 30
        found = relevance.relevant_entities(docs, "blue lamp", threshold=0.3)
        shown = plan(found)
        assert "hashpartitioning(page_id" not in shown and not re.search(r"Join \[doc_id#\d+L, segment", shown)
        assert len(re.findall(rf"hashpartitioning\(doc_id#\d+L, {parts}\), REPARTITION_BY_NUM", shown)) >= 4
        got = sorted((r.page_id, r.method, r.data["price"]) for r in found.filter("type = 'pricing'").collect())
        assert got == [(i, "full_content" if i % 10 == 1 else "segments", f"${i}") for i in range(100) if i % 10 in (1, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_best_segments_of_a_key_that_comes_twice(spark):
    """A segment is picked from every text of the key that is long enough."""
    rows = [(1, "Red chairs stand here today. Blue lamp costs $3 now."), (1, "Sofas and tables wait outside."), (1, "Green carpets lie flat. Grey walls cost $9 more."), (None, "Blue lamp $4."), (3, None)]
    rows += [(i, "Doors open slowly.") for i in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = relevance.relevant_entities(docs, "blue lamp", threshold=0.4)
    assert sorted((r.page_id, r.method, r.data["price"]) for r in found.filter("type = 'pricing'").collect()) == [(1, "segments", "$3"), (1, "segments", "$9")]


@pytest.mark.parametrize("cosine", [False, True])
def test_rows_of_stems_stay_with_their_texts(spark, monkeypatch, cosine):
    """Texts travel once; behind them only one row for each term of a part, there and back."""
    monkeypatch.setattr(skew, "PART_BYTES", 1000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(1000).selectExpr("id as doc_id", "concat('connected lamps lamp connecting word', id % 20, if(id % 2 = 0, ' chairs', '')) as text")
        parts = relevance.parts_of(docs, "text")
        assert parts > 30
        if cosine:
            tf = relevance.stemmed_frequencies(relevance.term_frequencies(docs))
            idf = relevance.inverse_frequencies(tf, docs)
            weights = relevance.with_idf(tf, idf, "doc_id").withColumn("weight", F.col("tf") * F.col("idf"))
            found = relevance.cosine_query(weights, idf, "chairs", stemmed=True)
        else:
            found = relevance.tfidf(docs, stemmed=True)
        shown = plan(found)
        assert "__salt" not in shown
        dealt = re.findall(r"Exchange (\w+)\(.*REPARTITION_BY_NUM", shown)
        assert dealt.count("hashpartitioning") == 1 + cosine  # the terms, again for the length of the task
        assert dealt.count("shufflepartitionidpassthrough") == 3 + cosine  # the texts for each reader, the idf
        assert len(re.findall(rf", {parts}\), REPARTITION_BY_NUM", shown)) == 4 + 2 * cosine
        rows = found.collect()
        made = plan(found)
        assert not cosine or re.search(r"ReusedExchange \[__part#\d+, term#\d+, n#\d+L\]", made)
        if cosine:
            assert {r.doc_id: r.similarity > 0 for r in rows} == {i: i % 2 == 0 for i in range(1000)}
        else:
            assert len(rows) == 3500 and {r.term for r in rows} == {"connect", "lamp", "chair"} | {f"word{i}" for i in range(20)}
            assert {round(r.idf, 9) for r in rows if r.term == "chair"} == {round(math.log(2), 9)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stems_of_texts_without_a_key_or_with_the_same(spark):
    """Many documents a part, among them null keys, keys that come twice, null and empty texts: as one by one."""
    texts = [None, "", "the of", "connecting connected lamps", "lamp lamps lamp", "chairs", "agreed yyy", "lamps"]
    rows = [(None if i % 17 == 0 else i % 90, texts[(i if i % 17 == 0 else i % 90) % 8]) for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = relevance.tfidf(docs, stemmed=True)
    assert relevance.dense(docs) and "__salt" not in plan(found)
    stem = {"connecting": "connect", "connected": "connect", "lamps": "lamp", "lamp": "lamp", "chairs": "chair", "agreed": "agre", "yyy": "yyi"}
    words = {}
    for key, text in rows:
        for w in (text or "").replace("the of", "").split():
            words.setdefault(key, []).append(stem[w])
    tf = relevance.stemmed_frequencies(relevance.term_frequencies(docs))
    assert sorted(((r.doc_id or -1, r.term, r.n) for r in tf.collect())) == sorted((k or -1, t, ws.count(t)) for k, ws in words.items() for t in set(ws))
    df = {t: sum(t in ws for ws in words.values()) for t in stem.values()}
    assert {(r.doc_id, r.term): round(r.idf, 9) for r in found.collect()} == {(k, t): round(math.log(180 / df[t]), 9) for k, ws in words.items() for t in ws}
