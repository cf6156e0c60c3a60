"""Failures put into every stage of the page pipeline, with and without stopping."""

from pyspark.sql import functions as F

from webquarry.operators import pagetext

PAGE = "<html><body><nav>menu</nav><p>plain words {}</p></body></html>"


def run(spark, stop):
    rows = [(1, PAGE.format("here")), (2, PAGE.format("BADHTML")), (3, PAGE.format("BADMARK")), (4, PAGE.format("BADTEXT")), (5, None), (6, ""), (7, PAGE.format("BADHTML BADMARK BADTEXT"))]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("clean_html", F.lit("x")).withColumn("markdown_error", F.lit("x"))
    checks = {stage: {"other": F.lit(None).cast("boolean"), f"no {word}": F.contains("html", F.lit(word))} for stage, word in [("html", "BADHTML"), ("markdown", "BADMARK"), ("text", "BADTEXT")]}
    result = pagetext.checked_pipeline(pages, checks, stop_on_error=stop)
    found = {r.page_id: r for r in result.collect()}
    assert len(found) == 7
    quarantine = sorted(tuple(r) for r in pagetext.quarantined(result).collect())
    assert quarantine == sorted((i, e.stage, e.cause) for i, r in found.items() for e in r.errors)
    return found


def test_failures_fall_back(spark):
    got = run(spark, False)
    ok = got[1]
    assert ok.executed == ["html", "markdown", "text"] and not ok.errors and "menu" not in ok.clean_html and "menu" not in ok.markdown and "plain words here" in ok.text
    assert got[2].clean_html is None and "menu" in got[2].markdown and got[2].executed == ["markdown", "text"]  # markdown of the page as it came
    assert got[3].markdown == "" and "plain words" in got[3].text and got[3].executed == ["html", "text"]
    assert got[4].text == "menu plain words BADTEXT" and got[4].executed == ["html", "markdown"]
    assert [tuple(e) for e in got[5].errors] == [(s, "no page") for s in ("html", "markdown", "text")] and (got[5].markdown, got[5].text) == ("", "")
    assert (got[6].clean_html, got[6].markdown, got[6].text, got[6].errors) == ("", "", "", [])
    assert [e.stage for e in got[7].errors] == ["html", "markdown", "text"] and got[7].executed == []


def test_stop_on_error(spark):
    got = run(spark, True)
    assert got[1].executed == ["html", "markdown", "text"]
    assert (got[2].clean_html, got[2].markdown, got[2].text, got[2].executed) == (None, None, None, [])
    assert got[3].clean_html and (got[3].markdown, got[3].text, got[3].executed) == (None, None, ["html"])
    assert got[4].markdown and got[4].text is None and got[4].executed == ["html", "markdown"]
    assert [tuple(e) for e in got[5].errors] == [("html", "no page")] and [e.stage for e in got[7].errors] == ["html"]
