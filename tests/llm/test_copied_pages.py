"""Template slots on hosts whose pages are copies."""

from framelake.llm import html_extraction


def texts(spark, htmls):
    rows = [(i, f"http://copies.test/{i}", h) for i, h in enumerate(htmls)]
    got = html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return [r.text for r in got.orderBy("page_id").collect()]


def test_copies_keep_their_text(spark):
    page = "<body><h1>Title</h1><div class=post><p>The only paragraph of this page, copied as it stands.</p></div></body>"
    assert texts(spark, [page] * 4) == texts(spark, [page]) * 4
    assert "only paragraph" in texts(spark, [page] * 4)[0]


def test_repeats_within_a_page_are_no_template(spark):
    assert texts(spark, ["<div class=post><p>again</p><p>again</p><p>again</p></div>"]) == ["again again again"]


def test_template_takes_pages_of_different_content(spark):
    pages = [f"<div class=post><p>Always here</p></div><div class=main><p>Story {w}, which goes on for a while and longer.</p></div>" for w in ("one", "two", "three")]
    assert texts(spark, pages + pages) == [f"Story {w}, which goes on for a while and longer." for w in ("one", "two", "three")] * 2
