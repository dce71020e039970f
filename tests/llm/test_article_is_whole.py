"""Article text that a host's pages share or lay out in several parts stays; written by hand, whole texts."""

import random

from framelake.llm import html_extraction as he


def texts(spark, htmls):
    rows = [(i, f"http://whole.test/{i}", h) for i, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return [r.text for r in he.extract_main_text(pages).orderBy("page_id").collect()]


def say(i, what="body"):
    return f"This is the {what} of story {i}, told in some words that no other page of the host has, number {i}."


def test_headings_that_all_articles_have(spark):
    pages = [f"<article><h1>Title {i}</h1><h2>Abstract</h2><p>{say(i, 'abstract')}</p><h2>Results</h2><p>{say(i)}</p><p>First printed by us.</p></article>" for i in range(4)]
    assert texts(spark, pages) == [f"Title {i} Abstract {say(i, 'abstract')} Results {say(i)} First printed by us." for i in range(4)]


def test_labels_in_sections_of_an_article(spark):
    def page(i):
        parts = "".join(f"<section class={k}><h3>{k}</h3><dl><dt>By</dt><dd>Writer {i}{k}</dd></dl><p>{say(i, k)}</p></section>" for k in ("Method", "Outcome"))
        return f"<main><h1>Case {i}</h1>{parts}<div class=hint><p>Terms of use apply.</p></div></main>"

    want = [f"Case {i} " + " ".join(f"{k} By Writer {i}{k} {say(i, k)}" for k in ("Method", "Outcome")) for i in range(5)]
    assert texts(spark, [page(i) for i in range(5)]) == want


def test_lead_and_body_in_different_containers(spark):
    def page(i):
        story = f'<div class="story"><h1>Head {i}</h1><div class="lead"><p>{say(i, "lead")}</p></div><div class="share"><p>Tell a friend, friend {i}</p></div><div class="copy"><p>{say(i)}</p><p>{say(i, "end")}</p></div></div>'
        return f'<body><div class="top"><p>All the news there is, every day and every night, since long ago.</p></div><div class="list"><ul><li><a href=a>Other story {i}</a></li><li><a href=b>One more {i}</a></li></ul></div>{story}<div class="base"><p>Write to us at any time.</p></div></body>'

    assert texts(spark, [page(i) for i in range(4)]) == [f"Head {i} {say(i, 'lead')} {say(i)} {say(i, 'end')}" for i in range(4)]


def test_fixed_headings_on_pages_without_marks(spark):
    pages = [f"<body><div class=x><p>Our motto for every page of ours.</p></div><div class=post><h1>Head {i}</h1><h2>Summary</h2><p>{say(i)}</p><h2>Details</h2><p>{say(i, 'rest')}</p></div></body>" for i in range(4)]
    assert texts(spark, pages) == [f"Head {i} Summary {say(i)} Details {say(i, 'rest')}" for i in range(4)]


def by_table(a, b):
    """Pairs of the same rule over the whole table."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_one_alignment_at_every_size():
    rng = random.Random(4)
    for size in [*range(13)] * 12 + [90, 400]:
        a, b = ([rng.choice("abcdefgh"[: rng.choice((2, 4, 8))]) for _ in range(rng.randint(0, size))] for _ in range(2))
        assert he._matches([[x, "", []] for x in a], [[x, "", []] for x in b]) == by_table(a, b)
    wide = [[f"p{i}", "", []] for i in range(6000)]
    found = he._matches(wide, wide[::2] + wide[1::2])
    assert len(found) == 3001
    assert all(wide[i][0] == (wide[::2] + wide[1::2])[j][0] for i, j in found)
