"""Main text on hosts whose wrapper must decide: no page marks an article, or names and marks mislead."""

import json

from framelake.llm import html_extraction as he


def texts(spark, htmls, host="site.test", **options):
    rows = [(i, f"http://{host}/{i}", h, "clash", 1) for i, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, slots int").repartition(3)
    return [r.text for r in he.extract_main_text(pages, **options).orderBy("page_id").collect()]


def story(i):
    return f"Story number {i} goes on for a while, and it is told at more length than anything around it."


def test_like_elements_are_told_apart_by_their_place(spark):
    # div.box stands twice, with one path; only the wrapper's order tells the motto from the story.
    pages = [f"<body><div class=box><p>Our motto stands here on each page, and it is a rather long one as mottos go.</p></div><h2>Part {i}</h2><div class=box><p>{story(i)}</p><p>And more {i}.</p></div></body>" for i in range(5)]
    assert texts(spark, pages) == [f"{story(i)} And more {i}." for i in range(5)]


def test_optional_and_repeated_groups(spark):
    def page(i):
        late = f"<div class=late><p>Added later, {i}.</p></div>" if i % 2 else ""
        parts = "".join(f"<h3>Head {i}.{j}</h3><p>{story(10 * i + j)}</p>" for j in range(1 + i % 3))
        return f"<body><div class=top><p>All news, all day</p></div><div class=post>{parts}</div>{late}<div class=base><p>Write to us</p></div></body>"

    def want(i):
        return " ".join(f"Head {i}.{j} {story(10 * i + j)}" for j in range(1 + i % 3))

    assert texts(spark, [page(i) for i in range(6)]) == [want(i) for i in range(6)]
    wrapper = he.infer_wrappers(spark.createDataFrame([(f"http://a.test/{i}", page(i)) for i in range(6)], "url string, html string")).first()
    assert "(h3[#] p[#])+" in wrapper.pattern and "div.late[p[#]]?" in wrapper.pattern


def test_fixed_part_of_a_marked_article_is_template(spark):
    pages = [f"<article><h1>Title {i}</h1><div class=hint><p>Read our terms before you go on.</p></div><p>{story(i)}</p></article>" for i in range(4)]
    assert texts(spark, pages) == [f"Title {i} {story(i)}" for i in range(4)]
    # Copies of one page can't tell what is fixed.
    assert texts(spark, pages[:1] * 4) == [f"Title 0 Read our terms before you go on. {story(0)}"] * 4


def test_names_that_only_hold_a_listed_word_keep_their_text(spark):
    parts = ['<div class="social-history"><p>History of the guild.</p></div>', '<section id="related-work"><p>Work by others.</p></section>', '<div class="notice-board-history"><p>On boards.</p></div>']
    page = f"<article><p>{story(1)}</p>{''.join(parts)}<div class='comment-list'><div class=comment>Nice!</div></div><div id=related-posts>See also</div><div class='cookie notice'>Cookies</div></article>"
    assert texts(spark, [page]) == [f"{story(1)} History of the guild. Work by others. On boards."]


def test_a_named_part_that_holds_the_main_slot_is_no_menu(spark):
    pages = [f"<body><div class=banner><p>{story(i)}</p><p>Further {i}</p></div><footer><p>x {i}</p></footer></body>" for i in range(3)]
    assert texts(spark, pages) == [f"{story(i)} Further {i}" for i in range(3)]


def test_awkward_pages(spark):
    wide = "<body>" + "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>{story(i) if i == 1500 else ''}</div>" for i in range(3000)) + "</body>"
    other = "<body>" + "".join(f"<p class=q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}></p>" for i in range(3000)) + "</body>"
    nested = f"<article><p>{story(2)}</p><form><p>Name</p></form><aside><p>By the way</p></aside><p>End.</p></article>"
    got = texts(spark, [wide, other, nested, nested, None, "", nested], host="odd.test")
    assert got == [story(1500), "", *[f"{story(2)} End."] * 2, "", "", f"{story(2)} End."]
    assert texts(spark, [nested, None], broadcast_bytes=0) == [f"{story(2)} End.", ""]


def test_place_of_repeats_and_options():
    wrapper = he.Wrapper(he.page_wrapper(he.read_page("<div class=a><p>x<p>y</div><h2>t</h2><div class=a><p>z</div><dl><dt>k<dd>v<dt>k<dd>v</dl>")[0]))
    root, blocks = he.read_page("<div class=a><p>1<p>2<p>3</div><h2>t</h2><div class=a><p>4</div><dl><dt>5<dd>6<dt>7<dd>8</dl><div class=b><p>9</div>")
    wrapper.place(root)
    got = [b[0].place for b in blocks]
    assert got[0] == got[1] == got[2] != got[4] and got[5] == got[7] and got[6] == got[8] and got[-1] == -1
    assert wrapper.within(got[0], wrapper.parents[got[0]]) and not wrapper.within(got[0], got[4])
    assert he.article_slots(json.dumps([]), []) == ([], [], [])
