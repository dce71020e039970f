"""Distrust over a chain of hosts that is longer than any fixed number of rounds."""

from framelake.llm import url_filter


def test_chain_of_hosts(spark):
    n = 25
    rows = [(0, "http://h0.net/x", "<p>x</p>")]
    rows += [(i, f"http://h{i}.test/", f'<a href="http://h{i - 1}.{"net" if i == 1 else "test"}/">x</a>') for i in range(1, n)]
    rows += [(n, "http://apart.test/", "<p>x</p>")]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # By hand: the blocked host keeps 0.15 of its mass, and each host further on has 0.85 of the one before.
    for i in range(n):
        assert got[i].verdict == "block" and abs(got[i].distrust - 0.15 * 0.85**i) < 0.85**n
    assert got[n].verdict == "allow" and got[n].distrust == 0
