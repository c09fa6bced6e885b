"""Scores that have come to rest, along more hosts than the SQL twin follows."""

import pytest

from citesift.llm import url_filter

SCHEMA = "page_id long, url string, html string"


def test_scores_of_a_long_chain_and_a_circle(spark):
    link = '<a href="http://{}/">'.format
    pages = [(k, f"http://spam{k}.net/", link(f"spam{k + 1}.net")) for k in range(1, 20)]
    pages += [(20, "http://spam20.net/", link("x.example.org")), (21, "http://x.example.org/es/", "")]
    # Two hosts that link to each other: trust goes round for ever.
    pages += [(30, "https://a.org/", link("b.net")), (31, "http://b.net/", link("c.net")), (32, "http://c.net/", link("b.net"))]
    rows = url_filter.filter_urls(spark.createDataFrame(pages, SCHEMA)).collect()
    got = {r.page_id: r for r in rows}
    assert all(got[k].verdict == "block" for k in range(1, 22))
    assert got[1].distrust == pytest.approx(0.15 * 0.85**20, abs=5e-7)
    # b = 0.85 (a + c) and c = 0.85 b, with a = 0.15.
    b = 0.85 * 0.15 / (1 - 0.85**2)
    assert got[31].trust == pytest.approx(b, abs=5e-7) and got[32].trust == pytest.approx(0.85 * b, abs=5e-7)
