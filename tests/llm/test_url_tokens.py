"""Rules come of whole URLs, also of what stands behind their first segments."""

from siftmark.llm import url_filters


def test_segments_and_parameters_far_behind_are_mined(spark):
    url = lambda k: f"http://a.b.c.d.e.shop.com/w/x/y/z/{'bad' if k % 2 else 'good'}/{k}?a=b&c=d&e=f&g=h&{'ad' if k % 3 else 'no'}=x"
    urls = [url(k) for k in range(60)]
    labelled = spark.createDataFrame([(u, "/bad/" in u) for u in urls], "url string, blocked boolean")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(pages, labelled).collect()}
    assert got == {k: "block" if k % 2 else "allow" for k in range(60)}
    mined = {tuple(r.tokens): r.n_urls for r in url_filters.mine_rules(labelled).collect()}
    assert mined["p:bad",] == 30 and len(mined) < 100
