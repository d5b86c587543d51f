"""Hosts of very many labels, and keys of any number of labels."""

import time

from fleetlens.llm import url_filter


def test_hosts_of_very_many_labels(spark):
    long = "a." * 100_000
    urls = [f"http://{long}bad.example", f"http://{long}good.example", "http://bad.example/x", "http://x.bad.example.", "http://example/", "http://.bad.example", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    listed = spark.createDataFrame([("bad.example",), (None,), ("deep.er.than.most",)], "key string")
    url_filter.judge(pages.limit(1), listed).collect()
    begin = time.perf_counter()
    found = {r.page_id: r.verdict for r in url_filter.judge(pages, listed, rules=()).collect()}
    assert time.perf_counter() - begin < 60
    assert [found[i] for i in range(len(urls))] == ["block", "allow", "block", "allow", "allow", "block", "allow"]


def test_an_empty_list_blocks_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id int, url string")
    assert [r.verdict for r in url_filter.judge(pages, spark.createDataFrame([], "key string"), rules=()).collect()] == ["allow"]
