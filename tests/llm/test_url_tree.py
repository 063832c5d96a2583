from cadenza.llm import url_filter


def slug(i):
    return "".join("abcdefghij"[int(d)] for d in str(1000 + i))


def test_slugs_below_variable_segments_are_one_branch(spark):
    """/u/<name>/<album>/<pic> is bad throughout, /docs/<topic> is good; no name, album or pic comes twice."""
    bad = [(i, f"http://h.io/u/{slug(i)}/{slug(3 * i)}/{slug(7 * i)}") for i in range(300)]
    good = [(1000 + i, f"http://h.io/docs/{slug(i)}") for i in range(300)]
    pages = spark.createDataFrame(bad + good, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(1000 + i, 0) for i in range(0, 300, 2)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, {}, labels).collect()}
    assert {got[i] for i, _ in bad} == {"block"} and {got[i] for i, _ in good} == {"allow"}


def test_like_branches_are_merged_at_each_parent(spark):
    """Twelve folders of one bad page each say nothing alone, but their parent does; the good part is apart."""
    bad = [(i, f"http://h.io/x/{slug(i)}/{slug(i)}/p") for i in range(12)]
    good = [(1000 + i, f"http://h.io/docs/{slug(i % 10)}/q") for i in range(200)]
    pages = spark.createDataFrame(bad + good, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i, _ in good], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, {}, labels).collect()}
    assert {got[i] for i, _ in bad} == {"block"} and {got[i] for i, _ in good} == {"allow"}
