from emporia.llm import urls as U

from .helpers import same, write

SF001 = "/root/testdata/sf0.001"


def _page(canonical=None, refresh=None):
    head = f'<LINK href="{canonical}" rel="canonical">' if canonical else ""
    head += f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else ""
    return f"<html><head>{head}</head><body><a href='x'>x</a></body></html>"


PAGES = [
    (1, "https://a.example.net/x", _page()),                                      # block net/
    (2, "http://example.net/en/1", _page()),                                      # allow beats net/
    (3, "https://safe.example.edu/p", _page(canonical="https://a.example.net/x")),  # alias of a blocked page
    (4, "https://other.example.edu/q?x=1#f", _page(refresh="//safe.example.edu/p")),  # alias of an alias
    (5, "https://news.example.org/fr/1", _page(canonical="http://A.EXAMPLE.NET/x")),  # allowed outright
    (6, "https://news.example.org/de/1", _page(canonical="/fr/1")),               # tied to it all the same
    (7, "https://fine.example.edu/", _page(canonical="sub/page")),
    (8, "https://fine.example.edu/sub/page", _page()),
    (9, "http://x.example.com/de/5", _page()),
    (10, "http://x.example.com", _page()),
    (11, None, _page(canonical="https://a.example.net/x")),
    (12, "", None),
    (13, "no scheme/net/", _page(refresh="/x")),
    (14, "ftp://UP.Example.NET?net/", _page()),
    (15, "https://mail.example.edu/", _page(canonical="mailto:a@example.net")),
    (16, "https://gone.example.edu/", _page(canonical="https://hidden.example.net/gone&amp;x")),
    (16, "https://gone.example.edu/", _page(canonical="https://hidden.example.net/gone&amp;x")),
    (None, "https://xnet/", "<link rel='canonical icon' href=https://www.b.net/>"),
    (18, "https://evil.org.net.edu/fr/", None),
]


def test_rules_and_aliases(spark, tmp_path):
    got = same(U.op5_url_filters, U.SQL, spark, write(spark, tmp_path, "pages", PAGES))
    verdict = {r[1]: r[4] for r in got}
    assert [verdict[i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [
        "block", "allow", "block", "block", "allow", "block", "allow", "allow", "block", "allow"]
    assert [verdict[i] for i in (11, 12, 13, 14, 15, 16, 18)] == ["allow", "allow", "allow", "allow", "allow", "block", "allow"]
    assert verdict[None] == "block"


def test_given_table(spark):
    assert len(same(U.op5_url_filters, U.SQL, spark, SF001)) > 0


def test_spellings_of_one_address_are_one_alias(spark, tmp_path):
    """An empty path is ``/``, and default ports do not count; the reported host
    and path, and the rules of the pages themselves, stay as they are."""
    pages = [(1, "https://bad.net", _page()), (2, "https://a.edu/1", _page(canonical="https://bad.net")), (3, "https://a.edu/2", _page(canonical="https://bad.net/")),
             (4, "https://a.edu/3", _page(canonical="https://BAD.net:443/p?q")), (5, "http://a.edu:80", _page(canonical="https://a.edu/1")),
             (6, "http://a.edu/", None), (7, "http://a.edu:8080/", None), (8, "https://b.edu?x", _page(canonical="https://bad.net/")), (9, "https://b.edu/?x", None)]
    got = same(U.op5_url_filters, U.SQL, spark, write(spark, tmp_path, "pages", pages))
    assert {r[1]: r[4] for r in got} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "block", 9: "block"}
    assert {r[1]: (r[0], r[2]) for r in got}[5] == ("a.edu:80", "")


def test_ties_between_rules_and_a_very_long_page(spark, tmp_path):
    rules = spark.createDataFrame([("block", "a.edu", "/x"), ("block", "a.edu", "/x"), ("allow", "edu", "/x/yz")], "verdict string, host string, path string")
    long = "<p>" + "word " * 400_000 + '</p><link rel="canonical" href="https://a.edu/x">'
    pages = spark.createDataFrame([(1, "https://a.edu/x/yz", None), (2, "https://b.edu/", long), (2, "https://b.edu/", long)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in U.judge_urls(pages, rules).fillna("").collect())
    assert got == [(1, "edu/x/yz", "allow"), (2, "", "block"), (2, "", "block")]      # the longest rule; repeated rules count once


def test_empty_table(spark, tmp_path):
    assert not same(U.op5_url_filters, U.SQL, spark, write(spark, tmp_path, "pages", []))


def test_long_alias_chain_and_star(spark, tmp_path):
    rows = [(i, f"https://c{i}.example.edu/", _page(canonical=f"https://c{i + 1}.example.edu/")) for i in range(40)]
    rows += [(100 + i, f"https://s{i}.example.edu/", _page(refresh="https://hub.example.edu/")) for i in range(50)]
    rows += [(40, "https://c40.example.edu/", _page(canonical="https://z.example.net/")), (99, "https://hub.example.edu/", None)]
    got = same(U.op5_url_filters, U.SQL, spark, write(spark, tmp_path, "pages", rows))
    assert {r[1] for r in got if r[4] == "block"} == set(range(41))


def test_extra_columns_do_not_clash(spark, tmp_path):
    schema = "page_id long, url string, html string, host string, rule string, node string, verdict string"
    rows = [(*p, "h", "r", "n", "v") for p in PAGES[:4]]
    write(spark, tmp_path, "pages", rows, schema)
    out = U.op5_url_filters(spark, str(tmp_path))
    assert {r.page_id: r.verdict for r in out.collect()} == {1: "block", 2: "allow", 3: "block", 4: "block"}


def test_more_rules_than_the_query(spark):
    rules = spark.createDataFrame([("block", "b.a.example", "/"), ("allow", "a.example", "/x/y")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "h://c.b.a.example/x/y", None), (2, "h://a.example/x/yz", None), (3, "h://ba.example/x/y", None),
                                   (4, "h://b.a.example/x", None)],
                                  SCHEMA)
    assert {r.page_id: r.rule for r in U.judge_urls(pages, rules).collect()} == {1: "a.example/x/y", 2: "a.example/x/y", 3: None, 4: "b.a.example/"}


SCHEMA = "page_id long, url string, html string"
