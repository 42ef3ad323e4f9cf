import datetime as dt

from foliant.llm.url_lists import filter_urls

EVENTS = [("domain", "Spam.example.org", "add", "2024-01-10"), ("domain", "spam.example.org", "remove", "2024-02-10"), ("domain", "spam.example.org", "add", "2024-03-10"), ("host", "a.b.com", "add", "2024-01-01"), ("prefix", "https://b.com/x/y/", "add", "2024-01-01"), ("domain", "b.com", "add", "2024-06-01"), ("domain", "same.com", "add", "2024-01-05"), ("domain", "same.com", "remove", "2024-01-05"), ("domain", None, "add", "2024-01-01"), ("host", "x.com", "add", None), ("prefix", "ports.com:8080/x", "add", "2024-01-01"), ("host", "me@Named.com:81", "add", "2024-01-01")]
CASES = [
    ("http://spam.example.org/", "2024-01-09", None), ("http://spam.example.org/", "2024-01-10", "spam.example.org"), ("http://u:p@deep.SPAM.example.org:81/q", "2024-02-09", "spam.example.org"),
    ("http://spam.example.org/", "2024-02-10", None), ("http://spam.example.org/", "2024-03-10", "spam.example.org"), ("http://notspam.example.org/", "2024-03-10", None),
    ("http://a.b.com/", "2024-02-01", "a.b.com"), ("http://c.a.b.com/", "2024-02-01", None), ("http://c.a.b.com/", "2024-07-01", "b.com"), ("http://a.b.com/", "2024-07-01", "a.b.com"),
    ("https://b.com/x/y", "2024-02-01", "b.com/x/y"), ("https://b.com/x/y/z?q=1", "2024-07-01", "b.com/x/y"), ("https://b.com/x/yy", "2024-02-01", None), ("https://same.com", "2024-02-01", None),
    ("http://ports.com:8080/x/y", "2024-02-01", "ports.com/x"), ("http://ports.com/x", "2024-02-01", "ports.com/x"), ("http://ports.com:8080/z", "2024-02-01", None), ("https://named.com/", "2024-02-01", "named.com"),
    ("http://x.com/", "2024-02-01", None), (None, "2024-02-01", None), ("http://a.b.com/", None, None), ("", "2024-02-01", None), ("no url", "2024-02-01", None), ("http://b.com/" + "/" * 9000, "2024-02-01", None),
]


def frames(spark, cases=CASES):
    day = lambda s: s and dt.datetime.fromisoformat(s)
    captures = spark.createDataFrame([(i, u, day(t), "mine") for i, (u, t, _) in enumerate([*cases, *cases])], "page_id long, url string, fetched timestamp, rule string")
    return captures, spark.createDataFrame(EVENTS, "kind string, pattern string, action string, at string")


def test_cases(spark):
    rows = filter_urls(*frames(spark)).collect()
    assert len(rows) == 2 * len(CASES)
    for r in rows:
        want = CASES[r["page_id"] % len(CASES)][2]
        assert (r["rule"], r["blocked"]) == (want, want is not None), r


def test_dealt_join_gives_the_same(spark, monkeypatch):
    want = sorted(map(str, filter_urls(*frames(spark)).collect()))
    monkeypatch.setattr("foliant.llm.url_lists.SENT_INTERVALS", 0)
    assert sorted(map(str, filter_urls(*frames(spark)).collect())) == want


def test_empty(spark):
    captures, events = frames(spark)
    assert filter_urls(captures.where("false"), events).count() == 0
    assert filter_urls(captures, events.where("false")).where("blocked").count() == 0
