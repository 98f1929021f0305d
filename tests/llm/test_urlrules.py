"""Hosts beyond ASCII: rules and urls are lowered alike, A-Z only."""

from factloom.llm import urlrules


def test_hosts_of_rules_are_lowered_as_those_of_urls(spark):
    rules = spark.createDataFrame([("ÄB.com", "/", "block"), ("Example.NET", None, "block"), (None, "/", "block")], "host string, path string, action string")
    urls = ["http://ÄB.com/x", "http://äb.com/x", "http://www.EXAMPLE.net", "http://sub.Äb.COM/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.id: (r.host, r.verdict) for r in urlrules.judged(pages, rules).collect()}
    assert got[0] == ("Äb.com", "block") and got[1] == ("äb.com", "allow") and got[3] == ("sub.Äb.com", "block") and got[4] == ("", "allow")
    assert got[2][1] == "allow"  # without a path the rule's path does not fit


def test_a_rule_of_a_whole_host_fits_every_path(spark):
    rules = spark.createDataFrame([("example.net", "", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://example.net"), (2, "http://a.example.net/x")], "page_id long, url string")
    assert {r.verdict for r in urlrules.judged(pages, rules).collect()} == {"block"}
