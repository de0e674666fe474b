import re

from marquee.llm import url_filter as u

URLS = ["http://A.Example.NET/en/1", "https://example.net/de/x?porn", "http://m.example.com/de/", "http://example.org/fr/a#b", "http://xexample.net", None, "", "no scheme/porn",
        "http://site.example.com/casino-poker", "http://site.example.com/casino", "http://casinos.example.com/pokers", "http://free.example.com/?q=download#free",
        "http://h.example.com:80/en/xxx", "://", "http://net/", "http://a.net?x/", "http://e.com/a://b.net/", "http://É.example.com/adultos", "HTTP://SPAM-FARM.example.org/", "http://x.org/" + "y" * 100_000 + "/warez"]


def plain(url):
    found = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]), found[2]) if found else ("", "")
    fitting = [(len(r), v, r) for v, r in u.RULES
               if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    low = (url or "").lower()
    terms = [[t for t in sorted(group) if re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", low)] for group in (u.STRICT, u.SOFT)]
    verdict = max(fitting)[1] if fitting else "block" if terms[0] or len(terms[1]) >= u.SOFT_HITS else "allow"
    return host, path, max(fitting)[2] if fitting else None, verdict, *terms


def test_matches_plain_version(spark):
    rows = [(i, url) for i, url in enumerate(URLS)] + [(None, URLS[8]), (3, URLS[3])]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, host string, verdict int")
    got = sorted((tuple(r) for r in u.judge_urls(pages).collect()), key=repr)
    assert got == sorted(((i, *plain(url)) for i, url in rows), key=repr)
    assert u.judge_urls(pages.limit(0)).count() == 0


def test_known_verdicts():
    verdicts = {url: plain(url)[2:4] for url in URLS}
    assert verdicts["http://A.Example.NET/en/1"] == ("example.net/en/", "allow")
    assert verdicts["https://example.net/de/x?porn"] == ("net/", "block")
    assert verdicts["http://example.org/fr/a#b"] == ("org/fr/", "allow")
    assert verdicts["http://site.example.com/casino"] == (None, "allow")
    assert verdicts["http://site.example.com/casino-poker"] == (None, "block")
    assert verdicts["http://casinos.example.com/pokers"] == (None, "allow")
