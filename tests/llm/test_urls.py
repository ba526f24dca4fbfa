import re
from urllib.parse import unquote

from matchloom.llm.url_filter import LISTED, RULES, filter_urls, production_lists

URLS = [
    None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://WWW.Example.NET/en/1?x=/de/", "https://example.net/en", "https://xexample.net/en/", "ftp://example.com/de/x#y",
    "http://m.example.com/de/", "http://example.com/DE/", "http://a.org/fr/1", "http://org/fr/", "http://cheap-pills.example.com/en/1", "http://x.spam-farm.example.org/fr/2",
    "http://spam-farm.example.org", "x://y://z.net/", "http://É.net/ü?", "http://user@a.net:80/", "http://a.net:80/", "http://" + ".".join(["a"] * 200) + ".net/", "http://.net/", "http:///path", "://?",
] + [f"http://h{k}.example.net/p{k}" for k in range(60)]


def brute(url, rules, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")

    def fits(entry, host=host, path=path):
        h, p = entry.split("/")[0], entry[entry.index("/") :]
        return (host == h or host.endswith("." + h)) and path.startswith(p)

    best = max((e for e, _ in rules if fits(e)), key=len, default=None)
    plain = canonical(host, path)
    return host, path, best, dict(rules)[best] if best else "block" if any(fits(e, *plain) for e in listed) else "allow"


def canonical(host, path):
    host = re.sub(r":[0-9]*$", "", host.rsplit("@", 1)[-1]).rstrip(".")
    try:
        path = unquote(path, errors="strict")
    except UnicodeDecodeError:
        pass
    done = []
    for part in path.split("/"):
        if part == "..":
            done = done[:-1]
        elif part not in ("", "."):
            done.append(part)
    return host, "/" + "/".join(done) + ("/" if done and path.rsplit("/", 1)[-1] in ("", ".", "..") else "")


def test_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "html", "x") for k, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, *production_lists(spark)).collect()}
    assert got == {k: brute(u, RULES, LISTED) for k, u in enumerate(URLS)}


def test_other_spellings_of_listed_urls(spark):
    listed = ["cheap-pills.example.com/", "a.example.org/bad/", "b.example.org/x y/"]
    same = ["http://cheap-pills.example.com:80/a", "http://cheap-pills.example.com./x", "http://cheap-pills.example.com", "http://cheap-pills.example.com?q", "http://me:pw@Cheap-Pills.example.com:/", "http://a.example.org/%62ad/1",
            "http://a.example.org/good/../bad/", "http://a.example.org//bad/./x", "http://a.example.org/bad/.", "http://www.b.example.org/x%20y/?z"]
    other = ["http://a.example.org/bad", "http://a.example.org/bad/..", "http://b.example.org/x+y/", "http://xcheap-pills.example.com/", "http://a.example.org/%zz", "http://a.example.org/../ba%64", "http://cheap-pills.example.com.net/"]
    long = ["http://a.example.org/" + "x/../" * 20_000 + "bad/", "http://" + "sub." * 20_000 + "cheap-pills.example.com/", "http://c.example.org/" + "y" * 100_000]
    urls = same + other + long
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "entry string, verdict string")
    got = {r.page_id: r.verdict for r in filter_urls(pages, none, spark.createDataFrame([(x,) for x in listed], "entry string")).collect()}
    assert [got[k] for k in range(len(urls))] == ["block"] * len(same) + ["allow"] * len(other) + ["block", "block", "allow"]
    assert [got[k] for k in range(len(urls))] == [brute(u, [], listed)[3] for u in urls]


def test_list_from_a_table(spark, tmp_path):
    spark.createDataFrame([("c.example.com/", 1)], "entry string, other int").write.parquet(str(tmp_path / "listed"))
    pages = spark.createDataFrame([(1, "http://c.example.com:8080"), (2, "http://d.example.com")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in filter_urls(pages, *production_lists(spark, str(tmp_path / "listed"))).collect()} == {1: "block", 2: "allow"}


def test_tiny_filter_is_still_exact(spark):
    rules = [(f"h{k}.example.net/p{k}", "allow" if k % 2 else "block") for k in range(0, 2000, 2)] + [("h2.example.net/", "allow")]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string")
    listed = spark.createDataFrame([], "entry string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, spark.createDataFrame(rules, "entry string, verdict string"), listed, 64).collect()}
    assert got == {k: brute(u, rules, []) for k, u in enumerate(URLS)}


def test_empty_sides(spark):
    none = spark.createDataFrame([], "entry string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in filter_urls(pages, none, none.select("entry")).collect()] == [(None, "allow")] * 2
    assert filter_urls(pages.limit(0), *production_lists(spark)).collect() == []
