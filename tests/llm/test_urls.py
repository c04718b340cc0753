import re

from convolens.llm import urls

RULES = urls.RULES


def split(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lowered, path, lowered + re.match(r"[^#]*", rest[len(host):])[0]


def rule_of(host, path):
    fitting = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting)[1:] if fitting else (None, None)


def expected(pages, links):
    """links: (from url, to url), already absolute."""
    near = {}
    for a, b in links:
        a, b = split(a)[2], split(b)[2]
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for page, url in pages:
        host, path, address = split(url)
        rule, verdict = rule_of(host, path)
        if verdict is None:
            reached, todo = {address}, [address]
            while todo:
                for other in near.get(todo.pop(), ()):
                    if other not in reached:
                        reached.add(other)
                        todo.append(other)
            told = set()
            if address in near:
                for r in reached:
                    told.add(rule_of(re.match(r"[^/?#]*", r)[0], re.sub(r"^[^/?#]*", "", r).split("?")[0])[1])
            verdict = "block" if "block" in told and "allow" not in told else "allow"
        out.append((page, host, path, rule, verdict))
    return sorted(out, key=str)


def canonical(href, quote='"'):
    return f"<html><HEAD><link rel={quote}canonical{quote} href={quote}{href}{quote}></head>"


PAGES = [
    (1, "http://a.com/x", canonical("https://b.net/y?q=1&amp;r=2#f")), (2, "http://B.net/y?q=1&r=2", None),
    (3, "https://c.com/de/1", "<meta http-equiv='refresh' content='0; url=http://a.com/x'>"),
    (4, "http://d.com/p/q", canonical("r?z=1", "'")), (5, "http://d.com/p/r?z=1", canonical("//EXAMPLE.com/de/k")),
    (6, "http://e.com/1", canonical("http://blog.example.com/de/9")), (7, "http://e.com/2", canonical("/1")),
    (8, "http://e.com/3", canonical("http://x.example.net/en/ok")), (9, "https://e.com/3#top", canonical("http://e.com/2")),
    (10, "http://www.example.net/EN/x", ""), (11, "http://www.example.net/en/x", "<link rel=stylesheet href=http://z.net/>"),
    (12, None, canonical("http://b.net/")), (13, "no scheme", None), (14, "http://net", None), (15, "http://net/", None),
    (16, "http://q.org/fr/?a://b", None), (17, "x://y://z/w", None), (18, "http://notexample.com/de/", None), (19, "", ""),
    (20, "http://self.com/a", canonical("#top")), (20, "http://self.com/a", canonical("#top")),
    (None, "http://d.com/p/q", "x" * 200_000), (21, "HTTP://d.com?x=1", "<link href=http://b.net/only data-x='1' rel=canonical>"),
    (22, "http://far.com/1", None), (23, "http://far.com/2", None),
    (24, "http://dot.com/a/b/c", canonical("../../x/./y/../z/..?q=/../")), (25, "http://dot.com/x/?q=/../", canonical("../../../up.net/./k")),
    (26, "http://dot.com/a/1", canonical("../../de/../..")), (27, "http://dot.com/", canonical("//example.com/en/.././de/k")),
    (28, "http://based.com/p/1", "<base target=_top href='http://other.com/de/'>" + canonical("../q")),
    (29, "http://other.com/q", canonical("http&#58;&#x2F;/b.net&#47;only")),
    (30, "http://mail.com/1", canonical("mailto:x@b.net")), (31, "http://mail.com/mailto:x@b.net", canonical("http://b.net/")),
    (32, "http://based.com/p/2", "<base href='/n/'>" + canonical("#top") + canonical("s")), (33, "http://based.com/n/s", canonical("http://b.net/")),
]
LINKS = [
    (PAGES[0][1], "https://b.net/y?q=1&r=2"), (PAGES[2][1], "http://a.com/x"), (PAGES[3][1], "http://d.com/p/r?z=1"),
    (PAGES[4][1], "http://EXAMPLE.com/de/k"), (PAGES[5][1], "http://blog.example.com/de/9"), (PAGES[6][1], "http://e.com/1"),
    (PAGES[7][1], "http://x.example.net/en/ok"), (PAGES[8][1], "http://e.com/2"), ("HTTP://d.com?x=1", "http://b.net/only"),
    ("http://self.com/a", "http://self.com/a"),
    ("http://dot.com/a/b/c", "http://dot.com/x/?q=/../"), ("http://dot.com/x/?q=/../", "http://dot.com/up.net/k"),
    ("http://dot.com/a/1", "http://dot.com/"), ("http://dot.com/", "http://example.com/de/k"),
    ("http://based.com/p/1", "http://other.com/q"), ("http://other.com/q", "http://b.net/only"),
    ("http://mail.com/mailto:x@b.net", "http://b.net/"), ("http://based.com/p/2", "http://based.com/n/s"),
    ("http://based.com/n/s", "http://b.net/"),
]
SCHEMA = "page_id long, url string, html string, host string, address int"


def test_verdicts_by_brute_force(spark):
    frame = spark.createDataFrame([(*p, "h", 1) for p in PAGES], SCHEMA)
    got = sorted((tuple(r) for r in urls.judge(frame).collect()), key=str)
    assert got == expected([p[:2] for p in PAGES], LINKS)
    verdicts = {r[0]: r[4] for r in got}
    assert [verdicts[i] for i in (1, 4, 5, 20, 21)] == ["block", "block", "block", "allow", "block"]
    # One member of the class is explicitly allowed.
    assert [verdicts[i] for i in (6, 7, 8)] == ["allow"] * 3


def test_redirect_table(spark):
    frame = spark.createDataFrame([(*p, "h", 1) for p in PAGES], SCHEMA)
    more = [("http://far.com/1", "https://mid.com/"), ("http://mid.com/", "http://far.com/2"), ("http://far.com/2", "http://t.net/x"),
            (None, "http://far.com/1")]
    got = urls.judge(frame, redirects=spark.createDataFrame(more, "from_url string, to_url string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected([p[:2] for p in PAGES], LINKS + more[:3])


def test_empty_and_native(spark):
    frame = spark.createDataFrame([(*p, "h", 1) for p in PAGES], SCHEMA)
    assert urls.judge(frame.limit(0)).count() == 0
    plan = urls.judge(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_dot_segments(spark):
    paths = ["/", "", "/a/./b", "/a/../b", "/a/b/../../c", "/../../a", "/a/..", "/a/.", "/a//../b", "/.../..a/.b", "/a/b/c/../../../../d/..",
             "/a/.//../b", "/./a/./", "/a/../b/../c/..", "/x/a../b"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in frame.select(urls.without_dots(frame.p)).collect()]

    def slow(path):
        out = []
        parts = path.split("/")[1:]
        for part in parts:
            if part == "..":
                out = out[:-1]
            elif part != ".":
                out.append(part)
        if parts and parts[-1] in (".", ".."):
            out.append("")
        return "".join("/" + part for part in out)
    assert got == [slow(p) for p in paths]
