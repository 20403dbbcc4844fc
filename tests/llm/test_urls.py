import duckdb
import pytest
from check import connect, differences

from panelrank.llm import queries, urls

RULES = queries.RULES


def page(i, url, *links):
    html = "".join(f'<p><a class=x HREF = "{link}">x</a>' for link in links)
    return (i, url, html)


PAGES = [
    page(1, "http://A.Good.org/fr/x?y#z", "https://b.com/1", "//b.com/2", "/inner", "#top"),
    page(2, "http://b.com/1", "http://c.com/", "http://b.com/self"),
    page(3, "http://c.com", "http://bad.net/x"),
    page(4, "https://farm.com/a", "http://bad.net/1", "http://worse.net", "mailto:x@y.z"),
    page(5, "https://farm.com/b", "HTTP://BAD.NET/2"),
    page(6, "http://bad.net/1?u=http://other.org/", "http://b.com"),
    page(7, "http://worse.net/"),
    page(8, "http://worse.net"),
    page(9, "http://www.example.net/en/7"),
    page(10, "http://notexample.net/en/7"),
    page(11, "http://example.net/english"),
    page(12, "http://example.com/de/"),
    page(13, "http://example.com/de"),
    page(14, "http://sub.example.com/de/1", "http://only-linked.com"),
    page(15, None),
    page(16, "no scheme.net/x"),
    page(17, ""),
    page(18, "://net/x"),
    page(19, "a://b://net/y"),
    (20, "http://null.html.com", None),
    (None, "http://x.org/fr/", ""),
    page(7, "http://worse.net/"),
]


def plain(pages):
    parts = []
    for i, url, html in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
            host, tail = rest[:cut].lower(), rest[cut:]
            path = tail[: next((k for k, c in enumerate(tail) if c in "?#"), len(tail))]
        fit = [
            (len(h + p), h + p, v)
            for h, p, v in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        parts.append((i, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None, html))
    hosts, links = {}, {}
    for _, host, _, _, verdict, html in parts:
        if host:
            hosts.setdefault(host, []).append(verdict)
            for link in {x.split('"')[0].lower() for x in (html or "").split('HREF = "')[1:]}:
                to = link.split("//", 1)[1].split("/")[0] if "//" in link else ""
                if to and to != host:
                    links.setdefault((host, to), set()).add(id(html))
    count = {}
    for _, host, _, _, _, html in parts:
        for to in {
            x.split('"')[0].lower().split("//", 1)[1].split("/")[0]
            for x in (html or "").split('HREF = "')[1:]
            if "//" in x.split('"')[0]
        }:
            if host and to and to != host:
                count[host, to] = count.get((host, to), 0) + 1
    names = set(hosts) | {b for _, b in count}
    t0 = {h: hosts.get(h, []).count("allow") / max(1, len(hosts.get(h, []))) for h in names}
    d0 = {h: hosts.get(h, []).count("block") / max(1, len(hosts.get(h, []))) for h in names}
    t, d = {h: 0.15 * x for h, x in t0.items()}, {h: 0.15 * x for h, x in d0.items()}
    for _ in range(200):
        nt, nd = {h: 0.15 * t0[h] for h in names}, {h: 0.15 * d0[h] for h in names}
        for (a, b), n in count.items():
            nt[b] += 0.85 * t[a] * n / sum(m for (x, _), m in count.items() if x == a)
            nd[a] += 0.85 * d[b] * n / sum(m for (_, y), m in count.items() if y == b)
        t, d = nt, nd
    return sorted(
        (
            (i, host, path, rule, verdict or ("block" if host and d[host] - t[host] > 0.075 else "allow"))
            for i, host, path, rule, verdict, _ in parts
        ),
        key=str,
    )


@pytest.mark.parametrize("rows", [200_000, 0])
def test_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(urls, "BROADCAST_ROWS", rows)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr(
        "*", "1 AS host", "2 AS trust", "'x' AS rule"
    )
    got = urls.judge(pages, RULES)
    found = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()]
    assert sorted(found, key=str) == plain(PAGES)
    by = {r[1]: r[4] for r in found}
    assert by["farm.com"] == "block" and by["b.com"] == "allow"


def test_sql_follows_links_too(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = queries.op7_url_filter(spark, str(tmp_path)).toPandas()
    assert differences(got, con.execute(queries.OP7_SQL).df()) is None


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op7_url_filter(spark, folder).toPandas()
    assert differences(got, connect(folder).execute(queries.OP7_SQL).df()) is None
    assert set(got.verdict) == {"allow", "block"} and got.rule.isna().any()


def test_empty_table_and_plan(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(pages, RULES).count() == 0
    plan = urls.judge(pages, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
