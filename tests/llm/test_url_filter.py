import re
from collections import defaultdict

from pyspark.sql import functions as F

from sparkloom.llm import url_filter as U
from sparkloom.llm.queries import RULES, op5_url_filter


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        n = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:].split("?")[0].split("#")[0]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_query_against_brute_force(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op5_url_filter(spark, sf).collect()
    assert len(rows) == len(pages)
    labels = {r.doc_id: int(r.quality == 0 or r.toxic == 1) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    hosts = defaultdict(lambda: [0, 0])
    for u in pages.values():
        host, path = brute(u)[:2]
        shown = re.match("/[^/]*/([0-9]{1,18})", path)
        hosts[host][0] += bool(shown) and int(shown[1]) in labels
        hosts[host][1] += labels.get(int(shown[1]), 0) if shown else 0
    blocked = brute_blocked(hosts, U.Reputation())
    for r in rows:
        want = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == want[:3]
        assert r.verdict == (want[3] or ("block" if r.host in blocked else "allow"))


def brute_blocked(hosts, p):
    means, strength = brute_levels(hosts, p)
    share = sum(b for _, b in hosts.values()) / max(1, sum(n for n, _ in hosts.values()))
    bound = {h: m - p.z * (m * (1 - m) / (hosts[h][0] + strength + 1)) ** 0.5 for h, m in means.items()}
    return {h for h, x in bound.items() if max(0.0, x) > (share if p.limit is None else p.limit)}


def brute_levels(hosts, p):
    """hosts: {host: (n, bad)}; posterior means level by level, with the moments' strengths; and the hosts' strength."""

    def strength(units):
        two = [(n, b, m) for n, b, m in units if n >= 2]
        if not two or sum(n * m * (1 - m) for n, _, m in two) <= 0:
            return p.least
        total = sum(n for n, _, _ in two)
        seen = sum(n * (b / n - m) ** 2 for n, b, m in two) / total
        whole, one = sum(n * m * (1 - m) for n, _, m in two) / total, sum(m * (1 - m) for _, _, m in two) / total
        between = (seen - one) / max(whole - one, 1e-12)
        return min(p.most, max(p.least, 1 / between - 1)) if between > 0 else p.most

    def suffix(h, k):
        parts = h.split(".")
        two = len(parts) >= 3 and len(parts[-1]) == 2 and parts[-2] in U._SECOND
        return ".".join(parts[-(k + two) :])

    total, bad = sum(x[0] for x in hosts.values()), sum(x[1] for x in hosts.values())
    above = {h: bad / total if total else 0.0 for h in hosts}
    for key in (lambda h: suffix(h, 1), lambda h: suffix(h, 2), lambda h: h):
        sums, up = defaultdict(lambda: [0, 0]), {}
        for h, (n, b) in hosts.items():
            sums[key(h)][0] += n
            sums[key(h)][1] += b
            up[key(h)] = above[h]
        k = strength([(*sums[u], up[u]) for u in sums])
        means = {u: (sums[u][1] + k * up[u]) / (sums[u][0] + k) for u in sums}
        above = {h: means[key(h)] for h in hosts}
    return above, k


def test_reputations_against_brute_force(spark):
    rows, bad = [], []
    hosts = {"a.spam.net": (40, 38), "b.spam.net": (5, 5), "c.spam.net": (0, 0), "good.org": (60, 1), "x.co.uk": (10, 2), "www.x.co.uk": (3, 3), "": (2, 0), "single": (1, 1)}
    for h, (n, b) in hosts.items():
        for i in range(n + 1):
            rows.append((len(rows), h))
            if i < n:
                bad.append((rows[-1][0], int(i < b)))
    got = U.reputations(spark.createDataFrame(rows, "_key long, _host string"), spark.createDataFrame(bad, "_key long, bad int"), U.Reputation(z=2.0)).collect()
    want = brute_levels(hosts, U.Reputation())[0]
    assert {r.host: round(r["mean"], 9) for r in got} == {h: round(m, 9) for h, m in want.items()}
    assert all(r.bound <= r["mean"] for r in got)
    assert {r.host for r in got if r.bound > 0.5} >= {"a.spam.net"} and not {r.host for r in got if r.bound > 0.5} & {"good.org", "", "x.co.uk"}


def test_posterior_decides(spark):
    """Hosts of a bad and a good domain; a new host stands on its domain; verdicts equal brute force."""
    counts = {f"h{i}.bad.net": (20, 14 + i % 3) for i in range(6)} | {f"h{i}.good.net": (20, i % 3) for i in range(9)} | {"new.bad.net": (0, 0), "new.good.net": (0, 0)}
    pages, out = [], []
    for h, (n, b) in counts.items():
        for i in range(n + 1):
            pages.append((len(pages), f"https://{h}/p/{i}"))
            if i < n:
                out.append((len(pages) - 1, int(i < b)))
    rows = U.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(out, "page_id long, bad int"), []).collect()
    blocked = brute_blocked(counts, U.Reputation())
    assert {r.host for r in rows if r.verdict == "block"} == blocked == {h for h in counts if "bad" in h}


def test_registered_domains(spark):
    names = {"a.b.co.uk": ("co.uk", "b.co.uk"), "u:p@x.y.com:8080": ("com", "y.com"), "192.168.0.1": ("192.168.0.1",) * 2, "x.y.org.": ("org", "y.org"), "": ("", ""), "h": ("h", "h"), "[::1]:80": ("[::1]",) * 2}
    df = spark.createDataFrame([(h,) for h in names], "h string").select("h", *U.suffix_domain(F.col("h")))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == names


def test_edges(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.com/en/7a?x#y", "http://com/en/", "http://xcom/en/", "http://a.COM#/en/", "http://É.org/es/ä?b", "http://h/" + "x" * 50000, "a://b://c/d", "http://example.net/de/81"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, urls[5]])] + [(None, urls[5], "y")], "page_id long, url string, host string")
    out = spark.createDataFrame([(5, 1), (5, None), (None, 1), (99, 1)], "page_id long, bad int")
    for outcomes in (out, out.filter("false")):
        got = U.judge(df, outcomes, RULES).collect()
        assert len(got) == len(urls) + 2
        for r in got:
            want = brute(urls[r.page_id] if r.page_id is not None and r.page_id < len(urls) else urls[5])
            assert (r.host, r.path, r.rule) == want[:3] and (want[3] is None or r.verdict == want[3])
    assert U.judge(df.filter("false"), out, RULES).count() == 0
    assert {r.rule for r in U.judge(df, out, []).collect()} == {None}
