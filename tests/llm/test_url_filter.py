import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from slideframe.llm import url_filter as uf


def brute(rows, damping=uf.DAMPING, steps=uf.STEPS):
    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        return low, re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]

    parts = [(i, *split(u), h or "") for i, u, h in rows]

    def rule(host, path):
        fit = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    edges = {}
    for _, host, _, html in parts:
        for u in re.findall(uf.LINK, html):
            dst = split("http:" + u if u.startswith("//") else u)[0]
            if host and dst and dst != host:
                edges[host, dst] = edges.get((host, dst), 0) + 1

    def flow(verdict, e):
        n, pages = {}, {}
        for _, host, path, _ in parts:
            pages[host] = pages.get(host, 0) + 1
            if rule(host, path)[1] == verdict:
                n[host] = n.get(host, 0) + 1
        seed = {h: c / pages[h] for h, c in n.items()}
        out = {}
        for (a, _), c in e.items():
            out[a] = out.get(a, 0) + c
        score = dict(seed)
        for _ in range(steps):
            new = dict(seed)
            for (a, b), c in e.items():
                if a in score:
                    new[b] = new.get(b, 0) + score[a] * c / out[a] * damping
            score = new
        return score

    trust, distrust = flow("allow", edges), flow("block", {(b, a): c for (a, b), c in edges.items()})
    out = []
    for i, host, path, _ in parts:
        r, v = rule(host, path)
        t, d = trust.get(host, 0), distrust.get(host, 0)
        out.append((i, host, path, r, v or ("block" if round(d - t, 9) > uf.THRESHOLD else "allow")))
    return out


def rows_of(n=150, seed=3):
    r = random.Random(seed)
    hosts = [f"h{i}.Example.{t}" for i in range(6) for t in ("org", "com", "net")] + ["net", "org", "com", "a.b:80"]
    paths = ["/de/1", "/fr/2?x=/de/", "/en/1", "/es/#a", "", "?q", "#x", "/en/2/", "/"]
    rows = []
    for i in range(n):
        links = "".join(f'<a class=x href="{r.choice(["http://", "https://", "//", "HTTP://"])}{r.choice(hosts)}{r.choice(paths)}">t</a>' for _ in range(r.randrange(4)))
        rows.append((i, f"http://{r.choice(hosts)}{r.choice(paths)}", f"<p>{links}<a href='/local'>x</a>"))
    farm = "".join(f'<a href="//spam{i}.com/de/">x</a>' for i in range(3))
    rows += [(500 + i, f"http://spam{i}.com/de/x", f'<a href="http://spam{(i + 1) % 3}.com/de/">y</a>') for i in range(3)] + [(600, "http://farm.net/a", farm), (601, "http://farm.net/b", "")]
    return rows + [(900, None, None), (901, "no scheme", ""), (902, "://", "x"), (None, "http://net/de/", None), rows[0], (903, "a\nb://H.org/x\ny", "")]


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


def test_against_brute_force_and_sql(spark, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("id", F.lit(2)).withColumn("trust", F.lit(2))
    want = sorted(brute(rows), key=key)
    assert {v for *_, r, v in want if r is None} == {"allow", "block"}
    for most in (uf.BROADCAST_ROWS, 0):
        monkeypatch.setattr(uf, "BROADCAST_ROWS", most)
        assert sorted((tuple(g)[:5] for g in uf.judge(df).collect()), key=key) == want
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})  # noqa: F841  read by name
    con = duckdb.connect()
    con.register("pages", pages)
    got = con.sql(uf.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, got), key=key) == want


def test_no_links_empty_and_plan(spark):
    df = spark.createDataFrame([(1, "http://x.net/", "<p>"), (2, "http://x.com/de/", None)], "page_id long, url string, html string")
    assert [g["verdict"] for g in uf.judge(df).orderBy("id").collect()] == ["allow", "block"]
    assert uf.judge(df.limit(0)).collect() == []
    plan = uf.judge(spark.createDataFrame(rows_of(30), df.schema))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
