"""URL rules and trust propagation against plain Python."""

import random
import re
from collections import Counter

from herdspark.llm import url_filter

SCHEMA = "page_id bigint, url string, html string, host int, ruled string"


def plain(rows, rules=url_filter.RULES, rounds=url_filter.ROUNDS, a=url_filter.DAMPING):
    judged = []
    for page, url, html in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.split("[/?#]", rest)[0])
            path = re.split("[?#]", rest[len(host) :])[0]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        judged.append((page, host, path, best.text if best else None, best.verdict if best else None, html))
    pages = Counter(j[1] for j in judged if j[1])
    good, bad = (Counter(j[1] for j in judged if j[1] and j[4] == v) for v in ("allow", "block"))
    weight = Counter()
    for host, n in pages.items():
        labels = host.split(".")
        while len(labels) > 2:
            child, labels = ".".join(labels), labels[1:]
            weight[child, ".".join(labels)] += n
            weight[".".join(labels), child] += n
    for _, host, _, _, _, html in judged:
        for dst in re.findall(r"""href="https?://([^/"]+)""", html or ""):
            if host and dst != host:
                weight[host, dst] += 1
    out, into = Counter(), Counter()
    for (s, d), w in weight.items():
        out[s] += w
        into[d] += w
    seeds = [{h: n / max(1, sum(c.values())) for h, n in c.items()} for c in (good, bad)]
    trust, distrust = (dict(s) for s in seeds)
    for _ in range(rounds):
        t, d = ({h: x * (1 - a) for h, x in s.items()} for s in seeds)
        for (src, dst), w in weight.items():
            t[dst] = t.get(dst, 0) + a * trust.get(src, 0) * w / out[src]
            d[src] = d.get(src, 0) + a * distrust.get(dst, 0) * w / into[dst]
        trust, distrust = t, d
    total = sum(pages.values())
    blocked = {
        h for h in pages
        if round(distrust.get(h, 0), 12) > round(trust.get(h, 0), 12) and round(distrust.get(h, 0) * total / pages[h], 9) >= url_filter.LEAST_LIFT
    }
    return sorted([(p, h, pa, r, v or ("block" if h in blocked else "allow")) for p, h, pa, r, v, _ in judged], key=repr)


def made():
    rng = random.Random(3)
    hosts = [f"{a}.{b}.example.{t}" for a in ("www", "m") for b in ("one", "two", "three") for t in ("com", "net", "org")] + ["x.test", "a.b.c.test", "farm.test"]
    rows = []
    for i in range(300):
        host = rng.choice(hosts)
        links = "".join(f'<a href="https://{rng.choice(hosts)}/p">l</a>' for _ in range(rng.randrange(3)))
        if host == "farm.test":
            links += '<a href="http://www.one.example.net/">bad</a>' * 5
        rows.append((i, f"https://{host}/{rng.choice(['en', 'de', 'fr'])}/{i}{rng.choice(['', '?q=/en/', '#x'])}", links))
    rows += [
        (900, None, None), (901, "", ""), (902, "no scheme", "x"), (903, "HTTP://EXAMPLE.NET", None), (904, "http://example.net/en", None),
        (905, "http://example.net/EN/", None), (906, "http://anet/", None), (907, "http://net/x", None), (908, "http://É.ORG/fr/a://b", None),
        (909, "a\n://x.org/fr/\n?z", "<a href=/rel>r</a>"), (909, "a\n://x.org/fr/\n?z", None), (None, "http://org?x", None), (910, "://", None),
    ]
    return rows


def test_pages(spark):
    rows = made()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    found = url_filter.judge(df)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = plain(rows)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert any(r[3] is None and r[4] == "block" for r in want)


def test_no_pages(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert url_filter.judge(df).count() == 0
    df = spark.createDataFrame([(1, "http://a.test/", None, 1, "x")], SCHEMA)
    assert [tuple(r) for r in url_filter.judge(df).collect()] == [(1, "a.test", "/", None, "allow")]
