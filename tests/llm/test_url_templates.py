"""Path-template tree against brute force, with rejected, merged and variable branches."""

import math
import random
from collections import Counter, defaultdict

from textmill.llm.queries import URL_RULES
from textmill.llm.url_templates import ALPHA, DEPTH, LITERALS, NEUTRAL, REJECT_AT, SUPPORT, WEIGHT, filter_urls


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def fitting(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def alike(x, n, y, m):
    return not n or not m or abs(x / n - y / m) <= math.sqrt(math.log(2 / ALPHA) / 2) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def brute(urls, labels):
    rows = []
    for url, label in zip(urls, labels):
        host, path = split_url(url)
        rule = fitting(host, path)
        bad = int(rule.verdict == "block") if rule else label
        rows.append({"host": host, "path": path, "rule": rule, "bad": bad, "seg": path.split("/")[1:] if path else [], "node": "", "done": False})
    purity = lambda own, above: (sum(r["bad"] or 0 for r in own) + WEIGHT * above) / (sum(r["bad"] is not None for r in own) + WEIGHT)
    for own in grouped(rows, lambda r: r["host"]).values():
        p = purity(own, NEUTRAL)
        for r in own:
            r["p"] = p
    for level in range(1, DEPTH + 1):
        for own in grouped([r for r in rows if not r["done"]], lambda r: (r["host"], r["node"])).values():
            kids = grouped(own, lambda r: "$" if len(r["seg"]) < level else "=" + r["seg"][level - 1])
            literal = {k: v for k, v in kids.items() if k != "$" and len(v) >= SUPPORT and len(v) * LITERALS >= len(own)}
            facts = {k: [len(v), sum(r["bad"] is not None for r in v), sum(r["bad"] or 0 for r in v), sum(len(r["seg"]) > level for r in v),
                         sum(any(c in "0123456789" for c in (r["seg"][level:] or [""])[0]) for r in v)] for k, v in literal.items()}
            label = {}
            for k in kids:
                if k in literal:
                    c, lab, bad, on, dig = facts[k]
                    o = [sum(x) - y for x, y in zip(zip(*facts.values()), facts[k])]
                    same = len(literal) > 1 and alike(lab, c, o[1], o[0]) and alike(bad, lab, o[2], o[1]) and alike(on, c, o[3], o[0]) and alike(dig, c, o[4], o[0])
                    label[k] = "~" if same else k
                else:
                    label[k] = "$" if k == "$" else "*"
            for name, parts in grouped(kids.items(), lambda x: label[x[0]]).items():
                branch = [r for _, part in parts for r in part]
                p = purity(branch, branch[0]["p"])
                for r in branch:
                    r.update(p=p, node=r["node"] + "/" + name, done=name == "$")
    return [(r["host"], r["path"], r["rule"] and r["rule"].host + r["rule"].path, r["host"] + r["node"], r["rule"].verdict if r["rule"] else "block" if r["p"] >= REJECT_AT else "allow") for r in rows]


def grouped(items, key):
    out = defaultdict(list)
    for x in items:
        out[key(x)].append(x)
    return out


ODD = [None, "", "no scheme", "http://", "HTTP://A.Org", "https://ORG/x", "http://borg/en/", "http://a.example.org/en/1#x", "http://a.example.org/es/?q", "x://y://z.com/de/", "http://u.com?a/fr/", "http://h.net//a//b/",
       "http://é.com/fr/É", "http://h.net/" + "a/" * 3000, "http://h.net/*/~/$", "http://x.net/a\nb/c"]


def test_against_brute_force(spark):
    r = random.Random(3)
    urls = ODD + [f"http://{r.choice(['a', 'b', 'c'])}.{r.choice(['net', 'com', 'org', 'example.org'])}/{r.choice(['en', 'fr', 'de', 'es'])}/{r.choice(['', 'p/', 'q/', str(r.randrange(9)) + '/'])}{r.randrange(2000)}{r.choice(['', '/', '.html', '?x=/y'])}" for _ in range(1500)]
    labels = [r.choice([None, 0, int("/q/" in (u or ""))]) for u in urls]
    rows = [(k, u, b, "host", k) for k, (u, b) in enumerate(zip(urls, labels))]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int, host string, `a-b` int")
    got = {x["page_id"]: x for x in filter_urls(df, URL_RULES, label_col="bad").collect()}
    want = brute(urls, labels)
    for k, w in enumerate(want):
        x = got[k]
        assert (x["host"], x["path"], x["rule"], x["template"], x["verdict"]) == w, urls[k]
    assert len(got) == len(urls) and {w[4] for w in want if w[2] is None} == {"allow", "block"}


def test_templates_are_rejected_by_their_examples(spark):
    """Of one host, the pages of a template whose examples are bad go, those of
    others stay, and branches that behave alike share their examples."""
    rows = [(f"http://h.net/shop/{k}/buy", 1 if k < 40 else None) for k in range(80)]
    rows += [(f"http://h.net/news/{k}.html", 0 if k < 40 else None) for k in range(80)]
    rows += [(f"http://h.net/{x}/{k}.html", 0 if k < 10 else None) for x in ("blog", "wiki") for k in range(30)]
    rows += [(f"http://other.net/{k}", None) for k in range(50)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "page_id long, url string, bad int")
    got = filter_urls(df, [], label_col="bad").collect()
    assert {x["template"] for x in got} == {"h.net/=shop/*/=buy/$", "h.net/=news/*/$", "h.net/~/*/$", "other.net/*/$"}
    assert all((x["verdict"] == "block") == ("/=shop/" in x["template"]) for x in got)


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "http://a.com/de/1"), (4, "http://a.com/de/1"), (4, "http://a.com/de/1"), (None, None)], "page_id long, url string")
    done = filter_urls(df, URL_RULES)
    assert Counter((x["page_id"], x["verdict"]) for x in done.collect()) == Counter({(None, "block"): 1, (4, "block"): 2, (None, "allow"): 1})
    assert filter_urls(df.limit(0), URL_RULES).collect() == []
    assert not any(word in done._jdf.queryExecution().toString() for word in ("Python", "Arrow", "Pandas"))
