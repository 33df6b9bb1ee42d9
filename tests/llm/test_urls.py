import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from staytrail.llm import queries, urls

PAGES = "page_id long, url string, html string, host string, rule string, n long"
ODD = [None, "", "no scheme/at/all", "http://", "http://EXAMPLE.com", "http://Example.COM/en/x", "http://a.example.com/en/", "http://www.example.com/en/1",
       "http://x.www.example.com/en/1?q=/es/", "http://net/es/", "https://sub.net/fr/a#b", "http://internet/es/x", "ftp://xcom/", "http://x.com?y",
       "http://x.com#y", "http://x.com/", "a://b://c.com/d", "http://ÄB.com/É/", "http://host:80/es/\nline", "http://u.net/ES/", "://c.net/es/"]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    best = None
    for kind, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, kind)
    return best or (None, None)


def brute_shape(path):
    out = []
    for s in [x for x in path.split("/") if x]:
        hexed = re.fullmatch(r"[0-9a-fA-F-]{8,}", s) and re.search("[0-9]", s)
        out.append("<id>" if len(s) >= 32 or hexed else re.sub("[0-9]+", "<n>", s))
    return tuple(out[:4] + ["**"] * (len(out) > 4))


def brute_verdicts(rows, label):
    """Page -> (template, verdict) of the tree; label(host, path, rule) is True, False or None."""
    parsed = [(i, *brute_parts(u)) for i, u in rows]
    hosts = defaultdict(list)
    for k, (_, h, p) in enumerate(parsed):
        hosts[h].append((k, brute_shape(p), label(h, p)))

    out = {}

    def grow(members, depth, template):
        for k, s, _ in members:
            if len(s) <= depth:
                out[k] = template
        branches = defaultdict(list)
        for m in members:
            if len(m[1]) > depth:
                branches[m[1][depth]].append(m)
        total, named, bands = sum(map(len, branches.values())), defaultdict(list), defaultdict(list)
        info = {}
        for s, ms in branches.items():
            lab = [m[2] for m in ms if m[2] is not None]
            smooth = (sum(lab) + 1) / (len(lab) + 2)
            band = None if len(lab) < 5 else "good" if smooth < 0.1 else "fair" if smooth < 0.5 else "poor" if smooth < 0.9 else "bad"
            info[s] = (len(ms) < 10 or len(ms) < 0.01 * total, band, sum(lab), len(lab))
            if not info[s][0] and band:
                bands[band].append(s)
        for s, ms in branches.items():
            rare, band, bad, n = info[s]
            name = s
            if rare:
                name = "*"
            elif band:
                p = sum(info[x][2] for x in bands[band]) / sum(info[x][3] for x in bands[band])
                if abs(bad / n - p) <= 1.96 * (max(p * (1 - p), 1e-9) / n) ** 0.5:
                    name = "*" + band
            named[name] += ms
        for name, ms in named.items():
            grow(ms, depth + 1, f"{template}/{name}")

    for h, members in hosts.items():
        grow(members, 0, "")
    score = defaultdict(lambda: [0, 0])
    for h, members in hosts.items():
        for k, _, lab in members:
            if lab is not None:
                score[h, out[k]][0] += lab
                score[h, out[k]][1] += 1
    verdicts = []
    for k, (i, h, p) in enumerate(parsed):
        bad, n = score[h, out[k]]
        method = "block" if n >= 5 and (bad + 1) / (n + 2) >= 0.8 else "allow"
        rule, kind = brute_rule(h, p)
        verdicts.append((str(i), h, p, str(rule), kind or method, out[k]))
    return sorted(verdicts)


def corpus(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(900):
        host = rnd.choice(["shop.org"] * 4 + ["www.example.com", "a.example.com", "news.net", "blog.example.net", "few.org"])
        first = rnd.choice(["en", "es", "fr", "de", "spam", "spam", "ads", "tag%d" % rnd.randrange(99), "rare" + rnd.choice("abcdefghijklmn")])
        rest = rnd.choice(["", "/", f"/{rnd.randrange(9999)}", f"/{rnd.randrange(99)}/a/b/c/d/e", f"/{rnd.getrandbits(64):016x}", "/x.html?a=1", "/item/long" * 3])
        rows.append((i, f"https://{host}/{first}{rest}"))
    return rows + [(2000 + i, u) for i, u in enumerate(ODD)] + [(None, None), (5, "http://x.com/"), (5, "http://x.com/")]


def result(df):
    return sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict, r.template) for r in df.collect())


def pages(spark, rows):
    return spark.createDataFrame([(i, u, None, "clash", "clash", 1) for i, u in rows], PAGES)


def test_hosts_paths_rules_and_tree(spark):
    rows = corpus(1)
    want = brute_verdicts(rows, lambda h, p: {"block": True, "allow": False, None: None}[brute_rule(h, p)[1]])
    assert result(urls.judge_urls(pages(spark, rows))) == want


def test_given_labels(spark):
    rows = corpus(2)

    def label(h, p):
        return None if len(p) % 3 == 0 else p.startswith(("/spam", "/ads")) or (len(p) % 7 == 0)

    bad = F.when(F.length("path") % 3 == 0, None).otherwise(F.col("path").rlike("^/(spam|ads)") | (F.length("path") % 7 == 0))
    got = result(urls.judge_urls(pages(spark, rows), bad=bad))
    assert got == brute_verdicts(rows, label)
    assert {v for _, h, p, rule, v, _ in got if h == "shop.org" and p.startswith("/spam/") and rule == "None"} == {"block"}
    assert "allow" in {v for _, h, p, *_, v, _ in got if h == "shop.org" and p.startswith("/en/")}


def test_registered_query_does_not_judge_pages_by_their_neighbours(spark, tmp_path):
    """On .net the rules block /es/ and /fr/ and say nothing on the rest, which must not fall with them."""
    urls_ = [f"https://{h}.example.net/{first}/{i}" for h, n in (("a", 3), ("b", 6), ("c", 40)) for i in range(n)
             for first in ("es", "fr", "de", "en", f"tag{chr(97 + i % 26)}")]
    urls_ += [f"https://d.example.net/{first}/{i}" for i in range(6) for first in ("es", "fr")] + ["https://d.example.net/de/3308"]
    pages(spark, list(enumerate(urls_))).write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op4_url_filter(spark, str(tmp_path)).collect()
    assert len(out) == len(urls_) and {r.verdict for r in out if r.rule is None} == {"allow"}
    assert {r.verdict for r in out if r.rule} == {"block"}


def test_apart_still_rejects_bad_templates(spark):
    """Bad branches that are mostly labelled go, rare ones together; a mostly unlabelled one stays."""
    rows = [(i, f"https://shop.org/spam/{i}") for i in range(100)] + [(200 + i, f"https://shop.org/ads/{i}") for i in range(100)]
    rows += [(400 + i, f"https://shop.org/junk{chr(97 + i % 20)}/{i}") for i in range(40)]
    rows += [(500 + i, f"https://shop.org/own{chr(97 + i % 20)}/{i}") for i in range(40)]
    path, end = F.col("path"), F.col("path").substr(-1, 1)
    bad = F.when(path.rlike("^/(spam|junk)") & (end != "3"), True).when(path.startswith("/ads") & (end == "3"), True)
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages(spark, rows), bad=bad, apart=True).collect()}
    assert all(got[i] == ("block" if i < 100 or 400 <= i < 500 and i % 10 != 3 else "allow") for i, _ in rows)  # no label of junkd, junkn


def test_empty(spark):
    assert urls.judge_urls(spark.createDataFrame([], PAGES)).collect() == []
