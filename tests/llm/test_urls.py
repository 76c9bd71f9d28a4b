import itertools
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tamarack.llm import urls
from tamarack.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def ruled(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x#y", "http://example.com/en/71", "http://example.com/en/8", "http://xexample.com/en/7", "http://com/en/"]
URLS += ["http://a.net/de/8", "http://example.net/de/8/z", "http://b.example.net/de/81", "http://É.org/es/1", "http://a.org?x=/es/", "http://a.org#://b.net/de/", "ftp://u@h.org:80/es//2", "a://b://c.org/es/1", "http://c.org/a\nb"]


def test_parts_and_rules(spark):
    data = list(enumerate(URLS)) + [(None, URLS[4]), (4, URLS[4])]
    found = urls.judge(spark.createDataFrame([(k, u, "z") for k, u in data], "page_id long, url string, URL string"), URL_RULES).collect()
    want = Counter()
    for key, url in data:
        host, path = split(url)
        want[key, host, path, *ruled(host, path)] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in found) == want
    assert {r.verdict for r in found} == {"allow", "block"}


def test_templates(spark):
    bad = [f"http://h.org/spam/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}/view" for i in range(60)]
    good = [f"http://h.org/news/2024/{i}" for i in range(60)]
    mixed = [f"http://h.org/forum/{i}" for i in range(60)]
    data = [(u, True) for u in bad[:30]] + [(u, None) for u in bad[30:]] + [(u, False) for u in good[:30]] + [(u, None) for u in good[30:]]
    data += [(u, i % 2 == 0) for i, u in enumerate(mixed[:40])] + [(u, None) for u in mixed[40:]] + [("http://other.org/spam/ak/view", None)]
    frame = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(data)], "page_id long, url string, b boolean")
    labels = {u: b for u, b in data}
    label = F.coalesce(*(F.when(F.col("url").isin([u for u, b in labels.items() if b is x]), x) for x in (True, False)))
    verdict = {r.page_id: r.verdict for r in urls.judge(frame, [], bad=label).collect()}
    assert all(verdict[i] == ("block" if "h.org/spam" in u and "other" not in u else "allow") for i, (u, _) in enumerate(data))


def test_branches_without_labels(spark):
    data = [(f"http://a.com/en/{i}", True) for i in range(20)] + [("http://a.com/fr/1", None), ("http://a.com/fr/x/1", None), ("http://a.com/", None)]
    data += [(f"http://b.com/en/{i}", False) for i in range(20)] + [("http://b.com/fr/1", None), ("http://c.com/fr/1", None)]
    data += [(f"http://d.com/en/{i}", i % 2 == 0) for i in range(20)] + [("http://d.com/fr/1", None)]
    # the nearest node that has labels decides, not the host
    data += [(f"http://e.com/bad/en/{i}", True) for i in range(20)] + [(f"http://e.com/good/en/{i}", False) for i in range(20)]
    data += [("http://e.com/bad/fr/1", None), ("http://e.com/good/fr/1", None), ("http://e.com/new/fr/1", None), ("http://f.com/en/1", True), ("http://f.com/fr/1", None)]
    frame = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(data)], "page_id long, url string, b boolean")
    label = F.coalesce(*(F.when(F.col("url").isin([u for u, b in data if b is x]), x) for x in (True, False)))
    verdict = {r.page_id: r.verdict for r in urls.judge(frame, [], bad=label).collect()}
    blocked = {u for i, (u, b) in enumerate(data) if b is None and verdict[i] == "block"}
    assert blocked == {"http://a.com/fr/1", "http://a.com/fr/x/1", "http://a.com/", "http://e.com/bad/fr/1"}


def test_rules_reach_pages_without_rule(spark):
    data = [f"http://x.com/en/{i}" for i in range(5)] + ["http://x.com/fr/1"] + [f"http://x.net/de/{i}" for i in range(5)] + ["http://x.net/fr/1"]
    found = urls.judge(spark.createDataFrame(list(enumerate(data)), "page_id long, url string"), URL_RULES).collect()
    assert {data[r.page_id]: r.verdict for r in found if r.rule is None} == {"http://x.com/fr/1": "block", "http://x.net/fr/1": "allow"}


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_deep_paths(spark):
    """Branches below the tenth segment tell, wildcards there too, and a very long path does no harm."""
    at = "http://h.org/" + "/".join("abcdefghij")
    words = ["".join(x) for x in itertools.product("klmnop", repeat=2)]
    data = [(f"{at}/spam/{w}/view", True if i < 20 else None) for i, w in enumerate(words)] + [(f"{at}/news/{w}/view", False if i < 20 else None) for i, w in enumerate(words)]
    data += [(at + "/x" * 400, None), (f"{at}/spam/zz/other", None)]
    frame = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(data)], "page_id long, url string, b boolean")
    label = F.coalesce(*(F.when(F.col("url").isin([u for u, b in data if b is x]), x) for x in (True, False)))
    verdict = {r.page_id: r.verdict for r in urls.judge(frame, [], bad=label).collect()}
    assert {u for i, (u, _) in enumerate(data) if verdict[i] == "block"} == {u for u, _ in data if "/spam/" in u}


def brute(data):
    """Rejected (host, shape) of (host, path, label) rows, by trees of plain dictionaries."""
    shapes = Counter()
    bad, good = Counter(), Counter()
    for host, path, label in data:
        shape = tuple(urls.WILDCARD if re.search(urls.VARIABLE, x) else x for x in path.split("/") if x)
        shapes[host, shape] += 1
        bad[host, shape] += label is True
        good[host, shape] += label is False
    template = {k: k[1] for k in shapes}
    for depth in range(max((len(s) for _, s in shapes), default=0)):
        visits = defaultdict(Counter)
        for (host, shape), t in template.items():
            if len(t) > depth and t[depth] != "*":
                visits[host, t[:depth]][t[depth]] += shapes[host, shape]
        for (host, shape), t in list(template.items()):
            below = visits[host, t[:depth]]
            if len(t) > depth and len(below) >= urls.FANOUT and sum(below.values()) < urls.RECURRENCE * len(below):
                template[host, shape] = t[:depth] + ("*",) + t[depth + 1 :]
    sums = defaultdict(lambda: [0, 0])
    for (host, shape), t in template.items():
        for k in range(len(t) + 1):
            sums[host, t[:k], "above"][0] += bad[host, shape]
            sums[host, t[:k], "above"][1] += good[host, shape]
        sums[host, t][0] += bad[host, shape]
        sums[host, t][1] += good[host, shape]
    families = defaultdict(lambda: [0, 0, 0.5])
    of = {}
    for host, t in {(h, t) for (h, _), t in template.items()}:
        b, g = sums[host, t]
        n = b + g
        kind = "none"
        if n:
            share, z = b / n, urls.Z
            centre, reach = (b + z * z / 2) / (n + z * z), z * (n * share * (1 - share) + z * z / 4) ** 0.5 / (n + z * z)
            kind = "bad" if centre - reach > 0.5 else "good" if centre + reach < 0.5 else "open"
        last = max((i for i, x in enumerate(t) if x != "*"), default=-1)
        key = host, tuple("+" if i == last else x for i, x in enumerate(t)), kind
        of[host, t] = key
        prior = 0.5
        for k in range(max(last, 0) + 1):
            p, q = sums[host, t[:k], "above"]
            prior = (p + prior * urls.SMOOTHING) / (p + q + urls.SMOOTHING)
        families[key][0] += b
        families[key][1] += g
        families[key][2] = prior
    gone = {k for k, (b, g, prior) in families.items() if (b + prior * urls.SMOOTHING) / (b + g + urls.SMOOTHING) >= urls.PURITY}
    return {k for k, t in template.items() if of[k[0], t] in gone}


def test_verdicts_like_brute_force(spark):
    rng = random.Random(6)
    data = []
    for host in ("a.com", "b.org", "c.net"):
        names = ["".join(rng.choices("abcdef", k=3)) for _ in range(60)]
        lean = {x: rng.choice([0.05, 0.5, 0.95]) for x in "xyzuvw"}
        for _ in range(400):
            top = rng.choice("xyzuvw")
            tail = rng.choice([[], [rng.choice(names)], [str(rng.randrange(99)), "view"], [rng.choice(names), "p", rng.choice(names)]])
            label = None if rng.random() < 0.5 else rng.random() < lean[top]
            data.append((host, "/" + "/".join([top, *tail]), label))
    gone = brute(data)
    frame = spark.createDataFrame([(i, f"http://{h}{p}", b) for i, (h, p, b) in enumerate(data)], "page_id long, url string, b boolean")
    # a label belongs to a row here, so that equal URLs may have different ones
    rows = frame.select("page_id", F.concat("url", F.lit("#"), F.coalesce(F.col("b").cast("string"), F.lit("none"))).alias("url"))
    mark = F.regexp_extract("url", "#(.*)$", 1)
    verdict = {r.page_id: r.verdict for r in urls.judge(rows, [], bad=F.when(mark != "none", mark == "true")).collect()}
    for i, (host, path, _) in enumerate(data):
        shape = tuple(urls.WILDCARD if re.search(urls.VARIABLE, x) else x for x in path.split("/") if x)
        assert (verdict[i] == "block") == ((host, shape) in gone)
    assert set(verdict.values()) == {"allow", "block"}
