"""URL filters against a plain Markov model."""

import hashlib
import math
from collections import Counter, defaultdict

from inkproof.llm import url_filter as U
from inkproof.llm.queries import URL_RULES

ROWS = [
    (1, "https://WWW.Example.ORG/es/1?q#f"),
    (2, "http://example.org/en/12"),
    (3, "http://example.org/en/2"),
    (4, "http://notexample.com/fr"),
    (5, "http://a.com/fr/x"),
    (6, "http://com/de/"),
    (7, None),
    (8, "no scheme/x"),
    (9, ""),
    (10, "http://b.net?x=http://y.org/"),
    (11, "http://b.net/é" + "z" * 3000),
    (5, "http://a.com/fr/x"),
    (None, "http://org/"),
    (12, "http://x.org"),
]


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "1 as score", "2 as gram")


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, path[:stop]


def plain_rule(host, path):
    fits = [
        (len(r), r, v)
        for r, v in URL_RULES
        for domain, rest in [r.split("/", 1)]
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest)
    ]
    return max(fits)[1:] if fits else (None, None)


def plain_held(url):
    return hashlib.md5((url or "").encode()).hexdigest()[0] in "012"


class Plain:
    def __init__(self, rows, order, support, letters):
        self.order, self.support, self.letters = order, support, letters
        self.counts = {v: defaultdict(Counter) for v in ("allow", "block")}
        for url, verdict in rows:
            text = padded(url, order)
            for i in range(order, len(text)):
                for k in range(order + 1):
                    self.counts[verdict][text[i - k : i]][text[i]] += 1

    def p(self, verdict, context, letter):
        below = self.p(verdict, context[1:], letter) if context else 1 / self.letters
        seen = self.counts[verdict].get(context)
        held = sum(sum(c[context].values()) for c in self.counts.values() if context in c) >= self.support or not context
        return (seen[letter] + len(seen) * below) / (sum(seen.values()) + len(seen)) if seen and held else below

    def score(self, url):
        text, total = padded(url, self.order), 0
        for i in range(self.order, len(text)):
            good, bad = (self.p(v, text[i - self.order : i], text[i]) for v in ("allow", "block"))
            total += round(1e6 * (math.log(good) - math.log(bad)))
        return int(total / (len(text) - self.order))


def padded(url, order):
    return "\x02" * order + (url or "") + "\x03"


def plain_threshold(scored):
    """From (score, verdict): the edge of best balanced accuracy, nearest to zero."""
    bins = [(max(-2000, min(2000, s // 1000)), v) for s, v in scored]
    allow, block = ([b for b, v in bins if v == w] for w in ("allow", "block"))
    if not (allow and block):
        return 0
    edges = sorted({b for b, _ in bins})
    edges.append(edges[-1] + 1)
    return max((sum(b < e for b in block) / len(block) - sum(b < e for b in allow) / len(allow), -abs(e), e) for e in edges)[2] * 1000


def test_against_plain_model(spark):
    rows = ROWS + [(100 + n, f"http://good{n % 7}.org/a{n}") for n in range(60)] + [(200 + n, f"http://bad.com/de/x-{n % 25}") for n in range(50)]
    rows += [(300 + n, f"http://some.net/{p}") for n, p in enumerate(["a1", "a2", "x-1", "1/%D0%91", "2/%D0%92", "я", "б", "de/x-", "good"])]
    for order, support in ((5, 4), (2, 1), (3, 30)):
        got = U.judge(_pages(spark, rows), URL_RULES, order, support).collect()
        assert len(got) == len(rows)
        fits = [plain_rule(*plain_split(u)) for _, u in rows]
        letters = {c for _, u in rows for c in padded(u, 0)}
        model = Plain([(u, f[1]) for (_, u), f in zip(rows, fits) if f[1] and not plain_held(u)], order, support, len(letters))
        score = {u: model.score(u) for _, u in rows}
        least = plain_threshold([(score[u], f[1]) for (_, u), f in zip(rows, fits) if f[1] and plain_held(u)])
        by = {(r.page_id, r.url): r for r in got}
        for key, (rule, verdict) in zip(rows, fits):
            row = by[key]
            assert (row.host, row.path, row.rule) == (*plain_split(key[1]), rule)
            assert abs(row.score - score[key[1]]) <= 2
            assert row.verdict == (verdict or ("allow" if row.score >= least else "block"))
        one = {r.url: r.score for r in got}
        assert order != 5 or (one["http://some.net/1/%D0%91"] != one["http://some.net/2/%D0%92"] and one["http://some.net/a1"] != one["http://some.net/a2"])


def test_tables_grow_with_the_input(spark):
    def grams(many):
        rows = [(f"http://{n}.example.org/{n * 7}", 1, "allow") for n in range(many)]
        return U.train(spark.createDataFrame(rows, "url string, copies long, verdict string")).count()

    assert grams(4000) > 4 * grams(400)
    assert "ResolvedHint" not in U.score(spark.range(1).selectExpr("id as number", "'x' as url"), spark.createDataFrame([("x", 1)], "gram string, score long"))._jdf.queryExecution().analyzed().toString()


def test_one_class_or_none(spark):
    for rows in ([(1, "http://x.net/"), (2, "http://y.net/")], [(1, "http://x.org/")], []):
        got = U.judge(_pages(spark, rows), URL_RULES).collect()
        assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)


def test_nothing_is_broadcast(spark, monkeypatch):
    plans = []
    plan = lambda frame: plans.append(frame._jdf.queryExecution().executedPlan().toString())
    stored = U.stored
    monkeypatch.setattr(U, "stored", lambda frame, name: (plan(frame), stored(frame, name))[1])
    plan(U.judge(_pages(spark, ROWS), URL_RULES, order=2))
    assert sum("Join" in p for p in plans) == 3 and not any("Broadcast" in p for p in plans)
