import math
import re
from collections import Counter, defaultdict
from hashlib import md5

import pytest

from evenhand.llm.queries import URL_RULES
from evenhand.llm.url_filter import BINS_PER_UNIT, FOLDS, ORDER, SMOOTHING, START, judge

PAGES = "page_id long, url string, html string, host string, path string, score double"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "own", "own", 0.0) for i, u in enumerate(urls)], PAGES)


def split(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def ruled(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def brute(urls):
    """(rule, ruled, score) of each URL by plain counting and recursion."""
    parts = [split(u) for u in urls]
    rules = [ruled(*p) for p in parts]
    folds = [int(md5("|".join(["42"] + ([u] if u is not None else [])).encode()).hexdigest()[:8], 16) % FOLDS for u in urls]
    seen = {v: [Counter() for _ in range(ORDER + 1)] for v in ("allow", "block")}
    for (host, path), rule, fold in zip(parts, rules, folds):
        if rule and fold:
            text = START * ORDER + host + path
            for i in range(ORDER, len(text)):
                for k in range(ORDER + 1):
                    seen[rule.verdict][k][text[i - k:i + 1]] += 1
    after = {v: defaultdict(int) for v in seen}
    for v in seen:
        for k in range(ORDER + 1):
            for s, n in seen[v][k].items():
                after[v][(k, s[:-1])] += n

    def p(v, s):
        if not s:
            return 1 / 256
        k = len(s) - 1
        return (seen[v][k][s] + SMOOTHING * p(v, s[1:])) / (after[v][(k, s[:-1])] + SMOOTHING)

    scores = []
    for host, path in parts:
        text, total = START * ORDER + host + path, 0.0
        for i in range(ORDER, len(text)):
            for k in range(ORDER, -1, -1):
                s = text[i - k:i + 1]
                if seen["allow"][k][s] + seen["block"][k][s]:
                    total += math.log(p("allow", s)) - math.log(p("block", s))
                    break
        scores.append(total / max(len(text) - ORDER, 1))
    return parts, rules, folds, scores


@pytest.mark.parametrize("sent", [0, 30, 20_000])
def test_equals_brute_force(spark, sent):
    urls = [f"http://{h}.example.{t}/{lang}/{i * 37 % 211}" for i, h in enumerate(["a", "www.b", "c-d", "Blog.E"] * 12)
            for t in ("org", "com", "net") for lang in ("en", "fr", "de", "es")]
    urls += [None, "", "no scheme", "x://", "http://ORG/", "http://org", "http://a.org?x=/y", "HTTP://example.org/en/1#f",
             "http://notexample.org/es/1", "a://b://c/d", "http://\u00e9\U0001F600.net/\u00fc"] + urls[:3]
    parts, rules, folds, scores = brute(urls)
    got = {r.page_id: r for r in judge(pages(spark, urls), URL_RULES, sent_rows=sent).collect()}
    assert len(got) == len(urls)
    judged = [(scores[i], r.verdict) for i, r in enumerate(rules) if r and folds[i] == 0]
    steps = sorted({math.floor(s * BINS_PER_UNIT) for s, _ in judged})
    middle = {t: math.floor((last + 1 + t) / 2) for last, t in zip(steps, steps[1:])} | {steps[0]: steps[0]}
    n = {v: sum(w == v for _, w in judged) for v in ("allow", "block")}

    def right(t):
        return (sum(v == "allow" and math.floor(s * BINS_PER_UNIT) >= t for s, v in judged) * n["block"]
                + sum(v == "block" and math.floor(s * BINS_PER_UNIT) < t for s, v in judged) * n["allow"])

    best = min(steps, key=lambda t: (-right(t), abs(middle[t]), middle[t]))
    limit = middle[best] / BINS_PER_UNIT
    for i, (part, rule, score) in enumerate(zip(parts, rules, scores)):
        r = got[i]
        assert (r.host, r.path) == part
        assert r.rule == (rule.host + rule.path if rule else None)
        assert r.score == pytest.approx(score, abs=1e-9)
        assert r.verdict == (rule.verdict if rule else "allow" if score >= limit else "block")


def test_the_model_learns_what_the_rules_mark(spark):
    urls = [f"http://h{i}.example.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(400)]
    urls += [f"http://h{i}.example.net/{'fr' if i % 2 else 'de'}/{i}" for i in range(60)]
    got = {r.page_id: r for r in judge(pages(spark, urls), URL_RULES).collect()}
    assert all(got[i].verdict == ("allow" if (i - 400) % 2 else "block") for i in range(400, 460))


def test_empty_and_unlabelled(spark):
    assert judge(pages(spark, ["x"]).limit(0), URL_RULES).count() == 0
    assert [r.verdict for r in judge(pages(spark, ["http://a.net/b", None]), URL_RULES).collect()] == ["allow", "allow"]
