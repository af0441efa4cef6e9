import random
import re

import numpy as np
from helpers import lowered

from chorale.llm import url_automaton
from chorale.llm.url_automaton import RULES, ShiftAnd


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = lowered(host)
    fitting = [
        (rule, verdict) for rule, verdict in RULES
        if (host == rule.split("/", 1)[0] or host.endswith("." + rule.split("/", 1)[0])) and path.startswith("/" + rule.split("/", 1)[1])
    ]
    rule, verdict = max(fitting, key=lambda r: len(r[0]), default=(None, "allow"))
    return host, path, rule, verdict


def urls():
    rng = random.Random(2)
    out = [None, "", "no scheme", "http://", "http://com", "http://com/", "https://a.net/es/?q=://x", "http://x.org/.com/", "http://example.com/en",
           "HTTP://WWW.Example.COM/en/a", "http://www.example.com/EN/", "http://exämple.net/fr/ü", "http://net/es/", "http://anet/es/",
           "http://u@example.com:80/en/", "http://a.com/" + "p" * 70_000]
    for _ in range(600):
        host = ".".join(rng.choice(["www", "example", "com", "net", "a", "COM"]) for _ in range(rng.randrange(1, 5)))
        out.append(f"http://{host}{rng.choice(['', '/', '/en/', '/es/x', '/fr', '/fr/', '/en/y?z', '#/en/', '?/es/', '//en/'])}")
    return out


def test_urls_against_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls())], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_automaton.judged(pages).collect()}
    assert got == {i: by_hand(u) for i, u in enumerate(urls())}
    assert url_automaton.judged(pages.limit(0)).collect() == []


def test_many_globs_over_several_words():
    rng = random.Random(3)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randrange(0, 10))) for _ in range(300)]
    automaton = ShiftAnd(globs)
    assert automaton.words > 2
    lengths = np.array([len(t) for t in texts])
    fits = automaton.fits(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum(lengths) - lengths, lengths)
    for k, glob in enumerate(globs):
        pattern = re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", glob)))
        assert fits[k].tolist() == [bool(pattern.fullmatch(t)) for t in texts], glob
