"""URL rules and role repair on small cases and against brute force."""

import random
from collections import Counter

from terrasift.llm.role_repair import ENDS, FAR, MOVES, path, render, repair, transfer
from terrasift.llm.url_rules import apply_rules

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "", "block")]


def test_rules(spark):
    rules = spark.createDataFrame([*RULES, (None, "/", "block")], "host string, path string, verdict string")
    urls = {
        1: "http://x.net/", 2: "http://x.net", 3: "https://M.Example.NET/en/1?x=/de/", 4: "http://badexample.net/en/", 5: "http://example.com/de/x#/y",
        6: "http://example.com/DE/", 7: None, 8: "no scheme.net/", 9: "http://", 10: "http://b.org/fr/", 11: "x://a.org?q", 12: "http://a.org/fr/", 13: "http://É.net/a",
    }
    rows = [(i, u, 1, "h") for i, u in urls.items()] + [(1, urls[1], 2, "h"), (None, urls[1], 2, "h")]
    got = apply_rules(spark.createDataFrame(rows, "page_id bigint, url string, host int, prefix string"), rules).collect()
    assert Counter(r[0] for r in got) == Counter(r[0] for r in rows)
    found = {r["page_id"]: tuple(r)[1:] for r in got}
    assert found[1] == ("x.net", "/", "net/", "block") and found[2] == ("x.net", "", None, "allow")
    assert found[3] == ("m.example.net", "/en/1", "example.net/en/", "allow") and found[4][2:] == ("net/", "block")
    assert found[5][2] == "example.com/de/" and found[6][3] == "allow"
    assert found[7] == found[8] == found[9] == ("", "", None, "allow")
    assert found[10][2] == "org/fr/" and found[11][2] == "a.org" and found[12][2] == "org/fr/" and found[13][2] == "net/"
    assert apply_rules(spark.createDataFrame(rows, "page_id bigint, url string, host int, prefix string"), rules.limit(0)).where("rule IS NOT NULL").count() == 0


def brute_cost(roles):
    best = FAR

    def go(i, state, cost):
        nonlocal best
        if cost >= best:
            return
        if i == len(roles):
            best = min(best, cost + ENDS[state])
            return
        for c, after, *_ in MOVES[roles[i], state]:
            go(i + 1, after, cost + c)

    go(0, 0, 0)
    return best


def test_costs_by_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        roles = [rng.randrange(4) for _ in range(rng.randrange(1, 6))]
        costs = transfer(roles)[0]
        leave = min(range(4), key=lambda s: costs[s] + ENDS[s])
        assert costs[leave] + ENDS[leave] == brute_cost(roles)
        assert sum(m[0] for m in path(roles, 0, leave)) == costs[leave]


def test_repair(spark):
    rng = random.Random(9)
    names = {"system": 1, "user": 2, "assistant": 3}
    rows = []
    for conv in range(12):
        roles = [rng.choice([*names, "bot", None]) for _ in range(rng.randrange(1, 6))]
        rows += [(conv, k, r, f"t{k}", 1, "x") for k, r in enumerate(roles)]
    rows += [(50, 0, " User ", None, 1, "x"), (50, 1, "assistant", "a <|im_end|>", 1, "x"), (None, 0, "user", "q", 1, "x"), (51, None, "user", "q", 1, "x"), (51, None, "user", "q", 1, "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part int, piece string")
    for segment in (2, 4096):
        got = repair(turns, segment=segment).collect()
        assert Counter((r["conv_id"], r["turn"]) for r in got) == Counter(r[:2] for r in rows)
        cost = Counter()
        for r in got:
            cost[r["conv_id"]] += r["cost"]
        for conv in range(12):
            assert cost[conv] == brute_cost([names.get(r[2], 0) for r in rows if r[0] == conv])
    text = {r["conv_id"]: r["rendered"] for r in render(repair(turns)).collect()}
    assert text[50] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\na < |im_end| ><|im_end|>\n"
    assert text[None] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert text[51] == "<|im_start|>user\nq\nq<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    for t in text.values():
        roles = [x.split("\n", 1)[0] for x in t.split("<|im_start|>")[1:]]
        roles = roles[1:] if roles[0] == "system" else roles
        assert roles == ["user", "assistant"] * (len(roles) // 2) and roles
    assert repair(turns.limit(0)).count() == 0
