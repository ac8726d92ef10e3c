import random
import re
from itertools import combinations

import numpy as np
import pytest

from joinlens.llm import neardup
from joinlens.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, bases = [], [[word() for _ in range(rng.choice([12, 60, 200]))] for _ in range(12)]
    for i in range(220):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(220, None), (221, ""), (222, " \t\n"), (223, "Three SHORT words"), (224, "three short\nwords"), (225, "three short"), (226, "one"), (227, " ".join(["same"] * 500)), (228, "same " * 30), (229, "É a b c d"), (230, "é a b c d")]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_matches_brute_force(make, percent):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(make(rows), percent).collect()}
    assert got == brute(rows, percent)


def test_last_round_alone_finds_what_the_others_miss(make, monkeypatch):
    """Without neighbours the exact join still finds every link between classes that share a bucket."""
    monkeypatch.setattr(neardup, "FIRST_TREES", 1)
    monkeypatch.setattr(neardup, "FIRST_NEAR", 1)
    monkeypatch.setattr(neardup, "NEAR", 1)
    rows = corpus(9)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(make(rows), 85).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("rounds", [True, False])
def test_exact_form_and_split_shingles_lose_nothing(make, monkeypatch, rounds):
    """With a shingle's rows dealt to many tasks; and with the exact join doing all the work."""
    monkeypatch.setattr(neardup, "TASK_ROWS", 3)
    if not rounds:
        monkeypatch.setattr(neardup, "_neighbours", lambda keys, near: keys.selectExpr("node u", "node v").limit(0))
    rows = corpus(11)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(make(rows), 80, exact=True).collect()}
    assert got == brute(rows, 80)


def test_long_texts(make):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 1_000_000), (4, "short text of some few words")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(make(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_shingle_values_follow_the_words():
    data, starts = [], [0]
    texts = ["a b c d e f", "A  b\nc d E f", "b c d e f", "ab c d e f", ""]
    for t in texts:
        data += t.encode()
        starts.append(len(data))
    with np.errstate(over="ignore"):
        sets = neardup.shingle_sets(np.array(data, np.uint8), np.array(starts))
    assert list(map(len, sets)) == [2, 2, 1, 1, 0]
    assert np.array_equal(sets[0], sets[1]) and sets[2][0] in sets[0] and sets[3][0] not in sets[0]


def test_odd_rows(make):
    rows = make([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)]).selectExpr("*", "1 as n", "2 as node", "3 as component", "'x' as sig")
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(rows).collect()), key=repr)
    assert out == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, True)]
    kept = neardup.deduplicated(make([(5, "a b c d e f g"), (3, "a b c d e f g"), (4, "x y z")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4]
    assert neardup.near_duplicates(make([]).limit(0)).count() == 0


@pytest.mark.parametrize("edges, expected", [([(1, 2), (2, 3), (5, 4)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}), ([(7, 7)], {}), ([], {})])
def test_components(spark, edges, expected):
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == expected
