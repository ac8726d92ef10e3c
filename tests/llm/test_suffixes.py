import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from joinlens.llm import suffixes


def brute(rows):
    """Every window of 100 bytes against all earlier ones."""
    seen, out = set(), {}
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest())
    return out


def found(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary):x}é" for _ in range(n))


def corpus():
    rng = random.Random(5)
    shared = [words(rng, 60) for _ in range(4)]
    rows = [(0, words(rng, 300)), (1, None), (2, ""), (3, "short"), (4, "a" * 450), (5, "ab" * 300), (6, "\0" * 250)]
    for i in range(7, 40):
        parts = [words(rng, rng.randrange(1, 80))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            cut = rng.randrange(0, 40)
            parts += [s[cut : len(s) - rng.randrange(0, 40)], words(rng, rng.randrange(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(40, rows[0][1]), (41, rows[9][1] + "x"), (42, "y" + rows[9][1]), (43, rows[10][1][:99]), (44, rows[10][1][:130])]
    return rows


def test_matches_brute_force(make):
    rows = corpus()
    assert found(suffixes.without_repeats(make(rows))) == brute(rows)


def test_common_strings_are_split(make, monkeypatch):
    """A string of 40 bytes in all surroundings, with repeats of 100 bytes and more around it in some."""
    rng = random.Random(13)
    common = "the same forty bytes stand in every text!"
    rows = [(i, words(rng, rng.randrange(10, 30)) + common + words(rng, rng.randrange(10, 30))) for i in range(80)]
    for i in range(80, 140):
        other = rng.choice(rows)[1]
        at = other.index(common)
        a, b = rng.randrange(0, 80), rng.randrange(0, 80)
        rows.append((i, words(rng, 12) + other[max(0, at - a) : at + len(common) + b] + words(rng, 12)))
    rows += [(140, common * 20), (141, (common + "x") * 9), *((200 + i, t) for i, t in corpus())]
    monkeypatch.setattr(suffixes, "COMMON", 5)
    parts = []
    dealt = suffixes.dealt
    often = []
    monkeypatch.setattr(suffixes, "_common", lambda twice, f=suffixes._common: often.extend(f(twice)) or often)
    got = found(suffixes.without_repeats(make(rows).repartition(6)))
    assert got == brute(rows) and len(often) > 5 and max(n for _, n in often) >= 100
    # The split suffixes cover each offset once.
    n = 50
    low, high = np.array([rng.randrange(0, 69) for _ in range(n)]), np.zeros(n, int)
    high = np.array([rng.randrange(a, 69) for a in low])
    z = np.zeros(n, int)
    out = dealt((z, np.ones((n, 100), np.uint8), np.ones((n, 68), np.uint8), np.arange(n), z, z, low, high), 7, np.array([0]))
    for i in range(n):
        parts = sorted((a, b) for d, a, b in zip(out[3], out[6], out[7], strict=True) if d == i)
        assert parts[0][0] == low[i] and parts[-1][1] == high[i] and all(b + 1 == a for (_, b), (a, _) in zip(parts, parts[1:], strict=False))


def test_matches_brute_force_in_small_runs(make, monkeypatch):
    """Many runs for each bucket, so that the merge has work to do."""
    rows = corpus()
    runs = []
    make_run = suffixes.encode_run
    monkeypatch.setattr(suffixes, "encode_run", lambda *a: runs.append(1) or make_run(*a))
    docs = [(i, (t or "").encode()) for i, t in rows]
    parts = []
    for i, b in docs:  # a run for each document
        data = np.frombuffer(b, np.uint8)
        _, pos, low, high, _ = suffixes.anchors(data, np.array([0, len(b)]))
        if not len(pos):
            continue
        padded = np.concatenate([np.zeros(68, np.uint8), data, np.zeros(100, np.uint8)])
        right = padded[(pos + 68)[:, None] + np.arange(100)]
        right[np.arange(100) >= 100 - low[:, None]] = 0
        left = padded[(pos + 67)[:, None] - np.arange(68)]
        order = np.lexsort(right.T[::-1])
        parts.append(suffixes.Run(suffixes.encode_run(right[order], left[order], np.full(len(pos), i)[order], np.zeros(len(pos), int), pos[order], low[order], high[order])))
    doc, _, start, end = suffixes.repeats(parts)
    expected = brute(rows)
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for s, e in zip(start[doc == i], end[doc == i], strict=True):
            gone[s:e] = True
        assert int(gone.sum()) == expected[i][1], i


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=6), min_size=1, max_size=12), min_size=1, max_size=5))
def test_loser_tree_merges_in_order(runs):
    made = []
    for r in runs:
        full = np.array([list(x.ljust(100, b"\1")) for x in sorted(r)], np.uint8)
        n = len(full)
        zero = np.zeros(n, int)
        made.append(suffixes.Run(suffixes.encode_run(full, np.zeros((n, 68), np.uint8), np.arange(n), zero, zero, zero, zero)))
    run, at, common = suffixes.merged(made)
    out = [sorted(runs[i])[j].ljust(100, b"\1") for i, j in zip(run, at, strict=True)]
    assert out == sorted(x.ljust(100, b"\1") for r in runs for x in r)
    for a, b, n in zip(out[:-1], out[1:], common[1:], strict=True):
        same = next((i for i in range(100) if a[i] != b[i]), 100)
        assert same == n


def test_repeated_rows_extra_columns_and_empty_table(make, spark):
    text = words(random.Random(1), 100)
    rows = make([(1, text), (1, text), (None, text), (2, None)]).selectExpr("*", "'x' as start", "1 as kmer", "2 as bucket")
    out = {(r["doc_id"], r["n_removed"]) for r in suffixes.without_repeats(rows).collect()}
    n = len(text.encode())
    assert out == {(None, 0), (1, n), (2, 0)}
    assert suffixes.without_repeats(make([]).limit(0)).count() == 0


def test_a_text_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    whole, parts = suffixes.anchors_of(data, np.array([0, 3000])), suffixes.anchors(data, np.array([0, 3000]))
    windows = lambda a: sorted({(int(p), int(p - o)) for p, lo, hi in zip(*a[1:4], strict=True) for o in range(lo, hi + 1)})
    assert windows(whole) == windows(parts)
    assert len(windows(whole)) == 3000 - 99


@pytest.mark.parametrize("n", [0, 99, 100, 101])
def test_anchor_windows_at_the_edge(n):
    _, pos, low, high, _ = suffixes.anchors(np.arange(n).astype(np.uint8), np.array([0, n]))
    assert sum(high - low + 1) == max(0, n - 99)
