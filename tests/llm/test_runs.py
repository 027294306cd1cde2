"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.llm import runs


def plain_runs(w):
    out, n = [], len(w)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if length >= max(6, 4 * p) and not any(all(w[i + k] == w[i + k + d] for k in range(length - d)) for d in range(1, p)):
                out.append((i, length, p))
            i = j
    return sorted((a, n, p) for a, n, p in out)


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for a, length, p in found for i in range(a + p, a + length)}
    lines = "".join(f"{a},{length},{p}\n" for a, length, p in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha(lines), sha(kept))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=4))
def test_runs_of_small_alphabets(documents):
    got = runs.runs_of_documents(documents)
    assert [sorted(x) for x in got] == [plain_runs(w) for w in documents]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=7), st.integers(1, 9)), max_size=6))
def test_runs_of_powers(parts):
    w = [x for root, k in parts for x in root * k]
    assert runs.runs_of_documents([w, w[::-1]]) == [plain_runs(w), plain_runs(w[::-1])]


def test_common_extensions():
    rng = random.Random(3)
    s = [rng.randrange(1, 4) for _ in range(300)] + [0]
    tree = runs.SuffixTree(s)
    order = sorted(range(len(s)), key=lambda i: s[i:])
    assert [int(tree.rank[i]) for i in order] == list(range(len(s)))
    for _ in range(500):
        i, j = rng.sample(range(len(s)), 2)
        k = 0
        while s[i + k] == s[j + k]:
            k += 1
        assert tree.common(runs.np.array([i]), runs.np.array([j]))[0] == k


def test_best_run_is_the_greatest_exact_fraction_then_the_first(spark):
    d = spark.createDataFrame([(3, "x y " * 5 + "q " + "a " * 6 + "z " + "b " * 6 + "u v w " * 4)], "doc_id long, text string")
    assert runs.digest(runs.periodic_runs(d)).first()[:6] == (3, 4, 11, 6, 1, 6000)


def test_long_and_odd_texts(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice("abcdefgh") for _ in range(3000)) + " " + "p q r " * 900
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 5), (5, "a " * 6), (None, "b " * 9), (5, "a " * 6), (7, long), (8, "é ü " * 4 + "  x"), (9, "one")]
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, runs string, collapsed long, best int")
    got = sorted(map(tuple, runs.digest(runs.periodic_runs(d)).collect()), key=str)
    want = [plain_row(i if i is not None else "", t) for i, t in rows]
    want = sorted(((None, *w[1:]) if w[0] == "" else w for w in want), key=str)
    plain = {w[0]: w for w in want}
    assert len(got) == len(rows)
    for r in got:
        if r[0] not in (1, 2, 3, 4, 5, 7, 8, 9) or zlib.crc32(str(r[0]).encode()) % 10:
            assert r == plain[r[0]]
    assert runs.digest(runs.periodic_runs(d.limit(0))).collect() == []


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_is_the_plain_version(spark, tables, sf):
    from docflow.llm import queries

    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, f"/root/testdata/sf{sf}").collect()}
    rows = tables("documents", sf).select("doc_id", "text").collect()
    assert len(got) == len(rows) and sum(r[1] for r in got.values()) > 5
    for r in rows:
        if len(r.text.split()) < 1500:
            assert got[r.doc_id] == plain_row(r.doc_id, r.text)
