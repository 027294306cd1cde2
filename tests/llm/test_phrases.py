"""Phrases against a plain count of all sequences."""

import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.llm import phrases


def plain(rows, least=100, first=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f = counts.setdefault(lang, Counter())
            for m in range(1, 6):
                f.update(" ".join(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n, kept = total[lang], []
        found = [g for g, a in f.items() if " " in g and a >= least]
        inside = {}
        for g in found:
            w = g.split(" ")
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    s = " ".join(w[i : i + m])
                    inside[s] = max(inside.get(s, 0), f[g])
        for g in found:
            a, w = f[g], g.split(" ")
            if 100 * inside.get(g, 0) >= 100 * a:
                continue
            score, _, left, r = min((1000 * a * n // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w)))
            kept.append((-score, -a, g.encode(), left, r))
        for rank, (s, a, g, left, r) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, g.decode(), -a, left, r, n, -s))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "d", "é", ","]), max_size=60), max_size=4))
def test_each_phrase_start_is_owned_once(pieces):
    text = ",".join(" ".join(p) for p in pieces).encode()
    old = phrases.TRIGGER
    phrases.TRIGGER = 3
    try:
        whole, cut = phrases.parse(text, phrases._Checksums())
    finally:
        phrases.TRIGGER = old
    for m in range(2, 6):
        got, want = Counter(), Counter()
        for held, behind in ((whole, 0), (cut, 4)):
            for chunk, n in held.items():
                w = chunk.split(b" ")
                for i in range(min(len(w) - behind, len(w) - m + 1)):
                    got[b" ".join(w[i : i + m])] += n
        for piece in text.split(b","):
            w = piece.split()
            want.update(b" ".join(w[i : i + m]) for i in range(len(w) - m + 1))
        assert got == want


def test_long_piece_without_a_trigger_is_cut():
    text = b"x " * 10_000
    whole, cut = phrases.parse(text, phrases._Checksums())
    assert max(c.count(b" ") for c in (*whole, *cut)) < phrases.CUT + phrases.OVERLAP
    assert sum(n * (c.count(b" ") + 1 - k) for held, k in ((whole, 0), (cut, 4)) for c, n in held.items()) == 10_000


def test_small_tables(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", "en", "de", None])
        w = [rng.choice(["The", "red", "fox", "ran", "off", "über", "x y"]) + rng.choice(["", "", "", "", ",", ".", ";\n", "\t", "\r\n"]) for _ in range(rng.randrange(40))]
        rows.append((lang, rng.choice(["", "the red fox ran off today. ", "a b c d e f g "]) + " ".join(w)))
    rows += [("en", None), ("en", ""), ("en", " .,;\t\n"), ("fr", "only once"), ("en", rows[0][1]), ("und", "the red fox")] + [("en", "q q q q q q q q")] * 30
    d = spark.createDataFrame([(i, t, lang, "s", 3, "y") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, a long, chunk string").repartition(5)
    for least in (3, 25, 100):
        want = plain(rows, least)
        assert len(want) > (10 if least < 100 else 0)
        assert sorted(map(tuple, phrases.top_phrases(d, least=least).collect())) == want
    assert sorted(map(tuple, phrases.top_phrases(d, first=7, least=3).collect())) == plain(rows, 3, 7)
    assert phrases.top_phrases(d.limit(0)).collect() == []


def test_arithmetic_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        a = rng.randrange(1, 10**12)
        left, r = a + rng.randrange(10**12), a + rng.randrange(10**12)
        rows.append((a, left, r, max(left, r) + rng.randrange(10**13)))
    df = spark.createDataFrame(rows, "a long, l long, r long, n long").selectExpr("a", "l", "r", "n", "cast(cast(a as decimal(38,0)) * cast(n as decimal(38,0)) * 1000 as decimal(38,0)) div cast(cast(l as decimal(38,0)) * cast(r as decimal(38,0)) as decimal(38,0)) as score")
    assert all(x.score == 1000 * x.a * x.n // (x.l * x.r) for x in df.collect())


def test_query_on_the_small_tables(spark, tables):
    from docflow.llm import queries

    rows = [(r.lang, r.text) for r in tables("documents", "0.01").select("lang", "text").collect()]
    got = sorted(map(tuple, queries.op13_phrases(spark, "/root/testdata/sf0.01").collect()))
    assert got == plain(rows) and len(got) > 50
