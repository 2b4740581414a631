"""Runs against a brute force that knows nothing of factors."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cadenza.llm import periodic, plans

DOCS = "/root/testdata/sf0.001"


def plain_runs(words, least=24, exponent=3):
    """Every stretch, period by period; a stretch whose smaller period is known already is no run of this one."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        x = 0
        while x < n - q:
            if words[x] != words[x + q]:
                x += 1
                continue
            start = x
            while x < n - q and words[x] == words[x + q]:
                x += 1
            length = x - start + q
            if length >= max(least, exponent * q) and not any(
                    p < q and a <= start and start + length <= a + m for (a, p), m in found.items()):
                found[start, q] = length
    return sorted((a, m, p) for (a, p), m in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(list(words))]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for a, m, p in runs for i in range(a + p, a + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{a},{m},{p}\n" for a, m, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_random_words_with_planted_loops(letters):
    random = np.random.default_rng(letters)
    for _ in range(150):
        parts = [random.integers(0, letters, random.integers(0, 30))]
        for _ in range(random.integers(0, 4)):
            block = random.integers(0, letters + 1, random.integers(1, 14))
            parts += [np.resize(block, random.integers(1, 70)), random.integers(0, letters, random.integers(0, 6))]
        words = np.concatenate(parts)
        assert periodic.runs_of(words) == sorted(plain_runs(words.tolist()), key=lambda r: (r[0], r[2]))


def test_lower_limits_and_short_texts():
    rule = periodic.Rule(length=3, exponent=3)
    for text in ("", "a", "ab", "aaa", "abababab", "aabaabaabaab", "mississippi"):
        coded = np.array([ord(c) for c in text], np.int64)
        assert periodic.runs_of(coded, rule) == sorted(plain_runs(list(text), 3), key=lambda r: (r[0], r[2]))
    with pytest.raises(ValueError):
        periodic.Rule(exponent=2)


def test_query_equals_brute_force_on_every_row(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text").collect()
    out = plans.QUERIES["op11_periodic_runs"](spark, DOCS)
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted(tuple(r) for r in out.select(*columns).collect())
    short = {d.doc_id for d in docs if len((d.text or "").split()) <= 1500}
    assert len(got) == len(docs) and len(short) > 0.8 * len(docs)
    assert sum(r[1] for r in got) > 0
    assert [r for r in got if r[0] in short] == sorted(plain_row(d.doc_id, d.text) for d in docs if d.doc_id in short)


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    loop = " ".join(["x y z"] * 8)
    long = " ".join(f"w{i}" for i in range(60_000)) + " " + " ".join(["end"] * 50_000)
    docs = spark.createDataFrame(
        [(1, None, "k", 0, 9), (2, "", "k", 0, 9), (None, loop, "k", 0, 9), (3, f"{loop} q {loop}", None, 0, 9), (3, f"{loop} q {loop}", None, 0, 9), (4, long, "k", 0, 9)],
        "doc_id long, text string, Runs string, found int, period int")
    out = {}
    for r in periodic.repeated_runs(docs).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert set(out[1][0].asDict()) == {"doc_id", "text", "found", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"}
    for empty in (out[1][0], out[2][0]):
        assert (empty.n_words, empty.n_runs, empty.start, empty.runs, empty.collapsed) == (0, 0, None, [], "")
    assert [tuple(r) for r in out[None][0].runs] == [(0, 24, 3)] and out[None][0].collapsed == "x y z"
    assert len(out[3]) == 2 and out[3][0] == out[3][1]
    assert (out[3][0].start, out[3][0].exponent_milli, out[3][0].collapsed) == (0, 8000, "x y z q x y z")
    assert (out[4][0].start, out[4][0].length, out[4][0].period) == (60_000, 50_000, 1)
    assert periodic.repeated_runs(docs.limit(0)).count() == 0
