"""SimHash, embeddings, suffixes, sketches and tool calls against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from cadenza.llm import iblt, pq, simhash, suffixes, tool_calls
from cadenza.llm.components import components

DRAW = random.Random(9)
WORDS = ["".join(DRAW.choices("abcdefghij", k=DRAW.randint(2, 9))) for _ in range(300)]
SCHEMA = "doc_id long, text string, d string, key string, fp string"


def sentence(n):
    return " ".join(DRAW.choices(WORDS, k=n)) + "."


def texts():
    base = [" ".join(sentence(DRAW.randint(3, 30)) for _ in range(DRAW.randint(1, 12))) for _ in range(25)]
    long = " ".join(sentence(20) for _ in range(60))
    edited = long[:3000] + "X" + long[3001:]
    found = [*base, None, "", " \n\t", "one", "Two words", long, long, edited, "start " + long[100:900] + " end", base[0], base[0].upper()]
    return found + ["é" * 300 + long[:450], "x" * 1000]


TEXTS = texts()


def docs_of(rows):
    made = [(i, t, "a", "b", "c") for i, t in enumerate(TEXTS)]
    return rows(SCHEMA, *made, made[-1], (None, "no id here at all", "a", "b", "c"))


def reach(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_equals_brute_force(rows):
    prints = [plain_simhash(t) for t in TEXTS]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = {i: (f"{p:016x}", r) for i, (p, r) in enumerate(zip(prints, reach(len(prints), pairs)))}
    out = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(out) == len(TEXTS) + 2
    assert {r[0]: (r[1], r[2]) for r in out if r[0] is not None} == want
    assert simhash.near_duplicates(docs_of(rows).limit(0)).count() == 0


def test_hot_blocks_lose_no_link(spark, monkeypatch):
    centre, draw = 0x0123456789ABCDEF, random.Random(2)
    prints = {centre} | {centre ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(300)}
    prints |= {draw.getrandbits(64) for _ in range(100)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = reach(len(signed), [(i, j) for i in range(len(signed)) for j in range(i)
                               if ((signed[i] ^ signed[j]) & (2 ** 64 - 1)).bit_count() <= 2])
    for most in (2, 64):
        monkeypatch.setattr(simhash, "BUCKET", most)
        links = simhash.close_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), 2).collect()
        assert all(((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2 for a, b in links)
        at = {p: i for i, p in enumerate(signed)}
        assert reach(len(signed), [(at[a], at[b]) for a, b in links]) == want


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK", 50)
    draw = np.random.default_rng(3)
    heads = draw.standard_normal((12, 16))
    vectors = [(heads[i % 12] + 0.28 * draw.standard_normal(16)).tolist() for i in range(300)]
    vectors += [vectors[0], [2 * x for x in vectors[1]], None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0, 2.0], []]
    out = pq.link(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n_links int")).collect()
    good = [i for i in range(302)]
    unit = np.array([vectors[i] for i in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    want_roots = reach(len(vectors), [(i, j) for i in good for j in good if j < i and close[i, j]])
    assert {r[0]: (r[1], r[2], r[3]) for r in out} == {
        i: (int(close[i].sum()) - 1 if i in set(good) else 0, want_roots[i], want_roots[i] == i) for i in range(len(vectors))}
    assert close.sum() > len(good)
    assert pq.link(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_links_of_wide_vectors_and_of_every_width(spark):
    """Width 64: pairs near the limit on either side; the exact search finds all, the usual one at least 0.95 of them."""
    draw = np.random.default_rng(6)
    heads = draw.standard_normal((120, 64))
    near = heads[draw.integers(0, 120, 1800)]
    spread = draw.uniform(0.05, 0.45, (1800, 1))
    vectors = near + spread * draw.standard_normal((1800, 64))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    others = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [2.0, 4.0, 6.1], [-1.0, 0.0, 0.0], [5.0], [7.0], [-7.0]]
    table = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000 + i, v) for i, v in enumerate(others)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in pq.link(df, deviations=None).collect()}
    assert [found[i].n_links for i in range(1800)] == close.sum(axis=1).tolist()
    roots = reach(1800, [(i, j) for i, j in zip(*np.nonzero(close)) if j < i])
    assert [found[i].component_id for i in range(1800)] == [roots[i] for i in range(1800)]
    assert [(found[2000 + i].n_links, found[2000 + i].component_id) for i in range(7)] == [
        (2, 2000), (2, 2000), (2, 2000), (0, 2003), (1, 2004), (1, 2004), (0, 2006)]
    usual = pq.link(df).filter("vec_id < 1800").agg({"n_links": "sum"}).first()[0]
    assert 0.95 * close.sum() <= usual <= close.sum() and close.sum() > 5000


def plain_repeats(values):
    data = [(v or "").encode() for v in values]
    seen = Counter(b[i:i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i:i + 400]] > 1:
                gone[i:i + 400] = b"\x01" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force_on_both_paths(rows, monkeypatch):
    values = [*TEXTS, TEXTS[-1], "no id here at all"]
    want = sorted(zip([*range(len(TEXTS)), len(TEXTS) - 1, -1], plain_repeats(values)))
    for most in (4096, 1):  # sorted in tasks, and counted row by row
        monkeypatch.setattr(suffixes, "MOST_CONTEXTS", most)
        out = suffixes.remove_repeats(docs_of(rows)).collect()
        assert sorted(((-1 if r[0] is None else r[0]), tuple(r[1:])) for r in out) == want
    assert suffixes.remove_repeats(docs_of(rows).limit(0)).count() == 0


@pytest.mark.parametrize("length, letters", [(20, 1), (20, 2), (33, 2), (400, 1), (400, 3)])
def test_buckets_are_in_the_order_of_their_bytes(monkeypatch, length, letters):
    """The order is that of Python's sorted(), and neighbours are alike where their bytes are."""
    monkeypatch.setattr(suffixes, "LENGTH", length)
    draw = random.Random(length + letters)
    for case in range(12):
        block = bytes(draw.randrange(letters) for _ in range(draw.randrange(1, 2 * length)))
        parts = [(block * 3)[draw.randrange(9):][:length + draw.randrange(300)] + bytes(draw.randrange(letters) for _ in range(length)) for _ in range(draw.randrange(1, 7))]
        size = np.array([len(x) for x in parts])
        bucket = np.array([draw.randrange(2) for _ in parts])
        owner, _, at = suffixes.suffixes_of(bucket * 0, size * 0, size)
        buffer = b"".join(parts)
        order, same = suffixes.suffix_order(suffixes.words_of(buffer), bucket[owner], at)
        heads = [(bucket[owner[i]], buffer[at[i]:at[i] + length]) for i in order]
        assert sorted(order.tolist()) == list(range(len(at))) and heads == sorted(heads)
        assert same.tolist() == [i > 0 and heads[i] == heads[i - 1] for i in range(len(heads))]


def test_cover_ranks_follow_the_bytes(monkeypatch):
    monkeypatch.setattr(suffixes, "LENGTH", 50)
    draw = random.Random(3)
    buffer = bytes(draw.randrange(2) for _ in range(60)) * 4 + b"\x00" * 150 + bytes(draw.randrange(3) for _ in range(200))
    words, cover = suffixes.words_of(buffer), suffixes.difference_cover(suffixes.COVER)
    ranks = suffixes.cover_ranks(words, cover)
    places = [i * suffixes.COVER + c for i in range(len(buffer) // suffixes.COVER) for c in cover if i * suffixes.COVER + c < len(buffer)]
    padded = buffer + b"\x00" * 200
    heads = [padded[p:p + 52] for p in places]  # four times the modulus: the first length of 50 or more
    found = ranks[:len(places)]
    assert [heads[i] for i in np.lexsort((found,))] == sorted(heads)
    assert len(set(found.tolist())) == len(set(heads))


def test_query_equals_brute_force_on_the_whole_table(spark):
    from cadenza.llm.plans import QUERIES

    docs = sorted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    out = sorted(QUERIES["op3_suffix_dedup"](spark, "/root/testdata/sf0.01").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert [tuple(r[1:]) for r in out] == plain_repeats([d.text for d in docs])


def test_passages_of_400_bytes_and_more_are_caught_at_their_borders(spark):
    """Passages of over 50 words in documents of their own: those below 400 bytes stay, all others go, and nothing else."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(3, 11)))
    prose = lambda n: " ".join(word() for _ in range(n))
    values, want = [], []
    for case in range(60):
        n = draw.choice([51, 55, 60, 80, 200, 1500])
        passage = prose(n)
        if case % 3 == 0:
            passage = (passage + prose(100))[:399 + case % 2]
        for copy in range(draw.choice([2, 2, 3, 9])):  # other digits beside each copy, so nothing more is shared
            before, after = prose(draw.randrange(0, 90)) + f" <{copy}", f"{copy}> " + prose(draw.randrange(0, 90))
            values.append(before + passage + after)
            want.append(passage if len(passage) >= 400 else "")
        values.append(prose(draw.randrange(0, 300)))
        want.append("")
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    out = sorted(suffixes.remove_repeats(docs).collect())
    assert [tuple(r[1:]) for r in out] == plain_repeats(values)
    assert [r["n_removed"] for r in out] == [len(w) for w in want]


def test_cover_has_every_difference():
    assert len(suffixes.difference_cover(suffixes.COVER)) == 4
    for v in (7, 13, 32, 64):
        cover = suffixes.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and len(cover) < v


def paragraphs(text):
    return set(re.findall(r"(?:\S+(?<![.!?])[^\S\n]+){0,23}\S+", text, re.ASCII))


def test_sketches_recover_the_differences(rows, spark):
    out = {r["doc_id"]: r for r in iblt.compare_edits(docs_of(rows).filter("doc_id is not null").limit(len(TEXTS))).collect()}
    values = {i: t or "" for i, t in enumerate(TEXTS)}
    assert sorted(out) == sorted(values)
    for i, text in values.items():
        following = values[i - 1 if i else max(values)]
        third = len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        own, edit, other = map(paragraphs, (text, edited, following))
        alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert out[i]["n_chars"] == len(text) and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(out[i]["near_edited"] - alike(own, edit)) < 1e-9 and abs(out[i]["near_next"] - alike(own, other)) < 1e-9
    groups = {}
    for i, text in values.items():
        groups.setdefault(frozenset(paragraphs(text)), set()).add(out[i]["fingerprint"])
    assert all(len(found) == 1 for found in groups.values()) and len(set().union(*groups.values())) == len(groups)
    assert iblt.compare_edits(docs_of(rows).limit(0)).count() == 0


def test_small_sketches_fail_and_are_retried(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(iblt, "size_for", lambda a, b, factor: sizes.append(factor) or (a * 0 + 4 * factor).cast("long"))
    pairs = spark.createDataFrame([(1, 0, list(range(40)), list(range(20, 50)))], "row long, kind int, a array<long>, b array<long>")
    assert [tuple(r) for r in iblt.recovered(pairs).collect()] == [(1, 0, 20, 10)] and len(sizes) > 1


CALL = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
RESULT = "conv_id long, call_id string, turn long, content string, extra int"
SCHEMAS = [("add", [("x", "integer", True), ("y", "number", False)])]


def test_tool_calls(spark, rows):
    calls = rows(
        CALL, (1, "a", 3, "add", '{"y": 1.5, "x": 2}', ["b"]), (1, "b", 1, "add", '{"x": "2", "z": 0}', None),
        (1, "c", 5, "none", "{", ["d"]), (1, "d", 6, "add", None, ["c"]), (1, "b", 2, "add", "{}", []),
        (1, None, 7, "add", '{"x":1}', ["missing"]), (1, "e", 8, "add", "[1]", ["e"]),
    )
    results = rows(RESULT, (1, "a", 4, "three", 1), (1, "a", 9, "late", 1), (2, "q", 1, None, 1), (1, None, 10, "", 1))
    schemas = spark.createDataFrame(SCHEMAS, "name string, fields array<struct<name:string,kind:string,required:boolean>>")
    out = {(r["conv_id"], r["call_id"], r["status"]): r for r in tool_calls.link(calls, results, schemas).collect()}
    assert {k: (r["level"], r["position"]) for k, r in out.items()} == {
        (1, "b", "pending"): (0, 0), (1, "a", "linked"): (1, 1), (1, "c", "pending"): (None, 2), (1, "d", "pending"): (None, 3),
        (1, None, "linked"): (None, 4), (1, "e", "pending"): (None, 5), (1, "b", "repeated"): (None, None), (2, "q", "orphan"): (None, None)}
    assert out[1, "a", "linked"]["canonical"] == '{"x":2,"y":1.5}' and out[1, "a", "linked"]["content"] == "three"
    assert {k[1]: r["errors"] for k, r in out.items() if r["errors"] is not None} == {
        "a": [], "b": ["kind x", "unknown z"], "c": ["arguments"], "d": ["arguments"], None: [], "e": ["arguments"]}
    assert tool_calls.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_queries_and_pipeline(spark):
    import corpus_pipeline
    from cadenza.llm.plans import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.run(spark, folder).count() > 0
