"""Token counts, BPE, secrets, toxicity and mixing on small fixtures."""

import hashlib
import random
import re
from sys import getsizeof

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import bpe, mixing, plans, secrets, token_counts, toxicity
from cadenza.llm.common import fresh_folder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "supercalifragilistic " * 3000
TEXTS = ["Hello World's 123 ÉTÉ", None, "", "Hello World's 123 ÉTÉ", "  \t\n", "a<|endoftext|>b", LONG, "ΑΣ ΣΑΣ ﬁ"]
DOCS = "doc_id long, text string, digest string, ids string, score string, source string"


def docs_of(rows, texts=TEXTS):
    """Rows with columns that clash with those the operators use; the last two rows are the same."""
    made = [(i, t, "x", "y", "z", None if i % 3 == 0 else "s") for i, t in enumerate(texts)]
    return rows(DOCS, *made, *made[-1:])


def test_counts_equal_the_library_and_are_cached(spark, rows):
    library, cache = Tokenizer.from_file(BYTES), fresh_folder(spark, "cache")
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in enumerate(TEXTS))
    want.append(want[-1])
    for _ in range(2):  # the second run finds all of them stored
        assert sorted(map(tuple, token_counts.count_tokens(docs_of(rows), cache, BYTES).collect())) == sorted(want)
    held = token_counts.cached_counts(spark, f"{cache}/{token_counts.tokenizer_digest(BYTES)}")
    assert held.count() == len({t or "" for t in TEXTS})


def test_counts_of_an_empty_table(spark, rows):
    assert token_counts.count_tokens(docs_of(rows).limit(0), fresh_folder(spark, "cache"), BYTES).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counter_reads_every_kind_of_file(name):
    assert token_counts.counter(public_tokenizers.path(name))("two words") >= 2


def test_bpe_equals_the_library(rows):
    library = Tokenizer.from_file(WORDS)
    out = bpe.decode(bpe.encode(docs_of(rows), WORDS), WORDS).select("doc_id", "ids", "decoded").collect()
    assert len(out) == len(TEXTS) + 1
    for doc_id, ids, decoded in out:
        want = library.encode(TEXTS[doc_id] or "", add_special_tokens=False).ids
        assert ids == want and decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_equals_the_library_on_odd_characters():
    library, model, draw = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS), random.Random(4)
    pool = [chr(i) for i in [*range(0x250), *range(0x300, 0x400), *range(0x1E00, 0x2100), 0x3000, 0x1F600, 0x212A, 0x130, 0x301, 0xA7CB]]
    pool += ["'s", "'RE", "<|endoftext|>", "<|end"]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randint(0, 10))) for _ in range(1500)]
    found = model.encode(pa.array(texts))
    for text, got, decoded in zip(texts, found.to_pylist(), model.decode(found).to_pylist()):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got == ids and decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_query_columns_equal_the_library(spark):
    folder = "/root/testdata/sf0.001"
    library, sha = Tokenizer.from_file(WORDS), lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        want.append((row.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, plans.QUERIES["op9_word_bpe"](spark, folder).collect())) == sorted(want)


def test_round_trip_is_decode_after_encode(rows):
    docs = docs_of(rows)
    apart = bpe.decode(bpe.encode(docs, WORDS), WORDS)
    together = bpe.round_trip(docs.withColumn("both", F.lit(1)), WORDS)
    columns = ("doc_id", "digest", "score", "source", "ids", "decoded")
    assert together.columns == ["doc_id", "digest", "score", "source", "both", "ids", "decoded"]
    assert sorted(map(str, together.select(*columns).collect())) == sorted(map(str, apart.select(*columns).collect()))
    assert bpe.round_trip(docs.limit(0), WORDS).count() == 0


def test_texts_are_cut_into_parts_of_any_size(monkeypatch):
    model = bpe.WordBpe(WORDS)
    texts = pa.array(["", "one two", "three " * 40, "", "<|endoftext|> x\x1cy", "four", ""] * 5).slice(1)
    whole = model.encode(texts)
    for size in (1, 7, 100, 10_000):
        monkeypatch.setattr(bpe, "AT_ONCE", size)
        ids = bpe._in_parts(model.encode, texts, pc.binary_length(texts))
        assert ids.to_pylist() == whole.to_pylist()
        rest = ids.slice(2)
        assert bpe._in_parts(model.decode, rest, pc.list_value_length(rest)).to_pylist() == model.decode(whole).to_pylist()[2:]
    assert model.decode(pa.array([None, [], [7]], pa.list_(pa.int32()))).to_pylist() == ["", "", model.strings[7].as_py()]


def test_memory_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20_000)
    model, library, draw = bpe.WordBpe(WORDS), Tokenizer.from_file(WORDS), random.Random(1)
    texts = [" ".join(f"w{draw.randrange(10 ** 9)}" + "long" * (i % 30) for i in range(50)) for _ in range(40)]
    assert model.encode(pa.array(texts)).to_pylist() == [library.encode(t, add_special_tokens=False).ids for t in texts]
    held = [*model.by_word.items(), *model.by_word.older.items()]
    assert held and max(len(key) for key, _ in held) <= bpe.LONGEST
    assert sum(getsizeof(key) + getsizeof(value) for key, value in held) <= 20_000


def test_new_code_points_load_the_file_once(monkeypatch):
    model, loads, load = bpe.WordBpe(WORDS), [], Tokenizer.from_file
    monkeypatch.setattr(tokenizers, "Tokenizer", type("Counting", (), {"from_file": staticmethod(lambda path: loads.append(path) or load(path))}))
    odd = " ".join(chr(0x0378) + str(i) for i in range(200))  # not assigned in any version so far
    assert model.encode(pa.array([odd, odd])).to_pylist() == [load(WORDS).encode(odd, add_special_tokens=False).ids] * 2
    assert len(loads) == 1


def test_stale_queue_entries_are_skipped():
    a, b, c, ab, bc = range(5)
    ranks, merged = {a << 20 | b: 1, b << 20 | c: 0}, [bc, ab]
    assert bpe.merge_word([a, b, c], ranks, merged) == [a, bc]
    assert bpe.merge_word([a, b, a, b, c], ranks, merged) == [ab, a, bc]


SECRET = "aZ9xQ2vLk83Tb7WmE4rY"


def test_base_spans_follow_the_rules():
    text = f'Token = "abc" secret=token:abcdefgh API_KEY: {SECRET} AKIA{"A1" * 9} {"0f" * 12} {"0f" * 11} ſecret=abcdefgh'
    pattern = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    want = [("assign", *m.span()) for m in pattern.finditer(text) if len(m[2]) >= 6]
    want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert secrets.base_spans(text) == sorted(want, key=lambda s: s[1])
    assert [k for k, *_ in want] == ["assign", "access", "hex"]


def test_models_tell_random_strings_from_identifiers(spark, rows):
    draw = random.Random(1)
    odd = ["".join(draw.choices(secrets.LETTERS[:62], k=24)) for _ in range(200)]
    plain = ["_".join(draw.choices(["customer", "order", "total", "internal", "address", "line"], k=3)) for _ in range(200)]
    models = secrets.train(spark.createDataFrame([(w, 1) for w in odd] + [(w, 0) for w in plain], "word string, label int"))
    texts = [f"key {SECRET} end", "the internal_customer_address_line stays", None, ""]
    found = {r[0]: [s["kind"] for s in r[1]] for r in secrets.find(docs_of(rows, texts), models).select("doc_id", "spans").collect()}
    assert found == {0: ["random"], 1: [], 2: [], 3: []}
    kept = {r[0]: r[1] for r in secrets.redact(docs_of(rows, texts), models).select("doc_id", "text").collect()}
    assert kept == {0: "key [secret] end", 1: texts[1], 2: None, 3: ""}


def test_secret_sample_and_empty_table(spark, rows):
    models = secrets.train(secrets.labelled_sample(docs_of(rows).limit(0)))
    assert secrets.find(docs_of(rows).limit(0), models).count() == 0


def toxic_texts(n, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("aeioulmnrst", k=draw.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        found, bad = draw.choices(words, k=draw.randint(20, 200)), i % 3 == 0
        if bad:
            for _ in range(3):
                found.insert(draw.randrange(len(found)), draw.choice(["zgork", "zgorkly", "vraxx"]))
        texts.append(" ".join(found))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_network_learns_and_scores_held_out_texts(rows):
    network = toxicity.train(*toxic_texts(300, 1))
    texts, labels = toxic_texts(150, 2)
    assert ((toxicity.scores(network, texts) >= 0.7) == labels).mean() > 0.9
    out = toxicity.score(docs_of(rows, [None, "", "  ", LONG]), network).select("doc_id", "score").collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(docs_of(rows).limit(0), network).count() == 0


def test_windows_overlap_and_cover_the_text():
    for n in (0, 1, 64, 65, 96, 97, 500):
        starts = toxicity.window_starts(n)
        seen = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n)) and all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_gradients_match_differences():
    network = toxicity.Network()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    words, rows, _, starts, ends = toxicity.cut(["one two three two", "four"])
    windows = toxicity.windows_at(rows, starts, ends)
    x, parts = network.features(words)
    logits, kept = network.run(network.project(x), windows, True)
    found = network.gradients(x, parts, kept, np.ones(len(logits)))
    for name, at in (("fU", (1, 2)), ("bW", (3, 4)), ("att", (0, 1)), ("query", (1,)), ("out", (2,))):
        old, sums = network.p[name][at], []
        for step in (1e-4, -1e-4):
            network.p[name][at] = old + step
            sums.append(network.run(network.project(network.features(words)[0]), windows)[0].sum())
        network.p[name][at] = old
        assert abs((sums[0] - sums[1]) / 2e-4 - found[name][at]) < 1e-4


def plain_targets(sizes, weights, total=1.5, repeats=2):
    """Targets found by closing one full source after the other."""
    wanted, found, left = total * sum(sizes.values()), {}, dict(weights)
    while left:
        level = (wanted - sum(found.values())) / sum(left.values())
        name = min(left, key=lambda n: repeats * sizes[n] / left[n])
        if left[name] * level < repeats * sizes[name]:
            return found | {n: w * level for n, w in left.items()}
        found[name] = float(repeats * sizes[name])
        del left[name]
    return found


@pytest.mark.parametrize("case", range(6))
def test_targets_equal_brute_force(rows, case):
    draw = random.Random(case)
    sizes = {f"s{i}": draw.choice([0, 1, 10, 1000, draw.randint(0, 50_000)]) for i in range(draw.randint(1, 40))}
    weights = {name: draw.choice([5.0, 2.0, 1.0, 0.01]) for name in sizes}
    sources = rows("of string, source_size long, weight double", *[(n, sizes[n], weights[n]) for n in sizes])
    found = {r["of"]: r["target"] for r in mixing.targets(sources, 1.5, 2).collect()}
    assert found == pytest.approx(plain_targets(sizes, weights), abs=1e-6)


def test_many_sources_are_all_mixed(spark):
    n = 200_001
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.lit("w "), (F.col("id") % 5).cast("int"))).alias("text"),
        F.when(F.col("id") != 7, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("source"))
    planned = mixing.plan(docs, mixing.turns(docs))
    words = sum(1 + i % 5 for i in range(n))
    total, least, rows_ = planned.agg(F.sum("target"), F.min("source_size"), F.count("*")).first()
    assert rows_ == n and least == 1 and total == pytest.approx(1.5 * words)


def test_one_key_and_odd_sources(rows):
    made = [(None, "w " * (i % 3 + 1), "\x00null" if i % 2 else None) for i in range(600)]
    docs = rows("doc_id long, text string, source string, size string, at string, key int", *[(*m, "x", "y", 1) for m in made])
    found, again = (sorted(map(str, mixing.plan(docs, mixing.turns(docs)).collect())) for _ in range(2))
    assert found == again and len(found) == 600
    by_source = {}
    for r in mixing.plan(docs, mixing.turns(docs)).collect():
        by_source.setdefault(r["source"], []).append(r)
    sizes = {k: sum(r["size"] for r in v) for k, v in by_source.items()}
    assert sizes == {None: 600, "\x00null": 600}
    for k, v in by_source.items():
        assert v[0]["source_size"] == sizes[k] and abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 3


def test_curriculum_query_is_in_training_order(spark):
    folder = "/root/testdata/sf0.001"
    out = plans.QUERIES["op5_curriculum"](spark, folder).collect()
    first = [r.positions[0] if r.positions else -1.0 for r in out]
    assert first == sorted(first) and max(first) > 0.9
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sizes, weights = {}, {}
    for r in docs.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for i, name in enumerate(sorted(sizes, key=lambda n: (n is None, (n or "").encode()))):
        weights[name] = (5.0, 2.0, 1.0)[i % 3]
    want, taken = plain_targets(sizes, weights), dict.fromkeys(sizes, 0)
    for r in out:
        source = docs[r.doc_id].source
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert r.taken == len(r.positions) * r["size"] <= 2 * r["size"]
        taken[source] += r.taken
    largest = max(r["size"] for r in out)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)


def test_mix_comes_near_its_targets(spark, rows):
    draw = random.Random(3)
    made = [(i, " ".join(["w"] * draw.randint(0, 30)) or None, ["a", "b", "c", None][min(3, i % 7)]) for i in range(700)]
    docs = rows("doc_id long, text string, source string", *made)
    found = mixing.plan(docs, mixing.turns(docs))
    again = mixing.plan(docs, mixing.turns(docs)).collect()
    out = found.collect()
    assert sorted(out, key=str) == sorted(again, key=str) and len(out) == 700
    for source in ("a", "b", "c", None):
        own = [r for r in out if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 30
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and r["positions"] == sorted(r["positions"]) for r in out)
    assert mixing.plan(docs.limit(0), mixing.turns(docs.limit(0))).count() == 0


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(s / 10,) for s in range(11)], "s double").select(
        "s", mixing.inverse_demand(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)), F.array(F.lit(1.0), F.lit(3.0), F.lit(0.0)), F.col("s")).alias("t"))
    area = lambda t: t + 2 * t * t if t <= 0.5 else 1.0 + 3 * (t - 0.5) - 3 * (t - 0.5) ** 2
    for s, t in df.collect():
        assert area(t) == pytest.approx(s * 1.75, abs=1e-9)
