"""Each stage on its own: nulls, repeats, ties, long texts, clashing names; the whole against plain rules."""

import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cadenza.llm import simhash

FOLDER = "/root/testdata/sf0.001"
KIND = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " score double, positions int, _id int, _position int, _kept int, document string, row int, ids int"
)
EXTRA = (0.5, 1, 2, 3, 4, "d", 5, 6)
LONG = "a long text of many words that never ends " * 20_000


def docs_of(rows, *given):
    return rows(KIND, *[(i, t, "en", s, len(t or ""), *EXTRA) for i, t, s in given])


def texts(df):
    return sorted((str(r.doc_id), str(r.text), str(r.source)) for r in df.collect())


def ran(stage, spark, docs):
    out = stage(spark, docs, FOLDER)
    assert out.columns == docs.columns and out.schema["score"].dataType.simpleString() == "double"
    return out


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:4]])
def test_stages_keep_columns_and_clean_documents(spark, rows, stage):
    given = [(1, "a quiet walk along the river bank", "a"), (2, "prices of copper rose again last week", "b"), (None, "the train was late once more", None)]
    docs = docs_of(rows, *given)
    out = ran(stage, spark, docs)
    assert {(str(i), t) for i, t, _ in texts(out)} == {(str(i), t) for i, t, _ in given}
    assert {tuple(r[5:]) for r in out.collect()} == {EXTRA}


def test_near_copies_are_chosen_by_row(spark, rows):
    same = "one two three four five six seven eight nine ten"
    docs = docs_of(
        rows, (5, same, "a"), (3, same, "a"), (3, same, "a"), (3, "another text under the same id", "a"),
        (None, None, "a"), (None, "", "b"), (7, " \t", "b"), (8, LONG, "b"), (9, LONG, None))
    out = texts(ran(corpus_pipeline.drop_near_copies, spark, docs))
    # One of the empty ones (null first), one of the long ones, one of the equal ones, and the other text.
    assert sorted((i, t) for i, t, _ in out) == sorted([("3", same), ("3", "another text under the same id"), ("8", LONG), ("None", out[-1][1])])
    assert out[-1][1] in ("", "None")
    prints = {simhash.fingerprint_of("" if t == "None" else t, 3) for _, t, _ in out}
    assert len(prints) == len(out)


def test_toxic_rows_go_whatever_their_names(spark, rows):
    scored = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    assert 0 < scored.count() < spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    docs = docs_of(rows, (1, None, None), (1, None, None), (2, LONG, "a"), (3, "", "a"))
    assert ran(corpus_pipeline.drop_toxic, spark, docs).count() == 4


def test_secrets_are_marked_in_every_row(spark, rows):
    secret = 'password="hunter2hunter2"'
    docs = docs_of(rows, (1, f"use {secret} here", "a"), (1, f"use {secret} here", "a"), (None, None, None), (2, LONG + secret, "a"))
    out = ran(corpus_pipeline.redact_secrets, spark, docs).collect()
    assert len(out) == 4 and not any("hunter2" in (r.text or "") for r in out)
    assert all(r.n_chars == len(r.text or "") for r in out if r.text)


def test_copies_of_repeated_rows_and_shared_ids(spark, rows):
    given = [(1, "one two", "a"), (1, "one two", "a"), (1, "three four five", "a"), (None, "six", None), (2, None, "a"), (3, LONG, "b")]
    out = ran(corpus_pipeline.mix_sources, spark, docs_of(rows, *given)).collect()
    copies = {}
    for r in out:
        copies[r.doc_id, r.text] = copies.get((r.doc_id, r.text), 0) + 1
    assert set(copies) <= {(i, t) for i, t, _ in given} and (2, None) not in copies
    assert copies[1, "one two"] <= 4 and all(n <= 2 for key, n in copies.items() if key != (1, "one two"))
    words = sum(len(r.text.split()) for r in out)
    total = 1.5 * sum(len((t or "").split()) for _, t, _ in given)
    assert abs(words - total) <= len(LONG.split())


def test_tokens_of_every_copy(spark, rows):
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    given = [(1, "Ein Text", "a"), (1, "Ein Text", "a"), (None, None, None), (2, "", "a"), (3, LONG, "b")]
    out = corpus_pipeline.encode_tokens(spark, docs_of(rows, *given), FOLDER).collect()
    assert len(out) == 5
    for r in out:
        text = next((t for i, t, _ in given if i == r.doc_id), None) or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == library.decode(want, skip_special_tokens=False)


def test_run_is_the_chain_of_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, FOLDER).collect()
    least = {}
    for r in clean:  # equal texts are certain copies: of each, only the least id may stay
        digest = hashlib.sha256((r.text or "").encode()).hexdigest()
        least[digest] = min(r.doc_id, least.get(digest, r.doc_id))
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in out} <= set(least.values())
    assert max(sum(1 for r in out if r.doc_id == i) for i in {r.doc_id for r in out}) <= 2
