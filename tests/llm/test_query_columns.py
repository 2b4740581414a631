"""Columns of the queries over whole tables, against rules written down a second time and against labels."""

import hashlib
import re
import zlib

from cadenza.llm import plans

RULES = (
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
                          r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def base(text):
    found = []
    for place, (kind, rule, group, least) in enumerate(RULES):
        found += [(m.start(), place, m.end(), kind) for m in rule.finditer(text) if len(m[group]) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def test_secret_columns(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = plans.QUERIES["op7_secrets"](spark, folder).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        spans = base(docs[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        every = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r.spans.split(",")] if r.spans else []
        assert [s for s in every if s[0] != "random"] == spans
        random = [s for s in every if s[0] == "random"]
        assert len(random) == r.n_random and all(b > a for _, a, b in every)
        # What the models add touches no base span, and is a whole run of token characters.
        assert all(b2 <= a or b <= a2 for _, a, b in random for _, a2, b2 in spans)
        assert all(re.fullmatch(r"[A-Za-z0-9+/_=-]{16,}", docs[r.doc_id][a:b]) for _, a, b in random)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in out) > 20


def test_toxicity_on_held_out_labels(spark):
    """The network, trained on two thirds of the labels, against the third it never saw."""
    folder = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.toxic is not None}
    out = plans.QUERIES["op10_toxicity"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in toxic]
    ones, zeros = ([r for r in held if toxic[r.doc_id] == label] for label in (1, 0))
    caught, alarms = sum(r.predicted for r in ones) / len(ones), sum(r.predicted for r in zeros) / len(zeros)
    ahead = sum((a.score > b.score) + (a.score == b.score) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    print(f"held out: {len(ones)} toxic, {len(zeros)} clean; caught {caught:.3f}, false alarms {alarms:.3f}, area {ahead:.3f}")
    assert len(ones) > 50 and caught > 0.6 and alarms < 0.02 and ahead > 0.85


def test_token_count_columns(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    out = plans.QUERIES["op8_token_counts"](spark, folder).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert sorted(map(tuple, out.collect())) == sorted(want)
