"""Secrets in texts: fixed rules, and two character Markov models compared by likelihood ratio.

Rules (kinds ``assign``, ``access``, ``hex``) are matched left to right without overlap, each kind by
itself; matches that are too short are dropped. Beside them, every run of token characters that no rule
touches is scored: the log-likelihood of its characters under a model of random strings, less that under
a model of ordinary identifiers, per character. Runs above a threshold that no training word reaches
become spans of kind ``random``.

Null and empty texts have no spans. Spans count code points, ends exclusive. Repeated rows give repeated
results; a column of the input named ``spans`` is replaced, others stay. Without training words of a
class its model is uniform.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import content, stored

ASSIGN = re.compile(  # fixed value
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run fails as a whole, so the length may stand in the pattern
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs of token characters; hexadecimal runs lie within them. Those of digits alone are numbers, which
#: the models do not judge.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind:string, start:int, `end`:int>>"
#: Characters the models tell apart: the token characters, and the edge of a run.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(128, 0, np.int64)
CODE[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)
#: Bounds of the training sample: texts read, and words of each class.
SAMPLE_TEXTS, SAMPLE_WORDS = 4000, 40_000


class Models(NamedTuple):
    """Log ratio of the two models' transition probabilities, and the threshold per character."""

    ratio: np.ndarray
    threshold: float


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed rules, by start and then kind."""
    spans = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    for run in RUN.finditer(text):
        if run.end() - run.start() >= 24:
            spans += [("hex", *m.span()) for m in HEX.finditer(text, *run.span())]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def ratios(models: Models, words: list[str]) -> np.ndarray:
    """Mean log-likelihood ratio per transition of each word, edges included."""
    if not words:
        return np.empty(0)
    joined = CODE[np.frombuffer(("\x00" + "\x00".join(words) + "\x00").encode("ascii"), np.uint8)]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return np.add.reduceat(models.ratio[joined[:-1], joined[1:]], np.cumsum(lengths) - lengths) / lengths


def _log_transitions(words: list[str]) -> np.ndarray:
    n = len(LETTERS) + 1
    counts = np.ones((n, n))  # each transition is seen once more than it was
    if words:
        joined = CODE[np.frombuffer(("\x00" + "\x00".join(words) + "\x00").encode("ascii"), np.uint8)]
        np.add.at(counts, (joined[:-1], joined[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def train(sample: DataFrame) -> Models:
    """Models from (word, label): 1 for random strings, 0 for ordinary identifiers.

    The threshold lies above every ordinary training word of a run's length, and no lower than
    midway between the classes' means.
    """
    rows = sample.toPandas()
    words = {label: [w for w in rows["word"][rows["label"] == label] if w.isascii()] for label in (0, 1)}
    models = Models(_log_transitions(words[1]) - _log_transitions(words[0]), 0.0)
    plain, odd = (ratios(models, words[label]) for label in (0, 1))
    long_plain = plain[np.fromiter((len(w) >= 16 for w in words[0]), bool, len(words[0]))]
    highest = float(long_plain.max()) if len(long_plain) else 0.0
    middle = float(plain.mean() + odd.mean()) / 2 if len(plain) and len(odd) else 0.0
    return models._replace(threshold=max(highest + 0.05, middle, 0.0))


def labelled_sample(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, label) from a bounded, hash-drawn sample of texts: what the rules find is labelled 1,
    lower-case words and identifiers that stand apart from them 0."""

    @F.arrow_udf("array<struct<word:string, label:int>>")
    def words(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            whole, found = value.as_py(), {}
            spans = base_spans(whole)
            for kind, start, end in spans:
                word = ASSIGN.match(whole[start:end])[2] if kind == "assign" else whole[start:end]
                found.update((w, 1) for w in RUN.findall(word))
            blank = [*whole]
            for _, start, end in spans:
                blank[start:end] = " " * (end - start)
            # An identifier: letters, perhaps with digits after them, joined by single signs.
            for word in re.findall(r"(?<!\S)[A-Za-z]+[0-9]{0,4}(?:[_/-][A-Za-z]+[0-9]{0,4})*(?=[\s.,;:!?]|$)", "".join(blank)):
                found.setdefault(word, 0)
            out.append([{"word": w, "label": label} for w, label in found.items()])
        return pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("label", pa.int32())])))

    # Keys are drawn first, so that only the sample's texts leave the scan.
    drawn = docs.select(F.col(key).alias("_drawn")).distinct().orderBy(F.xxhash64("_drawn"), "_drawn").limit(SAMPLE_TEXTS)
    texts = docs.select(key, content(text).alias("_text")).join(F.broadcast(drawn), F.col(key).eqNullSafe(F.col("_drawn")))
    each = stored(texts.select(F.explode(words("_text")).alias("w")).select("w.*").distinct(), "words")
    parts = [
        each.filter(F.col("label") == label).orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS) for label in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def all_spans(texts: list[str], models: Models) -> list[list[tuple[str, int, int]]]:
    """Spans of the rules and of the models in each text, by start and then kind."""
    spans = [base_spans(text) for text in texts]
    runs = [(i, m.start(), m[0]) for i, text in enumerate(texts) for m in RUN.finditer(text) if not m[0].isdigit()]
    for (i, start, run), ratio in zip(runs, ratios(models, [run for *_, run in runs])):
        end = start + len(run)
        if ratio > models.threshold and not any(s < end and start < e for _, s, e in spans[i]):
            spans[i].append(("random", start, end))
    return [sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))) for found in spans]


def find(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: kind, start and end of each secret."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        found = all_spans([value.as_py() for value in texts], models)
        return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in found], kind)

    return docs.withColumn("spans", run(content(text)))


def redact(docs: DataFrame, models: Models, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with ``mark`` in place of each secret; overlapping spans become one mark."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        values = [value.as_py() for value in texts]
        out = []
        for whole, spans in zip(values, all_spans([v or "" for v in values], models)):
            parts, at = [], 0
            for _, start, end in spans:
                if start >= at:
                    parts += [whole[at:start], mark]
                at = max(at, end)
            out.append("".join([*parts, whole[at:]]) if spans else whole)
        return pa.array(out, pa.string())

    return docs.withColumn(text, run(F.col(text)))
