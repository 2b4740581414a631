"""Runs of repeated words, found with a dictionary of basic factors.

The factors of a text are its stretches of L words, L a power of two. Each level names them (equal
factors, equal names); the names of the next level are those of pairs of this one, so no factor is
ever compared word by word. If a factor comes again at most L words later, the two overlap or
touch, and their distance d proposes a period; the factors of a run with period d in (L/2, L] that
start at its first, second, third ... word all have their successor d words on. Such a stretch of
equal distances is therefore one run: it starts with the first of these factors, and ends L + d
words after the last one's start. Every run of at least three periods shows up at exactly one
level; comparing the words beside it extends it and merges what is found twice. Levels end as soon
as no factor repeats.

Words are runs of anything but the six ASCII white-space characters. Null and empty texts have no
words, no runs and the empty text as the collapsed one. Rows are independent: repeated rows get equal
results, null ids are allowed. Columns named like an output are replaced; others stay. One text is
held by one task, in memory proportional to its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import content, free_name

WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
FOUND = (
    "struct<n_words:bigint, n_runs:bigint, start:bigint, length:bigint, period:bigint, exponent_milli:bigint,"
    " runs:array<struct<start:bigint, length:bigint, period:bigint>>, collapsed:string>"
)


@dataclass(frozen=True)
class Rule:
    """A run counts from ``length`` words and ``exponent`` periods on; ``exponent`` is 3 at least."""

    length: int = 24
    exponent: int = 3

    def __post_init__(self):
        if self.exponent < 3:
            raise ValueError("runs of fewer than three periods are not found at a single level")


def _successors(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose name comes again, and how far on, by place."""
    order = np.argsort(names, kind="stable")
    again = names[order[1:]] == names[order[:-1]]
    places, distance = order[:-1][again], (order[1:] - order[:-1])[again]
    by_place = np.argsort(places, kind="stable")
    return places[by_place], distance[by_place]


def _extended(words: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The stretch with this period, as far as the words beside it go on with it."""
    while start and words[start - 1] == words[start - 1 + period]:
        start -= 1
    while end < len(words) and words[end] == words[end - period]:
        end += 1
    return start, end


def runs_of(words: np.ndarray, rule: Rule = Rule()) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period."""
    words = np.asarray(words, np.int64)
    found, names, length = set(), words, 1
    while length + length // 2 < len(words):
        places, distance = _successors(names)
        if not len(places):
            break
        near = (distance > length // 2) & (distance <= length)
        at, d = places[near], distance[near]
        if len(at):  # progressions: neighbouring places with the same distance
            cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(d) != 0)) + 1
            first, last = np.r_[0, cuts], np.r_[cuts, len(at)] - 1
            ends = at[last] + length + d[first]
            enough = ends - at[first] >= np.maximum(rule.length, rule.exponent * d[first])
            for a, e, p in zip(at[first][enough].tolist(), ends[enough].tolist(), d[first][enough].tolist()):
                a, e = _extended(words, a, e, p)
                found.add((a, e - a, p))
        pairs = names[:-length] * (names.max() + 1) + names[length:]
        _, names = np.unique(pairs, return_inverse=True)
        length *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``n`` words lies in some run after that run's first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def most_repeated(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties go to the least start, then period."""
    best = None
    for run in runs:  # in order of start and period, so only a greater one replaces
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def analysed(words: list[str], rule: Rule) -> dict:
    numbers: dict[str, int] = {}
    coded = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    runs = runs_of(coded, rule)
    if runs:
        words = [words[i] for i in np.flatnonzero(~dropped(len(words), runs)).tolist()]
    start, length, period = most_repeated(runs) or (None, None, None)
    return {
        "n_words": len(coded), "n_runs": len(runs), "start": start, "length": length, "period": period,
        "exponent_milli": 1000 * length // period if runs else None,
        "runs": [{"start": a, "length": n, "period": p} for a, n, p in runs], "collapsed": " ".join(words),
    }


def repeated_runs(docs: DataFrame, rule: Rule = Rule(), text: str = "text", loop_from=None, loop_width=None) -> DataFrame:
    """``docs`` with the fields of ``FOUND``: its runs, the most repeated one, and the text without repeats.

    With ``loop_from`` and ``loop_width`` (columns, null: leave the text as it is) the words from the
    first on are replaced by repeats of the ``loop_width`` words there, before anything is counted.
    """

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array, starts: pa.Array, widths: pa.Array) -> pa.Array:
        out = []
        for value, a, p in zip(texts.to_pylist(), starts.to_pylist(), widths.to_pylist()):
            words = WORDS.findall(value)
            if a is not None and p is not None and a < len(words):
                block = words[a:a + p]
                words[a:] = [block[i % p] for i in range(len(words) - a)]
            out.append(analysed(words, rule))
        return pa.array(out, kind)

    kind = pa.struct([
        *((name, pa.int64()) for name in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")),
        ("runs", pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))),
        ("collapsed", pa.string()),
    ])
    none = F.lit(None).cast("bigint")
    made, names = free_name(docs, "found"), [field.name for field in kind]
    with_runs = docs.withColumn(made, found(
        content(text), none if loop_from is None else loop_from, none if loop_width is None else loop_width))
    kept = [c for c in docs.columns if c.lower() not in names]
    return with_runs.select(*kept, *(F.col(made)[name].alias(name) for name in names))


def word_count(text: str = "text"):
    """Number of words of a text, in SQL functions."""
    return F.regexp_count(content(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
