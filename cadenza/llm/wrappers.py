"""Main text of web pages, by wrappers that are inferred from the pages of a host.

A wrapper is a union-free regular expression over the token streams of a host's pages. It is inferred
step by step: the first page is the first wrapper; every further page is aligned with it, and what does
not agree is resolved by text slots (different texts at one place), optional groups (tokens that one
side lacks) and repeated groups (a stretch of tokens that follows its like). Tags of a stream are
balanced, so alignment goes level by level. Wrappers are aligned with each other in the same way, so a
host of any size is folded by many tasks, and their results once more, until one is left.

The wrapper keeps, for each place, how much text the host's pages have there, how much of it in links,
and whether it is always the same. That decides which places hold the main text: those in an article
(or a main element, or an element that is named so), whichever holds most of the host's text, without
the parts that tags, roles and names set apart; where no such element is, the place in which most of
the varying text gathers, without link lists and texts that never change. Each page is then aligned
with its host's wrapper, and its texts at such places are its main text.

Null and empty pages have an empty text. Pages without a host (or url) share one wrapper. Pages that
are repeated, also under one id, get equal texts. A page with an article is taken at its word: the
text may be empty. An empty table gives no rows. Columns of the input other than outputs stay.
Wrappers are bounded: levels of more than ``WIDE`` places become one repeated group of optional
places, and wrappers of more than ``PLACES`` end at a lesser depth, below which pages go by their own
tags. No page is left out, none is cut, and the text of a page never depends on these bounds alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.llm import markup
from cadenza.llm.common import content, free_name, stored
from cadenza.llm.markup import ARTICLE, DENSEST, MAIN, NAMED, TEXT

#: Places of one level, and of a whole wrapper.
WIDE, PLACES = 256, 4096
#: Partial wrappers that are merged by one task at a time, and hosts that a task holds at once.
FAN, HOSTS = 64, 1000
ANY = "(*)"
LABEL, QUANTIFIER, CHILDREN, CHARS, LINKS, VALUE, TEXTS = range(7)
OPTIONAL, REPEATED = 1, 2


def unite(a: list, b: list) -> list:
    """Two places with one label as one, in place of ``a``."""
    a[QUANTIFIER] |= b[QUANTIFIER]
    a[CHARS] += b[CHARS]
    a[LINKS] += b[LINKS]
    a[TEXTS] += b[TEXTS]
    if a[VALUE] != b[VALUE]:
        a[VALUE] = None  # a text slot
    if a[CHILDREN] is not None:
        a[CHILDREN] = combined(a[CHILDREN], b[CHILDREN])
    return a


def labels_of(items: list) -> list[str]:
    return [x[LABEL] for x in items]


def group(items: list) -> list:
    return ["(" + " ".join(f"<{x}>" for x in labels_of(items)) + ")", 0, items, 0, 0, None, []]


def _neighbours(items: list) -> list:
    out: list = []
    for x in items:
        if out and out[-1][LABEL] == x[LABEL]:
            both = out[-1][QUANTIFIER] & x[QUANTIFIER] & OPTIONAL
            out[-1] = unite(out[-1], x)
            out[-1][QUANTIFIER] = both | REPEATED if x[LABEL] != TEXT else both
        else:
            out.append(x)
    return out


def repeats(items: list) -> list:
    """Stretches that follow their like as one repeated place, single tags first, then longer groups."""
    items, size = _neighbours(items), 2
    while 2 * size <= len(items) and 2 * size <= WIDE:
        labels, before, i = labels_of(items), len(items), 0
        while i + 2 * size <= len(labels):
            j = i + size
            while j < len(labels) and labels[i] == labels[j] and labels[i:i + size] == labels[j:j + size]:
                j += size
            if j > i + size:
                items[i:j] = _neighbours([group(items[k:k + size]) for k in range(i, j, size)])
                labels[i:j] = [items[i][LABEL]]
            i += 1
        items = _neighbours(items)
        size = 2 if len(items) < before else size + 1
    return spread(items) if len(items) > WIDE or any(x[LABEL] == ANY for x in items) and len(items) > 1 else items


def _flat(items: list) -> Iterator[list]:
    for x in items:
        if x[LABEL].startswith("("):
            yield from _flat(x[CHILDREN])
        else:
            yield x


def spread(items: list) -> list:
    """All places of a level as one repeated group of optional places, one for each label."""
    for short in (False, True):
        by_label: dict[str, list] = {}
        for x in _flat(items):
            if short:
                x[LABEL] = x[LABEL].split(" ")[0]
            known = by_label.get(x[LABEL])
            by_label[x[LABEL]] = x if known is None else unite(known, x)
            by_label[x[LABEL]][QUANTIFIER] = OPTIONAL | REPEATED
        items = [by_label[label] for label in sorted(by_label)]
        if len(items) <= WIDE:
            break
    return [[ANY, OPTIONAL | REPEATED, items, 0, 0, None, []]]


def _wrapped(items: list, like: list) -> list:
    """Stretches of ``items`` as groups, where ``like`` has such groups."""
    for g in like:
        if g[LABEL].startswith("(") and g[LABEL] != ANY:
            inside, labels, i = labels_of(g[CHILDREN]), labels_of(items), 0
            while inside[0] in labels[i:]:
                i = labels.index(inside[0], i)
                if labels[i:i + len(inside)] == inside:
                    items = [*items[:i], group(items[i:i + len(inside)]), *items[i + len(inside):]]
                    labels = labels_of(items)
                i += 1
    return items


def combined(a: list, b: list) -> list:
    """One level of two expressions as one that takes what either takes."""
    if any(x[LABEL] == ANY for x in (*a, *b)):
        return spread([*a, *b])
    if labels_of(a) == labels_of(b):
        for x, y in zip(a, b):
            unite(x, y)
        return a
    a, b = _neighbours(_wrapped(a, b)), _neighbours(_wrapped(b, a))
    out: list = []
    for step, i, j, k, m in SequenceMatcher(None, labels_of(a), labels_of(b), autojunk=False).get_opcodes():
        if step == "equal":
            out += [unite(x, y) for x, y in zip(a[i:j], b[k:m])]
            continue
        for x in (*a[i:j], *b[k:m]):
            x[QUANTIFIER] |= OPTIONAL
            out.append(x)
    return repeats(out)


def expression(page: str) -> tuple[list, list]:
    """A page as an expression with its own repeats folded, and its texts."""
    def folded(items: list) -> list:
        for x in items:
            if x[CHILDREN]:
                x[CHILDREN] = folded(x[CHILDREN])
        return repeats(items)

    items, texts = markup.tokens(page)
    return folded(items), texts


def _size(items: list) -> int:
    return sum(1 + (_size(x[CHILDREN]) if x[CHILDREN] else 0) for x in items)


def _cut(items: list, depth: int) -> None:
    """Leave no places below ``depth``; what they hold counts for the place above them."""
    for x in items:
        if not x[CHILDREN]:
            continue
        _cut(x[CHILDREN], depth - 1)
        if depth <= 1:
            x[CHARS], x[LINKS] = (x[n] + sum(c[n] for c in x[CHILDREN]) for n in (CHARS, LINKS))
            x[CHILDREN] = []


class Wrapper:
    """The expression of a host's pages so far, and how many those are."""

    def __init__(self, text: str | None = None):
        self.pages, self.items = json.loads(text) if text else (0, [])

    def _add(self, items: list, pages: int) -> None:
        self.items = items if not self.pages else combined(self.items, items)
        self.pages += pages
        for depth in (24, 16, 12, 8, 6, 4, 2):
            if _size(self.items) <= PLACES:
                break
            _cut(self.items, depth)

    def add_page(self, page: str) -> None:
        items, _ = expression(page)
        _forget(items)
        self._add(items, 1)

    def add(self, other: Wrapper) -> None:
        self._add(other.items, other.pages)

    def text(self) -> str:
        return json.dumps([self.pages, self.items], separators=(",", ":"))

    def __str__(self) -> str:
        return _written(self.items)


def _forget(items: list) -> None:
    for x in items:
        x[TEXTS].clear()
        if x[CHILDREN]:
            _forget(x[CHILDREN])


def _written(items: list) -> str:
    """The expression as people write it."""
    def one(x):
        mark = ("", "?", "+", "*")[x[QUANTIFIER]]
        if x[LABEL] == TEXT:
            return ("#text" if x[VALUE] is None else "text") + mark
        inside = _written(x[CHILDREN])
        if x[LABEL].startswith("("):
            return f"({inside}){mark}"
        whole = f"<{x[LABEL]}>{inside}</{x[LABEL].split(' ')[0]}>"
        return f"({whole}){mark}" if mark else whole
    return " ".join(map(one, items))


# Which places hold the main text

OUT = -1


class Plan:
    """A wrapper with the decision for each of its places.

    ``items`` are [label, children, mark]: the content marks of a place, or ``OUT``. ``order``
    has the content marks by preference; a page goes by the first that it has a place for.
    """

    def __init__(self, text: str):
        pages, items = json.loads(text)
        self.volume = {mark: 0 for mark in (ARTICLE, MAIN, NAMED)}
        self.items = [self._marked(x, 0) for x in items]
        most = max(self.volume.values())
        # Teasers marked as articles must not win over the element that holds the text.
        self.order = sorted(self.volume, key=lambda mark: 2 * self.volume[mark] < most) + [DENSEST]
        self._mark_densest(items, self.items, pages)

    def _marked(self, x: list, inside: int) -> list:
        mark = decision(x[LABEL], inside)
        if mark == OUT:
            return [x[LABEL], [], OUT]
        inside |= mark
        for kind in self.volume:
            if inside & kind:
                self.volume[kind] += x[CHARS] - x[LINKS]
        return [x[LABEL], [self._marked(c, inside) for c in x[CHILDREN] or ()], mark]

    @staticmethod
    def _mark_densest(items: list, marked: list, pages: int) -> None:
        """Mark the smallest place with most of the varying text, for pages without any content mark."""
        def own(x):  # a single page has no text that varies
            return x[CHARS] - x[LINKS] if x[VALUE] is None or pages < 2 else 0

        def weight(x, m):
            return 0 if m[2] == OUT else own(x) + sum(weight(c, k) for c, k in zip(x[CHILDREN] or (), m[1]))

        level = list(zip(items, marked))
        if not any(weight(x, m) for x, m in level):
            own = lambda x: x[CHARS] - x[LINKS]  # noqa: E731  (pages that are all the same)
        chosen = [m for _, m in level]
        while level:
            heavy, weights = max(level, key=lambda p: weight(*p)), [weight(*p) for p in level]
            if 10 * weight(*heavy) < 7 * sum(weights) or not heavy[0][CHILDREN]:
                break
            below = list(zip(heavy[0][CHILDREN], heavy[1][1]))
            if all(c[LABEL] == TEXT for c, _ in below):
                break
            chosen, level = [heavy[1]], below

        def prune(x, m):
            total = lambda n: sum(y[n] for y in _all([x]))
            if 2 * total(LINKS) > total(CHARS) or x[LABEL] == TEXT and pages > 1 and own(x) == 0:
                m.append(DENSEST)  # not part of the densest place
            for c, k in zip(x[CHILDREN] or (), m[1]):
                prune(c, k)

        for x, m in level:
            prune(x, m)
        for m in chosen:
            if m[2] != OUT:
                m[2] |= DENSEST


def _all(items: list) -> Iterator[list]:
    for x in items:
        yield x
        yield from _all(x[CHILDREN] or ())


def decision(label: str, inside: int) -> int:
    """Content marks that a label adds, or ``OUT``."""
    if label == TEXT or label.startswith("("):
        return 0
    out, out_of_content, mark = markup.part_of(label)
    return OUT if out or out_of_content and not inside else mark


def _pairs(page: list, plan: list) -> Iterator[tuple[list, list | None]]:
    """Places of a page with those of the wrapper they are taken by (none: beyond the wrapper's depth)."""
    if len(plan) == 1 and plan[0][0] == ANY:
        known = {m[0]: m for m in plan[0][1]}
        for x in _flat(page):
            yield x, known.get(x[LABEL]) or known.get(x[LABEL].split(" ")[0])
        return
    mine, theirs = labels_of(page), [m[0] for m in plan]
    if mine != theirs:
        like = [[m[0], 0, [[k[0]] for k in m[1]]] for m in plan if m[0].startswith("(")]
        page = _neighbours(_wrapped(page, like))
        mine = labels_of(page)
    by_label: dict[str, list] = {}
    for m in plan:
        by_label.setdefault(m[0], m)
    for step, i, j, k, m in SequenceMatcher(None, mine, theirs, autojunk=False).get_opcodes() if mine != theirs else [("equal", 0, len(mine), 0, len(mine))]:
        if step == "equal":
            yield from zip(page[i:j], plan[k:m])
        else:
            for x in page[i:j]:
                yield x, by_label.get(x[LABEL])


def main_text(page: str, plan: Plan) -> str:
    items, texts = expression(page)
    places: dict[int, list[int]] = {mark: [] for mark in plan.order}
    seen = 0

    def visit(page_items: list, plan_items: list, inside: int) -> None:
        nonlocal seen
        for x, m in _pairs(page_items, plan_items):
            mark = m[2] if m else decision(x[LABEL], inside)
            if mark == OUT:
                continue
            here = inside | mark
            if m and len(m) > 3:
                here &= ~DENSEST
            seen |= here
            for kind in places:
                if here & kind:
                    places[kind] += x[TEXTS]
            if x[CHILDREN]:
                visit(x[CHILDREN], m[1] if m else [], here)

    visit(items, plan.items, 0)
    for mark in plan.order:
        if seen & mark:
            return markup.joined(texts, places[mark])
    return ""


# On tables

def host_of(url: Column) -> Column:
    """The host of an absolute url in lower case, else the empty text."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_PARTIAL = pa.schema([("host", pa.string()), ("wrapper", pa.string())])
_PARTIAL_DDL = "host string, wrapper string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Wrapper] = {}

    def out():
        rows = [{"host": host, "wrapper": known[host].text()} for host in sorted(known)]
        known.clear()
        return pa.RecordBatch.from_pylist(rows, _PARTIAL)

    for batch in batches:
        for host, page in zip(batch["host"], batch["page"]):
            host = host.as_py()
            if host not in known and len(known) >= HOSTS:
                yield out()
            known.setdefault(host, Wrapper()).add_page(page.as_py())
    yield out()


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    whole = Wrapper()
    for row in table.sort_by("part")["wrapper"]:
        whole.add(Wrapper(row.as_py()))
    return pa.Table.from_pylist([{"host": key[0].as_py(), "wrapper": whole.text()}], _PARTIAL)


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, wrapper``: one wrapper for each host.

    Every task folds the pages it reads; the partial wrappers of a host are then merged ``FAN`` at a
    time, so no task meets all pages of a host, and each round is written before the next one.
    """
    given = pages.select(host_of(F.col(url)).alias("host"), content(html).alias("page"))
    partial = stored(given.mapInArrow(_fold, _PARTIAL_DDL).withColumn("part", F.monotonically_increasing_id()), "wrappers")
    while True:
        counts = partial.groupBy("host").agg(F.count(F.lit(1)).alias("parts"))
        most = counts.agg(F.max("parts")).first()[0] or 0
        if most <= 1:
            return partial.select("host", "wrapper")
        piece = F.pmod(F.xxhash64("part"), F.ceil(F.col("parts") / FAN).cast("bigint"))
        merged = (
            partial.join(counts, "host").withColumn("piece", piece)
            .groupBy("host", "piece").applyInArrow(_merge, _PARTIAL_DDL)
        )
        partial = stored(merged.withColumn("part", F.monotonically_increasing_id()), "wrappers")


@lru_cache(maxsize=256)
def _plan(wrapper: str) -> Plan:
    return Plan(wrapper)


def extract(pages: DataFrame, url: str = "url", html: str = "html", wrappers: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text of each, by the given or else newly inferred wrappers."""

    @F.arrow_udf("string")
    def texts(found: pa.Array, by: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), _plan(w.as_py() or "[0,[]]")) for p, w in zip(found, by)], pa.string())

    wrappers = infer(pages, url, html) if wrappers is None else wrappers
    host, wrapper = free_name(pages, "host"), free_name(pages, "wrapper")
    known = wrappers.select(F.col("host").alias(host), F.col("wrapper").alias(wrapper))
    # The wrappers are a written table: Spark broadcasts it if it is small, else both sides are dealt by host.
    with_wrapper = pages.withColumn(host, host_of(F.col(url))).join(known, host, "left")
    return with_wrapper.withColumn("text", texts(content(html), F.col(wrapper))).drop(host, wrapper)
