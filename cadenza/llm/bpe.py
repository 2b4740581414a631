"""BPE encoding with a priority queue of merge ranks, and decoding.

A word is a doubly linked list of symbols. The queue holds (rank, place) of the pairs
that have a merge; the lowest rank, leftmost first, is taken, entries whose pair has
changed since are skipped, and each merge puts its two new neighbour pairs in the queue.
Decoding puts the vocabulary strings of the ids together.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded
alike. Columns of the input named like an output are replaced; others stay.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain
from string import punctuation
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from cadenza.llm.common import content

#: Bytes that a Python worker keeps of words and their ids. Words of more than ``LONGEST`` characters are never kept.
REMEMBERED, LONGEST = 32 << 20, 48
#: Bytes of text, and ids, that are worked on at once.
AT_ONCE = 6 << 20


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte."""
    letters, spare = [], 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


def merge_word(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge the symbols of one word, lowest rank first and leftmost among equals.

    ``ranks`` has the rank of a pair (left << 20 | right), ``merged`` the symbol each rank makes.
    """
    n, rank_of = len(symbols), ranks.get
    if n < 2:
        return symbols
    if n == 2:  # a queue of one entry
        rank = rank_of(symbols[0] << 20 | symbols[1])
        return symbols if rank is None else [merged[rank]]
    queue = [
        rank << 32 | i for i in range(n - 1) if (rank := rank_of(symbols[i] << 20 | symbols[i + 1])) is not None
    ]
    if not queue:
        return symbols
    heapq.heapify(queue)
    pop, push = heapq.heappop, heapq.heappush
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    while queue:
        entry = pop(queue)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if j < 0 or symbols[i] < 0 or rank_of(symbols[i] << 20 | symbols[j]) != rank:
            continue  # stale: one of the two has been merged since
        symbols[i] = symbol = merged[rank]
        symbols[j] = -1
        after[i] = j = after[j]
        if j >= 0:
            before[j] = i
            if (rank := rank_of(symbol << 20 | symbols[j])) is not None:
                push(queue, rank << 32 | i)
        if (k := before[i]) >= 0 and (rank := rank_of(symbols[k] << 20 | symbol)) is not None:
            push(queue, rank << 32 | k)
    return [s for s in symbols if s >= 0]


class Remembered(dict):
    """Results of ``make`` for keys that came up lately: at most ``REMEMBERED`` bytes, in two halves."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older, self.held = make, {}, 0

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            # The ids are those of the vocabulary; a place in the table takes some 100 bytes more.
            size = getsizeof(key) + getsizeof(value) + 100
            if self.held + size > REMEMBERED // 2:
                self.older, self.held = dict(self), 0
                self.clear()
            self.held += size
            self[key] = value
        return value


def known_letters(text: str) -> bool:
    """Whether this Python's Unicode tables know all code points of the text."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return all(c < "\u0378" or unicodedata.category(c) != "Cn" for c in set(text))


class WordBpe:
    """Encoder and decoder of one word-level BPE file (lower case, byte letters, word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        steps = [n["type"] for n in config["normalizer"]["normalizers"]]
        split = config["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError(f"{path} is not a word-level BPE of the known form")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks, self.merged = {}, []
        for rank, (left, right) in enumerate(pairs):
            self.ranks[vocab[left] << 20 | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        strings: list = [None] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in chain(vocab.items(), self.special.items()):
            strings[i] = token
        self.strings = pa.array(strings, pa.string())
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # The pattern never takes white space, so a text can be cut there first and pieces remembered.
        self.pattern, self.path = split["pattern"]["Regex"], path
        self.words = regex.compile(self.pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.odd = regex.compile(r"[\x1c-\x1f]")  # white space to str.split, not to the pattern
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.inner = [vocab[letter] for letter in byte_letters()]
        self.last = [vocab[letter + end] for letter in byte_letters()]
        self.by_word = Remembered(self._word)

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return tuple(merge_word(symbols, self.ranks, self.merged))

    @cached_property
    def _own(self):
        """Normaliser and splitter of the library: they know the Unicode version the file is used with."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        cut = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        return Tokenizer.from_file(self.path).normalizer.normalize_str, cut.pre_tokenize_str

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece without white space, in composed form and lower case letter by letter (no final sigma)."""
        letters = piece.rstrip(punctuation)
        if letters.isalpha() and max(letters) < "\u0100":  # composed already, and one word before the signs
            ids = self.by_word[letters.lower()]
            return ids if len(letters) == len(piece) else ids + self.by_word[piece[len(letters):]]
        if piece in self.special:
            return (self.special[piece],)
        if known_letters(piece):
            composed = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
            words = self.words.findall(composed.replace("Σ", "σ").lower())
        else:  # libraries differ in the Unicode version they know; newer code points are left to the file's own
            normalise, cut = self._own
            words = [word for word, _ in cut(normalise(piece))]
        return tuple(chain.from_iterable(map(self.by_word.__getitem__, words)))

    def pieces(self, text: str) -> list[str]:
        """Special tokens, and what white space leaves between them."""
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += part.split() if not self.odd.search(part) else filter(None, self.spaces.split(part))
        return out

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text. Texts are cut and their ids put together by Arrow; only different pieces are encoded."""
        pieces = pc.utf8_split_whitespace(texts)
        odd = np.flatnonzero(pc.match_substring_regex(texts, r"<\||[\x1c-\x1f]").to_numpy(zero_copy_only=False))
        if len(odd):  # special tokens, or white space to Arrow that the pattern does not take for it
            own = pa.array([self.pieces(texts[i].as_py()) for i in odd.tolist()], pieces.type)
            places = np.arange(len(texts))
            places[odd] = len(texts) + np.arange(len(odd))
            pieces = pa.concat_arrays([pieces, own]).take(pa.array(places))
        counts = pc.list_value_length(pieces).to_numpy()
        coded = pieces.flatten().dictionary_encode()
        found = list(map(self._piece, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        each = pa.ListArray.from_arrays(
            pa.array(_ends(sizes), pa.int32()), pa.array(np.fromiter(chain.from_iterable(found), np.int32, sizes.sum())))
        per_piece = _ends(sizes[coded.indices.to_numpy()])
        return pa.ListArray.from_arrays(pa.array(per_piece[_ends(counts)], pa.int32()), each.take(coded.indices).flatten())

    def decode(self, ids: pa.Array) -> pa.Array:
        """The vocabulary strings, special ones too, with a space between; word ends stay as they are written."""
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        strings = pa.ListArray.from_arrays(pa.array(_ends(counts), pa.int32()), self.strings.take(ids.flatten()))
        return pc.binary_join(strings, " ")


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, number) of stretches that hold about ``AT_ONCE`` together, and one value at least."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield at, upto - at
        at = upto


def _in_parts(work, column: pa.Array, sizes: pa.Array) -> pa.Array:
    parts = [work(column.slice(*part)) for part in _parts(pc.fill_null(sizes, 0).to_numpy())]
    return pa.concat_arrays(parts) if parts else work(column)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) of its texts."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        return _in_parts(word_bpe(tokenizer).encode, texts, pc.binary_length(texts))

    return docs.withColumn("ids", ids_of(content(text)))


def decode(docs: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of its ids; null ids count as none."""

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        return _in_parts(word_bpe(tokenizer).decode, lists, pc.list_value_length(lists))

    return docs.withColumn("decoded", text_of(F.col(ids)))


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, but with its ``ids`` and ``decoded``, the text of these ids.

    The same as ``decode`` after ``encode``, in one pass: with both in one plan, Spark would encode
    every text twice, once for the ids and once for what is decoded from them. Results leave the
    worker a part at a time, so it never holds those of a whole batch.
    """
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), "ids", "decoded")]
    given = docs.select(*kept, content(text).alias("_given"))
    out = StructType([*docs.select(*kept).schema, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(tokenizer)
        for batch in batches:
            texts = batch.column(len(kept))
            for part in _parts(pc.binary_length(texts).to_numpy()):
                ids = model.encode(texts.slice(*part))
                others = [batch.column(i).slice(*part) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*others, ids, model.decode(ids)], [*kept, "ids", "decoded"])

    return given.mapInArrow(both, out)
