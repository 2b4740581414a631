"""Token counts from a digest cache.

Content and tokenizer version are digested; counts that the cache holds are joined,
each distinct text that it lacks is encoded once, and the new counts are appended.

Null texts count as empty (0 tokens); equal texts share one cache row; repeated rows give
repeated results; an empty table gives no rows. Other columns of the input are not read, so
their names cannot clash. A null id is kept.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import content, lookup, stored

CACHE_SCHEMA = "digest binary, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer file and of the libraries that read it: another version, other counts."""
    with open(path, "rb") as file:
        digest = hashlib.sha256(file.read())
    digest.update(" ".join(f"{name} {version(name)}" for name in ("tokenizers", "tiktoken", "sentencepiece")).encode())
    return digest.hexdigest()


def _byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable Latin-1 stays, the rest goes to 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def _merge_ranks(config: dict) -> dict[bytes, int] | None:
    """Token bytes to id, if the file is a plain byte-level BPE whose ids follow the order of its merges."""
    model, split = config["model"], config.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and config.get("normalizer") is None and split.get("type") == "ByteLevel"
        and split.get("use_regex") and not split.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix", "ignore_merges"))
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in config["added_tokens"])
    )
    if not plain:
        return None
    vocab, alphabet = model["vocab"], _byte_alphabet()
    merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    ids = [vocab[m.replace(" ", "")] for m in merged]
    if ids != sorted(ids) or len(set(ids)) != len(ids):
        return None
    special = {t["content"] for t in config["added_tokens"]}
    return {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in special}


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    """Counts the tokens of one text, as the library of the file does."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    if (ranks := _merge_ranks(config)) is not None:  # the same tokens, several times faster
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value
        special = {t["content"]: t["id"] for t in config["added_tokens"]}
        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: len(encoding.encode(text, allowed_special="all"))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda text: len(model.encode(text, add_special_tokens=False))


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(digest, content) to (digest, n_tokens), one text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            counts = [count(text.as_py()) for text in batch["content"]]
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "content").mapInArrow(run, CACHE_SCHEMA)


def cached_counts(spark, folder: str) -> DataFrame:
    """What the cache of one tokenizer version holds, one row a digest."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row of ``docs``, and a cache that knows them all.

    ``cache`` is a folder all executors reach, with one folder per tokenizer version in it.
    Appending twice, as after a failed run, does no harm: equal digests have equal counts.
    """
    spark, folder = docs.sparkSession, f"{cache}/{tokenizer_digest(tokenizer)}"
    texts = docs.select(F.col(key).alias("key"), content(text).alias("content")).withColumn(
        "digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256))
    )
    wanted = stored(texts.select("key", "digest", F.octet_length("content").cast("long").alias("n_bytes")), "digests")
    # One row of each distinct text stands for it, so that texts are shuffled once and never grouped.
    first = wanted.groupBy("digest").agg(F.min("key").alias("_first"))
    misses = stored(first.join(cached_counts(spark, folder), "digest", "left_anti"), "misses")
    if not misses.isEmpty():
        missed = misses.withColumnRenamed("digest", "_digest")
        found = texts.join(missed, (F.col("digest") == F.col("_digest")) & F.col("key").eqNullSafe(F.col("_first")))
        encode_counts(found, tokenizer).write.mode("append").parquet(folder)
    counts = lookup(cached_counts(spark, folder))
    return wanted.join(counts, "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens")
