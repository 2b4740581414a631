"""Named queries of the training-data operators, and the SQL they are checked by."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.llm import bpe, iblt, mixing, periodic, pq, secrets, simhash, suffixes, token_counts, tool_calls, toxicity, whitening, wrappers
from cadenza.llm.common import fresh_folder, stored, table

#: Documents with this score or more count as toxic.
TOXIC_FROM = 0.7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by a cache that starts empty, so every distinct text is encoded in this run."""
    counts = token_counts.count_tokens(
        table(spark, folder, "documents"), fresh_folder(spark, "token-cache"),
        public_tokenizers.path("byte_bpe_50k.json"),
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op9_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, path)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash of 3-word shingles, linked at 2 bits or fewer."""
    return simhash.near_duplicates(table(spark, folder, "documents"), words=3, distance=2)


def toxicity_network(spark: SparkSession, docs: DataFrame, folder: str) -> toxicity.Network:
    """Trained on labelled rows of ``docs`` outside the held-out third."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = table(spark, folder, "labels").filter(fold != 1)
    return toxicity.train(*toxicity.training_sample(docs, labels))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document; rows whose crc32 leaves 1 are held out of training."""
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_network(spark, docs, folder))
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "score",
        F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted"),
    )


@query
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of the base rules and of the Markov models in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    models = secrets.train(secrets.labelled_sample(docs))
    found = secrets.find(docs, models)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *(of(kind) for kind in ("assign", "access", "hex")),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        of("random"),
    )


@query
def op5_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighing 5, 2, 1 in turn, in the order they are first due."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    planned = stored(mixing.plan(docs, mixing.turns(docs)).withColumn("first_position", F.get("positions", 0)), "planned")
    return mixing.in_training_order(planned, "first_position", "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken", "positions")


@query
def op4_pq_links(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings linked at cosine 0.95, whatever their labels."""
    return pq.link(table(spark, folder, "embeddings"), cosine=0.95)


#: Tools of the stand-in: every user turn asks one of them; ``count`` and ``fetch`` often get bad arguments.
TOOLS = (
    ("search", (("query", "string", True), ("limit", "integer", False))),
    ("count", (("limit", "integer", True), ("unit", "string", True), ("query", "string", False))),
)


@query
def op1_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn as a call, every assistant turn as the result of the user turn before it.

    Call k of a conversation uses the result of call (k - 1) div 2, so calls form a tree.
    """
    turns = table(spark, folder, "conversations")
    number = F.floor(F.col("turn") / 2)
    size = F.length(F.coalesce("text", F.lit("")))
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("query")))  # {"query":"..."}
    calls = turns.filter("role = 'user'").select(
        "conv_id", number.alias("call_id"), "turn",
        F.when(size % 3 == 0, "search").when(size % 3 == 1, "count").otherwise("fetch").alias("name"),
        F.concat(F.lit("{ "), F.substr(text, F.lit(2), F.length(text) - 2), F.lit(', "limit" : '), size.cast("string"), F.lit("}"))
        .alias("arguments"),
        F.when(number > 0, F.array(F.floor((number - 1) / 2))).otherwise(F.array().cast("array<bigint>")).alias("after"),
    )
    results = turns.filter("role = 'assistant'").select(
        "conv_id", F.floor((F.col("turn") - 1) / 2).alias("call_id"), "turn", F.col("text").alias("content"))
    schemas = spark.createDataFrame(list(TOOLS), "name string, fields array<struct<name:string,kind:string,required:boolean>>")
    out = tool_calls.link(calls, results, schemas)
    return out.select(
        "conv_id", "call_id", "turn", "name", "canonical", F.array_join("errors", ",").alias("errors"), "status",
        "result_turn", F.length("content").cast("long").alias("result_chars"), F.col("level").cast("long").alias("level"),
        F.col("position").cast("long").alias("position"),
    )


SQL["op1_tool_calls"] = """
with calls as (
  select conv_id, turn // 2 as call_id, turn, coalesce(text, '') as txt, length(coalesce(text, '')) as size
  from conversations where role = 'user'
), results as (
  select conv_id, (turn - 1) // 2 as call_id, turn as result_turn, length(text) as result_chars
  from conversations where role = 'assistant'
), linked as (
  select c.conv_id, c.call_id, c.turn,
    case size % 3 when 0 then 'search' when 1 then 'count' else 'fetch' end as name,
    '{"limit":' || size || ',"query":' || cast(to_json(txt) as varchar) || '}' as canonical,
    case size % 3 when 0 then '' when 1 then 'missing unit' else 'tool' end as errors,
    case when r.result_turn is null then 'pending' else 'linked' end as status, r.result_turn, r.result_chars,
    length(bin(c.call_id + 1)) - 1 as level
  from calls c left join results r using (conv_id, call_id)
)
select conv_id, call_id, turn, name, canonical, errors, status, result_turn, result_chars, level,
  row_number() over (partition by conv_id order by level, turn) - 1 as position
from linked
union all
select conv_id, call_id, null, null, null, null, 'orphan', result_turn, result_chars, null, null
from results r where not exists (select 1 from calls c where c.conv_id = r.conv_id and c.call_id = r.call_id)
"""


@query
def op2_iblt(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against its edited text and the next document."""
    return iblt.compare_edits(table(spark, folder, "documents"))


@query
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes left of every document without strings of 400 bytes that start elsewhere too."""
    return suffixes.remove_repeats(table(spark, folder, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated word runs of every document; one text in ten is made to loop from some word on."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    seed, n = F.floor(digest / 10), periodic.word_count()
    first = F.when((digest % 10 == 0) & (n > 0), seed % n)
    out = periodic.repeated_runs(docs, periodic.Rule(24, 3), loop_from=first, loop_width=1 + F.floor((n - first) / (3 + seed % 8)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))))
    return out.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings along their first eight components, whitened."""
    return whitening.whiten(table(spark, folder, "embeddings"), components=8, scale=1024, offset=100_000)


@query
def op12_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page by its host's wrapper."""
    out = wrappers.extract(table(spark, folder, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
