"""The queries of the ten operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, licenses, packing, pii, secrets, sentencepieces, simhash, topk, toxicity
from .shared import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantize(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("id % 20 = 0"))


def read_back(formatted: DataFrame, ranks_path: str) -> DataFrame:
    """What the formatted conversations say, from their ids and masks alone."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chat.encoding(ranks_path)
        for batch in batches:
            rows = []
            for ids, mask, shown in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                turns, under = chat.read_back(ids.values.to_numpy(), mask.values.to_numpy(), enc)
                said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(under)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(shown.as_py())))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(of, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    ranks = tokenizer("byte_bpe_50k.tiktoken")
    return read_back(chat.format_chats(rows.unionByName(more), ranks), ranks)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.sample(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), with_ids=False)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key="terrane")
    return done.select("doc_id", F.size("entities").cast("long").alias("n_entities"), "entities", "text")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk, op2_chat, op3_exact_dedup, op4_sentencepieces, op5_packing, op6_simhash, op7_toxicity, op8_pii, op9_licenses, op10_secrets)}


# Oracles, for DuckDB, where SQL can express the whole result.
_OP1 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q
  from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select a.vec_id as query_id, b.vec_id,
    cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q)
  where a.vec_id % 20 = 0
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

_ESCAPES = "({t}) - length(replace({t}, '\\\\', ''))" + "".join(f" + (length({{t}}) - length(replace({{t}}, '{x}', ''))) // {len(x)}" for x in chat.CONTROLS)
_SHOWN = lambda t: f"(2 * length{_ESCAPES.format(t=t)})"  # noqa: E731  characters of an escaped text
_OP2 = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, x.turn, x.role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) x(turn, role)
), e as (
  select *, {_SHOWN("text")} + case role when 'user' then 13 when 'system' then 11 when 'assistant' then 9 else 19 + {_SHOWN("role")} end as n from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(n) as bigint) as formatted_chars
from e group by conv_id
"""

_OP3 = """
with k as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
), g as (
  select *, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size from k
)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from g
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": _OP1, "op2_chat": _OP2, "op3_exact_dedup": _OP3}
