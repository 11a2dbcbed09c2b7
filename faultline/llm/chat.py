"""Chat formatting by token-level assembly.

Every turn is a row of segments: reserved ids, which no text can produce, and the ids of the role or the text, encoded
on their own by a byte-level tokenizer. Control strings inside texts are escaped first, so that neither the ids nor
the decoded text hold a control string that isn't the template's. The loss mask is the prefix sum of +1 and -1 at the
ends of assistant texts; a turn's place in its conversation is the prefix sum of the turns' lengths.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import in_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Reserved strings; their ids follow the vocabulary, in this order.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[END]")
#: What opens and closes the turns of these roles. A turn of another role is [ROLE] role [/ROLE] text [END].
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>"), "system": ("[SYS]", "[/SYS]")}

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)) + r"|\\")
_ESCAPED = re.compile(r"\\(?:\\|c(\d+);)")


def escape(text: str) -> str:
    """A backslash becomes two, the k-th control string \\ck;. The result holds no control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"\\c{CONTROL.index(m[0])};", text)


def unescape(text: str) -> str:
    """The text that escape() was given."""
    return _ESCAPED.sub(lambda m: "\\" if m[1] is None else CONTROL[int(m[1])], text)


class Codec:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {v: k for k, v in ranks.items()}
        self.base = max(ranks.values()) + 1

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def control(self, name: str) -> int:
        return self.base + CONTROL.index(name)

    def decode(self, ids) -> str:
        return b"".join(self.bytes[i] for i in ids).decode()

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a turn, and the mask of those that the loss counts."""
        body = self.encode(escape(text))
        if role in TURNS:
            segments = [[self.control(TURNS[role][0])], body, [self.control(TURNS[role][1])]]
        else:
            segments = [[self.control("[ROLE]")], self.encode(escape(role)), [self.control("[/ROLE]")], body, [self.control("[END]")]]
        ids = np.fromiter((i for s in segments for i in s), np.int32)
        steps = np.zeros(len(ids) + 1, np.int8)
        if role == "assistant":
            steps[1] += 1
            steps[1 + len(body)] -= 1
        return ids, np.cumsum(steps[:-1]).astype(bool)

    def parse(self, ids) -> tuple[str, str, str]:
        """Role, text and rendered form of a turn's ids."""
        parts: list = [[]]
        for i in ids:
            if i >= self.base:
                parts += [CONTROL[i - self.base], []]
            else:
                parts[-1].append(i)
        texts = [p if isinstance(p, str) else self.decode(p) for p in parts]
        opened = {a: role for role, (a, _) in TURNS.items()}
        role, text = (opened[texts[1]], texts[2]) if texts[1] in opened else (unescape(texts[2]), texts[4])
        return role, unescape(text), "".join(texts)


def _encode(path: str, names: list[str]):
    def run(batches):
        codec = Codec(path)
        for batch in batches:
            turns = [codec.turn(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            ids = pa.array([a for a, _ in turns], pa.list_(pa.int32()))
            mask = pa.array([m for _, m in turns], pa.list_(pa.bool_()))
            yield pa.record_batch([*(batch.column(c) for c in names), ids, mask, pa.array([len(a) for a, _ in turns], pa.int64())], names=[*names, "ids", "mask", "n_ids"])

    return run


def format_turns(turns: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, turn, position (place among the conversation's turns), start (of its first id), ids, mask, n_ids.

    Turns of a conversation are ordered by turn, role and text, nulls first, so ties have an order and rows that
    repeat stay. Null roles and texts count as empty. Encoding happens where the rows are; the shuffle by conversation
    moves ids. A conversation is never gathered: its turns stay rows, sorted within a partition. No rows, no turns;
    further columns are left out.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.struct("role", F.sha2(F.col("text").cast("binary"), 256)))
    encoded = rows.transform(in_batches).mapInArrow(_encode(tokenizer, ["conv_id", "turn", "tie"]), "conv_id bigint, turn bigint, tie struct<role:string,col2:string>, ids array<int>, mask array<boolean>, n_ids bigint")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "tie")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return encoded.select("conv_id", "turn", F.row_number().over(order).alias("position"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "ids", "mask", "n_ids")


def _digest(path: str):
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids"]

    def run(batches):
        codec = Codec(path)
        now, state = None, None

        def row(conv, s):
            return (conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["ids"])

        for batch in batches:
            done = []
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(row(now, state))
                    now, state = conv, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "ids": 0}
                role, text, rendered = codec.parse(ids)
                learned = unescape(codec.decode([i for i, m in zip(ids, mask, strict=True) if m]))
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["loss"].update(learned.encode())
                state["loss_chars"] += len(learned)
                state["chars"] += len(rendered)
                state["ids"] += len(ids)
            yield _rows(done, fields)
        if state is not None:
            yield _rows([row(now, state)], fields)

    return run


def _rows(rows, fields):
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=fields)


def read_back(formatted: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """What the ids of each conversation say, digested: a check of format_turns from its output alone.

    A digest goes through a conversation's turns in order and keeps only its own state, however long the conversation.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_ids bigint"
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "ids", "mask").transform(in_batches).mapInArrow(_digest(tokenizer), schema)


def op1(conversations: DataFrame) -> DataFrame:
    """One row per conversation, conversation -1 with its control strings included."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]).unionByName(probe)
    return read_back(format_turns(turns)).drop("n_ids")


def _escaped_sql(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for k, c in enumerate(CONTROL):
        sql = f"replace({sql}, '{c}', '\\c{k};')"
    return sql


OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, sha256(text)), '')) AS loss_sha256,
       sum(length({_escaped_sql('text')}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 11 ELSE 18 + length({_escaped_sql('role')}) END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
