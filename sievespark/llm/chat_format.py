"""Chat formatting with offset-aligned loss masks.

A turn is rendered as START role SEP text END; the three are control tokens of the tokenizer, so ids never cross
their borders. In roles and texts a backslash is doubled and "<|" becomes "<\\|", which is undone exactly, so no text
can hold a control string. A conversation is rendered whole and encoded once, with offsets; the sorted spans of the
assistant's texts are then intersected with the sorted token spans by binary search, which gives the loss mask.

A conversation comes out in pieces of about PIECE characters, cut between turns only, so a conversation of any
length needs bounded memory; control tokens make the pieces' ids those of the whole. One turn is never cut: it is held
whole, at about 100 bytes a character. Turns are ordered by turn (null last), then role and text, so ties and repeated
rows have one order. Null role or text: empty. Rows without a conv_id form one conversation of their own; an empty table
gives none. Only conv_id, turn, role and text are read; the vocabulary is a parameter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PIECE = 1_000_000
FORMATTED = "conv_id long, piece long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.processors import ByteLevel

    t = Tokenizer.from_file(path)
    t.post_processor = ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, SEP, END)])
    t.no_truncation()
    t.no_padding()
    return t


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text, and the spans (starts, ends) of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def mask_of(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each token lies in one of the spans, which are sorted as the tokens are."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(spans[:, 0], starts, "right") - 1
    return (at >= 0) & (ends <= spans[at, 1]) & (ends > starts)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    found = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(START).partition(SEP)
        found.append((unescape(role), unescape(text)))
    return found


def runs(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, formatted: str) -> list[str]:
    """The texts under the mask, unescaped, in order."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return [unescape(formatted[starts[i] : ends[j]]) for i, j in zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist())]


def format_conversations(conversations: DataFrame, path: str) -> DataFrame:
    """Pieces of the formatted conversations, in order within a partition, each conversation in one partition."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        last, piece = object(), 0

        def pieces(b: pa.RecordBatch) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
            turns: list[tuple[str, str]] = []
            key, size = None, 0
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if turns and (conv != key or size > PIECE):
                    yield key, turns
                    turns, size = [], 0
                key = conv
                turns.append((role or "", text or ""))
                size += len(text or "")
            if turns:
                yield key, turns

        def rows(got: list[tuple[int | None, list[tuple[str, str]]]]) -> pa.RecordBatch:
            nonlocal last, piece
            made = [(key, *render(turns)) for key, turns in got]
            out: list[list] = [[] for _ in range(7)]
            for (key, text, spans), e in zip(made, own.encode_batch([x[1] for x in made], add_special_tokens=False)):
                piece = piece + 1 if key == last else 0
                last = key
                where = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
                for col, value in zip(out, (key, piece, text, e.ids, where[:, 0], where[:, 1], mask_of(spans, where[:, 0], where[:, 1]))):
                    col.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["conv_id", "piece", "formatted", "ids", "starts", "ends", "mask"])

        for b in batches:
            held, size = [], 0
            for key, turns in pieces(b):
                held.append((key, turns))
                size += sum(len(t) for _, t in turns)
                if size > PIECE:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    ordered = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(make, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What op6 reports of each conversation, read back from format_conversations' own output in its order."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = None
        state: list | None = None

        def done() -> pa.RecordBatch:
            n, turns, chars, loss, size = state
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key, pa.int64()), (n, pa.int64()), (turns.hexdigest(), pa.string()), (chars, pa.int64()), (loss.hexdigest(), pa.string()), (size, pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            out = []
            for i in range(b.num_rows):
                conv, piece, text = (b.column(k)[i].as_py() for k in range(3))
                if piece == 0:
                    if state:
                        out.append(done())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                starts, ends = (b.column(k)[i].values.to_numpy() for k in (4, 5))
                mask = b.column(6)[i].values.to_numpy(zero_copy_only=False)
                for role, said in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for said in runs(starts, ends, mask, text):
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if state:
            yield done()

    return formatted.mapInArrow(make, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ADDED = f"{END}{START}assistant ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.sql("SELECT -1L AS conv_id, explode(array(named_struct('t', 0L, 'r', 'user'), named_struct('t', 1L, 'r', 'assistant'))) AS x").select("conv_id", F.col("x.t").alias("turn"), F.col("x.r").alias("role"), F.lit(ADDED).alias("text"))
    return digests(format_conversations(given.unionByName(added), public_tokenizers.path("byte_bpe_50k.json")))


SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{ADDED}' UNION ALL SELECT -1, 1, 'assistant', '{ADDED}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum({len(START + SEP + END)} + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
