"""Chat formatting at token level: segments encoded apart, reserved ids spliced between.

A turn becomes ``TURN role SEP text END``; the five markers are ids above the
vocabulary, so no text can ever produce them. Control strings that occur in a role or
text are escaped all the same (a backslash after the opening bracket, one more if some
stand there), so that the rendered string is unambiguous too; reading takes it off
again. The loss mask of a segment is the prefix sum of +1 where an assistant's text
begins and -1 where it ends; a segment's place in its conversation is the prefix sum
of the lengths before it.

Rows are encoded where they lie, then move once to their conversation. The output holds
one row a turn, so a conversation of any length is never gathered in one value.

Edge cases: null texts and roles count as empty; a null conversation id is a
conversation of its own; turns with equal numbers are ordered by role and text (nulls
first); repeated rows stay; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquetry.llm.tokenizer import give_back, slices
from marquetry.runtime import ensure_checkpoint_dir, read_table

MARKERS = ("<|turn|>", "<|sep|>", "<|end|>")
_BODY = r"/?s>|/?INST\]|</?SYS>>|\|[A-Za-z_]{1,40}\|>"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_BODY})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_BODY})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


class ChatCodec:
    """A byte-level rank file with ids reserved above its vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 2  # the id after the last is an end mark in some layouts
        self.turn, self.sep, self.end = range(first, first + 3)

    def segment(self, role: str, text: str, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a turn and its loss mask."""
        head = self.encoding.encode_ordinary(escape(role))
        body = self.encoding.encode_ordinary(escape(text))
        ids = np.array([self.turn, *head, self.sep, *body, self.end], np.int32)
        steps = np.zeros(len(ids) + 1, np.int8)
        if learn:
            steps[len(head) + 2] += 1
            steps[len(head) + 2 + len(body)] -= 1
        return ids, np.cumsum(steps[:-1], dtype=np.int8)

    def text(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode()

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """Role, text, text under the mask and rendered length of a segment."""
        at = int(np.flatnonzero(ids == self.sep)[0])
        if ids[0] != self.turn or ids[-1] != self.end:
            raise ValueError("a segment must begin and end with its markers")
        role, text = self.text(ids[1:at]), self.text(ids[at + 1 : -1])
        under = self.text(ids[mask.astype(bool)])
        return unescape(role), unescape(text), unescape(under), len(role) + len(text) + sum(map(len, MARKERS))


_CODECS: dict[tuple[str, str], ChatCodec] = {}


def _codec(path: str, pattern: str) -> ChatCodec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ChatCodec(path, pattern)
    return _CODECS[path, pattern]


def format_conversations(
    turns: DataFrame, path: str, pattern: str, *, learn_role: str = "assistant",
    cols: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"),
) -> DataFrame:
    """``(conv_id, seq, start, tokens, mask)``, one row a turn, in order of ``seq``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for part in slices(batch, 3, most_rows=1024):
                roles, texts = part.column(2).to_pylist(), part.column(3).to_pylist()
                made = [codec.segment(r or "", t or "", r == learn_role) for r, t in zip(roles, texts, strict=True)]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in made])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(4)), pa.array([len(x[0]) for x in made], pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[0] for x in made]))),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[1] for x in made]))),
                    ],
                    ["conv_id", "turn", "role", "text", "n_tokens", "tokens", "mask"],
                )

    kinds = [turns.schema[c].dataType.simpleString() for c in cols]
    named = turns.select(*[F.col(c).alias(n) for c, n in zip(cols, ("conv_id", "turn", "role", "text"), strict=True)])
    encoded = named.mapInArrow(
        run, f"conv_id {kinds[0]}, turn {kinds[1]}, role string, text string, n_tokens long, tokens array<int>, mask array<tinyint>"
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return encoded.select(
        "conv_id", F.row_number().over(order).cast("long").alias("seq"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "tokens", "mask",
    )


def read_conversations(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(conv_id, seq, role, text, loss_text, formatted_chars)`` from the output."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [
                    codec.read(np.asarray(i.values), np.asarray(m.values))
                    for i, m in zip(part.column(2), part.column(3), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3)),
                     pa.array([r[3] for r in rows], pa.int64())],
                    ["conv_id", "seq", "role", "text", "loss_text", "formatted_chars"],
                )
            give_back()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "seq", "tokens", "mask").mapInArrow(
        run, f"conv_id {kind}, seq long, role string, text string, loss_text string, formatted_chars long"
    )


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests by conversation over rows sorted by (conv_id, seq); holds one row at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state: list | None = None

    def close(done: list[list]) -> pa.RecordBatch:
        values = [[s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]] for s in done]
        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        kinds[0] = id_kind
        return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], kinds[i]) for i in range(6)], names)

    id_kind = pa.int64()
    for batch in batches:
        id_kind, done = batch.schema.field(0).type, []
        for conv, role, text, loss, chars in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(state)
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(loss)
            state[4].update(loss.encode())
            state[5] += chars
        if done:
            yield close(done)
    if state is not None:
        yield close([state])


def conversation_digests(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    return (
        rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
        .mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    probe = spark.sql(
        "SELECT -1L AS conv_id, i AS turn, if(i = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text "
        "FROM (SELECT explode(array(0L, 1L)) AS i)"
    )
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    out = f"{ensure_checkpoint_dir(spark)}/chat-{uuid.uuid4().hex}"
    format_conversations(turns, path, pattern).write.parquet(out)
    return conversation_digests(read_conversations(spark.read.parquet(out), path, pattern))
