"""Chat formatting at token level.

Every segment - a control string, a role name, a turn's text - is encoded by itself; control
strings become reserved ids beyond the vocabulary, so no text can produce one. Ids of segments are
spliced, and the loss mask is the prefix sum of +1 where an assistant's span begins and -1 where
it ends. Control strings that occur inside texts are escaped with a backslash, and backslashes
are doubled, so the formatted string can be parsed back as well.

The template: ``<<SYS>>text<</SYS>>`` for system, ``[INST]text[/INST]`` for user, ``<s>text</s>``
for assistant, ``[ROLE]name[/ROLE]text</s>`` for any other role. The assistant's text and its
``</s>`` are under the mask.

Conversations are dealt by conv_id, sorted, and streamed in slices of turns; each turn is a row of
its own, so a conversation of any length needs the memory of a slice. Segments of a slice are
encoded, and decoded, in one call. A conversation is one task's work, as its digest runs over its
turns in order.

Defined cases: null texts and roles are empty; texts of any length are encoded whole; turns are
ordered by turn (null first), then role and text; repeated rows are repeated turns; rows with a null
conv_id form a conversation, ids may be of any type; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzloom.llm.common import by_rows, id_ddl, map_arrow, record

FILE = "byte_bpe_50k.json"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
TURN = pa.schema([("seq", pa.int64()), ("first_id", pa.int64()), ("first_char", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8()))])
TURN_DDL = "seq long, first_id long, first_char long, formatted string, ids array<int>, mask array<byte>"
_SPECIAL = "|".join(map(re.escape, ("\\", *CONTROLS)))
_ESCAPE, _UNESCAPE = re.compile(_SPECIAL), re.compile(rf"\\({_SPECIAL})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Template:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings are ordinary text here
        self.first = self.model.get_vocab_size(with_added_tokens=True)
        self.reserved = {c: self.first + i for i, c in enumerate(CONTROLS)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([escape(t) for t in texts], add_special_tokens=False)]

    def segments(self, role: str, text: str) -> list[tuple[str, bool, bool]]:
        """(string, is control, under the mask)."""
        if role == "system":
            return [("<<SYS>>", True, False), (text, False, False), ("<</SYS>>", True, False)]
        if role == "user":
            return [("[INST]", True, False), (text, False, False), ("[/INST]", True, False)]
        if role == "assistant":
            return [("<s>", True, False), (text, False, True), ("</s>", True, True)]
        return [("[ROLE]", True, False), (role, False, False), ("[/ROLE]", True, False), (text, False, False), ("</s>", True, False)]

    def turns(self, rows: list[tuple[str, str]]) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """The formatted string, ids and mask of each turn (role, text)."""
        parts = [self.segments(role, text) for role, text in rows]
        coded = iter(self.encode([s for turn in parts for s, control, _ in turn if not control]))
        out = []
        for turn in parts:
            ids = [[self.reserved[s]] if control else next(coded) for s, control, _ in turn]
            ends = np.cumsum([len(i) for i in ids])
            edge = np.zeros(int(ends[-1]) + 1, np.int8)
            for n, end, (_, _, loss) in zip(map(len, ids), ends, turn, strict=True):
                if loss:
                    edge[end - n] += 1
                    edge[end] -= 1
            out.append(("".join(s if control else escape(s) for s, control, _ in turn), np.concatenate(ids).astype(np.int32), np.cumsum(edge[:-1], dtype=np.int8)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [unescape(t) for t in self.model.decode_batch(ids, skip_special_tokens=False)]

    def read(self, turns: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, str, str]]:
        """Role, text and text under the mask of each turn, from its ids and mask."""
        coded, shape = [], []
        for ids, mask in turns:
            head = CONTROLS[int(ids[0]) - self.first]
            role = text = None
            if head == "[ROLE]":
                k = int(np.flatnonzero(ids == self.reserved["[/ROLE]"])[0])
                coded.append(ids[1:k].tolist())
                role, body = len(coded) - 1, ids[k + 1 : -1]
            else:
                body = ids[1:-1]
            loss = ids[(mask != 0) & (ids < self.first)]
            coded.append(body.tolist())
            text = len(coded) - 1
            if len(loss) and not np.array_equal(loss, body):
                coded.append(loss.tolist())
            shape.append((head, role, text, None if not len(loss) else text if np.array_equal(loss, body) else len(coded) - 1))
        found = self.decode(coded)
        names = {"<<SYS>>": "system", "[INST]": "user", "<s>": "assistant"}
        return [(names[head] if role is None else found[role], found[text], "" if loss is None else found[loss]) for head, role, text, loss in shape]


@lru_cache
def template(path: str) -> Template:
    return Template(path)


def same(a: object, b: object) -> bool:
    """Whether two ids are one key, as Spark groups them: NaN is equal to NaN."""
    return a == b or (a != a and b != b)


def format_turns(conversations: DataFrame, file: str = FILE) -> DataFrame:
    """A row for each turn, in order inside partitions, each conversation in one: its place, string, ids and loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, now, seq, at, char = template(public_tokenizers.path(file)), object(), 0, 0, 0
        for part in by_rows(batches):
            rows = []
            ids_of, roles, texts = (part.column(i).to_pylist() for i in range(3))
            for conv, (string, ids, mask) in zip(ids_of, make.turns(list(zip(roles, texts, strict=True))), strict=True):
                if not same(conv, now):
                    now, seq, at, char = conv, 0, 0, 0
                rows.append((seq, at, char, string, ids, mask))
                seq, at, char = seq + 1, at + len(ids), char + len(string)
            rest = record(TURN, *(zip(*rows, strict=True) if rows else [[]] * len(TURN)))
            yield pa.RecordBatch.from_arrays([part.column(0), *rest.columns], names=["conv_id", *TURN.names])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select("conv_id", text("role"), text("text"), "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(rows.select("conv_id", "role", "text"), run, f"{id_ddl(conversations, 'conv_id')}, {TURN_DDL}")


DIGEST = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(turns: DataFrame, file: str = FILE) -> DataFrame:
    """What ids and masks say, read back: a row for each conversation of format_turns()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, now, some, kind = template(public_tokenizers.path(file)), None, False, pa.int64()
        n = chars = formatted = 0
        turns_hash = loss_hash = None
        done = []

        def close() -> None:
            if some:
                done.append((now, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted))

        def ready() -> pa.RecordBatch:
            ids, *rest = zip(*done, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(ids, kind), *record(DIGEST, *rest).columns], names=["conv_id", *DIGEST.names])
            done.clear()
            return out

        for part in by_rows(batches):
            kind = part.schema.field(0).type
            held = [(i.values.to_numpy(), m.values.to_numpy()) for i, m in zip(part.column(2), part.column(3), strict=True)]
            for conv, string, (role, text, loss) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), make.read(held), strict=True):
                if not some or not same(conv, now):
                    close()
                    now, some, n, chars, formatted, turns_hash, loss_hash = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                n += 1
                turns_hash.update(f"{role}\n{text}\n".encode())
                chars += len(loss)
                loss_hash.update(loss.encode())
                formatted += len(string)
            if len(done) >= 1000:
                yield ready()
        close()
        if done:
            yield ready()

    return map_arrow(turns.select("conv_id", "formatted", "ids", "mask"), run, f"{id_ddl(turns, 'conv_id')}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{ok}' as text")
    return digests(format_turns(rows.union(extra)))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         length(regexp_replace(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]', '_\0', 'g')) AS n,
         length(regexp_replace(role, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]', '_\0', 'g')) AS rn FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 17 + rn END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
