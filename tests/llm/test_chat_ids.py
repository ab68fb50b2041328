"""Conversations whose ids are numbers that are not equal to themselves, dates, decimals or bytes."""

import datetime
from decimal import Decimal

import pytest

from quartzloom.llm import chat

IDS = {
    "double": [float("nan"), 1.5, None, float("inf")],
    "date": [datetime.date(2020, 1, 1), None, datetime.date(1960, 2, 3)],
    "decimal(20,3)": [Decimal("1.500"), None, Decimal("-7.000")],
    "binary": [bytearray(b"a\xff"), None, bytearray(b"")],
}


@pytest.mark.parametrize("kind", IDS)
def test_a_conversation_is_a_key(spark, kind):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"text {n} {t}") for n, i in enumerate(IDS[kind]) for t in range(4)]
    df = spark.createDataFrame(rows, f"conv_id {kind}, turn int, role string, text string").repartition(3)
    found = chat.digests(chat.format_turns(df)).collect()
    name = lambda i: str(bytes(i) if isinstance(i, (bytes, bytearray)) else i)
    assert sorted((name(r["conv_id"]), r["n_turns"]) for r in found) == sorted((name(i), 4) for i in IDS[kind])
