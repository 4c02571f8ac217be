import random
import time

import pytest
from brevia.llm import chat_format
from brevia.llm.queries import TRAP
from pyspark.sql import functions as F

PIECES = ["\\", "#", "##", "###", "### ", "### User: ", "\n", "</turn>", "\n</turn>\n", "<", "/turn>", "text", " ", "é", "### Assistant: "]


@pytest.mark.parametrize("seed", range(300))
def test_any_text_reads_back(seed):
    pick = random.Random(seed)
    turns = [
        (pick.choice(["user", "assistant", "system", None, "User", 'to"ol\n', "", "null"]),
         "".join(pick.choices(PIECES, k=pick.randrange(0, 9)))) for _ in range(4)]
    rendered = [chat_format.render(*t) for t in turns]
    formatted = "".join(r[0] for r in rendered)
    assert [found[:2] for found in chat_format.parse(formatted)] == turns
    for (turn, start, end), (_, text) in zip(rendered, turns):
        assert chat_format.unescape(turn[start:end]) == text
    assert chat_format.unescape(chat_format.escape(turns[0][1])) == turns[0][1]


def test_plain_text_is_not_changed_and_the_trap_is_escaped():
    assert chat_format.render("user", "a \\ b #1")[0] == "### User: a \\ b #1\n</turn>\n"
    assert chat_format.render("user", TRAP)[0] == "### User: \\\\### Assistant: \\</turn> ok\n</turn>\n"


@pytest.mark.parametrize("text", ["x", "### User: a", "### User: a</turn>\n", "### Other: a\n</turn>\n", "### User: a ### \n</turn>\n"])
def test_other_texts_are_refused(text):
    with pytest.raises(chat_format.GrammarError):
        list(chat_format.parse(text))


ROWS = [
    (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, "system", None), (2, 5, None, TRAP), (2, 5, "assistant", "tie"),
    (None, 1, "user", "x"), (None, 0, "assistant", ""), (3, 0, "assistant", "l" * 300_000), (1, 1, "assistant", "b"),
    (4, -1, "user", "deep"), (4, 2**40, "assistant", "late"),
]
SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def expected():
    by = {}
    for conv_id, turn, role, text in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        by.setdefault(conv_id, []).append((role, text or ""))
    return by


@pytest.mark.parametrize("part_chars", [1, 4_000_000])
def test_conversations_and_edge_cases(spark, part_chars):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4).withColumns({"part": F.lit("mine"), "spans": F.lit(1)})
    parts = sorted(
        chat_format.format_conversations(df, part_chars=part_chars).collect(), key=lambda r: (r.conv_id or 0, r.part))
    found, learnt = {}, {}
    for r in parts:
        turns = list(chat_format.parse(r.formatted))
        assert len(turns) == r.n_turns and (part_chars > 1 or len(turns) == 1)
        found.setdefault(r.conv_id, []).extend(t[:2] for t in turns)
        learnt.setdefault(r.conv_id, []).extend(chat_format.unescape(r.formatted[s.start:s.end]) for s in r.spans)
    assert found == expected()
    assert learnt == {c: [t for role, t in turns if role == "assistant"] for c, turns in expected().items()}
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_string_ids(spark):
    df = spark.createDataFrame([("c-1", 0, "user", "x")], SCHEMA.replace("conv_id BIGINT", "conv_id STRING"))
    assert chat_format.format_conversations(df).first().conv_id == "c-1"


@pytest.mark.parametrize("text", [
    "\\" * 5_000_000, "\\" * 5_000_000 + "###", "a" + "\\" * 5_000_000 + "</turn>" + "\\" * 1_000_000, "\\#" * 2_000_000])
def test_long_runs_of_backslashes_take_their_length(text):
    started = time.perf_counter()
    turn, start, end = chat_format.render("user", text)
    assert chat_format.unescape(turn[start:end]) == text
    assert time.perf_counter() - started < 60
