import random

import pytest
from pyspark.sql import functions as F

from webloom.llm.chat import Template, format_chats, parse_chats, trained_text

SCHEMA = "conv_id long, turn long, role string, text string, turns int, segments string"
T = Template()
PIECES = [*T.controls(), "\\", "\\\\", "<", ">", "[", "]", "/", "s>", "<<s>", "[INST", "INST]", " ", "\n", "x", "é", "\U0001f600", "$1", "\\E", "</s>[INST] ok [/INST]"]


def read_back(spark, rows, template=T):
    out = format_chats(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), template)
    return {r.conv_id: r for r in out.select("*", parse_chats(F.col("formatted"), template).alias("read"), trained_text(F.col("segments"), template).alias("loss")).collect()}


def expected(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {k: [x[1:] for x in sorted(v)] for k, v in by_conv.items()}


@pytest.mark.parametrize("seed", range(3))
def test_round_trip(spark, seed):
    r = random.Random(seed)
    roles = ["user", "assistant", "assistant", "system", "tool", "", None, "<<TEXT>>", "a\\<</ROLE>>", "user "]
    rows = []
    for conv in range(40):
        rows += [(conv, i, r.choice(roles), r.choice([None, "", "".join(r.choices(PIECES, k=r.randint(0, 12)))])) for i in range(r.randint(1, 12))]
    rows += [(None, 1, "user", "a"), (None, 0, None, "b"), (50, None, "user", "x"), (50, 1, "user", "y"), (50, 1, "user", "y"), (50, 1, "assistant", "z")]
    r.shuffle(rows)
    got, want = read_back(spark, rows), expected(rows)
    assert set(got) == set(want)
    for k, x in got.items():
        assert [tuple(t) for t in x.read] == want[k]
        assert x.formatted == "".join(s.text for s in x.segments)
        assert x.loss == "".join(t for role, t in want[k] if role == "assistant")


def test_layout(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "a"), (1, 2, "user", "[INST]"), (1, 3, "assistant", "b"), (1, 4, "tool", "c"), (2, 0, "assistant", None)]
    got = read_back(spark, rows)
    assert got[1].formatted == "<<SYS>>\nS\n<</SYS>>\n\n<s>[INST] a<<TURN>>[\\INST] [/INST]<<ANSWER>> b </s><<ROLE>>tool<<TEXT>>c<</ROLE>>"
    assert [tuple(s) for s in got[1].segments if s.trained] == [("b", True)]
    assert got[2].formatted == "<<ANSWER>>  </s>" and [tuple(t) for t in got[2].read] == [("assistant", "")]


def test_marks_of_ones_own(spark):
    chat = Template(roles=(("user", "<|user|>\n", "<end>\n"), ("model", "<|model|>\n", "<stop>\n")), trained=("model", "tool"))
    got = read_back(spark, [(1, 0, "user", "a<end><|model|>"), (1, 1, "model", "b<stop>"), (1, 2, "tool", "c")], chat)[1]
    assert [tuple(t) for t in got.read] == [("user", "a<end><|model|>"), ("model", "b<stop>"), ("tool", "c")] and got.loss == "b<stop>c"
    assert got.formatted.count("<|model|>") == 1
    with pytest.raises(ValueError):
        Template(join="\n").controls()


def test_long_conversation_and_text(spark):
    rows = [(1, i, ["user", "assistant"][i // 2 % 2], f"{i}\\") for i in range(3000)] + [(2, 0, "assistant", "<s>é" * 200_000)]
    got = read_back(spark, rows)
    assert [tuple(t) for t in got[1].read] == [x[2:] for x in rows[:-1]]
    assert got[2].loss == rows[-1][3]


def test_empty_table(spark):
    assert read_back(spark, [(1, 0, "user", "a")]).keys() == {1}
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
