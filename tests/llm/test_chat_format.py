"""Chat formatting: exact round trips, the role machine, loss flags, grounding annotations."""

import random

import pytest
from pyspark.sql import functions as F

from scenesift.llm.chat_format import ChatTemplate, format_chats, grounding_turns, loss_text, read_back

SCHEMA = "sample_id long, turn long, role string, text string, formatted string, segments int"


def formatted(spark, rows, template=ChatTemplate()):
    frame = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA)
    out = format_chats(frame, template=template)
    return out.withColumn("back", read_back(F.col("formatted"), template)).withColumn("loss", loss_text(F.col("segments"))).collect()


@pytest.mark.parametrize("template", [ChatTemplate(), ChatTemplate(start="<|turn|>", end="<|stop|>", gap="", trained=("assistant", "system"))])
def test_round_trip_of_hostile_texts(spark, template):
    r = random.Random(1)
    bits = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "<|turn|>", "<|stop|>", "a", "\n", "%0A", "%", "ü", "\U0001f600", "im_end|>", "$1", "\x00"]
    rows = []
    for c in range(150):
        for t in range(r.randint(1, 6)):
            role = r.choice(["user", "assistant", "system", "", None, "a\nb", "%0A", "<|im_start|>"])
            rows.append((c, t, role, "".join(r.choice(bits) for _ in range(r.randint(0, 12))) if r.random() < 0.9 else None))
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    r.shuffle(rows)
    out = formatted(spark, rows, template)
    assert len(out) == len(want)
    for x in out:
        assert [tuple(b) for b in x.back] == want[x.sample_id] and x.n_turns == len(want[x.sample_id])
        assert x.loss == "".join(t for role, t in want[x.sample_id] if role in template.trained)
        assert x.formatted == "".join(s.text for s in x.segments) and len(x.segments) == 3 * x.n_turns
        assert x.formatted.count(template.start) == x.formatted.count(template.end) == x.n_turns


def walked(spark, roles):
    out = formatted(spark, [(1, k, role, "x") for k, role in enumerate(roles)])[0]
    return out.valid, out.bad_turn, out.state


def test_role_machine(spark):
    assert walked(spark, ["system", "user", "assistant", "user"]) == (True, None, "asked")
    assert walked(spark, ["user", "assistant"]) == (True, None, "answered")
    assert walked(spark, ["user", "user", "assistant"]) == (False, 1, "asked")
    assert walked(spark, ["assistant", "user"]) == (False, 0, "begin")
    assert walked(spark, ["user", "assistant", "system"]) == (False, 2, "answered")
    assert walked(spark, ["user", None]) == (False, 1, "asked")
    solo = ChatTemplate(moves=(("begin", "note", "end"),))
    assert [x.valid for x in formatted(spark, [(1, 0, "note", "")], solo)] == [True]


def test_ties_nulls_and_empty_tables(spark):
    rows = [(None, 0, "user", "q"), (None, None, "system", "s"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    out = {x.sample_id: x for x in formatted(spark, rows)}
    assert [tuple(b) for b in out[None].back] == [("system", "s"), ("user", "q")] and out[None].valid
    assert [b.text for b in out[2].back] == ["a", "a", "b"] and out[2].bad_turn == 1
    assert formatted(spark, []) == []
    long = "word <|im_end|> " * 200_000
    many = [(3, k, ("user", "assistant")[k % 2], "t") for k in range(1500)] + [(4, 0, "user", long)]
    out = {x.sample_id: x for x in formatted(spark, many)}
    assert out[3].valid and out[3].loss == "t" * 750 and out[4].back[0].text == long


def test_templates_that_could_not_be_read_back_are_refused():
    for bad in ({"start": "[INST]"}, {"end": "</s>"}, {"end": "<|im_start|>more"}, {"gap": "<"}):
        with pytest.raises(ValueError):
            ChatTemplate(**bad)


def test_grounding_annotations_become_dialogues(spark):
    schema = "sample_id string, prompt string, bbox3d struct<center:array<double>,size:array<double>,yaw:double>, turn string"
    rows = [("scene_1_0001_mug_p000", "the mug near the box", ([1.0, 2.0, 3.0], [0.1, 0.2, 0.3], 0.5), "own"), ("scene_1_0001_box_p000", None, None, "own")]
    out = {x.sample_id: x for x in format_chats(grounding_turns(spark.createDataFrame(rows, schema))).withColumn("loss", loss_text(F.col("segments"))).collect()}
    full, bare = out["scene_1_0001_mug_p000"], out["scene_1_0001_box_p000"]
    assert full.valid and full.state == "answered" and full.loss == '{"center":[1.0,2.0,3.0],"size":[0.1,0.2,0.3],"yaw":0.5}'
    assert bare.valid and bare.state == "asked" and bare.loss == "" and bare.n_turns == 2
