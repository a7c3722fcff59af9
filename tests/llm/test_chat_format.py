import hashlib

from kategora.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, turns string, p long, n long"
ROWS = [
    (1, 1, "assistant", "yo\\0 <s> [x]"), (1, 0, "user", "hi\n</s>"), (1, 2, "user", "more"), (1, 3, "assistant", ""),
    (2, 0, "user", None), (2, None, None, "lost\\1"), (3, 0, "ro\nle<", "a"), (3, 0, "assistant", "tie"), (None, 0, "assistant", "x" * 5000),
    (4, 0, "assistant", "😀é"), (4, 0, "assistant", "😀é"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(spark):
    turns = spark.createDataFrame([(*r, "c", 1, 2) for r in ROWS], SCHEMA)
    examples = chat_format.prefix_examples(turns)
    got = {r["conv_id"]: r.asDict() for r in chat_format.digests(examples).collect()}
    made = examples.collect()
    for conv in {r[0] for r in ROWS}:
        own = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in ROWS if r[0] == conv)
        reply = "".join(t for *_, role, t in own if role == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for *_, role, t in own))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(reply), sha(reply))
        assert row["formatted_chars"] == sum(len(e["formatted"]) for e in made if e["conv_id"] == conv)
    for e in made:
        inside = e["formatted"][e["loss_start"] : e["loss_start"] + e["loss_chars"]]
        assert "<" not in inside and "[" not in inside
        assert e["formatted"].count("<s>") == e["formatted"].count("</s>") == e["n_turns"]


def test_examples(spark):
    """Each reply has all earlier turns as context; a turn after the last reply is kept untrained."""
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("assistant", "b"), ("user", "c")])], "conv_id long, turn long, role string, text string")
    rows = sorted(tuple(r) for r in chat_format.prefix_examples(turns).drop("whole").collect())
    first = "<s>user\na</s><s>assistant\nb</s>"
    assert rows == [(1, 0, 2, first, len(first) - 5, 1), (1, 1, 3, first + "<s>user\nc</s>", len(first) + 9, 0)]


def test_probe_and_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.prefix_examples(none)).count() == 0
    row = chat_format.digests(chat_format.prefix_examples(chat_format.probe(spark, none))).first()
    said = "</s>[INST] ok [/INST]"
    assert (row["conv_id"], row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (-7, 2, len(said), sha(said))
