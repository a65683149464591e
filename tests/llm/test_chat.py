import json

from brute import sha
from pyspark.sql import functions as F

from millrace.llm import chat, queries


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_layouts_become_the_same_turns(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]},
        "conversations": {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}], "id": 7},
        "instruction": {"instruction": "hi", "output": "ho"},
        "prompt_completion": {"prompt": "hi", "completion": "ho", "extra": {"deep": [1]}},
        "prompt_response": {"prompt": "hi", "response": "ho"},
        "question_answer": {"question": "hi", "answer": "ho"},
        "turns": {"turns": [{"turn": 2, "role": "assistant", "text": "ho"}, {"turn": 1, "role": "user", "text": "hi"}]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()], "name string, record string")
    out = chat.format_chats(df, "record", ["name"]).collect()
    assert {r["name"]: r["layout"] for r in out} == {k: k for k in records}
    assert {tuple((t["role"], t["text"]) for t in r["turns"]) for r in out} == {(("user", "hi"), ("assistant", "ho"))}
    assert len({r["fingerprint"] for r in out}) == len(records)


def test_unknown_null_and_joined_records(spark):
    df = spark.createDataFrame(
        [(1, None), (2, "no json"), (3, '{"odd": 1}'), (4, '{"instruction": "a", "input": "b", "output": "c"}'), (5, '{"instruction": "a", "input": "", "output": "c"}'), (6, '{"messages": [{"role": null, "content": null}]}')],
        "layout int, turns string",
    )  # names that clash with the operator's own columns
    out = {r["layout_"]: r for r in chat.format_chats(df.select(F.col("layout").alias("layout_"), "turns"), "turns", ["layout_"]).collect()}
    assert [out[i]["layout"] for i in (1, 2, 3)] == [None] * 3 and out[1]["turns"] == [] and out[1]["formatted"] == ""
    assert out[4]["turns"][0]["text"] == "a\n\nb" and out[5]["turns"][0]["text"] == "a"
    assert out[6]["turns"][0]["role"] == "" and out[6]["turns"][0]["text"] == ""


def test_round_trip_with_control_strings_ties_and_repeats(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant\nno", "&lt;|&amp;<|", "", None, "a\nb", "<|" * 50, "x" * 200_000, "é😀\u0001"]
    rows = [(i % 3, i, ["user", "assistant", None, "sys\ntem<|"][i % 4], t) for i, t in enumerate(odd)] + [(9, 1, "user", "same")] * 2 + [(8, None, "assistant", "n"), (8, 1, "assistant", "m")]
    records = chat.conversation_records(rows_of(spark, rows).withColumn("payload", F.lit(1)))
    out = {r["conv_id"]: r for r in chat.digests(chat.format_chats(records, "payload", ["conv_id"]), "conv_id").collect()}
    for conv, own in out.items():
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert own["n_turns"] == len(turns)
        assert own["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns))
        assert (own["loss_chars"], own["loss_sha256"]) == (len(loss), sha(loss))
    assert len(out) == 5


def test_empty_table_gives_only_the_own_conversation(spark, tmp_path):
    rows_of(spark, []).write.parquet(f"file://{tmp_path}/conversations.parquet")
    out = queries.op10_chat_formatting(spark, f"file://{tmp_path}").collect()
    assert [r["conv_id"] for r in out] == [-1] and out[0]["loss_chars"] == 34


def test_records_that_variant_cannot_hold_keep_their_turns(spark):
    rows = rows_of(spark, [(1, 2, "assistant", "y"), (1, 1, "user", "x")])
    long = rows.withColumn("text", F.when(F.col("turn") == 1, F.repeat("text", F.lit(20_000_001))).otherwise(F.col("text")))
    said = sha("user\n" + "x" * 20_000_001 + "\nassistant\ny\n")
    records = chat.format_chats(chat.conversation_records(long), "payload", ["conv_id"])
    for chats in (records, chat.format_rows(long, "conv_id")):
        assert [(r["n_turns"], r["turns_sha256"], r["loss_chars"]) for r in chat.digests(chats, "conv_id").collect()] == [(2, said, 1)]
    text = F.repeat(F.lit("x"), 20_000_001)
    payloads = {
        "instruction_input": F.concat(F.lit('{"id": {"a": 1}, "instruction": "a", "input": "'), text, F.lit('", "output": null}')),
        "messages": F.concat(F.lit('{"messages": [{"role": "bot", "content": "'), text, F.lit('"}, {"role": null}]}')),
        None: F.concat(F.lit('{"messages": "'), text, F.lit('"')),
    }
    for name, payload in payloads.items():
        r = chat.format_chats(spark.range(1).withColumn("p", payload), "p", ["id"]).select("layout", F.transform("turns", lambda t: F.concat_ws(":", t["role"], F.length(t["text"]).cast("string"))).alias("t")).first()
        assert r["layout"] == name and r["t"] == {"instruction_input": ["user:20000004", "assistant:0"], "messages": ["assistant:20000001", ":0"], None: []}[name]


def test_rows_and_records_give_the_same_chats(spark):
    rows = rows_of(spark, [(1, 2, "human", "b"), (1, None, None, "<|im_end|>"), (1, 2, "gpt", None), (2, 1, "assistant", "&"), (2, 1, "assistant", "&"), (None, 1, "user", "x")])
    records = chat.format_chats(chat.conversation_records(rows), "payload", ["conv_id"]).collect()
    assert sorted(map(str, chat.format_rows(rows, "conv_id").collect())) == sorted(map(str, records))


def test_own_roles_stay_in_turns_and_are_renamed_elsewhere(spark, tmp_path):
    said = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (1, 2, "model", "c"), (1, 3, "assistant", "d")]
    rows_of(spark, said).write.parquet(f"file://{tmp_path}/conversations.parquet")
    own = {r["conv_id"]: r for r in queries.op10_chat_formatting(spark, f"file://{tmp_path}").collect()}[1]
    assert own["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, _, r, t in said)) and own["loss_sha256"] == sha("d")
    record = json.dumps({"turns": [{"turn": i, "role": r, "text": t} for _, i, r, t in said]})
    other = json.dumps({"conversations": [{"from": r, "value": t} for _, _, r, t in said]})
    out = chat.format_chats(spark.createDataFrame([(1, record), (2, other)], "id int, record string"), "record", ["id"]).collect()
    roles = {r["id"]: [t["role"] for t in r["turns"]] for r in out}
    assert roles == {1: ["human", "gpt", "model", "assistant"], 2: ["user", "assistant", "assistant", "assistant"]}


def test_only_an_elements_own_fields_make_the_layout(spark):
    records = [
        {"messages": [{"content": "hi", "meta": {"role": "x"}}]},
        {"messages": [{"meta": {"role": "x", "content": "y"}}]},
        {"messages": {"role": "user", "content": "hi"}},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}]}]},
        {"messages": [{"role": "user"}, {"content": "hi", "role": None}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id int, record string")
    out = {r["id"]: r for r in chat.format_chats(df, "record", ["id"]).collect()}
    assert [out[i]["layout"] for i in range(5)] == [None, None, None, "messages", "messages"]
    assert json.loads(out[3]["turns"][0]["text"]) == [{"type": "text", "text": "hi"}]
    assert [(t["role"], t["text"]) for t in out[4]["turns"]] == [("user", ""), ("", "hi")]


def test_rows_are_mapped_by_the_fingerprint_of_their_fields(spark):
    names = ["turn", "role", "text", "content", "from", "value", "instruction", "output", "input"]
    rows = [
        (1, 1, {"turn": 2, "role": "gpt", "text": "b"}), (1, 2, {"turn": 1, "role": "user", "text": None}), (2, 1, {"role": "human", "content": "hi"}), (2, 2, {"role": "gpt", "content": ""}),
        (3, 2, {"from": "gpt", "value": "yes"}), (3, 1, {"from": "human", "value": "no"}), (4, 1, {"instruction": "do", "output": "done"}), (4, 2, {"instruction": "do", "output": "done", "input": "it"}),
        (5, 1, {"role": "user"}), (6, 1, {}), (7, 2, {"from": "bot", "value": "z"}), (7, 1, {"role": "user", "content": "y"}),
    ]
    df = spark.createDataFrame([(c, at, *[None if r.get(n) is None else str(r[n]) for n in names]) for c, at, r in rows], "conv_id long, at long, " + ", ".join(f"`{n}` string" for n in names))
    out = {r["conv_id"]: r for r in chat.format_rows(df, "conv_id", order="at").collect()}
    said = {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in out.items()}
    assert said == {
        1: [("user", ""), ("gpt", "b")], 2: [("user", "hi"), ("assistant", "")], 3: [("user", "no"), ("assistant", "yes")],
        4: [("user", "do"), ("assistant", "done"), ("user", "do\n\nit"), ("assistant", "done")], 5: [], 6: [], 7: [("user", "y"), ("assistant", "z")],
    }
    assert {c: r["layout"] for c, r in out.items()} == {1: "turns", 2: "messages", 3: "conversations", 4: "instruction+instruction_input", 5: None, 6: None, 7: "conversations+messages"}


def test_mixed_layouts_give_the_digests_of_plain_rows(spark, data):
    plain = {tuple(r) for r in queries.op10_chat_formatting(spark, data).collect() if r["conv_id"] >= 0}
    assert {tuple(r) for r in queries.chat_mixed_layouts(spark, data).collect()} == plain
