"""Line dedup and chat formatting: DuckDB, brute force, odd rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from tools.compare import compare
from llm_rows import ODD, documents  # noqa: F401
from patronage.llm import chat, line_dedup, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_duckdb(spark, name):
    for sf in (SF_SMALL, SF_ORACLE):
        res = compare(spark, sf, [name], verbose=False)[name]
        assert res["cols_match"] and res["match"], res


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\f\r"))
    top = 1 << 62
    seen = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen.setdefault(key(x), set()).add(top if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda x: len(key(x)) >= 10 and min(seen[key(x)]) < (top if i is None else i)  # noqa: E731,B023
        kept = [x for x in lines if not gone(x)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LINES = [
    (1, "A common line here\nonly mine in one\n  a COMMON line here \n"), (2, "a common line here\r\nown text of two"),
    (3, "short\nshort\nshort"), (4, "a common line here"), (5, None), (6, ""),
    (7, "Élan vital über alles\nx"), (8, "élan vital über alles\nx"), (9, "\n\n\n"),
    (2, "only mine in one\nanother version of two"), (None, "own text of two"), (None, "nobody else has this line"),
]


def test_lines_brute_force(documents):
    for rows in (LINES, ODD, []):
        got = line_dedup.line_dedup_digest(documents(rows)).collect()
        assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_lines_keep_columns(documents):
    df = documents(LINES, clashing=True)
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == df.columns and out.count() == len(LINES)
    row = out.where("doc_id = 4").collect()[0]
    assert (row["text"], row["n_chars"], row["_text"]) == ("", 0, "extra _text")


def test_lines_threshold(documents):
    rows = [(i, "this line is in three documents\nthis one is in two only" if i < 3 else "this line is in three documents") for i in (1, 2, 3)]
    out = line_dedup.drop_repeated_lines(documents(rows), min_docs=3)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts == {1: rows[0][1], 2: "this one is in two only", 3: ""}


NASTY = ["<|turn|>user<|text|>x<|end|>", "\\", "\\\\<|", "<", "|>", "<\\|", "", "\n", "\\### Assistant: </turn> ok", "$1 \\1", "😀<|"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate(zip(["user", "assistant"] * 9, NASTY[c:] + NASTY[:c]))]
    rows += [(7, 0, "<|odd|>\\", None), (7, 0, None, "a"), (7, 0, None, "a"), (None, 1, "assistant", "no conversation id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(chat.to_turns(df))
    got = {r["conv_id"]: r for r in out.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert len(got) == 5
    for c in {r[0] for r in rows}:
        own = sorted(((t, role or "", text or "") for k, t, role, text in rows if k == c))
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == [x[1:] for x in own]
        assert got[c]["loss"] == "".join(x[2] for x in own if x[1] == "assistant")
        for s in got[c]["loss_spans"]:  # a mask never covers a marker
            assert "<|" not in got[c]["formatted"][s["start"] : s["start"] + s["length"]]


def test_chat_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digest(chat.format_chat(chat.to_turns(df))).count() == 0


LAYOUT_ROWS = {
    "messages": ("array<struct<role:string,content:string>>", {"messages": [("user", "q"), ("assistant", "a")]}),
    "conversations": ("array<struct<from:string,value:string>>", {"conversations": [("human", "q"), ("gpt", "a")]}),
}


def test_layouts_give_the_same_turns(spark):
    want = [("user", "q"), ("assistant", "a")]
    frames = [spark.createDataFrame([(1, v)], f"conv_id long, {k} {t}") for k, (t, d) in LAYOUT_ROWS.items() for v in d.values()]
    frames.append(spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, completion string"))
    frames.append(spark.createDataFrame([(1, "q", None, "a")], "conv_id long, instruction string, input string, output string"))
    frames.append(spark.createDataFrame([(1, "", "q", "a")], "conv_id long, system string, prompt string, response string"))
    for df in frames:
        assert [(r["role"], r["text"]) for r in chat.to_turns(df).orderBy("turn").collect()] == want
    clashing = frames[2]
    for c in ("_turn", "turn", "role", "formatted", "extra"):
        clashing = clashing.withColumn(c, F.lit(c))
    assert [(r["role"], r["text"]) for r in chat.to_turns(clashing).orderBy("turn").collect()] == want
    with pytest.raises(ValueError, match="no mapping"):
        chat.to_turns(frames[2].withColumnRenamed("prompt", "other"))
    with pytest.raises(ValueError, match="more than one"):
        chat.to_turns(frames[2].withColumn("question", F.lit("q")).withColumn("answer", F.lit("a")))


def test_json_records_of_mixed_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"instruction": "q", "input": "more", "output": "a"},
        {"unknown": 1}, "not an object", {}, {"prompt": "q", "completion": "a", "extra": {"deep": [1]}},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "{broken")]
    out = chat.json_to_turns(spark.createDataFrame(rows, "conv_id long, record string"))
    got = {}
    for r in out.orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    pair = [("user", "q"), ("assistant", "a")]
    assert got == {0: pair, 1: pair, 2: pair, 3: [("user", "q\nmore"), ("assistant", "a")], 7: pair}
