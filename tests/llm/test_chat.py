import re

from pyspark.sql import functions as F

from gridloom.llm import chat
from gridloom.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import sha, write
from tools.check import compare, connect

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def awkward_turns():
    """Null ids, turns, roles and texts, ties, repeated rows, control strings, escapes, many scripts, a long text, many turns."""
    out = [(i, t, role, text) for i, pairs in enumerate([
        [("user", "hi"), ("assistant", "there")], [("user", None), ("assistant", "")], [(None, "x"), ("assistant", None)],
        [("assistant", "<|im_end|>\\<|im_sep|>"), ("assistant", "\\\\"), ("us\ner<|im_sep|>", "<<<SYS>>[[INST]<s></s>")],
        [("system", "漢字 😀 é\n\r\t"), ("user", "[/INST] <|im_end|"), ("assistant", "$1 \\1 ${x} <|im_start|>")],
        [("user", "word </s> " * 30000), ("assistant", "\\<s>" * 30000)],
    ]) for t, (role, text) in enumerate(pairs)]
    out += [(7, None, "user", "first"), (7, 3, "user", "b"), (7, 3, "assistant", "a"), (7, 3, "user", "b"), (7, -2, "assistant", "z")]
    out += [(None, 0, "user", "no id"), (None, 1, "assistant", "no id either"), (-1, 0, "assistant", "mine")]
    return out + [(9, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(700)]


def brute(rows):
    rows = [(c, False, t, r or "", x or "") for c, t, r, x in rows]
    rows += [(-1, True, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))]
    controls = re.compile("|".join(map(re.escape, chat.CONTROLS)))
    escaped = lambda t: len(t) + t.count("\\") + len(controls.findall(t))
    out = []
    for key in {r[:2] for r in rows}:
        turns = sorted((r[2:] for r in rows if r[:2] == key), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        said = "".join(x for _, r, x in turns if r == "assistant")
        n = sum(len(chat.START + chat.SEPARATOR + chat.END) + escaped(r) + escaped(x) for _, r, x in turns)
        out.append((key[0], len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(said), sha(said), n))
    return sorted(out, key=repr)


def test_query_on_awkward_turns(spark, tmp_path):
    table = spark.createDataFrame(awkward_turns(), CONVERSATIONS)
    # Columns that other layouts, or the operator itself, use.
    clashing = table.withColumns({c: F.lit("clash") for c in ("position", "part", "extra", "prompt", "response", "_k0", "formatted", "t", "content")})
    for given in (table, clashing):
        folder = write(given, tmp_path, "conversations")
        got = QUERIES["op12_chat_format"](spark, folder)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(awkward_turns())
        assert compare(got, _duck(folder), ORACLES["op12_chat_format"]) is None


def _duck(folder):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS FROM '{folder}/conversations.parquet/*.parquet'")
    return duck


def test_no_control_string_inside_a_text(spark):
    rows = [r for r in awkward_turns() if r[2] is not None and r[3] is not None]
    made = chat.format_chats(chat.table_turns(spark.createDataFrame(rows, CONVERSATIONS), "conv_id", "turn")).collect()
    for row in made:
        assert not re.search(r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>", row.formatted)
        turns = sum(1 for r in rows if r[0] == row.conv_id)
        assert all(row.formatted.count(mark) == turns for mark in (chat.START, chat.SEPARATOR, chat.END)) and len(row.loss) == turns


def test_only_the_extra_conversation_on_an_empty_table(spark, tmp_path):
    folder = write(spark.createDataFrame([], CONVERSATIONS), tmp_path, "conversations")
    assert list(map(tuple, QUERIES["op12_chat_format"](spark, folder).collect())) == brute([])
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, position long, role string, text string")).count() == 0


def test_main_path_is_native(spark):
    plan = QUERIES["op12_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)


def test_records_of_many_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"a","x":1},{"role":"assistant","content":"b"}],"n":3}'),
        (2, '{"instruction":"i","output":"o"}'), (3, '{"instruction":"i","input":"p","output":"o","system":"s"}'), (4, "no json"), (5, None),
        (6, '{"conversations":[{"from":"human","value":"q"},null,{"from":"gpt","value":null}]}'), (7, '{"messages":[]}'),
        (8, '{"prompt":"p","response":"r","system":null}'), (9, '{"question":1,"answer":[2]}'), (10, "[]"), (None, '{"prompt":"p","completion":"c"}'),
        (11, '{"role":"user","text":"t"}'), (11, '{"role":"user","text":"t"}'),
    ]
    got = chat.record_turns(spark.createDataFrame(records, "id long, record string").withColumn("_paths", F.lit(1)), "id").collect()
    turns = {}
    for r in sorted(got, key=lambda r: (r.conv_id or 0, r.position if r.position is not None else -1)):
        turns.setdefault((r.conv_id, r.layout), []).append((r.role, r.text))
    nothing = [(None, None)]
    assert turns == {
        (1, "messages"): [("user", "a"), ("assistant", "b")], (2, "instruction"): [("user", "i"), ("assistant", "o")],
        (3, "instruction"): [("system", "s"), ("user", "i"), ("user", "p"), ("assistant", "o")], (4, None): nothing, (5, None): nothing,
        (6, "shared conversations"): [("user", "q"), ("", ""), ("assistant", "")], (7, None): nothing, (10, None): nothing,
        (8, "prompt and response"): [("user", "p"), ("assistant", "r")], (9, "question and answer"): [("user", "1"), ("assistant", "[2]")],
        (None, "prompt and completion"): [("user", "p"), ("assistant", "c")], (11, "turn rows"): [("user", "t"), ("user", "t")],
    }
    assert chat.record_turns(spark.createDataFrame([], "id long, record string"), "id").count() == 0


def test_typed_tables_of_many_layouts(spark):
    messages = spark.createDataFrame([(1, [("user", "a"), None, (None, None)]), (2, None), (3, [])], "id long, messages array<struct<role string, content string>>")
    assert sorted(map(tuple, chat.table_turns(messages, "id").collect())) == [(1, 0, "user", "a"), (1, 2, "", "")]
    prompts = spark.createDataFrame([(1, "p", "r", None), (2, None, "r", "s")], "id long, prompt string, response string, system string")
    assert sorted(map(tuple, chat.table_turns(prompts, "id").collect())) == [
        (1, 1, "user", "p"), (1, 2, "assistant", "r"), (2, 0, "system", "s"), (2, 1, "user", ""), (2, 2, "assistant", "r")]
    try:
        chat.table_turns(spark.range(1), "id")
    except ValueError as error:
        assert "id" in str(error)
    else:
        raise AssertionError("a table that fits no layout was taken")
