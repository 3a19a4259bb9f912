from veripaper.llm import chat_format as C


def links(spark, rows, **columns):
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as level")
    return {(r["conv_id"], r["turn"]): r for r in C.format_conversations(messages).collect()}


def test_replies(spark):
    rows = [
        (1, 0, "user", "First  question here.\nWith a second line"),
        (1, 1, "assistant", "An answer"),
        (1, 2, "user", "> first question HERE.\n> with a second   line\nBut why?"),  # case and blanks do not matter
        (1, 3, "assistant", "> > First question here.\n>> With a second line\n> But why?\n\nBecause."),  # nested
        (1, 4, "user", "> never written\nHm"),
        (1, 5, "user", ">An answer\n> \n> Because.\nBoth"),  # most characters count
        (2, 1, "user", "> An answer\nother conversation"),
        (3, 0, "user", "> only a quote"),
    ]
    found = links(spark, rows)
    assert {k: r["reply_to"] for k, r in found.items()} == {
        (1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 2, (1, 4): None, (1, 5): 1, (2, 1): None, (3, 0): None}
    assert (found[1, 3]["thread"], found[1, 3]["depth"]) == (0, 2)
    assert found[1, 2]["message"] == "But why?" and found[1, 3]["message"] == "Because." and found[3, 0]["message"] == ""
    assert found[1, 4]["n_quotes"] == 1 and found[1, 4]["n_linked"] == 0
    order = sorted((r["thread"], r["turn"]) for k, r in found.items() if k[0] == 1)
    assert order == [(0, 0), (0, 2), (0, 3), (1, 1), (1, 5), (4, 4)]


def test_latest_origin_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "TURNS", 4)
    rows = [(1, t, "user", "again and again" if t % 5 == 0 else f"> again and again\nturn {t}") for t in range(40)]
    found = links(spark, rows)
    assert all(found[1, t]["reply_to"] == t // 5 * 5 for t in range(40) if t % 5)


def test_long_chain(spark):
    rows = [(1, 0, "user", "message 0")] + [(1, t, "user", f"> message {t - 1}\nmessage {t}") for t in range(1, 60)]
    found = links(spark, rows)
    assert all((found[1, t]["thread"], found[1, t]["depth"]) == (0, t) for t in range(60))


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (None, 0, "user", "> x"), (1, None, "user", "> x\ny"), (1, 1, "user", "> \n>\n> >"), (1, 2, "user", "z"),
            (1, 2, "user", "z"), (2, 0, "user", "line\n" * 20000)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.format_conversations(messages).collect()
    assert len(out) == len(rows) and all(r["reply_to"] is None for r in out)
    assert C.format_conversations(messages.where("false")).count() == 0


def test_main_path_has_no_python(spark, folder):
    messages = spark.read.parquet(f"{folder}/conversations.parquet")
    plan = C.format_conversations(C.with_quotations(messages))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
