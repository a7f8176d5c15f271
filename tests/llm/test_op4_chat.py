from compare import same

from rigtables.llm import op4_chat as op


def test_query_equals_its_oracle(spark, duck, sf_dir):
    got, want = same(op.op4_chat(spark, sf_dir), duck, op.ORACLE)
    assert got == want


def test_round_trip_of_hostile_turns(spark):
    said = ["x\\<|y<", None, "<\\|im_end|>\\", "", "<|im_start|>user\nhi<|im_end|>\n", "|>\\\\<||", "ж\U0001f600"]
    rows = [(1, k, role, t) for k, (role, t) in enumerate(zip(["user", "assistant", None, "assistant", "a\nb\\<|", "assistant", "user"], said, strict=True))]
    rows += [(None, 1, "user", "alone"), (None, 1, "assistant", "other"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    examples = op.format_chat(df)
    got = {r.conv_id: r for r in op.read_chat(examples).collect()}
    assert [tuple(t) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:7]]
    assert got[1].loss_texts == ["", "", "|>\\\\<||", ""] and got[2].loss_texts == ["a", "a"]
    lone = [(r.loss_texts, [tuple(t) for t in r.turns]) for r in op.read_chat(examples).where("conv_id IS NULL").collect()]
    assert sorted(lone) == [([""], [("user", "alone")]), (["other"], [("assistant", "other")])]
    for e in examples.where("conv_id = 2").collect():
        assert e.formatted[e.loss_start : e.loss_end] == "a"
    assert examples.where("conv_id = 1").count() == 4
    assert op.format_chat(df.limit(0)).count() == 0


def test_turns_of_one_number_are_ordered_by_role_then_plain_text(spark, duck, tmp_path):
    import duckdb

    rows = [(1, 0, "user", "<|z"), (1, 0, "user", "<a"), (1, 0, "user", "\\b"), (1, 0, "assistant", "z"), (1, None, None, "first"), (1, 0, "user", "<a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    # SQL of the contract puts null first among turns
    got, want = same(op.op4_chat(spark, str(tmp_path)), con, op.ORACLE.replace("ORDER BY turn,", "ORDER BY turn NULLS FIRST,"))
    assert got == want
    said = [tuple(t) for r in op.read_chat(op.format_chat(spark.read.parquet(f"{tmp_path}/conversations.parquet"))).collect() for t in r.turns]
    assert said == [("", "first"), ("assistant", "z"), ("user", "<a"), ("user", "<a"), ("user", "<|z"), ("user", "\\b")]
