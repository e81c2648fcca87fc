from rollspark.operators import shaping as H

MSG = "array<struct<role:string,content:string>>"


def _msgs(spark, rows):
    return spark.createDataFrame([(i, m) for i, m in enumerate(rows)], f"id int, messages {MSG}")


def test_split_prompt_response_edge_cases(spark):
    df = _msgs(spark, [
        [("user", "q"), ("assistant", "a"), ("user", "q2"), ("assistant", "a2")],
        [("user", "q"), ("user", "q2")],            # no assistant: all prompt
        [("assistant", "a"), ("user", "q")],        # assistant first: all prompt (as the reference)
        [],
    ])
    got = {r.id: (len(r.prompt), len(r.response), r.num_turns)
           for r in H.split_prompt_response(df).collect()}
    assert got == {0: (1, 3, 1), 1: (2, 0, 0), 2: (2, 0, 0), 3: (0, 0, 0)}


def test_first_user_message_absent(spark):
    df = _msgs(spark, [[("assistant", "a")], [("system", "s"), ("user", "u")]])
    got = [r.p for r in df.orderBy("id").select(H.first_user_message("messages").alias("p")).collect()]
    assert got == [None, "u"]


def test_loss_flags_modes(spark):
    df = _msgs(spark, [[("system", "s"), ("user", "u v"), ("assistant", "a"), ("assistant", "b c")]])
    want = {"last_assistant_message": [0, 0, 0, 1], "all_assistant_messages": [0, 0, 1, 1],
            "all_messages": [1, 1, 1, 1], "all_tokens": [1, 1, 1, 1], "all_user_and_system_messages": [1, 1, 0, 0]}
    for mode, flags in want.items():
        r = df.select(H.loss_flags("messages", mode).alias("f")).first()
        assert r.f == flags
    r = df.select(H.token_weights("messages", H.loss_flags("messages", "last_assistant_message"), 2,
                                  "last_assistant_message").alias("w")).first()
    assert r.w == [0, 0, 0] + [0, 0, 0, 0] + [0, 0, 0] + [0, 0, 1, 1]


def test_sweep_params_missing_parts(spark):
    df = spark.createDataFrame([("caltech101-Qwen-Qwen3-VL-235B-A22B-Instruct-32rank-0.0005lr-32batch-4shot-seed0-2025-11-26",),
                                ("flowers-m-5e-4lr-8batch-seed1-2024-01-02",)], "name string")
    rows = df.select(*H.sweep_params("name")).collect()
    assert (rows[0].dataset, rows[0].lora_rank, rows[0].learning_rate, rows[0].batch_size, rows[0].examples_per_class,
            rows[0].subset_seed, rows[0].date) == ("caltech101", 32, 0.0005, 32, 4, 0, "2025-11-26")
    assert rows[1].lora_rank is None and rows[1].examples_per_class is None and rows[1].learning_rate == 0.0005
