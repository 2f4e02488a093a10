import hashlib
import random

import pytest
from pyspark.sql import functions as F

from catalith.llm import chat

NODES = "tree long, node long, parent long, role string, text string, score double"
TRICKY = ["", None, "plain", "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "\\", "\\\\<\\s>", "<s><s></s>", "<<SYS>>\n\n<</SYS>>", "$1 \\1", "日本 <|im_end|", "[INST][INST]", "<\\|im_end|>"]


def test_escaping_is_reversible_and_hides_control_strings(spark):
    rng = random.Random(1)
    texts = TRICKY + ["".join(rng.choice(["<", "|", "im_end", ">", "\\", "\n", "s", "/", "[INST]", "a", "<|im_start|>"]) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert r["t"] is None or not any(c in r["e"] for c in chat.CONTROL)


def formatted(spark, rows, keep=1):
    return chat.format_paths(chat.paths_of(spark.createDataFrame(rows, NODES), keep))


def test_linear_conversations_come_back(spark):
    rng = random.Random(2)
    said = {i: [(rng.choice(["user", "assistant", "system", None, "a\nb\\"]), rng.choice(TRICKY)) for _ in range(rng.choice([1, 2, 3, 8, 37]))] for i in range(25)}
    rows = [(i, t, role, text, "clash") for i, turns in said.items() for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string").repartition(3)
    done = chat.format_paths(chat.paths_of(chat.conversation_nodes(df)))
    got = done.select("tree", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("l"), "formatted", "n_turns").collect()
    assert len(got) == len(said)
    for r in got:
        want = [(a or "", b or "") for a, b in said[r["tree"]]]
        assert [tuple(t) for t in r["t"]] == want and r["n_turns"] == len(want)
        assert r["l"] == "".join(b for a, b in want if a == "assistant")


def test_best_branch_of_a_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.0), (1, 5, 2, "user", "x", 0.0), (2, 9, 77, "user", "root of a missing parent", None), (3, 1, 2, "u", "cycle", 0.0), (3, 2, 1, "u", "cycle", 0.0), (1, 4, 3, "user", "repeated", 0.0)]
    got = {(r["tree"], r["path"]): r for r in formatted(spark, rows, keep=None).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert {k: [t["text"] for t in r["turns"]] for k, r in got.items()} == {(1, 1): ["q", "good", "more"], (1, 2): ["q", "bad", "x"], (2, 1): ["root of a missing parent"]}
    assert {r["tree"]: r["leaf"] for r in formatted(spark, rows).collect()} == {1: 4, 2: 9}


def test_a_deep_path_and_no_rows(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(700)]
    got = formatted(spark, rows).first()
    assert got["n_turns"] == 700 and got["formatted"].startswith("<|im_start|>user\n0<|im_end|>\n")
    assert formatted(spark, []).count() == 0


def test_query_digests(spark, tmp_path):
    from catalith.llm import registry

    spark.createDataFrame([(1, 1, "assistant", "b\\"), (1, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in registry.op10_chat(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb\\\n") and got[1]["loss_sha256"] == sha("b\\") and got[1]["loss_chars"] == 2
    ok = "</s>[INST] ok [/INST]"
    assert got[-7]["turns_sha256"] == sha(f"user\n{ok}\nassistant\n{ok}\n") and got[-7]["loss_chars"] == len(ok)


@pytest.mark.parametrize("value", ["user", "a\nb", "", "x\\\n<|im_end|>"])
def test_roles_come_back(spark, value):
    assert formatted(spark, [(1, 1, None, value, "t", 0.0)]).select(chat.read_turns(F.col("formatted"))[0]["role"]).first()[0] == value


def test_very_long_roles_and_texts(spark):
    role, text = "r\\\n<s>" * 170_000, "[INST] \\ x\n" * 100_000
    got = formatted(spark, [(1, 1, None, role, text, 0.0)]).select(chat.read_turns(F.col("formatted"))[0].alias("t")).first()["t"]
    assert got["role"] == role and got["text"] == text


def test_a_null_tree_is_one_tree(spark):
    rows = [(None, 2, "assistant", "b"), (None, 1, "user", "a"), (3, 1, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_paths(chat.paths_of(chat.conversation_nodes(df))).select("tree", chat.read_turns(F.col("formatted")).alias("t")).collect()
    assert sorted((r["tree"] or 0, [tuple(x) for x in r["t"]]) for r in got) == [(0, [("user", "a"), ("assistant", "b")]), (3, [("user", "c")])]
    branches = [(None, 1, None, "user", "q", 0.0), (None, 2, 1, "assistant", "bad", 0.1), (None, 3, 1, "assistant", "good", 0.9)]
    assert [(r["tree"], r["leaf"]) for r in formatted(spark, branches).collect()] == [(None, 3)]
