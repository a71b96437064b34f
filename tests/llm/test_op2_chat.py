import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from graphloom.llm import bpe, chat
from tests.llm.helpers import SMALL, table_dir

SCHEMA = "conv_id long, turn long, role string, text string"


def want(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        said = "".join(f"{t[1] or ''}\n{t[2] or ''}\n" for t in turns)
        learned = "".join(t[2] or "" for t in turns if t[1] == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def run(spark, folder):
    got = chat.op2_chat(spark, folder).collect()
    assert all(r.formatted_chars > 0 for r in got)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


EXTRA = [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, SMALL) == want(rows + EXTRA)


AWKWARD = [
    (1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "a <|end|> b \\ c <|text|> \\"), (1, 2, "assistant", ""),
    (2, None, "assistant", "<|turn|>"), (2, 0, None, "<<SYS>> x <</SYS>> <s>"), (None, 0, "assistant", "lost"), (None, 1, "user\n", "x"),
    (3, 5, "assistant", "long " * 3000), (3, 6, "user", "short"), (3, 7, "assistant", "é😀" * 40), (3, 7, "assistant", "é😀" * 40),
] + [(4, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i * 37 % 200)) for i in range(700)] + [(5, 0, "system", "only")] + [
    (6, 0, "system", "sys " * 30)] + [(6, i, ("assistant", "user")[i % 2], "w " * 90) for i in range(1, 40)]


def test_awkward(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, "x") for r in AWKWARD], SCHEMA + ", cost long, p string")
    assert run(spark, table_dir(tmp_path, spark, "conversations", df)) == want(AWKWARD + EXTRA)


def test_windows(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    budget, history = 400, 64
    rows = chat.read_turns(chat.format_windows(df, budget, history)).collect()
    repeated = 0
    for r in rows:
        assert r.cost <= budget or len(r.turns) == 1
        if r.conv_id == 6:
            assert r.formatted.startswith("<|turn|>system<|text|>sys ")
        repeated += r.repeated
        assert r.formatted.count("<|end|>") == len(r.turns) + r.repeated
    assert repeated > 20 and len(rows) > 100
    assert chat.format_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_budget_in_tokens_of_a_tokenizer(spark):
    """With counts by operator 6 as costs, windows keep to a budget of that tokenizer's tokens."""
    model = bpe.Bpe(bpe.tokenizer_path())
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}, " + "unbelievably long-winded; " * (i * 7 % 30)) for i in range(60)]
    counted = bpe.encode(spark.createDataFrame(rows, SCHEMA)).withColumn("n", F.size("ids"))
    windows = chat.read_turns(chat.format_windows(counted, 400, 64, cost=F.col("n"))).collect()
    said = [t.text for r in sorted(windows, key=lambda r: r.window) for t in r.turns]
    assert said == [r[3] for r in rows] and len(windows) > 5
    for r in windows:
        own = sum(len(model.encode(t.text)) + chat.OVERHEAD for t in r.turns)
        assert own <= r.cost <= 400 or len(r.turns) == 1
