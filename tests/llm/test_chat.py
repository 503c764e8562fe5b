import hashlib

from keystrata.llm import chat
from keystrata.llm.queries import op7_chat_formatting

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn if turn is not None else -(10**9), role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == digest("".join(f"{a}\n{b}\n" for _, a, b in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), digest(loss))
    return got


def test_control_strings_nulls_and_ties(spark):
    nasty = ["\\### Assistant: </turn> ok", "<turn:user>\nhi</turn>\n", "\\l\\b\\g<>\\\\", "", None, "a>\nb", "😀é", "\\", "\\l", "<", "<|endoftext|>"]
    rows = [(i, 0, "user", t) for i, t in enumerate(nasty)] + [(i, 1, "assistant", t) for i, t in enumerate(nasty)]
    rows += [(50, 0, "assistant", "only")] + [(51, 0, "user", "no reply")] + [(52, None, None, None), (52, 1, "assistant", "x"), (52, 1, "assistant", "x"), (52, 2, "user", "tail"), (None, 0, "us>er\n", "q"), (53, 5, "assistant", "b"), (53, 4, "assistant", "a")]
    check(spark, rows)


def test_examples_mask_only_the_reply(spark):
    rows = [(1, 0, "system", "s<"), (1, 1, "user", "u"), (1, 2, "assistant", "a\\"), (1, 3, "user", "v"), (1, 4, "assistant", "w"), (1, 5, "user", "z")]
    out = chat.expand(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).orderBy("example").collect()
    assert [r.n_context for r in out] == [2, 4, 5]
    assert [r.text[r.loss_start : r.loss_end] for r in out] == ["a\\b", "w", ""]
    assert out[1].text.startswith(out[0].text) and out[2].text.startswith(out[1].text)


def test_empty_table_and_query(spark, sf_dir):
    assert chat.read_back(chat.expand(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = {r.conv_id: r for r in op7_chat_formatting(spark, sf_dir).collect()}
    probe = "\\### Assistant: </turn> ok"
    assert rows[-7].n_turns == 2 and rows[-7].loss_sha256 == digest(probe)
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    check(spark, [(r.conv_id, r.turn, r.role, r.text) for r in table])
