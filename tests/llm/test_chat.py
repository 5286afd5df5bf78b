import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldmill.llm import chat as H

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = st.lists(st.sampled_from([*H.CONTROL, "\\", "<\\", "[\\\\", "<", ">", "[", "]", "/INST]", "s>", " ", "\n", "a", "é", "😀", " </s>\n", "[INST] "]), max_size=9).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]) | PIECES, PIECES), max_size=6))
def test_turns_come_back_from_the_whole_text(turns):
    done = [H.format_turn(*t) for t in turns]
    assert H.read_turns("".join(d[0] for d in done)) == turns
    assert [H.unescape(d[0][d[1] : d[2]]) for d in done] == [t[1] for t in turns]


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_is_reversible_and_leaves_no_bare_control_string(text):
    assert H.unescape(H.escape(text)) == text and H._BARE.search(H.escape(text)) is None


def test_only_conflicting_text_is_escaped():
    assert H.format_turn("user", "plain <b> [x] \\ text")[0] == "[INST] plain <b> [x] \\ text [/INST]\n"
    assert H.format_turn("assistant", "a </s> <\\s>")[0] == "<s> a <\\/s> <\\\\s> </s>\n"
    for broken in ("[INST] a", "x", "[INST] a </s>\n", "[INST] a [INST] b [/INST]\n"):
        with pytest.raises(ValueError):
            H.read_turns(broken)


def brute(rows):
    of = {}
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        of.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = []
    for conv, turns in of.items():
        trained = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), sum(len(H.format_turn(*t)[0]) for t in turns)))
    return sorted(out, key=str)


def test_nulls_repeats_one_large_conversation_and_other_columns(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i} </s>") for i in range(3000)]
    rows += [(2, 0, None, None), (2, None, "assistant", "late"), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 0, "user", "no one's"), (3, 5, "a <|text|> role", "<|end|>\n")]
    rows += [(4, 0, "assistant", "é😀[INST]" * 40_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", loss_start int, formatted string").repartition(6)
    assert sorted((tuple(r) for r in H.read_back(H.format_turns(df)).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert H.read_back(H.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0


def test_registered_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "</s>[INST] ok [/INST]"
    assert sorted((tuple(r) for r in H.op13_chat(spark, folder).collect()), key=str) == brute([*rows, (-1, 0, "user", text), (-1, 1, "assistant", text)])
