import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from momentlake.llm import chat

SPELLS = st.lists(st.sampled_from(["\\", "#", "###", " ", "### Assistant: ", "</turn>", "\n", "é", "a", "<", "\\#"]), max_size=12).map("".join)


@given(SPELLS)
def test_escape_is_reversible_and_hides_control_strings(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and "###" not in out and "</turn>" not in out.replace("\\<", "\\ ")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool", "critic", "", "#a"]), SPELLS), max_size=6))
def test_assembly_round_trip(turns):
    t = chat.Template(chat.default_ranks())
    ids, mask = t.assemble(turns)
    got = list(t.read(ids, mask))
    assert [(r, x) for r, x, _, _ in got] == turns
    assert ["".join(x[2]) for x in got if x[0] == "assistant"] == [x for r, x in turns if r == "assistant"]
    assert sum(x[3] for x in got) == len(t.render(ids))
    assert not mask[np.asarray(ids) >= t.first].any()


def test_conversations(spark):
    rows = [(1, 1, "assistant", "### User: </turn>"), (1, 0, "user", "hi"), (1, 1, "assistant", "### User: </turn>"), (2, None, None, None), (None, 0, "assistant", ""), (3, 0, "assistant", "long " * 50_000)]
    rows += [(7, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    formatted = chat.format_chat(df)
    assert formatted.filter("conv_id = 7").count() > 1
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, None, 3, 7):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        text = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


@pytest.mark.parametrize("unit", [" ", "\n", "\t", "\u2003", " \n"])
def test_long_white_space_has_the_ids_of_the_tokenizers_file(unit):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    n = 5_000_000 // len(unit) if unit in " \n\t" else 300_000
    for text in (unit * n, unit * n + "x", f"a b{unit * n}word {unit * 200_000}", f"x{unit * 100_000} y"):
        assert chat.encode_text(chat.default_ranks(), text) == library.encode(text, add_special_tokens=False).ids


def test_conversation_of_long_white_space(spark):
    rows = [(1, 0, "user", " " * 1_500_000 + "x"), (1, 1, "assistant", "\n" * 1_200_000)]
    got = chat.read_back(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert got.loss_sha256 == hashlib.sha256(rows[1][3].encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
