"""Chat formatting against a row-by-row version, and its read-back against what went in."""

import random

import pytest

from tickbars.llm import chatformat, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, loss int, turns string, _rows int"
PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "[AND]", "<\\/s>", "<\\\\s>", "[", "<", "\\", "<<SYS>>", "[ROLE]", "[SAYS]", "é", "漢\U0001f600", "\n", " ok "]


def conversations():
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        for turn in range(rng.choice([1, 2, 5, 60])):
            role = rng.choice(["system", "user", "assistant", "assistant", "tool", "a[SAYS]b", "", None])
            text = rng.choice([None, "", "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))])
            rows.append((conv, turn, role, text))
    rows += [(None, 0, "user", "x"), (None, 0, "user", "x"), (41, None, "assistant", "b"), (41, 1, "assistant", "a"), (41, 1, "assistant", "<")]
    rows += [(42, 0, "assistant", "word </s> " * 50_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, "t", 2) for r in rows], SCHEMA).repartition(3)


def escaped(text, controls):
    """A backslash behind the first character of each control string, whatever backslashes stand there."""
    out = ""
    for i, ch in enumerate(text):
        out += ch
        rest = text[i + 1 :].lstrip("\\") if text[i + 1 : i + 2] == "\\" else text[i + 1 :]
        out += "\\" if any(c[0] == ch and rest.startswith(c[1:]) for c in controls) else ""
    return out


def expected(turns):
    template = chatformat.Template()
    text, loss, last = "", [], None
    for n, (_, role, said) in enumerate(turns):
        before, after = template.roles.get(role, (f"[ROLE]{escaped(role, template.controls)}[SAYS]", "[/ROLE]"))
        if role == last:
            text += "[AND]"
        else:
            text += before
        start = len(text.encode())
        text += escaped(said, template.controls)
        if role == "assistant":
            loss.append((start, len(text.encode()) - start))
        if n + 1 == len(turns) or turns[n + 1][1] != role:
            text += after
        last = role
    return text, loss


def test_format_and_read_back(spark):
    rows = conversations()
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    formatted = chatformat.format_conversations(frame(spark, rows))
    found = chatformat.read_back(formatted).collect()
    assert len(found) == len(groups)
    for r in found:
        turns = sorted(groups[r.conv_id], key=lambda t: (t[0] is not None, t))
        if r.conv_id != 42:
            text, loss = expected(turns)
            assert r.formatted == text and [tuple(s) for s in r.loss] == loss
        assert [tuple(t) for t in r.turns] == [t[1:] for t in turns]
        assert r.loss_text == "".join(t[2] for t in turns if t[1] == "assistant")
        assert r.n_blocks == 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))


def test_no_control_string_survives_in_a_text(spark):
    template = chatformat.Template()
    df = frame(spark, conversations()).select("text").dropna()
    for r in df.select("text", template.escape(df["text"]).alias("e"), template.unescape(template.escape(df["text"])).alias("u")).collect():
        assert not any(c in r.e for c in template.controls)
        assert r.u == r.text


def test_no_conversations_and_many_turns(spark):
    assert chatformat.read_back(chatformat.format_conversations(frame(spark, []))).count() == 0
    many = [(1, i, "user" if i % 2 else "assistant", "é" * (i % 7)) for i in range(5_000)]
    r = chatformat.read_back(chatformat.format_conversations(frame(spark, many))).first()
    assert [tuple(t) for t in r.turns] == [t[2:] for t in many]
    assert r.loss_text == "".join(t[3] for t in many[::2])


def test_overlapping_control_strings_are_refused():
    for foreign in ("[[", "s>x", "INST", "<s", "a\\b", "x"):
        with pytest.raises(ValueError):
            chatformat.Template(foreign=(foreign,))


def test_chat_query(spark, tmp_path):
    rows = [(5, 1, "assistant", "b"), (5, 0, "user", None), (None, 0, "user", "[INST]")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op11_chat_format(spark, str(tmp_path))
    assert found.dtypes == [
        ("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint"),
    ]
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in found.collect()} == {(5, 2, 1), (None, 1, 0), (-1, 2, len(queries.PLANTED))}
