"""Template language, escapes, and formatted conversations read back."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duelframe.llm import chat_format as cf


def rendered(source, messages, names=None, **options):
    pieces = list(cf.compile_template(source, names, {"escape": cf.escaped}).render(messages, **options))
    return "".join("".join(p.parts) for p in pieces), [p.spans for p in pieces]


TURNS = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "Yes.", "n": 3}]


@pytest.mark.parametrize("body, want", [
    ("{{ message.role }}:{{ message['text'] }};", "user:hi;assistant:Yes.;"),
    ("{{ loop.index0 }}{% if loop.last %}!{% elif loop.first %}?{% else %}-{% endif %}", "0?1!"),
    ("{% set x = message.text | upper | length + 1 %}{{ x * 2 }},", "6,10,"),
    ("{{ message.n is defined and message.n > 2 }} ", "false true "),
    ("{{ message.n | default('none') }} ", "none 3 "),
    ("{{ 'a' if message.role == 'user' else 'b' ~ 1 }}", "ab1"),
    ("{{ message.role in ['user', 'tool'] }}{{ 'x' not in message.text }}", "truetruefalsetrue"),
    ("{% for c in [1, 2 - 4, 'z\\n'] %}{{ c }}{% endfor %}|", "1-2z\n|1-2z\n|"),
    ("{#- gone -#}  {{- message.text | replace('Y', 'J') | trim -}}  ", "hiJes."),
    ("{{ 7 // 2 }}{{ 7 % 4 }}{{ -3 + 1.5 }}{{ not none }}{{ missing }}", "33-1.5true" * 2),
    ("{{ message.role[0] }}{{ message.role[99] }}{{ message.text.upper }}", "ua"),
])
def test_language(body, want):
    assert rendered("{% for message in messages %}" + body + "{% endfor %}", TURNS)[0] == want


def test_names_before_and_after_the_loop():
    source = "{% set end = '</' ~ tag ~ '>' %}<{{ tag }}>{% for m in messages %}{{ m.text ~ end }}{% endfor %}{{ end }}."
    assert rendered(source, TURNS, {"tag": "b"})[0] == "<b>hi</b>Yes.</b></b>."
    assert rendered(source, [], {"tag": "b"})[0] == "<b></b>."
    assert rendered(source, TURNS, {"tag": "b"}, first=4, closes=False)[0] == "hi</b>Yes.</b>"


@pytest.mark.parametrize("source", [
    "no loop", "{% for m in messages %}", "{% for m in messages %}{{ m.text | evil }}{% endfor %}", "{% endfor %}",
    "{% for m in messages %}{{ messages }}{% endfor %}", "{% import os %}", "{{ 1 + }}{% for m in messages %}{% endfor %}",
    "{% for m in messages %}{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}{% endfor %}",
    "{% for m in messages %}{{ f() }}{% endfor %}", "{{ 1 // 0 }}{% for m in messages %}{% endfor %}", "{{ 'a' < 1 }}{% for m in messages %}{% endfor %}",
    "{% for m in messages %}x{% endfor %}{% for m in messages %}y{% endfor %}",
])
def test_refused_templates(source):
    with pytest.raises(cf.TemplateError):
        cf.compile_template(source)


@pytest.mark.parametrize("expression", ["message.__class__", "message.text.__class__.__mro__", "message['text'].format", "loop.__init__"])
def test_python_is_out_of_reach(expression):
    assert rendered("{% for message in messages %}{{ " + expression + " }}{% endfor %}", TURNS)[0] == ""


def test_folding_leaves_only_what_depends_on_messages():
    source = "{{ 'a' ~ (1 + 2) }}{% if mode == 'x' %}{{ mark ~ '!' }}{% else %}no{% endif %}{% for m in messages %}{{ mark ~ m.text ~ mark ~ '.' }}{% endfor %}"
    tree = cf.folded(cf.parse(source), cf.FILTERS, {"mode": "x", "mark": "#"})
    assert tree == (cf.Text("a3#!"), cf.Loop("m", cf.Name("messages"), (cf.Text("#"), cf.Print(cf.Member(cf.Name("m"), cf.Const("text"))), cf.Text("#."))))


pieces = st.lists(st.one_of(st.sampled_from([*cf.CONTROLS, "\\", "\\\\", "[", "<", "/", "\n", " ", "ROLE]"]), st.text(max_size=3)), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), pieces), pieces), max_size=5), st.integers(1, 60))
def test_formatted_turns_read_back(turns, size):
    out = list(cf.corpus_template().render([{"role": r, "text": t} for r, t in turns], size=size))
    assert [x for piece in out for x in cf.read_turns("".join(piece.parts))] == turns
    loss = [cf.unescaped("".join(p.parts)[s:e]) for p in out for s, e in p.spans]
    assert loss == [t for r, t in turns if r == "assistant"]
    assert all(not cf._CONTROL.search(cf.escaped(t)) for _, t in turns)


def plain(rows):
    """Digests per conversation from the rows themselves."""
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
    out = {}
    for conv, _, role, text in order:
        out.setdefault(conv, []).append((role or "", text or ""))
    found = set()
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        formatted = "".join("".join(p.parts) for p in cf.corpus_template().render([{"role": r, "text": t} for r, t in turns]))
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        found.add((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
    return found


@pytest.mark.parametrize("slice_turns, piece_chars", [(cf.SLICE_TURNS, cf.PIECE_CHARS), (3, 20)])
def test_long_conversations_nulls_ties_and_clashing_names(spark, slice_turns, piece_chars):
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "tool", None, "a\\[ROLE]"]
    rows = [(c, t, rng.choice(roles), rng.choice(["ok", "</s>", None, "", "x" * rng.randint(1, 50), "é😀\\"])) for c in (1, 2, None, -1) for t in range(rng.randint(1, 40))]
    rows += [(7, None, "user", "late"), (7, None, "assistant", "later"), (7, 0, "user", "a"), (7, 0, "user", "a"), (8, 5, "assistant", "y" * 100_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "slice": F.lit("x")})
    made, cut = cf.format_conversations(df, slice_turns=slice_turns, piece_chars=piece_chars)
    assert cut == (slice_turns == 3)
    if cut:
        assert made.agg(F.max("slice")).first()[0] > 2
    assert {tuple(r) for r in cf.read_back(made, cut).collect()} == plain(rows)
    assert cf.read_back(*cf.format_conversations(df.limit(0))).collect() == []
