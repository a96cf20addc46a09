import hashlib
import random

import pytest

from findingflow.llm.chat import TEMPLATE, digest_chats, escape, format_chats, read_turn, unescape
from findingflow.llm.templates import TemplateError, compile_template, fold, parse

BITS = ["\\", "[", "]", "/", "<", ">", "s", "</s>", "<s>", "[INST]", " [/INST]", "[ROLE] ", " [TEXT] ", "[/ROLE]", " ", "\n", "é", "🙂", "INST"]


def render(template, **scope):
    return [p for p in compile_template(template)(scope) if p[0]]


def test_escaping_round_trips():
    rng = random.Random(3)
    run = compile_template(TEMPLATE, {"escape": escape})
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "tool", "", "".join(rng.choices(BITS, k=3))]), "".join(rng.choices(BITS, k=rng.randint(0, 9)))) for _ in range(3)]
        out = "".join(t for t, _ in run({"messages": iter([{"role": r, "text": t} for r, t in turns])}) if t)
        at, back = 0, []
        while at < len(out):
            role, text, at = read_turn(out, at)
            back.append((role, text))
        assert back == turns
        assert all(unescape(escape(t)) == t for _, t in turns)


def test_language():
    assert render("a{# no #}{{ 'b' + 'c' | upper }}{{ x.y }}", x={"y": 1}) == [("a" + "bC", False), ("1", False)]
    assert render("{% for x in xs %}{% if loop.first %}<{% elif x == '2' or not x %}?{% else %}{{ x }}{% endif %}{% if loop.last %}>{% endif %}{% endfor %}", xs="1234") == [(t, False) for t in "<?34>"]
    assert render("{% generation %}{{ x }}{% endgeneration %}!", x="g") == [("g", True), ("!", False)]
    assert render("{{ x.__class__ }}{{ missing.a }}", x="s") == []
    for bad in ("{% if x %}", "{{ a b }}", "{% nope %}", "{{ x | nope }}", "{{ f(x) }}", "{{ 'a }}", "{% for x y %}{% endfor %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)


@pytest.mark.parametrize("operator", ["==", "!=", "+", "and", "or"])
def test_folded_operators_equal_running_ones(operator):
    spelled = {"1": 1, "2": 2, "'a'": "a", "''": "", "true": True, "false": False}
    for a, x in spelled.items():
        for b, y in spelled.items():
            folded = "".join(p for p, _ in render(f"{{{{ {a} {operator} {b} }}}}"))
            assert folded == "".join(p for p, _ in render(f"{{{{ x {operator} y }}}}", x=x, y=y)) == "".join(p for p, _ in render(f"{{{{ {a} {operator} y }}}}", y=y))


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' }}{% if 1 == 2 %}x{% else %}c{% endif %}{{ not true }}"), {}) == ("block", [("text", "abcFalse")])


def brute(rows):
    out, by = {}, {}
    for c, turn, role, text, *_ in rows:
        by.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "b </s> 🙂", 0), (1, 0, "user", "[INST] \\", 0), (1, 2, "tool", None, 0), (1, 2, "tool", None, 0), (2, 0, None, "x", 0), (None, 0, "user", "", 0), (None, None, "assistant", "n", 0),
        (3, 0, "assistant", "long " * 50_000, 0), *[(4, i, ("user", "assistant")[i % 2], f"t{i}", 0) for i in range(12_000)],
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(5)
    made = format_chats(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digest_chats(made).collect()}
    assert got == brute(rows)
    parts = sorted(((r.position, r.offset, r.formatted, r.loss) for r in made.where("conv_id = 1").collect()))
    whole = "".join(p[2] for p in parts)
    assert [p[1] for p in parts] == [whole.index(p[2]) if i < 3 else len(whole) - len(p[2]) for i, p in enumerate(parts)]
    (span,) = [s for p in parts for s in p[3]]
    assert unescape(whole[span.start : span.end]) == "b </s> 🙂"


def test_empty(spark):
    assert digest_chats(format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
