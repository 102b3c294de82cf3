import hashlib
import random

import pytest

from tickforge.llm import chat as C
from tickforge.llm import templates as T

ROWS = "conv_id long, turn long, role string, text string"


def joined(source, messages=(), **values):
    return "".join(e for e in T.compiled(source, C.FILTERS, values)(iter(messages), **values) if isinstance(e, str))


def test_language():
    say = [{"role": "user", "text": "a"}, {"role": "bot", "text": None}, {"role": "user", "text": "c"}]
    assert joined("{% for m in messages %}{{ loop.index }}{{ m.text }}{% if not loop.last %},{% endif %}{% endfor %}", say) == "1a,2,3c"
    assert joined("{% for m in messages %}{% if loop.previous.role == 'bot' %}!{% elif m['role'] != 'user' %}?{% else %}.{% endif %}{% endfor %}", say) == ".?!"
    assert joined("a  {{- 'b' | upper -}}  c{# note #}{{ 1 ~ true ~ none }}") == "aBc1true"
    assert joined("{% set x = 'q' ~ y %}{{ x if x == 'qz' else 'no' }}{{ 'z' in x and not ('k' in x) }}", y="z") == "qztrue"
    assert joined("{{ y.__class__ }}{{ y['__class__'] }}{{ y.key }}", y={"key": 1}) == "1"
    events = list(T.compiled("{% for m in messages %}<{% generation %}{{ m.text }}{% endgeneration %}>{% endfor %}", {})(iter(say[:1])))
    assert events == ["<", T.BEGIN, "a", T.END, ">", T.TURN]


def test_folding():
    tree = T.fold(T.parse("a{% if 1 == 2 %}x{% else %}b{{ 'c' ~ 2 | upper }}{% endif %}{% if true and y %}d{% endif %}{{ false or y }}", C.FILTERS, ["y"]), C.FILTERS)
    assert tree == (T.Text("abc2"), T.If(T.Name("y"), (T.Text("d"),), ()), T.Print(T.Name("y")))


@pytest.mark.parametrize("source", ["{{ unknown }}", "{{ y() }}", "{{ y | nope }}", "{% for m in y %}{% endfor %}", "{% if y %}", "{% endif %}", "{{ y", "{{ 'a }}",
                                    "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{{ messages }}", "{% import os %}", "{{ y. }}", "{{ 1 2 }}",
                                    "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}"])
def test_sandbox_refuses(source):
    with pytest.raises(T.TemplateError):
        T.compiled(source, C.FILTERS, ["y"])


def test_escape_is_reversible_and_hides_controls():
    rng = random.Random(1)
    bits = [*C.CONTROLS, "<", "[", "\\", "\\l", "/", "s>", "INST]", "x", "\n", " ", "é🙂"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        safe = C.escape(text)
        assert C.unescape(safe) == text and not any(c in safe for c in C.CONTROLS)


def conversations():
    rng = random.Random(2)
    bits = [*C.CONTROLS, "<", "[", "\\", "/", " ", "é🙂", "word"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", "<s>"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))))
    return rows


def expected(turns):
    whole = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), whole, len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_round_trip_in_parts(spark):
    rows = conversations() + [(77, 3, "assistant", "x" * 300_000), (77, 1, None, None), (77, None, "user", "first"), (77, 1, "assistant", "b"),
                              (77, 1, "assistant", "b"), (None, 0, "user", "no id"), (None, 1, "assistant", "x")] + [(88, k, "assistant", f"turn {k}") for k in range(500)]
    frame = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS key", "2 AS part")
    for part in (1, 200, C.PART_CHARS):
        made = C.format_conversations(frame, part_chars=part)
        got = {r.conv_id: r for r in C.read_back(made).collect()}
        sizes = {}
        for r in made.collect():
            sizes.setdefault(r.conv_id, []).append(len(r.formatted))
        for conv in {r[0] for r in rows}:
            mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
            g = got[conv]
            assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == expected([r[2:] for r in mine])
            assert g.formatted_chars == sum(sizes[None if conv is None else str(conv)])
        assert len(sizes["88"]) == (500 if part == 1 else 1 if part > 1000 else len(sizes["88"]))
    assert C.read_back(C.format_conversations(frame.limit(0))).count() == 0


def test_probe(spark):
    (r,) = C.read_back(C.format_conversations(C.probe(spark))).collect()
    text = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([("user", text), ("assistant", text)])
