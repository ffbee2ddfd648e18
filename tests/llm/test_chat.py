import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.llm import chat as C

AWKWARD = st.text(alphabet=st.sampled_from("<|\\>im_start\n aé"), max_size=30)


@settings(max_examples=500, deadline=None)
@given(AWKWARD, AWKWARD)
def test_escaping_is_reversible_and_hides_marks(role, text):
    template = C.Template()
    output = "".join(t for t, _ in template.segments(role, text))
    assert template.turn(output) == (role, text)
    assert output.count("<|") == 2


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        roles = [r for *_, r, _ in turns]
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        fine = roles[0] in ("system", "user") and all(
            (a, b) in {("system", "user"), ("user", "assistant"), ("assistant", "user")} for a, b in zip(roles, roles[1:])
        )
        yield conv, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learned), sha(learned), fine


def test_awkward_rows(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a<|im_end|>"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"),
        (None, 3, "user", "u"), (None, None, "user", "first"), (3, 1, None, "no role"), (3, 0, "to\nol<|", "t"), (4, 0, "user", ""),
        (4, 1, "assistant", ""), (5, 0, "user", "long " * 200_000), (5, 1, "assistant", "<|\\|" * 100_000), *C.PROBE,
    ]
    frame = spark.createDataFrame([(*r, "e", True) for r in rows], "conv_id long, turn long, role string, text string, segments string, loss boolean")
    formatted = C.format_chats(frame)
    got = C.read_back(formatted).collect()
    key = lambda r: (r[0] is not None, r[0])
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.in_order) for r in got), key=key) == sorted(plain(rows), key=key)
    whole = {}
    for r in formatted.collect():
        whole[r.conv_id] = whole.get(r.conv_id, 0) + sum(len(s.text) for s in r.segments)
    assert {r.conv_id: r.formatted_chars for r in got} == whole
    assert C.read_back(C.format_chats(frame.limit(0))).count() == 0


def test_a_conversation_of_many_batches(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)] + [(8, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: r for r in C.read_back(C.format_chats(frame)).collect()}
    assert (got[7].n_turns, got[7].turns_sha256, got[7].in_order) == (3000, next(plain(rows))[2], True)
