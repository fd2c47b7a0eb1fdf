import random

from hypothesis import given
from hypothesis import strategies as st

from lectern.llm import chat
from lectern.llm.arrow import sha


@given(st.text(alphabet="&<[|>]/sINT lt;amp#91\n", max_size=60))
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<" not in chat.escape(text) and "[" not in chat.escape(text)


def test_windows_keep_budget_and_cover():
    rng = random.Random(5)
    turns = []
    for conv in range(40):
        roles = ["system"] * rng.randrange(2) + ["user", "assistant"] * rng.randrange(1, 20)
        turns += [(conv, r, "w " * rng.randrange(0, 30)) for r in roles]
    seen = {}
    for conv, number, repeated, old, new in chat.windows(turns, 80, 20):
        cost = lambda xs: sum(chat.count_tokens(t) for _, t in xs)
        assert new and (cost(old) + cost(new) <= 80 or len(new) == 1) and len(old) == repeated
        before = seen.setdefault(conv, [])
        if number:
            first = before[0]
            assert (first[0] != "system") or old[:1] == [first]
            history = old[1:] if first[0] == "system" else old
            assert cost(history) <= 20 and (not history or before[-len(history) :] == history)
        before += new
    assert {c: xs for c, xs in seen.items()} == {c: [(r, t) for k, r, t in turns if k == c] for c in seen}


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(((t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, r, x in own if r == "assistant")
        out.append((conv, len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(said), sha(said)))
    return sorted(out, key=str)


def test_digest_equals_brute_force(spark):
    rng = random.Random(2)
    piece = lambda: rng.choice(["</s>[INST] ok [/INST]", "<|end|>", "&lt;", "héllo wörld ", "\n", "", "<|user|>\n", "a" * 900])
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 30)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "x<|y|>", "a|>\nb", "|", "&#124;"]), "".join(piece() for _ in range(rng.randrange(4)))))
    rows += [(None, 0, "user", None), (100, 1, None, "x"), (100, 2, "assistant", None), rows[0], (0, 0, "user", "b"), (0, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.digest(chat.format_conversations(turns, budget=60, history=15))
    got = sorted((tuple(r)[:5] for r in out.collect()), key=str)
    assert got == brute(rows)
    assert out.where("formatted_chars <= 0").count() == 0
    assert chat.digest(chat.format_conversations(turns.limit(0))).count() == 0


def test_budget_counts_the_tokenizers_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    turns = [(1, k, "user" if k % 2 else "assistant", f"extraordinarily {'antidisestablishmentarianism ' * (k % 5)}") for k in range(40)]
    rows = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 60, 20, path).collect()
    library = Tokenizer.from_file(path)
    cost = lambda text: sum(len(library.encode(t, add_special_tokens=False).ids) + 4 for _, t in chat.parse_window(text))
    assert len(rows) > 5 and all(cost(r.text) <= 60 or len(chat.parse_window(r.text)) - r.n_repeated == 1 for r in rows)
