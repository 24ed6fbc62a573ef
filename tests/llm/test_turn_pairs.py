"""Pairs of every assistant turn."""

from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from frostline.llm import preferences


def test_turn_pairs(spark):
    talk = [("user", "q"), ("assistant", "same"), ("user", "more"), ("assistant", "own"), ("user", "thanks")]
    rows = [(c, k, r, f"own {c}" if t == "own" else t) for c in range(30) for k, (r, t) in enumerate(talk)] + [(90, 0, "user", "alone"), (91, 0, None, None), (92, 0, "assistant", None)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for rows_a_group in (2, 20_000):
        got = preferences.turn_pairs(conversations, rows_a_group).collect()
        assert sorted(r["pair_id"] for r in got) == sorted([*range(30), *range(30), 90, 91, 92])
        replies = {t or "" for _, _, r, t in rows if r == "assistant"}
        for r in got:
            assert len(r["chosen"]) == sum(c == r["pair_id"] for c, *_ in rows)
            k = len(r["rejected"]) - 1
            if r["pair_id"] in (90, 91):
                assert r["rejected"] == r["chosen"]
                continue
            assert r["rejected"][:k] == r["chosen"][:k] and r["chosen"][k]["role"] == "assistant"
            assert r["rejected"][k]["text"] in replies - {r["chosen"][k]["text"] or ""}
        assert {(r["pair_id"], len(r["rejected"])) for r in got if r["pair_id"] < 30} == {(c, k) for c in range(30) for k in (2, 4)}


def test_query_formats_every_turn(spark, tmp_path):
    rows = [(c, k, r, f"{t}{c}") for c in range(3) for k, (r, t) in enumerate([("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b"), ("user", "bye")])] + [(9, 0, "user", "alone")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["pair_id"], r["n_common"]): r for r in preferences.op8_preference_formatting(spark, str(tmp_path)).collect()}
    assert set(got) == {(c, n) for c in range(3) for n in (1, 3)} | {(9, 1)}
    assert got[9, 1]["chosen"] == got[9, 1]["rejected"] == "" and got[0, 3]["chosen"].endswith("bye0\n") and got[0, 1]["rejected"].count("<|") == 1


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    """Pairs with prefixes, texts, ids and masks, turn by turn."""
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    encode = lambda x: t.encode(x, add_special_tokens=False).ids
    replies = {x or "" for _, _, r, x in rows if r == "assistant"}
    talks = defaultdict(list)
    for c, k, r, x in sorted(rows, key=lambda v: tuple((y is not None, y) for y in v)):
        talks[c].append((r, x))

    def side(turns):
        text, ids, mask = "", [], []
        for r, x in turns:
            for learn, part in ((False, f"<|{r or ''}|>\n"), (r == "assistant", f"{x or ''}\n")):
                text += part
                ids += encode(part)
                mask += [int(learn)] * len(encode(part))
        return text, ids, mask

    out = []
    for c, turns in talks.items():
        at = [k for k, (r, _) in enumerate(turns) if r == "assistant"]
        for k in at or [None]:
            out.append((c, k, [side(turns[:m])[0] for m in range(len(turns) + 1)], [side(turns[m:]) for m in range(len(turns) + 1)], turns))
    return out, replies, side


def test_formatted_turns_by_brute_force(spark):
    """Null, empty, repeated and very long turns, special strings, a null conversation, columns that clash."""
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello <|endoftext|>"), (1, 2, None, "x"), (1, 3, "assistant", "hello <|endoftext|>"), (2, 0, "assistant", None), (2, 0, "assistant", ""), (3, 5, "user", None),
        (4, 2, "assistant", "late"), (4, 1, "user", "word " * 40_000), (None, 0, "user", "no id"), (None, 1, "assistant", "a\n\nb  c"), (5, None, "assistant", "no turn"), (6, 0, "tool", ""), (7, 0, "user", "same"), (7, 0, "user", "same"),
    ]
    rows += [(20 + c, k, ("user", "assistant")[k % 2], f"t{k}" if k % 4 else f"t{c}") for c in range(15) for k in range(6)]
    frame = spark.createDataFrame([(*r, "clash", "clash", -1, "clash") for r in rows], "conv_id long, turn long, role string, text string, other string, reply string, h long, `g.x` string")
    want, replies, side = brute(rows)
    for most in (100, 1_000_000):
        got = preferences.turn_preferences(frame, VOCABULARY, 3, most).collect()
        assert len(got) == len(want)
        by = defaultdict(list)
        for r in got:
            by[r.pair_id].append(r)
        for c, k, prompts, rests, turns in want:
            n = len(turns) if k is None else k
            (r,) = [r for r in by[c] if r.n_common == n]
            assert r.prompt == prompts[n] and (r.chosen, r.chosen_ids, r.chosen_mask) == rests[n]
            if k is None:
                assert (r.rejected, r.rejected_ids, r.rejected_mask) == ("", [], [])
                continue
            other = r.rejected.removeprefix("<|assistant|>\n").removesuffix("\n")
            assert other in replies - {turns[k][1] or ""} and (r.rejected, r.rejected_ids, r.rejected_mask) == side([("assistant", other)])
    assert preferences.turn_preferences(frame.limit(0), VOCABULARY).count() == 0
    assert preferences.turn_pairs(frame).count() == len(want)


def test_an_only_reply_is_common(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", ""), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in preferences.turn_preferences(frame, VOCABULARY).collect()}
    assert {k: r.n_common for k, r in got.items()} == {1: 2, 2: 1} and all(r.chosen == r.rejected == "" for r in got.values())
