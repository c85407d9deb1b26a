import hashlib
import random

import numpy as np
import pytest

from gridloom.llm.chat import END, ROLE, START, TEXT, digests, escape, format_chats, loss_mask, unescape

ODD = "</s>[INST] ok [/INST]"


def rows():
    rng = random.Random(0)
    pieces = ["a", " b", "\n", "é", "日本", "🎉", "[", "]", "<", ">", "\\", "/", "s>", "INST]", *(x for x in (START, ROLE, TEXT, END)), "<\\s>", "[\\\\/INST]", "  ", "<|endoftext|>"]
    text = lambda n: "".join(rng.choices(pieces, k=n))
    out = [(-1, 0, "user", ODD), (-1, 1, "assistant", ODD), (None, 0, "assistant", None), (None, 1, None, "x"), (5000, 0, "assistant", "z " * 40_000), (5000, None, "assistant", "first")]
    for c in range(60):
        out += [(c, t, rng.choice(["user", "assistant", "system", "assistant", ROLE, text(2)]), rng.choice([None, "", text(rng.randrange(40))])) for t in range(rng.randrange(1, 9))]
    return out + [out[9], out[9], (7000, 3, "assistant", " leading and trailing "), (7000, 3, "assistant", "same turn")]


def brute(rows):
    by = {}
    low = lambda x: (x is not None, x if x is not None else 0)
    for c, *r in sorted(rows, key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        by.setdefault(c, []).append(r)
    out = []
    for c, turns in by.items():
        loss = "".join(x or "" for _, r, x in turns if r == "assistant")
        size = len(START) + sum(len(ROLE + escape(r or "") + TEXT + escape(x or "") + END) for _, r, x in turns)
        out.append((c, len(turns), hashlib.sha256("".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [1 << 20, 40])
def test_read_back(spark, segment):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows()], "conv_id long, turn long, role string, text string, formatted string, segment int").repartition(3)
    formatted = format_chats(table, segment=segment)
    assert sorted((tuple(r) for r in digests(formatted).collect()), key=str) == brute(rows())
    [odd] = [r for r in formatted.filter("conv_id = -1 and segment = 0").collect()][:1]
    assert odd.formatted.count(START) == 1 and (segment < 100 or odd.formatted.count(END) == 2)


def test_segments_give_the_same_tokens(spark):
    table = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    ids = []
    for segment in (1 << 20, 40):
        by = {}
        for r in sorted(format_chats(table, segment=segment).collect(), key=lambda r: r.segment):
            by.setdefault(r.conv_id, []).extend(r.token_ids)
        ids.append(by)
    assert ids[0] == ids[1]


def test_escape_is_reversible():
    for t in (ODD, "[\\INST]", "<\\\\s></s>", "\\[INST]\\", "[[/INST]<s>s>", "plain"):
        assert unescape(escape(t)) == t and not any(c in escape(t) for c in (START, ROLE, TEXT, END))
    assert escape("plain \\ [x] <b>") == "plain \\ [x] <b>"


def test_mask():
    spans = np.array([[2, 5], [5, 5], [9, 12]])
    starts, ends = np.array([0, 1, 2, 3, 5, 8, 9, 11, 12]), np.array([1, 2, 3, 5, 8, 9, 11, 12, 13])
    assert loss_mask(starts, ends, spans).tolist() == [False, False, True, True, False, False, True, True, False]


def test_offsets_are_the_tokenizers(spark):
    import json

    from tokenizers import AddedToken, Tokenizer, processors

    from gridloom.llm.chat import TOKENIZER, _tokenizer, offsets, render

    with open(TOKENIZER, encoding="utf-8") as file:
        data = file.read()
    slow = Tokenizer.from_str(data)
    slow.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, ROLE, TEXT, END)])
    slow.post_processor = processors.ByteLevel(trim_offsets=False)
    _, sizes = _tokenizer(data)
    texts = [render([(r or "", x or "")])[0] for _, _, r, x in rows()] + ["", "𝒳é日" * 30]
    for text, code in zip(texts, slow.encode_batch(texts, add_special_tokens=False), strict=True):
        starts, ends = offsets(text, sizes[np.array(code.ids, np.int64)])
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == code.offsets
    assert json.loads(data)["model"]["type"] == "BPE"
    with pytest.raises(ValueError):
        offsets("ab", np.array([1]))


def test_empty(spark):
    assert digests(format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
