"""Alignment of two tokenizers against a plain walk over whole texts."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from conftest import SCHEMA
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from frostline.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def tokens(texts):
    """Per text its A and B tokens as (id, bytes), by plain calls of both libraries over whole texts."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return [([(i, ranks[i]) for i in t.encode(" " + x, add_special_tokens=False).ids], [(i, piece(i)) for i in sp.encode(x)]) if x else ([], []) for x in texts]


def walk(text, a, b):
    """(groups as text, links) by two pointers."""
    want = b"" if not text else (" " + text).encode()
    if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return "", [], (0, 0)
    ends = []
    for ts in (a, b):
        at, out = 0, []
        for i, x in ts:
            out.append((at, at + len(x), i))
            at += len(x)
        ends.append(out)
    cuts = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
    groups, links, i, j = [], [], 0, 0
    for c in cuts:
        ga, gb = [], []
        while i < len(a) and ends[0][i][1] <= c:
            ga.append(ends[0][i])
            i += 1
        while j < len(b) and ends[1][j][1] <= c:
            gb.append(ends[1][j])
            j += 1
        groups.append(",".join(str(x[2]) for x in ga) + "|" + ",".join(str(x[2]) for x in gb))
        links += [(x[2], y[2]) for x in ga for y in gb if x[0] < y[1] and y[0] < x[1]]
    return ";".join(groups), links, (len(a), len(b))


def brute(rows):
    found = [(i, *walk(t, a, b)) for (i, t), (a, b) in zip(rows, tokens([t for _, t in rows]))]
    count = Counter(p for _, _, links, _ in found for p in links)
    most = {}
    for (_, b), c in count.items():
        most[b] = max(most.get(b, 0), c)
    out = []
    for i, g, links, (na, nb) in found:
        out.append((i, na, nb, g.count(";") + 1 if g else 0, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else ""))
    return out


ODD = ["a▁b", "a  b", " a", "a ", "\n", " ", "é́ ́x", "<|endoftext|> <s> </s> <unk> <0x41>", "x\ny z\n\nw", "\t a b　c", "漢字かな 😀😀 ﬁ①", "\0", "don't we'll 1234567 ___ ..!", "a\r\nb", "a\x1cb \x85 c", "z" * 5000]
KEY = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("chars", [16_000_000, 3_000])
def test_against_whole_texts(spark, docs, rows, chars):
    want = [(r[0], r[1]) for r in rows] + [(None, t) for t in ODD]
    more = spark.createDataFrame([(None, t, "en", "s", 0, 0, 0.0, "") for t in ODD], SCHEMA)
    got = alignment.align_tokenizers(docs.unionByName(more), A, B, chars)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(brute(want), key=KEY)


def test_empty(empty):
    assert alignment.align_tokenizers(empty, A, B).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \nab'▁1.\té漢"), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=4))
def test_pieces_join_to_whole_texts(texts):
    unit = alignment.Unit(alignment.aligner(A, B))
    numbers, hashes, _ = unit.add(texts)
    keys, n, _ = unit.pairs()
    count = Counter()
    for t, found, sha, (a, b) in zip(texts, numbers.tolist(), hashes, tokens(texts)):
        groups, links, (n_a, n_b) = walk(t, a, b)
        assert found == [n_a, n_b, groups.count(";") + 1 if groups else 0, len(links)]
        assert sha == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        count.update(x * 32_000 + y for x, y in links)
    assert {k: c for k, c in zip(keys.tolist(), n.tolist()) if c} == count


def test_union_find():
    rng = random.Random(3)
    for n in (1, 2, 50, 400):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)] + [(i, i + 1) for i in range(n // 2)]
        least = list(range(n))
        for _ in range(n):
            for u, v in links:
                least[u] = least[v] = min(least[u], least[v])
        got = alignment.union_find(n, np.array([u for u, _ in links]), np.array([v for _, v in links]))
        assert got.tolist() == least


def test_units_carry_all_pairs(spark, docs):
    units = alignment._in_units(docs, A, B, 3_000)
    assert units.select("unit").distinct().count() > 3
    assert units.where("kind = 2").count() == docs.count()
