"""Alignment of two tokenizers against a brute-force form, and on awkward rows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paneltide.llm import align

from .helpers import awkward, corpus


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def spans(tokens):
    out, at = [], 0
    for i, t in tokens:
        out.append((at, at + len(t), i))
        at += len(t)
    return out


def brute(rows, libraries):
    """[(doc_id, n_a, ... groups_sha256)], token by token."""
    from paneltide.llm.bpe import visible_bytes

    t, p = libraries
    to_byte = {c: b for b, c in enumerate(visible_bytes())}
    docs, count = [], Counter()
    for i, text in rows:
        full = (" " + text).encode() if text else b""
        a = [(k, bytes(to_byte[c] for c in t.id_to_token(k))) for k in t.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(k, bytes([int(p.id_to_piece(k)[3:5], 16)]) if p.is_byte(k) else p.id_to_piece(k).replace("▁", " ").encode()) for k in p.encode(text)] if text else []
        if b"".join(x for _, x in a) != full or b"".join(x for _, x in b) != full:
            a = b = []
        a, b = spans(a), spans(b)
        links, j = [], 0
        for s, e, k in a:
            while j < len(b) and b[j][1] <= s:
                j += 1
            m = j
            while m < len(b) and b[m][0] < e:
                links.append((b[m][2], k))
                m += 1
        count.update(links)
        common = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [",".join(str(k) for s, _, k in a if u <= s < v) + "|" + ",".join(str(k) for s, _, k in b if u <= s < v) for u, v in zip([0, *common], common)] if len(a) < 3000 else None
        docs.append((i, len(a), len(b), len(common), links, groups))
    best = {}
    for (b, _), n in count.items():
        best[b] = max(best.get(b, 0), n)
    sha = lambda g: None if g is None else hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(i, na, nb, ng, len(ls), sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls), sha(g)) for i, na, nb, ng, ls, g in docs]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_texts():
    rng = random.Random(5)
    texts = ["a  b ", " ", "  ", "▁x", "a▁b", "ﬁ½ Ａ é é", "\t\n x\r\n", "漢🙂 <|endoftext|> </s><s>", "a\x00b <0x41>", "　y \xa0", "don't  WE'll\n\n", "x" * 500, " lead", "tail   "]
    return texts + ["".join(rng.choice(" \t\nsdleéñ漢字🙂​ab01!?%…<>") for _ in range(rng.randint(1, 60))) for _ in range(150)]


@pytest.mark.parametrize("frequent", [align.FREQUENT, 40, 0])
def test_alignment(spark, libraries, monkeypatch, frequent):
    monkeypatch.setattr(align, "FREQUENT", frequent)
    rows = [r for r in corpus() if len(r[1] or "") < 50_000] + [(2000 + i, t) for i, t in enumerate(odd_texts())] + [(2000, "a  b ")]
    got = rows_of(align.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    want = sorted(brute(rows, libraries), key=str)
    assert len(got) == len(want) and sum(w[1] == 0 for w in want) > 3
    assert [g if w[-1] is not None else g[:-1] for g, w in zip(got, want)] == [w if w[-1] is not None else w[:-1] for w in want]


def test_groups_spell_the_text(spark, libraries):
    t, p = libraries
    rows = [(1, "Of the people, by the people"), (2, "größer als 100 % <|endoftext|>"), (3, None)]
    out = {r["doc_id"]: r for r in align.align(spark.createDataFrame(rows, "doc_id long, text string"), with_groups=True).collect()}
    for i, text in rows[:2]:
        groups = out[i]["groups"]
        assert [k for g in groups for k in g["a"]] == t.encode(" " + text, add_special_tokens=False).ids and [k for g in groups for k in g["b"]] == p.encode(text)
        assert hashlib.sha256(";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in groups).encode()).hexdigest() == out[i]["groups_sha256"] and len(groups) == out[i]["n_groups"]
    assert out[3]["groups"] == [] and out[3]["groups_sha256"] == "" and out[3]["count_sum"] == 0


def test_alignment_awkward(spark, libraries):
    df = awkward(spark).withColumns({c: F.lit("clash") for c in ("pairs", "times", "row", "pair", "b")})
    got = rows_of(align.align(df).drop("groups_sha256"))
    assert got == sorted((w[:-1] for w in brute([tuple(r) for r in awkward(spark).select("doc_id", "text").collect()], libraries)), key=str)
    assert align.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert rows_of(align.align(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"))) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
