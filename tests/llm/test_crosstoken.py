import random

import numpy as np
import pytest

import brute
from floodlake.llm import crosstoken, queries


@pytest.fixture(scope="module")
def tok():
    return crosstoken._tokenizers(crosstoken._file(queries.TOKENIZER_A), crosstoken._file(queries.TOKENIZER_B))


ODD = ["a  b", " lead", "trail ", "trail  ", "x\n y", "x \n\n  y\t z", "  ", "  a  b", "\x1c b\x85 c", "mix▁ed", "<s> </s> <|endoftext|> <0x0A>",
       "ﬁ é é 漢字 漢 字", "\x00 a\x00", "😀 😀😀", "don't we'll  'S", "1234 56  78", "=== \r\n ###", "﻿bom", "   deep   spaces   ", "a" * 300,
       "　wide　 x", "İ ı ſ K"]


def rows(df, **kw):
    return brute.sort_rows(crosstoken.align(df, queries.TOKENIZER_A, queries.TOKENIZER_B, **kw))


@pytest.mark.parametrize("which", ["edge", "clashing", "docs", "none"])
def test_alignment_equals_whole_texts(which, request):
    df = request.getfixturevalue(which)
    want = brute.alignment_rows([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert rows(df) == sorted(want, key=str)


def test_odd_texts_whole_and_cut(spark):
    rnd = random.Random(6)
    pieces = [*ODD, "word", "Thntblere", "übung", ",", "."]
    texts = ODD + [rnd.choice(["", " ", "\n"]).join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(150)]
    data = list(enumerate(texts)) + [(None, None), (None, "same words"), (3, "same words"), (3, "same words")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted(brute.alignment_rows(data), key=str)
    assert rows(df) == want
    assert rows(df, long=10, chunk=7, fan=3) == want     # nearly all texts go through ranges and the reduction


def test_fragments_compose_in_any_tree(tok):
    rnd = random.Random(7)
    text = " " + " ".join(rnd.choice(["Thntblere", "of", "naïve", "x\ny", "漢字", "retitioning,"]) for _ in range(60))
    whole = crosstoken.range_fragment(tok, text, 0, len(text.encode()), True)
    for chunk in (5, 11, 40):
        parts = [crosstoken.range_fragment(tok, data.decode(), low, high, k == 0)
                 for k, (low, high, data) in enumerate(crosstoken.byte_ranges(text.encode(), chunk))]
        assert len(parts) > 4
        for _ in range(4):
            todo = [crosstoken.Fragment(), *parts]
            while len(todo) > 1:
                k = rnd.randrange(len(todo) - 1)
                todo[k:k + 2] = [crosstoken.compose(tok, todo[k], todo[k + 1])]
            got = todo[0]
            assert (got.text, got.n_a, got.n_b, got.n_groups) == (whole.text, whole.n_a, whole.n_b, whole.n_groups)
            assert sorted(got.pairs) == sorted(whole.pairs) and not any(map(len, got.head + got.tail))


def test_units_forget_without_changing_results(tok, monkeypatch):
    monkeypatch.setattr(crosstoken, "KEEP", 20)
    units, rnd = crosstoken.Units(tok), random.Random(1)
    for _ in range(30):
        words = [" " + "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 4))) for _ in range(12)]
        places = units.look(words)
        for w, p in zip(words, places):
            a, b = tok.encode([w])
            f = crosstoken.range_fragment(tok, w, 0, len(w), True)
            assert units.texts[p] == f.text and units.stats[p].tolist() == [len(a[0]), len(b[0]), f.n_groups]
            assert units.pairs[units.begin[p]:units.begin[p + 1]].tolist() == f.pairs.tolist()


def test_small_numbers_pack():
    for values in ([], [0, 1, 254], [255, 3, 70_000, 256], [300] * 5):
        x = np.array(values, np.int64)
        data = crosstoken._pack(x)
        back, used = crosstoken._unpack(data + b"rest", len(x))
        assert back.tolist() == values and used == len(data)
