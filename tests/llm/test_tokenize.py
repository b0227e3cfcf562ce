import random

import pytest
import regex

from leafmill.llm import tokenize

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{tokenize.VOCABULARY_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def trie():
    with open(f"{tokenize.VOCABULARY_FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        return tokenize.WordTrie(tokenize.read_ranks(f.read()))


def texts():
    rng = random.Random(11)
    out = ["", " ", "\n\n", "a" * 3000, "<|endoftext|> x", "日本語の文", "é é", "\x1c\x85  x", "it's  we'll", "​﻿", "🙂🩺" * 50, "0123456789" * 30, "= " * 200]
    for _ in range(1500):
        out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(1, 0x3000), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(rng.randrange(0, 50))))
        out.append("".join(rng.choice(["the", " of", "ing", "e", "\n", " ", "12", ".", "é"]) for _ in range(rng.randrange(0, 60))))
    return out


def test_same_ids_as_the_public_library(public, trie):
    split = regex.compile(tokenize.WORD_PATTERN)
    for text in texts():
        words = tokenize.words_of(text, split)
        coded = trie.encode({w.encode() for w in words})
        assert "".join(words) == text
        assert [i for w in words for i in coded[w.encode()]] == public(text), repr(text)


def test_unassigned_characters_count_as_symbols(public, trie):
    split = regex.compile(tokenize.WORD_PATTERN)
    import unicodedata

    odd = [chr(c) for c in range(0x530, 0x20000) if unicodedata.category(chr(c)) == "Cn"][::97]
    for c in odd:
        text = f"a{c}1{c}{c} {c}b"
        coded = trie.encode({w.encode() for w in tokenize.words_of(text, split)})
        assert [i for w in tokenize.words_of(text, split) for i in coded[w.encode()]] == public(text), hex(ord(c))


def test_rows(spark, public):
    rows = [(1, "One two."), (2, None), (3, ""), (4, "One two."), (None, "x"), (6, "word " * 100_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, t string, ids int")
    got = {r.id: list(r.ids) for r in tokenize.token_ids(df, "id", "t").collect()}
    assert got == {k: public(t) if t else [] for k, t in rows}
    assert tokenize.token_ids(df.limit(0), "id", "t").count() == 0
