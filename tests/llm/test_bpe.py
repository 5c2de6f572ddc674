"""Prefix encoding against the tokenizers library, piece by piece and whole."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from blockweave.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, decoded string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    r = random.Random(4)
    kinds = ["ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "éüßaΣσ İǅ", "0123456789'sdtmrevl ", "中文字あ😀a ", "!?.-_=<|>/w", "\x1c\u0085　a\U00010d50Ɤ́e", "\x00﻿​a "]
    out = [None, "", " ", "\n\t", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|EndOfText|>", "don't DON'T we'LL", "é é", "a" * 5000, "ab" * 3000, "x" + " y" * 4000]
    for _ in range(1500):
        k = r.choice(kinds)
        s = "".join(r.choice(k) for _ in range(r.randrange(40)))
        out.append(s + r.choice(["", "", "", "<|endoftext|>" + s]))
    return out


def test_encoder_equals_library(library):
    tok = bpe.load(bpe.read_spec(PATH))
    assert tok.known
    for s in odd_texts():
        assert tok.encode(s or "").tolist() == library.encode(s or "", add_special_tokens=False).ids, repr(s)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers(name, library):
    own, theirs = bpe.load(bpe.read_spec(public_tokenizers.path(name))), Tokenizer.from_file(public_tokenizers.path(name))
    for s in odd_texts()[:500]:
        assert own.encode(s or "").tolist() == theirs.encode(s or "", add_special_tokens=False).ids, repr(s)


def test_pairs_fit_if_the_pair_is_its_own_encoding(library):
    m = bpe.load(bpe.read_spec(PATH)).merges
    r = random.Random(6)
    tokens = [i for i in m.parts if i < 6000]
    names = {i: t for t, i in library.get_vocab().items()}
    seen = set()
    while len(seen) < 300 or len({m.fits(*p) for p in seen}) < 2:
        a, b = r.choice(tokens), r.choice(tokens)
        if names[a].isascii() and names[b].isascii() and names[a].isalpha() and names[b].removesuffix("</w>").isalpha() and names[b].endswith("</w>"):
            seen.add((a, b))
            assert m.fits(a, b) == (library.encode(names[a] + names[b][:-4], add_special_tokens=False).ids == [a, b]), (names[a], names[b])


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError, match="merge"):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "aba": 3}, [["ab", "a"], ["a", "b"]], "")


def test_one_long_piece(library):
    s = "abcdefghij" * 20_000
    assert bpe.load(bpe.read_spec(PATH)).encode(s).tolist() == library.encode(s, add_special_tokens=False).ids


def test_tables_with_odd_rows(spark, library):
    data = [(i, t, "clash", "x") for i, t in enumerate(odd_texts()[:300])] + [(None, "same", None, None), (3, "same", None, None), (3, "same", None, None)]
    out = bpe.decode(bpe.encode(spark.createDataFrame(data, SCHEMA), PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(((r["doc_id"], r["text"], r["ids"], r["decoded"]) for r in out.collect()), key=str)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t, _, _ in data]
    assert got == sorted(((d[0], d[1], i, library.decode(i, skip_special_tokens=False)) for d, i in zip(data, ids, strict=True)), key=str)
    assert bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA), PATH), PATH).count() == 0
    odd = spark.createDataFrame([(1, [3306, None, -5, 10**6, 49407]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(odd, PATH).collect()} == {1: "hello</w> <|endoftext|>", 2: "", 3: ""}


def test_query(spark, library):
    from blockweave.llm.queries import op12_bpe

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in op12_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got.pop(r["doc_id"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert not got
