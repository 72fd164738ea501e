"""Word-end BPE against the public library, on whole texts and odd ones."""

from __future__ import annotations

import hashlib
import random
import sys
import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reviewlens.llm import queries, wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \t\n", "Hello  wörld's ΣΑΣ x<|endoftext|>y<|startoftext|><|endoftext|> 1234 \U0001F600!!!",
    "é é İstanbul ß ﬁ 'Re 'll don't I'M", "a" * 5000 + " " + "ab" * 700, "  　x\u0085y\x1cz",
    "<|ENDOFTEXT|> <|endoftext", "نص عربي 中文字符 हिन्दी", "ᲉꟋ unassigned \U0003FC3F",
    "word " * 3000, "\x00\x01 control", "end́́ ́", "½ ² Ⅷ ١٢",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_library(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded))


def test_every_character_splits_as_in_the_library(library):
    own = wordbpe.WordBpe(PATH)
    for c in range(0, sys.maxunicode + 1, 7):
        if 0xD800 <= c < 0xE000:
            continue
        text = f"a{chr(c)}B1 {chr(c)}"
        marked = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        want = [bytes(own.byte_of[x] for x in word).decode() for word, _ in marked]
        assert own.split(text) == want, (hex(c), unicodedata.category(chr(c)))


def test_heap_and_scan_merge_alike(library):
    own = wordbpe.WordBpe(PATH)
    random.seed(3)
    for _ in range(300):
        word = "".join(random.choices("abcdehinorst", k=random.randint(1, 90)))
        parts = [own.symbol[b] for b in word.encode()]
        parts[-1] += own.suffix
        merged = own.merge_long(list(parts))
        assert merged == own.merge_short(list(parts)) == library.encode(word, add_special_tokens=False).tokens


@pytest.mark.parametrize("config", [wordbpe.BlockConfig(), wordbpe.BlockConfig(chars=100, words=20, least_buckets=3, words_kept=5)])
def test_documents_like_the_library(spark, library, config):
    rows = [(i if i % 5 else 7, text, "x", i) for i, text in enumerate(ODD)] + [(None, "null key", "x", 0), (None, "null key", "x", 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, word string, block int")
    got = wordbpe.encode_documents(frame.repartition(3), PATH, True, config).collect()
    want = [(key, *by_library(library, text)) for key, text, *_ in rows]
    order = lambda row: tuple(str(x) for x in row)
    assert sorted([tuple(r)[:4] for r in got], key=order) == sorted(want, key=order)
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)


def test_the_query_on_all_documents(spark, library, always_shuffle):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_word_bpe(spark, SF).collect()}
    assert got == {key: by_library(library, text) for key, text in docs.items()}


def test_decode_passes_over_unknown_ids_and_keeps_empty_rows(spark):
    rows = spark.createDataFrame([(1, [320, 99999, 320]), (2, []), (3, None)], "key int, ids array<int>")
    pieces = spark.createDataFrame([(320, "a</w>")], "id int, piece string")
    assert {r["key"]: r["text"] for r in wordbpe.decode_rows(rows, "key", pieces).collect()} == {1: "a</w> a</w>", 2: "", 3: ""}


def test_an_empty_table(spark):
    assert wordbpe.encode_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        wordbpe.WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
