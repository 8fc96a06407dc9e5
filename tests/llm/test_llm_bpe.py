import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from corpuslens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = [
    *("a b e th ing é ß 漢 😀 ÉE 23 1 ! ... 's 'll aaaaaaaa ===== ² Ⅷ thereing".split()),
    *(" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "​", "﻿", "\0"),
]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return bpe.Encoder(bpe.Vocabulary.parse(file.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed=0):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def test_same_ids_as_the_library_and_round_trip(encoder, library):
    some = texts(2000)
    for text, packed in zip(some, encoder.pack(some)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.unpack(packed) == text.encode()


def test_remembered_words_change_nothing(encoder, library):
    text = "the cat\nthe dog the cat"
    first, again = encoder.pack([text]), encoder.pack([text, "the dog"])
    assert first[0] == again[0]
    assert np.frombuffer(again[1], "<u4").tolist() == library.encode_ordinary("the dog")


def test_neighbours_stay_apart_as_merging_says(encoder):
    vocabulary, draw = encoder.vocabulary, random.Random(1)
    for _ in range(3000):
        a, b = (draw.randrange(vocabulary.size) for _ in range(2))
        whole = [vocabulary.tokens[a], vocabulary.tokens[b]]
        assert vocabulary.apart[a * vocabulary.size + b] == (vocabulary.merge(b"".join(whole)) == whole)


def test_append_and_replace_equal_encoding_anew(encoder):
    vocabulary, draw = encoder.vocabulary, random.Random(2)

    def anew(data):
        return [vocabulary.ranks[part] for part in vocabulary.merge(data)]

    for text in texts(200, 3):
        data = text.encode() + b"abc"
        prefixes = bpe.PrefixTokens(vocabulary, data[:2])
        prefixes.append(data[2:])
        assert prefixes.ids() == anew(data)
        start = draw.randrange(len(data))
        stop = draw.randrange(start, len(data))
        prefixes.replace(start, stop, b"th")
        assert prefixes.ids() == anew(data[:start] + b"th" + data[stop:])


def test_an_edit_far_from_the_end_is_local(encoder):
    prefixes = bpe.PrefixTokens(encoder.vocabulary, b"the quick brown fox " * 100)
    assert prefixes.replace(10, 12, b"x") < 500


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b\n c", "z"), (3, "a b\n c", "z"), (None, "thing " * 20_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert [(r.doc_id, bytes(r.decoded).decode()) for r in out] == [(i, t or "") for i, t, _ in rows]
    assert [r.n_tokens for r in out[:2]] == [0, 0] and out[2] == out[3]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_query_digests(spark, sf_small, library):
    from corpuslens.llm.queries import op1_bpe

    whole = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    out = op1_bpe(spark, sf_small).collect()
    assert len(out) == len(whole)
    for row in out:
        ids = library.encode_ordinary(whole[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(whole[row.doc_id].encode()).hexdigest()
