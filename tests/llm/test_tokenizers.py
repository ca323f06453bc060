import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from quarry.llm import bpe, token_counts  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["a", "  ", " \u0308", "\x1c", "\r\n", "\u00a0", "\u2003", "the ", "e", "=", "--", " ", "\n", "é", "日本", "\x85", "😀", "12", "٣", "İ", "'s", "\t", "_", "́", "​", "<|endoftext|>", "x" * 40]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def samples(n=3000, seed=1):
    rnd = random.Random(seed)
    for i in range(n):
        if i % 3 == 0:
            yield "".join(rnd.choice("abcdeilnorstuhm ") for _ in range(rnd.randint(0, 60)))
        elif i % 3 == 1:
            yield "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 40)))
        else:
            yield "".join(chr(rnd.choice([rnd.randint(32, 0x2FF), rnd.randint(0x370, 0xD7FF), rnd.randint(0x1F300, 0x1F6FF)])) for _ in range(rnd.randint(0, 12)))


def test_transducer_equals_the_library(reference, monkeypatch):
    import regex

    monkeypatch.setattr(bpe, "MAX_STATES", 2000)  # states are dropped on the way
    monkeypatch.setattr(bpe, "MAX_PIECES", 500)
    transducer, pattern = bpe.BpeTransducer(bpe.load_ranks(PATH)), regex.compile(P.PATTERN)
    for text in samples():
        assert transducer.encode(pattern.findall(text)) == reference.encode_ordinary(text), repr(text)


def test_decoder_takes_any_cut():
    rnd = random.Random(2)
    for text in samples(300, 5):
        data, machine, out, at = text.encode(), bpe.Utf8Decoder(), "", 0
        while at < len(data):
            step = rnd.randint(1, 4)
            out += machine.feed(data[at : at + step])
            at += step
        machine.close()
        assert out == text
    for bad in (b"\xff", b"\xc0\x80", b"\xed\xa0\x80", b"a\x80"):
        with pytest.raises(ValueError):
            machine = bpe.Utf8Decoder()
            machine.feed(bad)
            machine.close()
    machine = bpe.Utf8Decoder()
    machine.feed("é".encode()[:1])
    with pytest.raises(ValueError):
        machine.close()


def test_round_trip_rows(spark, reference):
    texts = [None, "", "a" * 50_000, "hello world é" * 2000, *samples(40, 9)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in bpe.bpe_roundtrip(df, PATH, P.PATTERN).collect():
        text = texts[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.bpe_decode(bpe.bpe_encode(df, PATH, P.PATTERN), PATH)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.bpe_roundtrip(df.where("false"), PATH, P.PATTERN).count() == 0


def test_counts_equal_the_library(spark, monkeypatch):
    path = P.path("word_bpe_49k.json")
    tokenizer = token_counts._tokenizer(path)

    def encode(text):
        e = tokenizer.encode(text, add_special_tokens=False)
        return e.ids, e.offsets

    monkeypatch.setattr(token_counts, "PIECES", 50)
    pieces = token_counts.PieceCounts(tokenizer)
    for text in samples(600, 3):
        assert token_counts.spliced_ids(text, encode, 25, 6) == encode(text)[0], repr(text)
        assert pieces.of([text, " " + text, text]) == [len(encode(t)[0]) for t in (text, " " + text, text)], repr(text)
    texts = [None, "", "word " * 9000, "<|endoftext|>" * 5, "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts.token_counts(df, path, chunk=1000).collect():
        text = texts[r["doc_id"]] or ""
        n = len(encode(text)[0])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
    assert token_counts.token_counts(df.where("false"), path).count() == 0


@pytest.mark.parametrize("kept", [["\n"], ["\n", "\t"], []])
def test_white_space_that_is_a_token_counts_in_short_and_long_texts(spark, tmp_path, kept):
    """Tokenizers that take blanks away and keep other white space: no size of a text changes what counts."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    vocabulary = {w: i for i, w in enumerate(["?", "a", "b", "\n", "\t"])}
    tokenizer = Tokenizer(models.WordLevel(vocabulary, unk_token="?"))
    gone = "".join({" ", "\n", "\t"} - set(kept))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(f"[{gone}]"), "removed"), *(pre_tokenizers.Split(w, "isolated") for w in kept)])
    tokenizer.save(path := f"{tmp_path}/t.json")
    texts = ["a\nb a", "a b\n", "\n", "a\t\nb", " \n ", "a\nb \t a " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for chunk in (token_counts.CHUNK, 64):
        assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path, chunk=chunk).collect()} == want
    assert token_counts.spaces(tokenizer) == ([" ", "\n"] if "\n" not in kept else [" "])
