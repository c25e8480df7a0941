"""op4 and op5 against the libraries themselves."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from vellumspark.llm import bpe, token_counts
from vellumspark.llm.pretokens import fragments, pattern, read_ranks

TEXTS = [
    None, "", " ", "  ", "a", "a b", "a  b", " a\n b\t\tc ", "it's we're I'll 'tis '  's", "x<|endoftext|> y <|endoftext|><|endoftext|>", "été 你好, привет \U0001f600\U0001f600 é",
    "\x00\x01 \x1c a b 　c", "123 4567,89 !!!??? ...", "word " * 3000, "z" * 5000, "tab\tsep \r\nline", "same text", "same text", " <|endoftext|> ", "  a \x85 b",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "x")], "doc_id long, text string, n_tokens string").repartition(3)


def test_fragments_keep_pre_tokens():
    find = pattern().findall
    for t in TEXTS:
        if t:
            first, *rest = fragments(t)
            assert find(t) == [w for f in [first, *(" " + x for x in rest)] for w in find(f)]


def test_encode_decode(spark, docs):
    ranks = read_ranks(spark, P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    for limit in (1, 200, 1 << 20):
        made = bpe.encode(docs, ranks, P.PATTERN, chunk_bytes=limit, buckets=5)
        back = bpe.decode(made.selectExpr("*", "ids AS kept"), ranks)
        rows = sorted(((r.doc_id, r.n_tokens, bytes(r.kept), bytes(r.decoded)) for r in back.collect()), key=repr)
        want = sorted(((i, len(x), np.array(x, "<u4").tobytes(), (t or "").encode()) for i, t in [(r.doc_id, r.text) for r in docs.collect()] for x in [enc.encode_ordinary(t or "")]), key=repr)
        assert rows == want
    assert bpe.encode(docs.limit(0), ranks, P.PATTERN).collect() == []


def test_counts(docs):
    config = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    tok = Tokenizer.from_str(config)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, config).collect()), key=repr)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()), key=repr)
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), config).collect() == []
    with pytest.raises(ValueError):
        token_counts.checked(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_whole_tokens_are_proved():
    config = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    tok, whole = Tokenizer.from_str(config), token_counts.whole_tokens(config)
    assert len(whole) > 40_000
    assert all(len(e.ids) == 1 for e in tok.encode_batch(sorted(whole), add_special_tokens=False))


def test_queries_match_libraries(spark):
    from vellumspark.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(read_ranks(spark, P.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op4_byte_bpe(spark, sf).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((texts[r.doc_id] or "").encode()))
    for r in queries.op5_token_counts(spark, sf).collect():
        assert r.n_tokens == len(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 512)
