import hashlib

import numpy as np
import public_tokenizers
import pytest
from test_tokens import ODD
from tokenizers import Tokenizer

from millrace.llm import queries, wordbpe
from millrace.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"
QUOTED = [END, f"a {END} b", f"{END}{END}", f" {END}  x ", f"a{END}b  {END}\n", "<|endoftext|", f"<{END}>", f"don{END}'t", f"{END} " * 500, "<|endof", "text|>", "w 1a 2b  c  d", "é è", "a— b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("s", [wordbpe.Settings(), wordbpe.Settings(block_bytes=3000, step_bytes=200)])
def test_ids_and_texts_match_the_library(spark, library, s):
    texts = ODD + QUOTED
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "ids long, text string, word int").repartition(3)
    found = {r[0]: r for r in wordbpe.encode(df, "ids", "text", PATH, s=s).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert found[i][1] == ids and found[i][2] == library.decode(ids, skip_special_tokens=False)


def test_words_join_to_their_texts_and_no_token_spans_a_cut(library):
    import pyarrow as pa

    texts = [t for t in ODD + QUOTED if t]
    words, counts = wordbpe.words_of(pa.array(texts), wordbpe.quoted_tokens(PATH))
    words, low = words.to_pylist(), 0
    for t, n in zip(texts, counts, strict=True):
        own, low = words[low : low + n], low + n
        assert "".join(own) == t
        assert sum((library.encode(w, add_special_tokens=False).ids for w in own), []) == library.encode(t, add_special_tokens=False).ids
    assert wordbpe.words_of(pa.array([None, "a b", ""]).slice(1))[0].to_pylist() == ["a", " b"]


def test_repeated_and_null_keys_and_empty_tables(spark, library):
    df = spark.createDataFrame([(1, "ab c"), (1, "ab c"), (1, "d"), (None, None), (None, "")], "doc_id long, text string")
    rows = wordbpe.encode(df, "doc_id", "text", PATH, digests=True).collect()
    none = hashlib.sha256(b"").hexdigest()
    wanted = [(k, len(ids := library.encode(t, add_special_tokens=False).ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, t in [(1, "ab c"), (1, "ab c"), (1, "d")]]
    assert sorted(map(tuple, rows), key=str) == sorted([*wanted, (None, 0, none, none), (None, 0, none, none)], key=str)
    assert wordbpe.encode(df.where("false"), "doc_id", "text", PATH).collect() == []
    assert sorted(r[2] for r in wordbpe.encode(df.where("doc_id IS NULL"), "doc_id", "text", PATH).collect()) == ["", ""]


def test_long_texts_without_a_cut(spark, library):
    texts = ["日本語の文章" * 20_000, "x" * 100_000, "1 " * 50_000]
    found = dict(r[:2] for r in wordbpe.encode(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", PATH).collect())
    assert all(found[i] == library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


def test_decoding_joins_ids_with_pieces(spark, library):
    lists = [library.encode(t or "", add_special_tokens=False).ids for t in ODD[:60] + QUOTED] + [[220, 50256, 3], [243], [151, 243, 109]]
    df = spark.createDataFrame([(i % 7, x) for i, x in enumerate(lists)] + [(9, None), (9, [10**7])], "k int, ids array<int>")
    found = sorted(((r[0], r[1]) for r in wordbpe.decode(df, "k", "ids", PATH).collect()), key=str)
    assert found == sorted([(i % 7, library.decode(x, skip_special_tokens=False)) for i, x in enumerate(lists)] + [(9, None), (9, "")], key=str)


def test_query_covers_its_table(spark, data, library):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, data, "documents").collect()}
    rows = queries.op11_word_bpe(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
