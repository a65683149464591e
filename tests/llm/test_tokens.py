import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import Tokenizer

from millrace.llm import packing, pieces, queries
from millrace.llm.common import table

RANDOM = random.Random(4)
ODD = ["", None, " ", "  ", "a  b", "\n\n x", " a ", "▁", "▁▁a b▁", "é  b\t \n", "日本語 テキスト 😀 x", "<s> </s> <unk>", "a\0b", "trail  ", "x 　y", "'ll don't 's '", "12 345  6", "x" * 30_000, "word " * 20_000]
ODD += ["".join(RANDOM.choice(" \n\tab▁é日😀<0x>'1., \x1c") for _ in range(RANDOM.randint(1, 40))) for _ in range(400)]


@pytest.fixture(scope="module")
def texts(spark, data):
    return [r["text"] for r in table(spark, data, "documents").limit(60).collect()]


def test_pieces_match_the_library_and_span_every_byte(texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Codec(path)
    for text, (ids, starts, ends, decoded) in zip(ODD + texts, own.encode(ODD + texts), strict=True):
        wanted = library.encode(text or "", add_bos=True, add_eos=True)
        assert ids.tolist() == wanted
        assert decoded.decode() == library.decode(wanted)
        assert int((ends - starts).sum()) == len((text or "").encode())
        assert (starts[1:] == ends[:-1]).all()


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("remove", [True, False])
def test_normalisation_through_a_character_map(prefix, remove, texts):
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=prefix, remove_extra_whitespaces=remove, escape_whitespaces=True)
    spec = proto.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    chars = pieces.CharsMap(spec.precompiled_charsmap)
    for text in [x for x in ODD if x and len(x) < 1000] + ["ﬁ ℌello ½ ＡＢＣ　ﾊﾝｶｸ é ①"] + texts[:10]:
        normal, begin, end = pieces.aligned(text, chars, pieces.Rules(prefix, remove))
        assert normal == library.normalize(text)
        assert len(begin) == len(end) == len(normal.encode())
        assert (np.diff(begin) >= 0).all() and (begin <= end).all()


def test_ligature_projects_to_its_source_bytes():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    chars = pieces.CharsMap(proto.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec.precompiled_charsmap)
    normal, begin, end = pieces.aligned("aﬁb", chars, pieces.Rules(False, False))
    assert normal == "afib" and begin.tolist() == [0, 1, 1, 4] and end.tolist() == [1, 4, 4, 5]


def test_encode_returns_pieces_of_whole_tables(spark):
    df = spark.createDataFrame([(1, "ab c", "x"), (1, "ab c", "y"), (None, None, "z")], "ids long, text string, decoded string")
    out = pieces.encode(df, "ids", "text", public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(out) == 3 and out[0][1] == out[1][1] and out[2][1] == [1, 2] and out[2][4] == ""
    assert pieces.encode(df.where("false"), "ids", "text", public_tokenizers.path("piece_bpe_32k.model"), digests=True).collect() == []


def test_byte_ids_match_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.ByteBPE(path)
    for text in ODD + texts:
        assert np.frombuffer(own.ids(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_packing_covers_every_id_once_without_padding(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "length").repartition(3)
    p = packing.Packing(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(df, "length", "text", p, with_ids=True).toPandas()
    library = Tokenizer.from_file(p.tokenizer)
    wanted = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in rows)
    columns = list(out.columns)
    columns = ["key", "start", "length", *columns[3:]]
    out.columns = columns
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c and len(i) == n for i, c, n in zip(out.ids, out.ids_crc32, out.length))
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        n = s.length.sum()
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and n <= 1024 and n & (n - 1) == 0
    got = [tuple(x for ids in g.sort_values("start").ids for x in ids) for k, g in out.groupby("key") if k != 0]
    assert sorted(got) == sorted(w for w, (k, _) in zip([tuple(library.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in rows], rows) if k not in (0, None))
    assert out.length.sum() == sum(map(len, wanted))
    assert packing.pack(df.where("false"), "length", "text", p).collect() == []


def test_largest_remainders_go_to_the_cheapest_sequences():
    p = packing.Packing("", size=8)
    placed = packing.assign([5, 5, 3, 3], p)
    assert sorted(x[2] for x in placed) == [3, 3, 5, 5]  # nothing is cut: 5 + 3 twice
    assert {x[3] for x in placed if x[2] == 5} == {0, 1}
    assert packing.assign([], p) == []


def test_queries_cover_their_tables(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, data, "documents").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = queries.op4_sentencepiece(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = queries.op3_cost_packing(spark, data).toPandas().sort_values(["doc_id", "start"])
    assert set(found.doc_id) == set(docs)
    for doc, pieces_of in found.groupby("doc_id"):
        ids = np.array(library.encode(docs[doc], add_special_tokens=False).ids + [0], "<u4")
        assert pieces_of.start.tolist() == [0, *pieces_of.length.cumsum().tolist()[:-1]] and set(pieces_of.doc_tokens) == {len(ids)} == {pieces_of.length.sum()}
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(pieces_of.start, pieces_of.length)] == pieces_of.ids_crc32.tolist()
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024


def test_caches_hold_short_chunks_only():
    texts = [("日本語の文章" * 170_000)[i:] for i in range(4)] + ["x" * 1_000_000 + str(i) for i in range(4)]
    bpe, codec = packing.ByteBPE(public_tokenizers.path("byte_bpe_50k.json")), pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    short = [t[:2000] for t in texts]
    for t in short + ["some short words " + t for t in short]:
        bpe.ids(t)
    list(codec.encode([*short, "some short words"]))
    assert max(map(len, bpe.seen)) <= packing.LONGEST and max(map(len, codec.seen)) <= pieces.LONGEST and bpe.seen and codec.seen
    assert len(bpe.ids(texts[4])) > 0 and sum(len(k) for k in bpe.seen) < 1000


def test_quoted_added_tokens_match_the_library_by_default(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.ByteBPE(path)
    end = "<|endoftext|>"
    quoted = [end, f"a {end} b", f"{end}{end}", f" {end}  x ", f"a{end}b  {end}\n", "<|endoftext|", f"<{end}>", f"don{end}'t", f"{end} " * 5000]
    quoted += [f"{a or ''}{end}{b or ''}" for a, b in zip(ODD, reversed(ODD))]
    for text in quoted + ODD + texts:
        assert np.frombuffer(own.ids(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids
