import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from velumen.llm.packing import Memo, memo, pack

DOCS = "doc_id long, text string, sequence_id string"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def verify(rows, docs, tokenizer, capacity=2048, segments=128):
    want = {i: brute(tokenizer, t) for i, t, *_ in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and len(pieces) <= segments
        assert at == capacity or at & (at - 1) == 0


@pytest.mark.parametrize("kw", [{}, {"capacity": 64, "max_segments": 3}, {"capacity": 100, "max_loss": 40}])
def test_pieces_cover_every_document_once(spark, tokenizer, kw):
    docs = [(1, "The quick, brown fox... it's 'll ÀÉ ñ", "x"), (2, None, "x"), (3, "", None), (None, "only words", "x"), (4, "a b \x1f c \t d́e İ ΑΣ ß ﬁ", "x"), (5, "<|endoftext|> don't </s> we've 12,345!!! 日本 𝒳", "x"), (6, "long " * 9000, "x")]
    rows = pack(spark.createDataFrame(docs, DOCS).repartition(2), **kw).collect()
    verify(rows, docs, tokenizer, kw.get("capacity", 2048), kw.get("max_segments", 128))


def test_loss_limit(spark):
    docs = spark.createDataFrame([(i, "w " * 30, 20) for i in range(9)], "doc_id long, text string, lf int").coalesce(1)
    seqs = defaultdict(int)
    for r in pack(docs, loss_from_col="lf", capacity=128, max_loss=16).collect():
        seqs[r.sequence_id] += max(0, r.start + r.length - max(r.start, 20))
    assert max(seqs.values()) <= 16


def test_empty_and_repeated(spark, tokenizer):
    assert pack(spark.createDataFrame([], DOCS)).collect() == []
    rows = pack(spark.createDataFrame([(1, "same", "x")] * 3, DOCS)).collect()
    assert len(rows) == 3 and {r.length for r in rows} == {len(brute(tokenizer, "same"))}


def test_whole_table(spark, sf, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    from velumen.llm.registry import QUERIES

    rows = QUERIES["op9_vector_packing"](spark, sf).collect()
    verify(rows, docs, tokenizer)


def test_words_alone_equal_the_whole_text(sf, tokenizer):
    words = memo(None)
    text = "Don't STOP!!!'s #$% x_y [a]b{c} é.è, Ñandú?! ''' 's's   z"
    assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == brute(tokenizer, text)[:-1]


def test_tokenizers_that_keep_white_space_are_refused(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    odd = Tokenizer(models.WordLevel({"a": 0, " ": 1, "?": 2}, unk_token="?"))
    odd.pre_tokenizer = pre_tokenizers.Split(" ", "isolated")
    odd.save(f"{tmp_path}/odd.json")
    with pytest.raises(ValueError):
        Memo(f"{tmp_path}/odd.json")


def test_conversations_in_which_only_the_last_answer_bears_loss(spark, sf, tokenizer):
    """The whole table, under a limit of loss-bearing tokens that stops sequences before the limit of tokens does."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    docs = []
    for i, part in turns.groupby("conv_id"):
        texts = [t or "" for t in part["text"]]
        docs.append((int(i), " ".join(texts), len(brute(tokenizer, " ".join(texts[:-1]))) - 1))
    limit = {"capacity": 256, "max_loss": 48, "max_segments": 8}
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string, lf long").repartition(2), loss_from_col="lf", **limit).collect()
    verify(rows, docs, tokenizer, 256, 8)
    from_, loss, used = {i: n for i, _, n in docs}, defaultdict(int), defaultdict(int)
    for r in rows:
        loss[r.sequence_id] += max(0, r.start + r.length - max(r.start, from_[r.doc_id]))
        used[r.sequence_id] += r.length
    assert max(loss.values()) <= 48 and sum(n >= 40 and used[s] < 256 for s, n in loss.items()) > 0
    free = pack(spark.createDataFrame(docs, "doc_id long, text string, lf long").repartition(2), loss_from_col="lf", capacity=256, max_segments=8).collect()
    assert len({r.sequence_id for r in free}) < len(used)
