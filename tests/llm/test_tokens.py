from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from postloom.llm import sentence_pieces, token_files
from tests.llm import cases


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_hold_all_ids_in_order(spark, tmp_path, encoding):
    docs, folder = cases.documents(spark).repartition(5), str(tmp_path / "tokens")
    token_files.write_tokens(docs, folder, encoding=encoding)
    got = token_files.checksums(token_files.read_tokens(spark, folder)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    # Rows without an id come first and have equal ids or differ in text only; compare them as a set.
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    named = [w for w in want if w[0] is not None]
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == named
    assert sorted(r.n_tokens for r in got if r.doc_id is None) == sorted(w[2] for w in want if w[0] is None)
    assert sum(r.n_tokens for r in got) == start


def test_encodings_and_page_index(spark, tmp_path):
    for encoding, mark in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        folder = str(tmp_path / encoding)
        token_files.write_tokens(cases.documents(spark), folder, encoding=encoding)
        files = [f for f in glob.glob(folder + "/*.parquet") if pq.ParquetFile(f).metadata.num_rows]
        for file in files:
            group = pq.ParquetFile(file).metadata.row_group(0)
            columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert mark in ids.encodings and ids.has_offset_index
            assert "DELTA_BINARY_PACKED" in columns["before"].encodings and columns["doc_id"].has_column_index
    with pytest.raises(ValueError):
        token_files.write_tokens(cases.documents(spark), str(tmp_path / "no"), encoding="plain")


def test_metadata_is_read_alone(spark, tmp_path):
    token_files.write_tokens(cases.documents(spark), str(tmp_path / "t"))
    some = spark.read.parquet(str(tmp_path / "t")).where("doc_id = 8").select("before", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "EqualTo(doc_id,8)" in plan


def test_pieces_equal_the_library(spark, pieces):
    docs = cases.documents(spark)
    both = sentence_pieces.with_text(sentence_pieces.with_ids(docs))
    assert both.columns == [*docs.columns, "piece_ids", "decoded"]
    for r in both.collect():
        assert list(r.piece_ids) == pieces.encode(r.text or "") and r.decoded == (r.text or "")
    once = sentence_pieces.with_ids(docs, decoded="decoded")
    assert sorted(map(str, once.collect())) == sorted(map(str, both.collect()))
    assert all(r.same_text for r in sentence_pieces.summaries(docs).collect())


def test_names_in_use_are_left_alone(spark):
    docs = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, piece_ids int")
    assert sentence_pieces.with_ids(docs).columns == ["doc_id", "text", "piece_ids", "piece_ids_"]


def test_random_texts_equal_the_library(pieces):
    encoder, r = sentence_pieces.Encoder(sentence_pieces.Vocabulary.load()), random.Random(3)
    known = [pieces.id_to_piece(i).replace("▁", " ") for i in range(260, 32000)]
    texts = ["".join(r.choice(known) for _ in range(r.randint(1, 40))) for _ in range(400)]
    texts += ["".join(r.choice("aeinrst \n\t") for _ in range(r.randint(1, 300))) for _ in range(200)]
    texts += [" " * n for n in range(1, 70)] + ["a" * 5000, "ab" * 400, "日本語" * 60, "▁x", "<s>", "\x00\x01", "é" * 300]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == pieces.encode(text), text
        assert encoder.decode(ids) == pieces.decode(ids.tolist())


def test_long_words_are_relaxed_like_short_ones(monkeypatch, pieces):
    texts = ["internationalization", "aaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 100, "thethethethethethe"]
    for limit in (1, 1000):
        monkeypatch.setattr(sentence_pieces, "LONG", limit)
        got = sentence_pieces.Encoder(sentence_pieces.Vocabulary.load()).encode(texts)
        assert [g.tolist() for g in got] == [pieces.encode(t) for t in texts]


def test_empty_tables(spark, tmp_path):
    none = cases.empty(cases.documents(spark))
    token_files.write_tokens(none, str(tmp_path / "none"))
    assert token_files.read_tokens(spark, str(tmp_path / "none")).collect() == []
    assert sentence_pieces.with_ids(none).collect() == [] and sentence_pieces.summaries(none).collect() == []
