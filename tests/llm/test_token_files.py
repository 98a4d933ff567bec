import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from outletlens.llm import packing, token_counts
from outletlens.llm.common import table
from outletlens.llm.tokens import LONG_RUN, Encoder, byte_bpe_path

from ..conftest import SF0001
from .helpers import docs, rows

ODD = [" a  b\t c \n d", "", " ", "  ", " \n\n hi's we'll    z  q  ", "日本語 テスト 123abc 4 5  ", "a\n b", "\x85 x \x1c y", "it's 'tis 'S don't", "x" * (LONG_RUN + 5), "\n" * (LONG_RUN + 5), "a <|endoftext|> b", "😀 é́ \u00a0 x"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(byte_bpe_path())


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_tokenizers_ids(spark, tokenizer):
    encode = Encoder(byte_bpe_path())
    assert encode.fast is not None
    texts = [r["text"] or "" for r in table(spark, SF0001, "documents").collect()] + ODD
    assert all(np.frombuffer(encode(t), encode.dtype).tolist() == plain(tokenizer, t) for t in texts)
    ordinary = Encoder(byte_bpe_path(), special_as_text=True)
    assert token_counts.END_ID not in np.frombuffer(ordinary("a <|endoftext|> b"), ordinary.dtype)


@pytest.mark.parametrize("window", [7, 2048])
def test_packing_round_trip(spark, tokenizer, window):
    texts = [*ODD, None, "word " * 900]
    df = docs(spark, texts, 4).withColumns({"ids": F.lit("clash"), "part": F.lit(1)})
    got = packing.pack(df, byte_bpe_path(), window).collect()
    want = {i: [*plain(tokenizer, t), packing.END_ID] for i, t in enumerate(texts)}
    pieces, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and len(ids) == r["length"] > 0 and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids.tolist()))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {d: [x for _, ids in sorted(p) for x in ids] for d, p in pieces.items()} == want
    assert all([s for s, _ in sorted(p)] == np.cumsum([0, *(len(x) for _, x in sorted(p)[:-1])]).tolist() for p in pieces.values())
    total = sum(map(len, want.values()))
    assert sorted(sequences) == list(range(-(-total // window)))
    for k, parts in sequences.items():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()
        assert sum(n for _, n in parts) == (window if k < len(sequences) - 1 else total - window * k)


def test_packing_of_nothing_and_repeated_rows(spark):
    assert packing.pack(docs(spark, []), byte_bpe_path()).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id bigint, text string")
    assert packing.pack(twice, byte_bpe_path()).agg(F.sum("length")).first()[0] == 9


@pytest.mark.parametrize("block", [4, 64, 1 << 16])
def test_counts_are_read_back_from_the_token_files(spark, tokenizer, block, monkeypatch):
    texts = [*ODD[:-3], None, "", "", "word " * 500, "x"]
    monkeypatch.setattr(token_counts, "RUN", 3)
    files = token_counts.token_files(docs(spark, texts, 3).withColumn("block", F.lit("clash")), byte_bpe_path(), block=block)
    out = token_counts.count_tokens(files, block=block)
    got = rows(out)
    assert {d: r["n_tokens"] for d, r in got.items()} == {i: len(plain(tokenizer, t)) for i, t in enumerate(texts)}
    assert all(r["closed"] for r in got.values())
    for file in {r["file"] for r in got.values()}:
        own = sorted((r["ordinal"], r["start"], r["n_tokens"]) for r in got.values() if r["file"] == file)
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1] for x in own] == np.cumsum([0, *(x[2] + 1 for x in own[:-1])]).tolist()


def test_plain_binary_files_open_tails_and_empty_documents(spark, tmp_path):
    end = token_counts.END_ID
    for name, ids in {"a": [1, 2, end, end, 3], "b": [end], "c": [4, 5, 6, 7, 8, 9, 10], "d": []}.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    out = token_counts.count_tokens(token_counts.flat_blocks(spark, str(tmp_path), block=2), block=2).collect()
    got = sorted((r["file"][-1], r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in out)
    assert got == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 1, False), ("b", 0, 0, 0, True), ("c", 0, 0, 7, False)]
    assert token_counts.count_tokens(token_counts.token_files(docs(spark, []), byte_bpe_path())).count() == 0


@pytest.mark.parametrize("width,block,size", [(2, 4, 8), (2, 4, 24), (4, 8, 1)])
def test_files_are_read_in_byte_ranges(spark, tmp_path, width, block, size):
    rng, end = np.random.default_rng(width + size), token_counts.END_ID
    want = []
    for name in ("one file", "two%20", "three"):
        ids = np.where(rng.random(rng.integers(200, 400)) < 0.08, end, rng.integers(0, 1000, 1)[0])
        (tmp_path / name).write_bytes(ids.astype(f"<u{width}").tobytes())
        ends = np.flatnonzero(ids == end).tolist()
        starts = [0, *(e + 1 for e in ends)]
        want += [(name, k, s, e - s, True) for k, (s, e) in enumerate(zip(starts, ends))]
        want += [(name, len(ends), starts[-1], len(ids) - starts[-1], False)] * (starts[-1] < len(ids))
    blocks = token_counts.flat_blocks(spark, str(tmp_path), width, block, size)
    most = max(1, size // (block * width)) * block * width
    assert "content" not in blocks._jdf.queryExecution().toString().split("Physical Plan")[1]
    dealt = blocks.select(F.spark_partition_id().alias("task"), "file", "block").collect()
    # Three files are listed by up to three tasks, each of which deals its ranges out in turn.
    assert Counter(r["task"] for r in dealt).most_common(1)[0][1] <= 3 * most // (block * width) < len(dealt)
    got = [(r["file"].rsplit("/", 1)[1], r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in token_counts.count_tokens(blocks, block=block).collect()]
    assert sorted(got) == sorted(want)


def test_a_file_that_ends_inside_an_id_is_an_error(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number of ids"):
        token_counts.flat_blocks(spark, str(tmp_path)).count()
