import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from outletlens.llm import words as W
from outletlens.llm.common import slices, utf8_column

from .helpers import alnum_words, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aBZ09 \t\n\x0b.,é漢!-")), max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_spans_are_the_regular_expressions_words(texts):
    buf, offs = utf8_column(pa.array(texts, pa.string()))
    for kind, plain in ((W.NOT_SPACE, words), (W.ALNUM, alnum_words)):
        start, end, doc = W.spans(buf, offs, kind)
        got = [[] for _ in texts]
        for a, b, d in zip(start, end, doc):
            got[d].append(buf[a:b].tobytes().decode().translate(str.maketrans("BZ", "bz")))
        assert got == [plain(t) for t in texts]


def test_hashes_follow_lowered_bytes_across_segments():
    rng = random.Random(1)
    parts = ["".join(rng.choice("abcXYZé") for _ in range(rng.randrange(1, 9))) for _ in range(300)] * 2
    long = "x" * (W._SEGMENT + 10)
    text = " ".join([*parts, long, *parts, long.upper()])
    buf, offs = utf8_column(pa.array([text]))
    start, end, _ = W.spans(buf, offs, W.NOT_SPACE)
    h = W.hashes(buf, start, end)
    by_word = {}
    for word, x in zip(text.split(" "), h.tolist()):
        assert by_word.setdefault(word.lower(), x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_slices_keep_all_rows_and_nulls():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * 50, "c"])], ["text"])
    got = [r for part in slices(batch.slice(1), "text", 20) for r in part.column("text").to_pylist()]
    assert got == [None, "", "b" * 50, "c"]
    assert utf8_column(pa.array([], pa.string()))[1].tolist() == [0]
    assert np.array_equal(utf8_column(pa.array([None, "é"]))[1], [0, 0, 2])
