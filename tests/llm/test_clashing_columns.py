"""Pipeline stages keep all columns, also those named like the stages' own."""

import random

import pytest
from pyspark.sql import functions as F

from outletlens.llm import decontamination, exact_dedup, near_dedup, quality

from .helpers import sentence

#: Names that the stages use, or once used, themselves.
OWN = ["_sha", "_gone", "_gone_sha", "_again", "_again_sha", "__gone", "__hits", "__items", "__n_words", "__n_hit", "__score", "score", "f1", "f2", "id", "component",
       "component_id", "text_hash", "keys", "tokens", "n_shingles", "kept", "keep_id", "size", "_found", "_", "__", "c0", "c1", "label", "quality", "a.b"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    texts = [sentence(rng, 40) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", None]
    docs = spark.createDataFrame([(i, t, f"extra {i}") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, " ".join(texts[3].split()[:20]))], "item_id bigint, text string")
    return docs, labels, benchmark


@pytest.mark.parametrize("stage", ["quality", "exact", "near", "decontaminate"])
def test_stage_keeps_clashing_columns(tables, stage):
    docs, labels, benchmark = tables
    run = {"quality": lambda d: quality.good(d, labels), "exact": exact_dedup.kept_rows, "near": near_dedup.one_each,
           "decontaminate": lambda d: decontamination.clean(d, benchmark)}[stage]
    plain = sorted(r.doc_id for r in run(docs).collect())
    clash = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("lang")).alias(c) for c in OWN])
    out = run(clash)
    assert out.columns == clash.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == plain and plain
    assert all(r[c] == f"{c} extra {r.doc_id}" for r in rows for c in OWN)
