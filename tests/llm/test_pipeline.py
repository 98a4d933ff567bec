import corpus_pipeline as P
from outletlens.llm import packing
from outletlens.llm.common import table
from outletlens.llm.quality import scored

from ..conftest import SF0001
from .helpers import rows
from .test_decontamination import plain as contaminated
from .test_exact_dedup import plain as copies
from .test_near_dedup import plain as near


def test_stages_follow_their_operators_and_brute_force(spark):
    docs = table(spark, SF0001, "documents")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    good = stages["quality_classifier"](spark, docs, SF0001)
    score = rows(scored(docs.select("doc_id", "text"), table(spark, SF0001, "labels")))
    want = {k for k, r in score.items() if r["score"] >= 0.7}
    assert set(rows(good)) == want and len(want) < len(score) and good.columns == docs.columns

    text = {k: r["text"] for k, r in rows(good).items()}
    kept = sorted(d for d, _, _, k, _ in copies(list(text.items())) if k)
    exact = stages["exact_dedup"](spark, good, SF0001)
    assert sorted(rows(exact)) == kept and exact.columns == docs.columns

    unique = [kept[i] for i, _, _, k in near([text[d] for d in kept]) if k]
    one = stages["minhash_near_dedup"](spark, exact, SF0001)
    assert sorted(rows(one)) == unique and one.columns == docs.columns

    items = [tuple(r) for r in table(spark, SF0001, "benchmark").select("item_id", "text").collect()]
    clean = [unique[r[0]] for r in contaminated([text[d] for d in unique], items) if not r[5]]
    left = stages["benchmark_decontamination"](spark, one, SF0001)
    assert sorted(rows(left)) == clean and left.columns == docs.columns and 0 < len(clean) < len(unique)

    pieces = P.run(spark, SF0001).collect()
    assert {r["doc_id"] for r in pieces} == set(clean)
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())
    assert all(r["offset"] + r["length"] <= packing.WINDOW for r in pieces)


def test_empty_documents(spark):
    docs = table(spark, SF0001, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF0001)
    assert docs.count() == 0
