import numpy as np

import corpus_pipeline
from scarp.llm import decontaminate, queries, simhash
from scarp.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = queries.table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        if name != names[-1]:
            assert out.columns == docs.columns
        before, after = docs.toPandas(), out.toPandas()
        if name == "quality_rules":
            kept = set(queries.op2_quality_rules(spark, SF).filter("kept").toPandas().doc_id)
            assert set(after.doc_id) == kept and len(after) == len(kept)
        elif name == "simhash_near_dedup":
            groups = simhash.near_duplicates(docs).toPandas()
            assert set(after.doc_id) == set(groups.component_id) and len(after) == groups.component_id.nunique()
        elif name == "benchmark_decontamination":
            found = decontaminate.contamination(docs, queries.table(spark, SF, "benchmark")).toPandas()
            assert sorted(after.doc_id) == sorted(found[~found.contaminated].doc_id)
        elif name == "source_mixing":
            n = after.doc_id.value_counts()
            assert n.max() <= 2 and set(n.index) <= set(before.doc_id)
        else:
            assert len(after) == len(before) and sorted(after.doc_id) == sorted(before.doc_id)
            ordered = after.sort_values("start")
            assert (np.cumsum(ordered.n_tokens) - ordered.n_tokens == ordered.start).all()
        docs = out


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
