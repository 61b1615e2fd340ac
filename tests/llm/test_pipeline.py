"""The pipeline against plain versions of its stages, each on its own input."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from satchel.llm import mixing, simhash, toxicity
from satchel.llm.common import stored

from .test_operators import WORD, plain_dedup, plain_fingerprint, plain_groups, prose

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, inputs, outputs = [], [], []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, DATA))
        names.append(name)
        inputs.append(docs.toPandas())
        outputs.append(out.toPandas())
        docs = out
    columns = list(inputs[0].columns)
    assert all(list(o.columns) == columns for o in outputs[:-1])
    # toxicity
    model = toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    keep = [i for i, t in zip(inputs[0].doc_id, inputs[0].text, strict=True) if model.probability(model.passages((t or "").encode())[1]) < 0.5]
    assert sorted(outputs[0].doc_id) == sorted(keep)
    # near-duplicates
    label = plain_groups([(i, plain_fingerprint(t)) for i, t in zip(inputs[1].doc_id, inputs[1].text, strict=True)])
    assert sorted(outputs[1].doc_id) == sorted(set(label.values()))
    # substrings
    want = {i: n - k for i, n, k, _ in plain_dedup(list(zip(inputs[2].doc_id, inputs[2].text, strict=True)))}
    assert {i: len(WORD.findall(t)) for i, t in zip(outputs[2].doc_id, outputs[2].text, strict=True)} == want
    # mixing
    plan = mixing.plan(spark.createDataFrame(inputs[3])).toPandas()
    copies = {r.doc_id: r.passes + int(r.part > 0 and 2 * r.part >= r.size) for r in plan.itertuples()}
    assert outputs[3].doc_id.value_counts().to_dict() == {i: n for i, n in copies.items() if n}
    # token ids
    assert outputs[4].exact.all() and len(outputs[4]) == len(inputs[4])
    run = corpus_pipeline.run(spark, DATA).toPandas()
    assert sorted(run.ids) == sorted(outputs[4].ids)


def test_awkward_rows_pass_all_stages(spark):
    r = random.Random(12)
    long, passage = prose(r, 8000), prose(r, 80)
    rows = [(i, prose(r, r.randint(1, 60)), "en", f"s{i % 2}", None) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n ", "en", None, 0), (None, "no id here", "en", "s1", 0), (None, None, None, None, None)]
    rows += [(103, long, "en", "s0", 0), (104, long, "en", "s1", 0), (0, rows[0][1], "en", "s0", None), (105, passage + " tail", "en", "s0", 0), (106, "head " + passage, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_id", "_bit", "_row", "toxic", "refs", "a.b", "block", "key", "size"):
        docs = docs.withColumn(c, F.lit(1))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, DATA))
        assert kept.schema.simpleString() == docs.schema.simpleString(), name
    # An empty table too.
    last = corpus_pipeline.STAGES[-1][1]
    out = last(spark, kept, DATA).toPandas()
    assert out.exact.all() and len(out) == kept.count() and len(out) > 30
    texts = [x.text for x in kept.where("doc_id in (103, 104)").collect()]
    assert set(texts) <= {long, ""} and long in texts
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stored(stage(spark, none, DATA))
    assert last(spark, none, DATA).count() == 0


def test_registry(spark):
    from satchel.llm import registry

    queries = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries) == list(range(1, 11))
    assert set(registry.oracle_sql()) < set(queries)
    assert simhash.BUDGET == 2
