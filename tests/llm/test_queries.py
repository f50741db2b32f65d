"""The registered queries of the package and the pipeline on the smallest tables."""

import pytest

import corpus_pipeline
from tests.compare import compare, duck
from tests.llm.test_text_filters import fingerprint, judged
from tidegate.llm.oracles import ORACLES
from tidegate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert compare(spark, duck(SF), name, SF, QUERIES, ORACLES) is None


def test_near_duplicates_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: fingerprint(r.text) for r in rows}
    label = {d: d for d in prints}
    while True:
        new = {d: min(label[e] for e in prints if (prints[d] ^ prints[e]).bit_count() <= 4) for d in prints}
        if new == label:
            break
        label = new
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", label[d]) for d in prints}


def test_a_large_copy_group_leaves_one_whole_document(spark):
    own = lambda i, n=3: [" ".join(f"w{i}x{j}y{k}" for k in range(9)) for j in range(n)]
    pages = [["menu", *own(i)] for i in range(60)] + [own(i) for i in range(60, 300)]
    copied, near = "\n".join(own(1000)), own(2000, 60)
    texts = ["\n".join(p) for p in pages] + [copied] * 150 + ["\n".join([*near[:-1], f"{near[-1]} n{i}"]) for i in range(90)]
    texts += ["menu"] * 30 + [None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert left == {i: "\n".join(own(i)) for i in range(300)} | {300: copied, 450: texts[450], 540: "menu", 570: None}


def test_stages_filter_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == DOCUMENT_COLUMNS, name
        assert docs.exceptAll(before).count() == 0 or name == "line_dedup"
        n.append(docs.count())
    assert n[1] >= n[0] * 0.95 and n[1] == n[2] >= n[3] >= n[4] > 0
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(bad for *_, bad in judged([tuple(r) for r in docs.select("doc_id", "text").collect()], items))
    assert corpus_pipeline.run(spark, SF).count() == n[4]
