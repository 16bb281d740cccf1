"""The pipeline's stages against a brute-force run over the same documents."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_decontaminate, test_near_dedup
from tests.llm.helpers import lower

FOLDER = "/root/testdata/sf0.001"


def test_equal_to_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = {i: t for i, t in docs.items() if any(c.isalpha() for c in t or "")}
    last = {}
    for i in sorted(left):
        last[lower(left[i])] = i
    left = {i: left[i] for i in last.values()}
    left = {i: left[i] for i, _, _, kept in test_near_dedup.brute(list(left.items()), 5) if kept}
    gone = {d for d, *_ in test_decontaminate.brute(list(left.items()), bench)}
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: theirs.encode(t, add_special_tokens=False).ids for i, t in left.items() if i not in gone}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, FOLDER).collect()} == want
    assert 0 < len(want) < len(docs)
