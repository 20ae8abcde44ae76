import public_tokenizers as P
import tiktoken

import corpus_pipeline
from litsift.llm import bpe, pipeline

from .rows import documents
from .test_decontam import brute as leaks
from .test_setsketch import brute as groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = "Under the old bridge token = \"abcdef123456\" was left by somebody in a great hurry on a wet night."
    docs = docs.union(spark.createDataFrame([(10**6, planted, "en", "s", len(planted))], docs.schema))
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    first = {int(d) for d, _, c in groups(rows, 5, 80, 100) if int(d) == c}
    kept = pipeline.deduplicate(spark, kept, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == first
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    clean = {d for (d, _), (_, hit, _) in zip(rows, leaks([t for _, t in rows], items)) if not hit}
    kept = pipeline.decontaminate(spark, kept, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean < {d for d, _ in rows}
    before = {r.doc_id: r.text for r in kept.collect()}
    kept = pipeline.redact(spark, kept, SF)
    after = kept.collect()
    assert kept.columns == docs.columns and {r.doc_id for r in after} == clean
    assert all(r.n_chars == len(r.text) for r in after)
    assert "[SECRET]\" was left" in {r.doc_id: r.text for r in after}[10**6]
    assert all(r.text == before[r.doc_id] for r in after if "[SECRET]" not in r.text)
    vocabulary = bpe.Vocabulary(bpe.read_vocabulary(P.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in after if r.doc_id != 10**6}
    done = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert done == {d: library.encode_ordinary(t) for d, t in texts.items()}


def test_awkward_rows(spark):
    for docs in (documents(spark, "bits long, found string"), documents(spark, "bits long, found string").limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "tokens":
                assert out.columns == docs.columns
            if not docs.limit(1).count():
                assert out.count() == 0
            else:
                assert out.filter("doc_id is null").count() == 1
