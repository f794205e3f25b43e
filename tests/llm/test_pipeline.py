"""The pipeline and the near-duplicate query against plain versions on a small corpus."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_copies import slow_copies
from test_text_operators import ITEM, slow_fingerprint, slow_line_dedup

import corpus_pipeline
from logloom.llm import nbsvm, simhash, toxicity
from logloom.llm.common import table


def corpus():
    rng = random.Random(13)
    syllables = "ba ke li mo nu ra se ti vo zu fa ge".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    shared = [sentence(12) for _ in range(3)]
    docs = []
    for k in range(160):
        lines = [sentence(rng.randrange(6, 16)) for _ in range(rng.randrange(2, 8))]
        if k % 4 == 0:
            lines.insert(1, shared[k % 3])
        if k % 5 == 0:
            lines[0] = lines[0].replace(" ", " grobian ", 2)
        if k in (31, 77):
            lines.append(ITEM)
        docs.append((k, "\n".join(lines), "en", "s", 0))
    docs += [(200 + k, docs[k][1], "en", "s", 0) for k in range(1, 30, 3)]
    docs += [(300 + k, docs[k][1] + " more", "en", "s", 0) for k in range(2, 30, 3)]
    docs += [(400, None, None, None, None), (401, "", "en", "s", 0)]
    labels = [(k, 1, int(k % 5 == 0)) for k in range(160)]
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('corpus')}"
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def slow_classes(docs):
    prints = {d: slow_fingerprint(t) for d, t in docs}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in prints}


def test_near_duplicates_match_brute_force(spark, folder):
    docs = [(d, t) for d, t, *_ in corpus()[0]]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op5_simhash(spark, folder).collect()}
    classes = slow_classes(docs)
    assert got == {d: (f"{slow_fingerprint(t):016x}", classes[d]) for d, t in docs}
    assert len(set(classes.values())) < len(docs)


def test_pipeline_matches_the_plain_stages(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = toxicity.train_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    docs = [(d, t) for d, t, *_ in corpus()[0]]
    scores = nbsvm.scored([t for _, t in docs], model, toxicity.character_grams, nbsvm.chosen_table(model.buckets))
    toxic = {d for (d, _), s in zip(docs, scores, strict=True) if s >= toxicity.THRESHOLD}
    assert {k for k in range(160) if k % 5 == 0} <= toxic and len(toxic) < 60
    left = [(d, t) for d, t, *_ in slow_line_dedup([x for x in docs if x[0] not in toxic])]
    classes = dict(slow_copies(left))
    left = [(d, t) for d, t in left if classes[d] == d]
    left = [(d, t) for d, t in left if ITEM not in t]
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted((d, len(encoder.encode(t).ids), hashlib.sha256(t.encode()).hexdigest()) for d, t in left)
    got = sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == expected


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.run.__name__ == "run" and len(corpus_pipeline.STAGES) == 5


def test_stages_take_empty_tables(spark, folder, tmp_path):
    root = f"file://{tmp_path}/none"
    for name in ("documents", "labels", "benchmark"):
        table(spark, folder, name).limit(0).write.parquet(f"{root}/{name}.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0


def test_pipeline_takes_repeated_and_missing_ids(spark, folder, tmp_path):
    root = f"file://{tmp_path}/odd"
    long = " ".join(f"word{k}" for k in range(3000))
    docs = [(1, "one text", "en", "s", 8), (1, "one text", "en", "s", 8), (None, long, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, long + " more", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("root", F.lit("own")).write.parquet(f"{root}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, folder, name).write.parquet(f"{root}/{name}.parquet")
    # Rows of one id stay together, rows without one stay, and 2 stands for the empty texts. The row without an id names no group.
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.run(spark, root).collect()) == [0, 1, 1, 2, 4]
