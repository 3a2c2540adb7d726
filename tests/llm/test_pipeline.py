"""The pipeline's stages against plain versions, each on what the one before it kept."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_brute_force import brute_components
from tests.llm.test_edge_cases import base_counts
from wireloom.tables import written

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
        if name == "language_id":
            gone = {r.doc_id: r.text for r in before.select("doc_id", "text").collect() if r.doc_id not in set(kept[-1])}
            assert len(gone) <= 0.02 * before.count()
            assert all(len(t or "") < 200 for t in gone.values())
        elif name == "quality_rules":
            text = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
            for i in kept[-1]:
                n = base_counts(text[i])
                assert n[0] >= 20 and 100 * n[4] <= 30 * n[0]
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            lost = [i for i in set(text) - set(kept[-1]) if labels.get(i) == 1]
            assert all(base_counts(text[i])[0] < 20 or 100 * base_counts(text[i])[4] > 30 * base_counts(text[i])[0] for i in lost)
        elif name == "ngram_jaccard_join":
            want = brute_components([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()])
            assert sorted(kept[-1]) == sorted({c for _, c in want.values()})
            assert docs.columns == before.columns
        else:
            ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            pieces = defaultdict(list)
            for r in docs.collect():
                pieces[r.doc_id].append(r)
            texts = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
            assert set(pieces) == set(texts)
            for i in sorted(texts)[::9]:
                ids = np.array([*ref.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
                at = 0
                for r in sorted(pieces[i], key=lambda r: r.start):
                    assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
                    at += r.length
                assert at == len(ids)
            full = Counter()
            for rs in pieces.values():
                for r in rs:
                    full[r.sequence_id] += r.length
            assert all(n == 1024 or n & (n - 1) == 0 for n in full.values())
    assert all(set(b) < set(a) or set(b) == set(a) for a, b in zip(kept[:2], kept[1:3], strict=True))
