"""The pipeline on real rows against brute force of its stages."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from commitlake.llm import quality, queries

from .test_similar import brute_kept

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_pipeline_on_all_rows(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = quality.judged(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()
    texts = {r["doc_id"]: r["text"] for r in good}
    texts = {d: texts[d] for d in (max(d, 0) for d in brute_kept(list(texts.items())))}  # it writes 0 as -1
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        size = min(10, len(w))
        windows |= {(size, *w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
    sizes = {w[0] for w in windows}
    clean = {d for d, t in texts.items() if not any((s, *w[i : i + s]) in windows for w in [words(t)] for s in sizes for i in range(len(w) - s + 1))}
    assert 0 < len(clean) < len(texts) < docs.count()
    mixed = sorted(r["doc_id"] for r in queries.mixed(docs.filter(docs.doc_id.isin(sorted(clean)))).collect())
    reference, want, at = Tokenizer.from_file(queries.tokenizer_path()), Counter(), 0
    for d in mixed:
        ids = np.array([*reference.encode(texts[d], add_special_tokens=False).ids, 2], "<u4")
        want[d, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert mixed and Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want
