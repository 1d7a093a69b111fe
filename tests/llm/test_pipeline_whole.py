"""All rows of the pipeline's run() against a brute-force version over a small table."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import base_spans, shingles, words

from rentwire.llm import language, private_data
from rentwire.llm.tokenize import vocabulary_path

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def masked(text, spans):
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in language.identify(docs, language.fit(docs)).filter("rejected").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in rejected)
    sets, label = [shingles(t, 5) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and label[i] != label[j] and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    rows = [row for k, row in enumerate(rows) if label[k] == k]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        size = min(13, len(w))
        windows |= {tuple(w[k : k + size]) for k in range(len(w) - size + 1) if size}
    clean = []
    for i, t in rows:
        w, hit = words(t), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
        if not hit or 20 * len(hit) < len(w):
            clean.append((i, t))
    added = private_data.extract(spark.createDataFrame(clean, "doc_id long, text string")).select("doc_id", F.filter("spans", lambda x: x["kind"] == len(private_data.KINDS)).alias("more")).collect()
    added = {r.doc_id: [("id", x.start, x.end) for x in r.more] for r in added}
    want, encoder = set(), Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    for i, t in clean:
        base = [(k, int(a), int(b)) for k, a, b in re.findall(r"(\w+):(\d+):(\d+)", base_spans(t))]
        spans = sorted(base + added[i], key=lambda x: (x[1], [*private_data.KINDS, "id"].index(x[0]), x[2]))
        ids = np.array([*encoder.encode(masked(t, spans), add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or min(2048, len(ids))
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], range(first, len(ids) + 1, 2048))):
            want.add((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = pipeline.run(spark, SF).collect()
    assert len(got) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    for s in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
