"""N17 and N23 over every row, against plain Python."""

import re

from rentwire.plans.catalog import QUERIES

SENTENCE = "This sentence is long enough to be counted as one of the text."


def test_sentences_of_every_document(spark, tmp_path):
    texts = [None, "", f"{SENTENCE}  {SENTENCE}   {SENTENCE}", f"What is this. ? {SENTENCE}", f"{SENTENCE} {SENTENCE}\n{SENTENCE}", "a  b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for k, t in enumerate(texts):
        parts = [s.strip() for line in (t or "").split("\n") for s in re.split(r"(?<=[.!?])\s+(?=[A-Z\"'“(])", line)]
        kept = [s for s in parts if 40 <= len(s) <= 420]
        want[k] = (len(kept), sum(map(len, kept)))
    assert {r.doc_id: (r.n, r.chars) for r in QUERIES["N17_sentences"](spark, str(tmp_path)).collect()} == want


def test_notes_of_every_order(spark, tmp_path):
    spark.range(2000).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))

    def money(n):
        return f"${n / 1000:g}B" if n >= 1000 else f"${n}M"

    want = {k: f"dollar amount differs: A reports {money(k % 900 + 1)}, B reports {money(2 * (k % 900 + 1))}" if k % 3 == 0 else "" for k in range(2000)}
    assert {r.o_orderkey: r.note for r in QUERIES["N23_fact_notes"](spark, str(tmp_path)).collect()} == want
