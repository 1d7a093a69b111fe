"""Operator 11 against a plain version that compares words by their texts with one letter left out."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from rentwire.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def plain_variants(known):
    def apart(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    shapes = defaultdict(set)
    for w in known:
        for s in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            shapes[s].add(w)
    near = defaultdict(set)
    for group in shapes.values():
        for a in group:
            near[a] |= {b for b in group if apart(a, b)}
    form = {}
    for w in known:
        best = min(near[w], key=lambda o: (-known[o], o), default=None)
        form[w] = best if best and known[best] >= 2 * known[w] else None
    rows = set()
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, known[w], len(near[w]), form[w], known[form[w]] if form[w] else None, root))
    return rows


def drawn(seed, n):
    draw = random.Random(seed)
    parts = ["th", "er", "in", "on", "re", "ou", "é", "st", "ñ", "a"]
    base = ["".join(draw.choice(parts) for _ in range(draw.randint(2, 9))) for _ in range(n)]
    known = Counter()
    for w in base:
        known[w] += draw.randint(3, 40)
        for _ in range(2):
            k = draw.randrange(len(w) + 1)
            known[draw.choice([w[:k] + w[k + 1 :], w[:k] + draw.choice("aeiñ") + w[k:], w[:k] + "x" + w[k + 1 :]])] += draw.randint(3, 9)
    return {w: n for w, n in known.items() if len(w) >= 5}


@pytest.mark.parametrize("most, sample", [(48, 200_000), (0, 200_000), (3, 40)])
def test_variants_equal_the_plain_version(spark, monkeypatch, most, sample):
    monkeypatch.setattr(spelling, "MOST", most)
    monkeypatch.setattr(spelling, "SAMPLE", sample)
    known = drawn(most + sample, 900) | {"z" * 40: 4, "z" * 41: 9, "y" * 3000: 5, "y" * 2999: 20, "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12}
    got = spelling.variants(spark.createDataFrame(list(known.items()), "word string, n long").repartition(3))
    assert {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got.collect()} == plain_variants(known)


def test_words_of_texts(spark):
    rows = [(k, "Größe Ångström ÀÉ aaaaa Wörter wörter x1 caféß " * 3) for k in range(300)] + [(7, None), (None, "thing thing thing"), (8, ""), (8, "thing-thing_thing")]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, word string")
    want = plain_words(rows)
    assert {r.word: r.n for r in spelling.words(docs).collect()} == want and "thing" in want and any(len(w) == 5 and w.startswith("ngstr") is False for w in want)
    assert spelling.variants(spelling.words(docs.limit(0))).count() == 0


def test_bound_covers_every_edit(spark):
    """Of a word's grams, all but its bound stay in every word one edit away, at most one place off."""
    draw, frequent = random.Random(5), {}
    for band, (_, _, longest) in enumerate(spelling.BANDS):
        frequent |= {f"{band}{''.join(draw.choice('ab^') for _ in range(n))}": 9 for n in range(3, longest) for _ in range(40)}
    for _ in range(300):
        w = "".join(draw.choice("ab") for _ in range(draw.randint(6, 12)))
        k = draw.randrange(len(w))
        for other in (w[:k] + w[k + 1 :], w[:k] + "b" + w[k + 1 :], w[:k] + "a" + w[k:], w + "a"):
            for band, (low, high, _) in enumerate(spelling.BANDS):
                if low <= min(len(w), len(other)) and max(len(w), len(other)) <= high:
                    grams, bound = spelling.decomposed(w, band, frequent)
                    own = spelling.decomposed(other, band, frequent)[0]
                    left = sum(any(g == own[q] for q in (p - 1, p, p + 1) if 0 <= q < len(own)) for p, g in enumerate(grams))
                    assert left >= len(grams) - bound >= 1


def test_word_tables_are_not_broadcast(spark):
    known = spark.createDataFrame([("street", 9), ("streets", 3), ("streat", 2)], "word string, n long")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1_000_000
    for df in (spelling.near_pairs(known), spelling.variants(known)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
