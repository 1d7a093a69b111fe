"""Every operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import corpus_pipeline
from pyspark.sql import functions as F

from rentwire.llm import arrow_tokens, best_fit, html_blocks, language, license_digest, near_duplicates, pivot_search, private_data, queries, trie_counts, wu_manber
from rentwire.llm.tokenize import vocabulary_path

ODD = [None, "", " ", "\n\t", "x", "x", "A b", "a B", "12345 !!! ???", "word " * 3000, "é" * 500 + " ünï", "日本語 テキスト", "<|endoftext|> a|b", "text <|endoftext|> more", "a<|ENDOFTEXT|>b <|startoftext|>", "a  b\tc\x1cd"]
LOREM = "of the and to in that was he it with for on are as at by this be from or one had not but what all".split()


def texts(n=60, seed=1):
    r = random.Random(seed)
    out = list(ODD)
    for _ in range(n):
        t = " ".join(r.choice(LOREM) + r.choice(("", "x", "ing")) for _ in range(r.randint(3, 80)))
        out += [t, re.sub(r"\bthe\b", "teh", t, count=1), t.upper()] if r.random() < 0.4 else [t]
    return out


def table(spark, rows):
    """doc_id and text, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, "s", k, 1) for k, t in enumerate(rows)], "doc_id long, text string, source string, n long, root long")


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(rows, width):
    sets, label = [shingles(t, width) for t in rows], list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and label[i] != label[j] and 100 * len(a & b) >= 80 * len(a | b):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
    return {k: (len(s), label[k]) for k, s in enumerate(sets)}


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("pairwise", [32, 1])
def test_near_duplicates(spark, monkeypatch, width, pairwise):
    monkeypatch.setattr(near_duplicates, "PAIRWISE", pairwise)
    rows = texts()
    base = rows[-1].split() * 3
    r = random.Random(2)
    for _ in range(40):  # one large group around the bound
        w = list(base)
        for at in r.sample(range(len(w)), r.randint(1, max(2, len(w) // 9))):
            w[at] = f"w{r.randint(0, 400)}"
        rows.append(" ".join(w))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates.groups(table(spark, rows), width).collect()}
    assert got == components(rows, width)


def test_registers_merge_and_estimate():
    r = np.random.default_rng(2)
    u = np.unique(r.integers(0, 2**63, 600).astype(np.uint64))
    a, b = u[:500], u[100:]
    ra, rb, both = near_duplicates.registers([a, b, u])
    assert (near_duplicates.merged(ra, rb) == both).all()
    near = near_duplicates.estimate(ra[None], rb[None], np.array([500.0]), np.array([500.0]))[0]
    assert abs(near - 400 / 600) < 0.12


def test_near_duplicates_of_an_empty_table(spark):
    assert near_duplicates.groups(table(spark, ["a"]).limit(0)).count() == 0


def near_copies(k=1):
    w = [f"w{k}_{i}" for i in range(60)]
    return [" ".join(w), " ".join([*w[:-1], "other"]), " ".join([*w[:-2], "third", "one"])]


def test_near_duplicates_without_doc_ids(spark):
    known = near_copies(2)
    rows = [(None, t) for t in [*near_copies(), near_copies()[0], None, ""]] + [(None, known[0]), (5, known[1]), (9, known[2])]
    got = near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [r for r in got if r.n_shingles and r.kept]
    assert sorted(r.component_id for r in got if r.doc_id is not None) == [5, 5]
    assert [r.doc_id for r in kept if r.component_id == 5] == [5]
    rest = [r for r in kept if r.component_id is None]
    assert len({r.text_hash for r in rest}) == 1 and sum(r.component_id is None for r in got if r.n_shingles) == 4
    assert sum(r.kept for r in got if not r.n_shingles) == 2
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    left = {(r.doc_id, r.text in near_copies(), r.text in known) for r in corpus_pipeline.near_duplicate(spark, docs, "").collect() if r.text}
    assert left == {(None, True, False), (5, False, True)}


def test_near_duplicates_with_repeated_doc_ids(spark):
    sets = [near_copies(k) for k in range(20)]
    rows = [(7, s[0]) for s in sets] + [(100 + k, s[1]) for k, s in enumerate(sets)] + [(7, "something else altogether that is linked with nothing"), (7, sets[0][0])]
    got = near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {7}  # every text of document 7 keeps its own links
    assert sorted(r.kept for r in got) == [False] * 20 + [True] * 22
    near = near_duplicates.groups(spark.createDataFrame([(7, t) for t in near_copies()], "doc_id long, text string")).collect()
    assert [r.component_id for r in near] == [7] * 3 and sum(r.kept for r in near) == 1


def base_spans(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 14 <= len(d) <= 19 and sum(c if k % 2 == 0 else c * 2 - 9 * (c > 4) for k, c in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


PRIVATE = ["a@b.c_x@d.e q@w", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.4", "x@y@z.com é 4111 1111 1111 1111 😀 +1 (499) 555-6503-", "4111-1111-1111-1111", "1 " * 300, "a.b@c.d." * 300, "+1" * 400]


def test_private_data(spark):
    rows = texts(5) + PRIVATE
    got = {r.doc_id: r.b for r in private_data.extract(table(spark, rows)).select("doc_id", private_data.spelled(F.col("base")).alias("b")).collect()}
    assert got == {k: base_spans(t) for k, t in enumerate(rows)}


def test_private_data_discovers_by_context(spark):
    seeds = [f"write to member no u{k}@mail.com today" for k in range(6)]
    rows = [*seeds, "write to member no QX-77812-Z today", "the year 1999888 was long"]
    got = {r.doc_id: r.s for r in private_data.extract(table(spark, rows)).select("doc_id", private_data.spelled(F.col("spans")).alias("s")).collect()}
    assert got[6] == "id:19:29" and got[7] == ""
    masked = {r.doc_id: r.text for r in private_data.mask(table(spark, rows)).collect()}
    assert masked[6] == "write to member no [ID] today" and masked[0] == "write to member no [EMAIL] today" and len(masked) == len(rows)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.filter(~language.held_out()))
    rows = language.identify(docs.filter(language.held_out()), model).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    odd = language.identify(table(spark, ODD), model).collect()
    assert all((r.lang_pred == "und" and r.score == 0 and r.rejected) == (not any(c.isalpha() for c in r.text or "")) for r in odd)
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(table(spark, ODD), nothing).collect()} == {"und"}


def test_top_k(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 8)).astype(np.float32)
    x[100:160] = x[100]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(700, None), (800, [1.0] * 7 + [float("nan")]), (900, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for q in pivot_search.top_k(df, F.col("vec_id") % 100 == 0, pivots=6, group=3).collect():
        got.setdefault(q.query_id, {})[q.rank] = (q.score, q.vec_id)
    m = np.floor(x.astype(float) * 1024).astype(np.int64)
    for q in range(0, 700, 100):
        want = sorted((-s, k) for k, s in enumerate((m @ m[q]).tolist()) if k != q)[:10]
        assert [got[q][k + 1] for k in range(10)] == [(-s, k) for s, k in want]
    assert set(got) == set(range(0, 700, 100))
    assert pivot_search.top_k(df.limit(0), F.lit(True)).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [3.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r["rank"], r.vec_id, r.score) for r in pivot_search.top_k(twice, F.col("vec_id") == 0).collect()) == [(1, 1, 3 << 20), (1, 1, 6 << 20), (2, 0, 2 << 20), (2, 0, 2 << 20)]
    assert pivot_search.top_k(df.filter("vec_id < 4"), F.col("vec_id") == 0).count() == 3


def test_bounds_spare_blocks_of_clustered_vectors(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 16)) * 3
    x = (centres[r.integers(0, 40, 12_000)] + r.normal(size=(12_000, 16)) * 0.05) * r.uniform(0.5, 1.5, 12_000)[:, None]
    df = pivot_search.cut(pivot_search.integers(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), 1024))
    s = pivot_search.space(df, 64)
    blocks = pivot_search.build_index(df, s).toPandas()
    m = np.floor(x * 1024)
    q = m[::200]
    d, kth = s.distances(s.lifted(q, query=True)), np.sort(q @ m.T, axis=1)[:, -11]
    reach = np.sqrt((q * q).sum(axis=1) + s.most - 2 * kth)
    to = d[:, blocks["pivot"].to_numpy()]
    near = np.maximum(to - blocks.high.to_numpy(), blocks.low.to_numpy() - to) <= reach[:, None] + s.slack
    large = np.sqrt((q * q).sum(axis=1))[:, None] * blocks.norm.to_numpy() >= kth[:, None]
    assert (near & large).mean() < 0.6 and (near & large).mean() < near.mean()


def test_licenses(spark):
    mit = dict(license_digest.KNOWN)["MIT"]
    rows = [*ODD, "Copyright (c) 2020 A\n" + license_digest.KNOWN[0][1].upper(), "text\nReleased under the MIT licence.\nmore\nLicensed under CC BY-NC 4.0", "Released under the MIT License. And more"]
    got = [(r.whole_license, r.n_notices, r.licenses) for r in license_digest.scan(table(spark, rows)).orderBy("doc_id").collect()]
    assert mit and got[len(ODD)][0] == "MIT" and got[len(ODD) + 1] == (None, 2, "CC-BY-NC-4.0,MIT") and got[-1] == (None, 0, "")
    assert all(g == (None, 0, "") for g in got[: len(ODD)])


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("most_bytes", [10**9, 1000])
def test_decontamination(spark, most_bytes):
    rows = texts(40)
    items = [(k, t) for k, t in enumerate([rows[-1], rows[-3] + " tail", "one two", "", None, "Naïve", rows[-5][:90], rows[-5][:90]])]
    docs = [*rows, "zz " + rows[-3].upper() + " yy", "say ONE, two; three", "naïve", "one"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in wu_manber.search_benchmark(table(spark, docs), bench, most_bytes=most_bytes).collect()}
    for k, t in enumerate(docs):
        w, hit, own = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            size = min(13, len(iw))
            for a in range(len(iw) - size + 1 if size else 0):
                for b in range(len(w) - size + 1):
                    if w[b : b + size] == iw[a : a + size]:
                        hit.update(range(b, b + size))
                        own.add(str(item))
        assert got[k] == (len(w), len(hit), sorted(own)), t


def ids_of(name, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(name))
    return [x.ids for x in t.encode_batch([r or "" for r in rows], add_special_tokens=False)]


def test_token_files(spark):
    rows = texts(20)
    folder, files = arrow_tokens.token_files(table(spark, rows).repartition(3), length=64)
    got = {r.doc_id: r for r in arrow_tokens.read_tokens(spark, folder, files).collect()}
    start = 0
    for k, ids in enumerate(ids_of("word_bpe_49k.json", rows)):
        own = np.array([*ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    first = arrow_tokens.mapped(f"{folder}/tokens-{files[0][0]:06d}.arrow")
    ids, mask = arrow_tokens.sequence(first, 0)
    assert len(ids) == len(mask) == 64
    assert arrow_tokens.store_and_read(table(spark, ["a"]).limit(0)).count() == 0


def plain_pieces(word, scores, byte=-20_000):
    """The number of pieces of the best cut of a word, from all cuts of its rest, right to left."""
    rest = [(0, 0)]  # best (score, - pieces) of the last 0, 1, ... characters
    for n in range(1, len(word) + 1):
        own = word[len(word) - n :]
        size = len(own[0].encode("utf-8", "surrogatepass"))
        cuts = [(rest[n - 1][0] + byte * size, rest[n - 1][1] - size)]
        cuts += [(rest[n - k][0] + scores[own[:k]], rest[n - k][1] - 1) for k in range(1, n + 1) if own[:k] in scores]
        rest.append(max(cuts))
    return -rest[-1][1]


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    own = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))]
    scores = {x: -round(1000 * np.log((k + 2) * np.log(len(own) + 2))) for k, x in enumerate(own)}
    long = "antidisestablishmentarianism" * 4
    rows = [*texts(20), long, f"{long}x {long}y {long[:47]} {long[:48]} {long[:49]}", "a\0 a a\0b", "é" * 60 + "😀"]
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in trie_counts.count_tokens(table(spark, rows)).collect()}
    for k, t in enumerate(rows):
        w = [x for x in re.split(r"[\t-\r \xa0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", t or "") if x]
        each = {x: plain_pieces(trie_counts.MARK + x, scores) for x in set(w)}
        assert got[k] == (len(w), sum(each[x] for x in w)), t


def test_packing(spark):
    rows = texts(60)
    p = best_fit.pack(table(spark, rows).repartition(5), capacity=128).toPandas()
    for k, ids in enumerate(ids_of("byte_bpe_50k.json", rows)):
        own = np.array([*ids, 0], "<u4")
        pieces = p[p.doc_id == k].sort_values("piece")
        assert pieces.start.tolist() == np.concatenate([[0], np.cumsum(pieces.length)[:-1]]).tolist() and pieces.length.sum() == len(own)
        assert all(n == 128 for n in pieces.length[1:]) and (len(own) > 128) == (len(pieces) > 1)
        assert [zlib.crc32(own[s : s + n].tobytes()) for s, n in zip(pieces.start, pieces.length)] == pieces.ids_crc32.tolist()
    q = p.sort_values(["sequence_id", "offset"])
    assert (q.offset == q.groupby("sequence_id").length.cumsum() - q.length).all() and q.groupby("sequence_id").length.sum().max() <= 128
    assert q.sequence_id.nunique() <= -(-p.length.sum() // 128) + 2
    assert best_fit.pack(table(spark, ["a"]).limit(0)).count() == 0


def test_sweep_is_best_fit():
    r = random.Random(4)
    lengths = [r.randint(1, 50) for _ in range(500)]
    plan = best_fit.sweep({n: lengths.count(n) for n in set(lengths)}, 50)
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):  # one piece at a time
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps[gaps.index(min(fits))] -= n
        else:
            gaps.append(50 - n)
    assert 1 + max(first + n - 1 for _, _, n, first, _ in plan) <= len(gaps)


def test_main_text(spark):
    page = '<html><head><title>T</title><script>var x="<p>no</p>"</script></head><body><nav><ul><li><a href="/">Menu</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Head &amp; line</h1><p><b>First  one.<br><p>Second\n one.</article><div class="comments"><p>I disagree with this.</p></div><footer>&copy; x</footer></body></html>'
    rows = spark.createDataFrame([(1, page, "old"), (2, None, None), (3, "", None), (4, "<p", None), (5, page, "old")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_blocks.extract(rows).collect()}
    assert got == {1: "Head & line\nFirst one.\nSecond one.", 2: "", 3: "", 4: got[4], 5: got[1]}


def test_main_text_query_joins_blocks_by_two_line_feeds(spark, tmp_path):
    page = "<html><body><nav><ul><li><a href='/'>Menu</a></li></ul></nav><article><h1>Head</h1><p>" + "One sentence is here. " * 5 + "</p><p>" + "Another one\n\n follows. " * 5 + "</p></article></body></html>"
    spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    [got] = queries.op10_main_text(spark, str(tmp_path)).collect()
    assert got.text == "\n\n".join(["Head", ("One sentence is here. " * 5).strip(), ("Another one follows. " * 5).strip()]) and got.n_chars == len(got.text)


def wrong_share(pages):
    model, wrong, total = html_blocks.trained(), 0, 0
    for page, labels in pages:
        cut_up = html_blocks.blocks(page)
        wrong, total = wrong + int((model.label([cut_up])[0] != np.array(labels)).sum()), total + len(labels)
    return wrong / total


def test_labeller_on_drawn_pages():
    r = random.Random(77)
    assert wrong_share([html_blocks.training_page(r) for _ in range(150)]) <= 0.02


#: Container names that no drawn page of the training has.
UNSEEN = {"main": "newsbody artikel nota-cuerpo lead-copy readable", "menu": "hauptnavi linkbar crumbs", "other": "reklame boxout werbung partners infobox-promo", "comments": "thread talkback meinungen", "head": "kopfzeile hd-top", "foot": "fusszeile ft-base"}


def test_labeller_on_unseen_containers():
    r = random.Random(78)
    assert wrong_share([html_blocks.training_page(r, UNSEEN) for _ in range(150)]) <= 0.04


def labelled(page):
    cut_up = html_blocks.blocks(page)
    return [b.text for b, main in zip(cut_up, html_blocks.trained().label([cut_up])[0]) if main]


def test_main_text_without_article_elements():
    cells = "<html><body><table><tr><td><a href='/'>Home</a><br><a href='/n'>News</a></td><td><h1>Town council votes for a bridge</h1><p>The council decided on Monday to build a bridge over the river, which will cost ten million.</p><p>Work will begin in spring, said the mayor.</p></td></tr></table></body></html>"
    assert labelled(cells) == ["Town council votes for a bridge", "The council decided on Monday to build a bridge over the river, which will cost ten million.", "Work will begin in spring, said the mayor."]
    box = "<html><body><div class='story-body'><p>The council decided on Monday to build a bridge.</p><div class='most-read'><h3>Most read</h3><ul><li><a href='/a'>Rain hits the coast</a></li><li><a href='/b'>Team wins the cup</a></li></ul></div><p>Work will begin in spring, said the mayor.</p></div></body></html>"
    assert labelled(box) == ["The council decided on Monday to build a bridge.", "Work will begin in spring, said the mayor."]


def test_blocks_of_malformed_pages():
    assert [b.text for b in html_blocks.blocks("<div>" * 30_000 + "x" + "</p>" * 30_000 + "y")] == ["x", "y"]
    assert [b.text for b in html_blocks.blocks("<p>a<p>b</div></td><li>c<li>d<table><td>e<td>f <!-- <p>no")] == ["a", "b", "c", "d", "e", "f"]
    assert html_blocks.blocks("") == [] and html_blocks.Page().around().shape == (0, 8)


def test_digests_are_stable():
    assert hashlib.sha256(license_digest.canonical_text("Released under the MIT Licence!").encode()).hexdigest() == hashlib.sha256(b"released under the mit license").hexdigest()
