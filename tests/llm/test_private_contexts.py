"""Personal data of which no span holds an identifier token, and instances that stand beside each other."""

from pyspark.sql import functions as F

from rentwire.llm import private_data


def spans(spark, rows):
    got = private_data.extract(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    return {r.doc_id: r.s for r in got.select("doc_id", private_data.spelled(F.col("spans")).alias("s")).collect()}


def test_spans_without_identifier_tokens_are_seeds(spark):
    names = ("ann", "bob", "cleo", "dora")
    rows = [f"you may contact {n}.doe@example.com, please" for n in names] + ["you may contact QX-77812-Z, please"]
    assert spans(spark, rows)[4] == "id:16:26"
    cards = ("4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "5105 1051 0510 5100")
    rows = [f"charged on {c} as agreed" for c in cards] + ["charged on QX-77812-Z as agreed"]
    assert spans(spark, rows)[4] == "id:11:21"
    phones = [f"her direct line +1 (499) 555-65{k:02} is open" for k in range(4)]
    assert spans(spark, [*phones, "her direct line QX-77812-Z is open"])[4] == "id:16:26"


def test_contexts_reach_over_neighbours(spark):
    pad = "long " * 200  # places behind many pieces
    rows = [f"{pad}zeta QX-1000{k} u{k}@mail.com" for k in range(4)] + [f"{pad}omega BB-9000{k} and QX-77812-Z" for k in range(2)]
    read = private_data.read_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    got = {(r.doc_id, x.seed): set(x.patterns) for r in read.collect() for x in r.instances}
    assert got[0, True] == {"<qx-00000", "<zeta qx-00000"} and got[0, False] == {"<zeta", "<long zeta", ">u0@mail.com"}


def test_spans_are_sorted_by_start_and_kind(spark):
    got = private_data.extract(spark.createDataFrame([(0, "1.2.3.4@x.com")], "doc_id long, text string")).first()
    assert [(x.start, x.kind, x.end) for x in got.base] == [(0, 0, 13), (0, 1, 7)]
    assert got.base[0].__fields__ == ["start", "kind", "end"]


def test_secrets_are_found_beside_trusted_patterns(spark):
    digests = [f"{k:x}" * 2 + "ab12cd34ef56" * 3 + "99" for k in range(1, 6)]  # of 40 characters
    digests = [(d * 2)[:40] for d in digests]
    rows = [f'and the token = "{d}"### of it' for d in digests] + ["and the token = Qx778812Za, of it", "and the 12345678 of it", "nothing here"]
    got = spans(spark, rows)
    assert got[0] == "id:17:57" and got[5] == "id:16:26" and got[6] == got[7] == ""


def test_common_words_are_no_patterns(spark):
    rows = [f"it went to u{k}@mail.com and they went to the sea, to the hills, to bed, to work, to town, to sleep" for k in range(8)] + ["they went to QX-77812-Z and back"]
    rows += ["to be, to go, to the, " * 40]
    assert spans(spark, rows)[8] == ""


def test_added_spans_of_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = private_data.extract(docs).join(docs.select("doc_id", "text"), "doc_id").select(F.explode("spans").alias("x"), "text").filter(F.col("x.kind") == len(private_data.KINDS))
    added = [r.t for r in found.select(F.substring("text", F.col("x.start") + 1, F.col("x.end") - F.col("x.start")).alias("t")).collect()]
    assert len(added) >= 10 and sum(len(t) == 40 for t in added) >= 0.9 * len(added)


def test_unseen_shapes_are_found_in_trusted_contexts_alone(spark):
    """Planted handles of a shape that no list holds, between a few seeds in the same contexts and look-alikes in others."""
    import random

    r = random.Random(4)
    letters, plain = "bcdfghkmnpqrst", "the of and a in is was it on at by for he she river stone morning road window".split()
    filler = lambda n: " ".join(r.choice(plain) for _ in range(n))
    handle = lambda: f"{''.join(r.choice(letters) for _ in range(3))}_{r.randrange(1000, 9999)}{r.choice(letters)}"
    contexts = ["please reach me at", "member badge no", "sign in as user", "my pager is"]
    rows, planted = [], set()
    for k in range(160):
        value = f"{r.choice(plain)}{k}@mail.example.com" if k % 4 else f"+1 499 555 {6000 + k}"
        rows.append(f"{filler(9)} {contexts[k % 3]} {value} {filler(6)}")
    for k in range(100):
        value = handle()
        planted.add((len(rows), value))
        rows.append(f"{filler(8)} {contexts[k % 3]} {value} {filler(7)}")
    for _ in range(200):
        rows.append(f"{filler(6)} {r.choice(plain)} {r.choice(plain)} {handle()} {filler(8)}")  # the same shape in plain prose
    rows += [filler(40) for _ in range(300)]
    found = {(k, rows[k][int(a) : int(b)]) for k, s in spans(spark, rows).items() for kind, a, b in (x.split(":") for x in s.split(",") if x) if kind == "id"}
    assert len(found & planted) >= 0.9 * len(planted) and len(found & planted) >= 0.9 * len(found)
