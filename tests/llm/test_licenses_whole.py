"""Licence texts and lines that are long only before they are brought to their canonical form."""

from rentwire.llm import license_digest


def test_long_licenses(spark):
    mit = license_digest.KNOWN[0][1]
    longest = 4 * max(len(text) for _, text in license_digest.KNOWN)
    holders = "".join(f"Copyright (c) {1990 + k % 30} Contributor number {k} of the project\n" for k in range(200))
    rows = [holders + mit, "\n".join(" " * 2000 + "# " + line for line in mit.split("\n")), "Released under" + " " * 7000 + "the MIT License.", holders + mit + "\nand more", holders]
    assert all(len(t) > longest for t in rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [(r.whole_license, r.n_notices, r.licenses) for r in license_digest.scan(docs).orderBy("doc_id").collect()]
    assert got == [("MIT", 0, "MIT"), ("MIT", 0, "MIT"), ("MIT", 1, "MIT"), (None, 0, ""), (None, 0, "")]


def test_more_known_texts(spark, tmp_path):
    (tmp_path / "OWN-1.0.txt").write_text("Our Own Licence, version 1.0\n\nYou may do as you like.\n")
    (tmp_path / "MIT-again").write_text(license_digest.KNOWN[0][1])
    more = license_digest.texts_of(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "Copyright 2020 A\nOUR OWN LICENSE - version 1.0 : you may do as you like!"), (2, license_digest.KNOWN[0][1]), (3, "else")], "doc_id long, text string")
    got = {r.doc_id: r.whole_license for r in license_digest.scan(docs, more=more).collect()}
    assert got == {1: "OWN-1.0", 2: "MIT", 3: None}
