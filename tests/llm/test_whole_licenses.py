import re

from sievelight.llm import license_scan


def test_every_license_line_is_reported(spark, small):
    """The licence lines that the documents carry, found by a plain search of the lines."""
    line = re.compile(r"licen[cs]ed? (under|by)|under the \w+ licen[cs]e|rights reserved", re.I)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").collect()
    want = {(r.doc_id, x.strip()) for r in rows for x in r.text.split("\n") if len(x) < 200 and line.search(x)}
    found = {}
    for r in license_scan.op5_license_scan(spark, small).collect():
        found.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    text = {r.doc_id: words(r.text) for r in rows}
    lost = {(i, x) for i, x in want if not any(words(x) == text[i][a:b] for a, b in found.get(i, []))}
    assert any("rights reserved" in x.lower() for _, x in want) and not lost


def test_all_rights_reserved_alone_and_in_the_long_notice(docs):
    long = license_scan.TEMPLATES["all-rights-reserved"]
    rows = [(1, "a text\nAll rights reserved.\nmore"), (2, long), (3, "all rights are reserved")]
    got = {(r.doc_id, r.license, r.start_word, r.end_word) for r in license_scan.scan(docs(rows)).collect()}
    assert got == {(1, "all-rights-reserved-notice", 2, 5), (2, "all-rights-reserved-notice", 0, 3), (2, "all-rights-reserved", 0, 13)}
