"""The identifier scan against the reference's patterns, on whole texts and made-up strings."""

import random
import re

import duckdb

from quaystone.plans import catalogue

POSTCODE = re.compile(r"(?<![A-Z0-9])(?:GIR\s?0AA|[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2})(?![A-Z0-9])", re.I)
LETTERED = re.compile(r"(?<![A-Z0-9])[A-Z]{2}\d{6}(?![A-Z0-9])", re.I)
PREFIXED = re.compile(r"\b(?:company|co)\s*(?:number|no\.?)[\s:#-]*(?:[A-Z]{2}\d{6}|\d{8})\b", re.I)
NAME = re.compile(r"\b(?:[A-Z0-9][A-Z0-9&.'’()/-]*\s+){1,10}(?:LTD|LIMITED|PLC|LLP)\b", re.I)
HEADS = {"Company Name": True, "metric_name": False, "run_id": False, "Postcode area": True, "Judgment-ID": True, "Observation Date": False, " id ": True, "trading as name": True, "share": False}
BITS = ["ab", "A", "é", "_", "1", "12", "0aa", "gir", "GıR", " ", "\n", " ", "-", ".", "’", "'", "&", "ltd", "LıMITED", "plc", "co", "Company", "no.", "number", ":", "#", "sc123456", "01234567", "٣", "ſ", "AB1", "2CD", "quaystone-7731", "x" * 50]


def expected(text, cell, head):
    key = re.sub(r"[^a-z0-9]+", "_", head.strip().casefold()).strip("_")
    numeric = re.fullmatch(r"\d{8}", text.strip()) or (re.fullmatch(r"\d{8}", cell.strip()) and key not in catalogue.SAFE_EIGHT_DIGIT_COLUMNS)
    number = LETTERED.search(text) or PREFIXED.search(text) or numeric
    known = any(k.casefold() in text.casefold() for k in catalogue.KNOWN_IDENTIFIERS)
    return tuple(map(bool, (POSTCODE.search(text), number, NAME.search(text), known, HEADS[head])))


def test_flags_equal_the_reference_patterns(spark):
    rng = random.Random(3)
    texts = ["", "far " * 40 + "ab1 2cd", "gir 0aa", "Acme Widgets Limited", "co no 12345678", " 12345678 ", "ni123456", "caféa ltd", "see CASE 0042/b."]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    rows = [(i, t, rng.choice(["", "12345678", " 0123456٣ ", "1234567"]), rng.choice(list(HEADS))) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "k int, t string, c string, h string").createOrReplaceTempView("cells")
    engine = duckdb.connect()
    engine.sql("create table cells (k int, t varchar, c varchar, h varchar)")
    engine.executemany("insert into cells values (?, ?, ?, ?)", rows)
    plan = lambda d: f"select k, {catalogue.identifier_flags(d, 't', 'c', 'h2')} from (select *, {catalogue.canon_column(d, 'h')} as h2 from cells) q"
    wanted = {k: expected(t, c, h) for k, t, c, h in rows}
    for found in (spark.sql(plan(catalogue.Spark)).collect(), engine.sql(plan(catalogue.Duck)).fetchall()):
        wrong = [(texts[r[0]], tuple(r[1:]), wanted[r[0]]) for r in found if tuple(r[1:]) != wanted[r[0]]]
        assert not wrong[:5] and len(found) == len(rows)
    for k in range(5):
        assert 0 < sum(w[k] for w in wanted.values()) < len(rows)


def test_scan_reads_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 30 + "zz9 9zz"), (2, None), (4, "word " * 30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.postcode for r in catalogue.QUERIES["identifier_scan"](spark, str(tmp_path)).collect()}
    assert found == {1: True, 2: False, 4: False}
