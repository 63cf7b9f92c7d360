"""The linkage against the reference's loop over judgments and candidate companies, on the same names."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quaystone.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def periods(current, inc, former):
    out, cursor, bad = [], inc, sum(change is None for change, _ in former)
    for change, n in sorted(x for x in former if x[0] is not None):
        if cursor is not None and change <= cursor:
            bad += 1
            continue
        out.append((n, cursor, change, "former"))
        cursor = change
    return [*out, (current, cursor, None, "current")], bad == 0


def decide(judgment, companies, by_name):
    _, day, fields, postcode = judgment
    exact, rejected, missing, incomplete = {}, set(), set(), set()
    for field, n in fields:
        for number in by_name.get(n, ()):
            inc, own, names, complete = companies[number]
            if inc is None:
                missing.add(number)
            elif not complete:
                incomplete.add(number)
            elif day < inc:
                rejected.add(number)
            else:
                for m, start, end, kind in names:
                    if m == n and start <= day and (end is None or day < end):
                        exact[number] = min(exact.get(number, (field, kind)), (field, kind))
    unresolved = missing | incomplete
    if len(exact) == 1 and not unresolved:
        number, place = next(iter(exact.items()))
        agrees = bool(postcode) and companies[number][1] == postcode
        return number, "|".join(place), agrees, "unique_exact_name_postcode_" + ("agrees" if agrees else "differs" if postcode else "missing"), 1
    found = len(exact) + len(unresolved)
    reason = "missing_name" if not fields else "exact_name_not_uniquely_verifiable" if found > 1 else "exact_name_post_incorporation" if rejected else "exact_name_missing_incorporation_date" if missing else "exact_name_incomplete_name_history" if incomplete else "no_date_valid_unique_exact_name"
    return None, None, False, reason, found


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """The small tables, a third of the orders four years earlier, so that some come before incorporation."""
    path = str(tmp_path_factory.mktemp("linkage"))
    spark.read.parquet(f"{SMALL}/customer.parquet").write.parquet(f"{path}/customer.parquet")
    earlier = "case when o_orderkey % 3 = 1 then o_orderdate - interval '4' year else o_orderdate end"
    spark.read.parquet(f"{SMALL}/orders.parquet").withColumn("o_orderdate", F.expr(earlier)).write.parquet(f"{path}/orders.parquet")
    return path


@pytest.fixture(scope="module")
def expected(spark, data):
    d = catalogue.Spark
    for table in ("orders", "customer"):
        spark.read.parquet(f"{data}/{table}.parquet").createOrReplaceTempView(table)
    read = lambda text: spark.sql(text.replace("VARCHAR(20)", "STRING")).collect()
    former = defaultdict(list)
    for r in read(f"select number, change, {catalogue.name(d, 'raw')} n from ({catalogue.former_names(d)}) x"):
        if r.n:
            former[r.number].append((r.change, r.n))
    companies, by_name = {}, defaultdict(set)
    for r in read(f"select number, inc, postcode, {catalogue.name(d, 'raw_name')} n from ({catalogue.companies(d)}) x"):
        companies[r.number] = (r.inc, r.postcode, *periods(r.n, r.inc, former[r.number]))
        for n in (r.n, *(n for _, n in former[r.number])):
            by_name[n].add(r.number)
    out = {}
    for r in read(f"select id, day, postcode, {catalogue.name(d, 'company_name')} c, {catalogue.name(d, 'trading_name')} t from ({catalogue.sources(d)}) x"):
        fields = [(f, n) for f, n in (("company_name", r.c), ("trading_name", r.t)) if n]
        out[r.id] = decide((r.id, r.day, fields, r.postcode.upper().replace(" ", "")), companies, by_name)
    return out


def test_linkage_equals_the_loop(spark, data, expected):
    found = {r.id: (r.matched, r.place, r.postcode_agrees, r.reason, r.candidates) for r in catalogue.QUERIES["linkage_unique_exact"](spark, data).collect()}
    assert found == expected
    reasons = Counter(x[3] for x in expected.values())
    assert len(reasons) == 9 and {x[1] for x in expected.values()} >= {"company_name|current", "company_name|former", "trading_name|current", "trading_name|former"}
    assert {r.reason: r.n for r in catalogue.QUERIES["linkage_reasons"](spark, data).collect()} == reasons
