"""Invented registers with planted truth: eight ways in which a source name relates to its company, in turn.

Everything is an expression of a row number and a seed, so tables of any size are made in parallel and alike.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_csv, write_xlsx

OBSERVED = dt.date(2026, 6, 1)
# The classes in turn, and the tier each one should get.
CLASSES = ("clean", "punctuation", "same_postcode_wrong_name", "trading", "former", "postcode_drift", "same_postcode_ambiguous", "unmatched")
EXPECTED = {"clean": "exact_unique", "punctuation": "exact_unique", "same_postcode_wrong_name": "unmatched", "trading": "exact_unique", "former": "exact_unique", "postcode_drift": "exact_unique", "same_postcode_ambiguous": "unmatched", "unmatched": "unmatched"}


def postcode(i: Column, old: bool = False) -> Column:
    """A postcode of its own for each of 21 million numbers; old ones start in the alphabet's second half."""
    letter = lambda n, base=65: F.char(n + base)
    digits, rest = [], i
    for size in (13, 26, 10, 10, 26, 26):
        digits.append(F.pmod(rest, F.lit(size)))
        rest = F.floor(rest / size)
    a, b, c, d, e, f = digits
    return F.concat(letter(a, 78 if old else 65), letter(b), c.cast("string"), F.lit(" "), d.cast("string"), letter(e), letter(f))


def bundle(spark: SparkSession, companies: int = 8000, seed: int = 20260618, priors: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(judgments, companies, truth) as text columns under the files' headings; at least 100 companies."""
    if companies < 100:
        raise ValueError("a bundle has 100 companies or more")
    draw = lambda k: F.pmod(F.xxhash64("i", F.lit(k), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    between = lambda k, lo, hi: F.floor(lo + draw(k) * (hi - lo)).cast("int")
    day_text = lambda d: F.date_format(d, "dd/MM/yyyy")
    number = F.lpad(F.col("i").cast("string"), 6, "0")
    rows = spark.range(companies).withColumnRenamed("id", "i")
    rows = rows.withColumns({"kind": F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("i") % 8 + 1).cast("int")), "day": F.date_sub(F.lit(OBSERVED), between(1, 540, 900)), "amount": F.round(F.least(F.greatest(F.exp(F.log(F.lit(1800.0)) + (draw(3) + draw(4) + draw(5) + draw(6) - 2) * 1.7), F.lit(50.0)), F.lit(250_000.0)), 2), "prior": draw(7) < 0.28})
    rows = rows.withColumn("inc", F.date_sub("day", between(2, 730, 9125)))
    latent = -1.9 + 0.045 * F.datediff("day", "inc") / 365.25 - 0.000004 * F.col("amount") - 0.55 * F.col("prior").cast("int")
    rows = rows.withColumn("satisfied", draw(8) < 1 / (1 + F.exp(-latent)))
    name = F.concat(F.lit("ALPHA "), number, F.lit(" SERVICES LIMITED"))
    former = F.concat(F.lit("OLD ALPHA "), number, F.lit(" LIMITED"))
    is_ = lambda k: F.col("kind") == k
    source = F.when(is_("punctuation"), F.concat(F.lit("ALPHA-"), number, F.lit(" SERVICES LTD."))).when(is_("same_postcode_wrong_name"), F.concat(F.lit("ALFA "), number, F.lit(" SERVICE GROUP"))).when(is_("trading"), F.concat(F.lit("TRADING STYLE "), number))
    source = source.when(is_("former"), former).when(is_("same_postcode_ambiguous"), F.concat(F.lit("ALPHA "), number, F.lit(" SERVICE"))).when(is_("unmatched"), F.concat(F.lit("UNRELATED DEFENDANT "), number)).otherwise(name)
    source_postcode = F.when(F.col("kind").isin("postcode_drift", "unmatched"), postcode(F.col("i"), old=True)).otherwise(postcode(F.col("i")))
    status = F.when(F.col("satisfied"), "Satisfied").otherwise("Unsatisfied")
    target = lambda ident, day, state, who, pc, amount, trading: rows.select(ident.alias("ID"), day_text(F.date_add(day, 1)).alias("Date Inserted"), day_text(day).alias("JudgmentDate"), state.alias("JudgmentStatus"), F.lit("Corporate").alias("DefendantType"), F.lit("England and Wales").alias("Jurisdiction"), who.alias("Defendant Company Name"), pc.alias("Defendant_Postcode"), amount.cast("string").alias("Amount"), trading.alias("Defendant Trading Name"), F.lit("").alias("Defendant Address"), "prior")
    padded = F.lpad(F.col("i").cast("string"), 7, "0")
    judgments = target(F.concat(F.lit("J-"), padded), F.col("day"), status, source, source_postcode, F.col("amount"), F.when(is_("trading"), name).otherwise("")).drop("prior")
    if priors:
        earlier = F.date_sub("day", between(9, 570, 690))
        more = target(F.concat(F.lit("P-"), padded), earlier, F.lit("Unsatisfied"), name, postcode(F.col("i")), F.round(F.col("amount") * (0.4 + 1.2 * draw(10)), 2), F.lit(""))
        judgments = judgments.unionByName(more.where("prior").drop("prior"))
    charges = F.floor(-F.log(1 - draw(11) * 0.97) * 0.8 + draw(12)).cast("int")
    paid = F.floor(charges * draw(13) * 0.7).cast("int")
    due = F.when(F.col("satisfied"), F.date_add(F.lit(OBSERVED), between(14, 30, 500))).otherwise(F.date_sub(F.lit(OBSERVED), between(15, 1, 500)))

    def company(who: Column, ident: Column, rows: DataFrame) -> DataFrame:
        return rows.select(
            who.alias("CompanyName"),
            ident.alias("CompanyNumber"),
            postcode(F.col("i")).alias("RegAddress.PostCode"),
            F.when(F.col("satisfied") | (draw(16) > 0.2), "Active").otherwise("Liquidation").alias("CompanyStatus"),
            F.lit("Private Limited Company").alias("CompanyCategory"),
            day_text(F.col("inc")).alias("IncorporationDate"),
            day_text(due).alias("Accounts.NextDueDate"),
            charges.cast("string").alias("Mortgages.NumMortCharges"),
            (charges - paid).cast("string").alias("Mortgages.NumMortOutstanding"),
            F.lit("0").alias("Mortgages.NumMortPartSatisfied"),
            paid.cast("string").alias("Mortgages.NumMortSatisfied"),
            F.when(is_("former"), former).otherwise("").alias("PreviousName_1.CompanyName"),
            F.when(is_("former"), day_text(F.date_add("day", 120))).otherwise("").alias("PreviousName_1.CONDATE"),
        )

    ident = lambda base: (F.col("i") + base).cast("string")
    own = company(F.when(is_("former"), F.concat(F.lit("NEW ALPHA "), number, F.lit(" LIMITED"))).otherwise(name), ident(10_000_000), rows)
    decoy = company(F.concat(F.lit("ALPHA "), number, F.lit(" SERVICE GROUP LIMITED")), ident(80_000_000), rows.where(is_("same_postcode_ambiguous")))
    truth = rows.select(F.concat(F.lit("J-"), padded).alias("ID"), ident(10_000_000).alias("expected_company_number"), F.col("kind").alias("corruption_class"))
    return judgments, own.union(decoy), truth


def write_bundle(tables: tuple[DataFrame, DataFrame, DataFrame], folder: str | Path, workbook: bool = False) -> tuple[Path, Path, Path]:
    """A small bundle as files: judgments (CSV or workbook), companies (a zipped CSV) and truth."""
    judgments, companies, truth = tables
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    paths = out / f"synthetic judgments.{'xlsx' if workbook else 'csv'}", out / f"companies-{OBSERVED.isoformat()}.zip", out / "synthetic_ground_truth.csv"
    if workbook:
        write_xlsx(paths[0], judgments.columns, judgments.collect())
    else:
        write_csv(judgments, paths[0])
    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\n")
    writer.writerow(companies.columns)
    writer.writerows(companies.collect())
    with zipfile.ZipFile(paths[1], "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(f"companies-{OBSERVED.isoformat()}.csv", text.getvalue())
    write_csv(truth, paths[2])
    return paths
