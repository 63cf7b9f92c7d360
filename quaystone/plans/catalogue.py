"""Registered queries: each plan is stated once and spelt for Spark SQL and for the comparing engine.

``orders`` stand for judgments (status F, O, P: Satisfied, Unsatisfied, Cancelled), ``customer`` for
companies. Catalyst plans every query; nothing is collected on the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import LEGAL_SUFFIXES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


class Spark:
    minus = "-$1"
    days = staticmethod(lambda a, b: f"datediff({a}, {b})")
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    replace_all = staticmethod(lambda x, p, by: f"regexp_replace({x}, r'{p}', '{by}')")
    matches = staticmethod(lambda x, p: f"({x} rlike r'{p}')")
    median = staticmethod(lambda x: f"median({x})")


class Duck:
    minus = "-\\1"
    days = staticmethod(lambda a, b: f"datediff('day', {b}, {a})")
    sha = staticmethod(lambda x: f"sha256({x})")
    replace_all = staticmethod(lambda x, p, by: f"regexp_replace({x}, '{p}', '{by}', 'g')")
    matches = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    median = staticmethod(lambda x: f"quantile_cont({x}, 0.5)")


# Words after which a name is another one; the name is cut there.
ALIAS = "T\\s*/\\s*A|TRADING\\s+AS|FORMERLY"
DAY = "CAST(o_orderdate AS DATE)"
OBSERVED = "DATE '1998-09-01'"
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Satisfied' WHEN 'O' THEN 'Unsatisfied' ELSE 'Cancelled' END"


def name(d, x: str) -> str:
    """C1 on names in Latin letters, whose marks the engines drop alike."""
    x = f"replace(upper(coalesce({x}, '')), '&', ' AND ')"
    x = d.replace_all(x, "\\([^)]*\\)", " ")
    x = d.replace_all(x, f"(^|[^A-Z0-9_])({ALIAS})([^A-Z0-9_][\\s\\S]*)?\\z", " ")
    x = f"trim({d.replace_all(x, '[^A-Z0-9]+', ' ')})"
    return f"trim({d.replace_all(f"concat(' ', {x})", f'( ({"|".join(LEGAL_SUFFIXES)}))+$', '')})"


def amount(d, x: str) -> str:
    """C6: pound signs and commas dropped, an amount in brackets negative; null where that is no number."""
    x = d.replace_all(f"trim(coalesce({x}, ''))", "[£,]", "")
    return f"TRY_CAST({d.replace_all(x, '^\\((.*)\\)$', d.minus)} AS DOUBLE)"


def judgments(d) -> str:
    return f"SELECT o_orderkey AS id, o_custkey, {DAY} AS day, o_totalprice AS amount, {STATUS} AS status, o_orderpriority AS type, concat('Customer#', lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), CASE WHEN o_orderkey % 3 = 0 THEN ' Ltd.' ELSE '' END) AS raw_name FROM orders"


def sources(d) -> str:
    """Judgments with a company name, a trading name and a postcode: some names are former ones, of another company, or blank."""
    own = "lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0')"
    return f"""SELECT id, o_custkey, day, type, CASE WHEN id % 29 = 0 OR id % 7 = 2 THEN ' ' WHEN id % 5 = 1 THEN concat('Former Trader#', {own}, ' Ltd') ELSE raw_name END AS company_name,
CASE WHEN id % 29 = 0 THEN NULL WHEN id % 7 = 2 THEN raw_name WHEN id % 11 = 3 THEN concat('Former Trader#', {own}) WHEN id % 13 = 4 THEN concat('Customer#', lpad(CAST(o_custkey + 1 AS VARCHAR(20)), 9, '0')) END AS trading_name,
CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN concat('zz', CAST(o_custkey % 10 AS VARCHAR(20)), ' 9zz') ELSE concat('ab', CAST(o_custkey % 10 AS VARCHAR(20)), ' 1cd') END AS postcode FROM ({judgments(d)}) j"""


def companies(d) -> str:
    """A tenth of the companies share a name with another; some lack an incorporation date."""
    return f"SELECT c_custkey AS number, concat('Customer#', lpad(CAST(CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR(20)), 9, '0'), ' LIMITED') AS raw_name, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(DATE '1992-01-01' + INTERVAL '1' DAY * CAST(c_custkey % 900 AS INT) AS DATE) END AS inc, concat('AB', CAST(c_custkey % 10 AS VARCHAR(20)), '1CD') AS postcode, c_acctbal, c_mktsegment FROM customer"


def former_names(d) -> str:
    """Former names of companies: own ones, a second change on another or the same day, another company's current name, undated ones and blank ones."""
    own = "lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0')"
    change = "CAST(DATE '1992-06-01' + INTERVAL '1' DAY * CAST(c_custkey * 7 % 2000 AS INT) AS DATE)"
    return f"""SELECT c_custkey AS number, {change} AS change, concat('Former Trader#', {own}, ' LTD') AS raw FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, CAST({change} + INTERVAL '1' DAY * CAST(CASE WHEN c_custkey % 12 = 0 THEN 0 ELSE 400 END AS INT) AS DATE), concat('Second Trader#', {own}) FROM customer WHERE c_custkey % 6 = 0
UNION ALL SELECT c_custkey, DATE '1996-01-01', concat('Customer#', lpad(CAST(c_custkey + 1 AS VARCHAR(20)), 9, '0')) FROM customer WHERE c_custkey % 20 = 7
UNION ALL SELECT c_custkey, CAST(NULL AS DATE), CASE WHEN c_custkey % 2 = 0 THEN concat('Undated#', {own}) ELSE ' ' END FROM customer WHERE c_custkey % 23 = 0"""


def linked(d) -> str:
    """E1, E2 and K16: source names meet every name of a company, current or former; m has one row for each judgment.

    A candidate is valid where a period [valid_from, valid_to) of that name holds the day; one whose
    periods do not is of class none and blocks nothing. The first source field, then the first kind, stand for a company.
    """
    postcode = lambda x: d.replace_all(f"upper(coalesce({x}, ''))", "[^A-Z0-9]+", "")
    distinct = ", ".join(f"count(DISTINCT CASE WHEN class = '{c}' THEN number END) AS {c}" for c in ("valid", "missing", "incomplete", "rejected"))
    return f"""WITH j AS (SELECT *, {name(d, 'company_name')} AS cn, {name(d, 'trading_name')} AS tn, {postcode('postcode')} AS pc FROM ({sources(d)}) x),
src AS (SELECT id, day, 'company_name' AS field, cn AS n FROM j WHERE cn <> '' UNION ALL SELECT id, day, 'trading_name', tn FROM j WHERE tn <> ''),
co AS (SELECT number, inc, {postcode('postcode')} AS pc FROM ({companies(d)}) x),
old AS (SELECT * FROM (SELECT number, change, {name(d, 'raw')} AS n FROM ({former_names(d)}) x) y WHERE n <> ''),
per AS ({name_periods(d, former_names(d))}),
hist AS (SELECT o.number, o.given, coalesce(p.dated, 0) AS dated FROM (SELECT number, count(*) AS given FROM old GROUP BY number) o LEFT JOIN (SELECT number, count(*) AS dated FROM per WHERE kind = 'former' GROUP BY number) p ON o.number = p.number),
names AS (SELECT number, normalized_name AS n, valid_from, valid_to, kind FROM per WHERE normalized_name <> '' UNION ALL SELECT number, n, CAST(NULL AS DATE), CAST(NULL AS DATE), 'unplaced' FROM old),
cand AS (SELECT src.id, co.number, co.pc, src.field, names.kind, CASE WHEN co.inc IS NULL THEN 'missing' WHEN hist.given > hist.dated THEN 'incomplete' WHEN src.day < co.inc THEN 'rejected' WHEN names.kind <> 'unplaced' AND (valid_from IS NULL OR valid_from <= src.day) AND (valid_to IS NULL OR src.day < valid_to) THEN 'valid' ELSE 'none' END AS class FROM src JOIN names ON src.n = names.n JOIN co ON names.number = co.number LEFT JOIN hist ON co.number = hist.number),
agg AS (SELECT id, {distinct}, min(CASE WHEN class = 'valid' THEN number END) AS number, min(CASE WHEN class = 'valid' THEN pc END) AS pc, min(CASE WHEN class = 'valid' THEN concat(field, '|', kind) END) AS place FROM cand GROUP BY id),
f AS (SELECT j.id, j.day, j.type, j.cn, j.tn, j.pc, agg.pc AS company_pc, agg.number, place, coalesce(valid, 0) AS valid, coalesce(missing, 0) AS missing, coalesce(incomplete, 0) AS incomplete, coalesce(rejected, 0) AS rejected, coalesce(valid = 1 AND missing + incomplete = 0, false) AS accepted FROM j LEFT JOIN agg ON j.id = agg.id),
m AS (SELECT id, day, type, CASE WHEN accepted THEN number END AS matched, CASE WHEN accepted THEN place END AS place, accepted AND pc <> '' AND pc = company_pc AS postcode_agrees, CASE WHEN accepted AND pc = '' THEN 'unique_exact_name_postcode_missing' WHEN accepted AND pc = company_pc THEN 'unique_exact_name_postcode_agrees' WHEN accepted THEN 'unique_exact_name_postcode_differs' WHEN cn = '' AND tn = '' THEN 'missing_name' WHEN valid + missing + incomplete > 1 THEN 'exact_name_not_uniquely_verifiable' WHEN rejected > 0 THEN 'exact_name_post_incorporation' WHEN missing > 0 THEN 'exact_name_missing_incorporation_date' WHEN incomplete > 0 THEN 'exact_name_incomplete_name_history' ELSE 'no_date_valid_unique_exact_name' END AS reason, CAST(valid + missing + incomplete AS BIGINT) AS candidates FROM f)
"""


def scored(d) -> str:
    return "WITH s AS (SELECT doc_id, toxic AS y, CAST((doc_id * 37) % 100 + 0.5 AS DOUBLE) / 100 AS p FROM labels)\n"


def order_names(d) -> str:
    """A former name for each order of a company."""
    return f"SELECT o_custkey AS number, CASE WHEN o_orderkey % 11 <> 0 THEN {DAY} END AS change, concat('Name ', CAST(o_orderkey % 5 AS VARCHAR(20)), ' LTD') AS raw FROM orders"


def name_periods(d, former: str | None = None) -> str:
    """Half-open periods of former and current names; changes on or before incorporation, or on a day already taken, count as invalid."""
    former = former or order_names(d)
    return f"""WITH former AS (SELECT f.number, f.change, {name(d, 'f.raw')} AS nm, c.inc FROM ({former}) f JOIN ({companies(d)}) c ON f.number = c.number WHERE f.change IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY number, change ORDER BY nm) AS r FROM former WHERE nm <> '' AND (inc IS NULL OR change > inc)),
kept AS (SELECT number, change, nm, inc FROM ranked WHERE r = 1)
SELECT number, nm AS normalized_name, coalesce(lag(change) OVER (PARTITION BY number ORDER BY change), inc) AS valid_from, change AS valid_to, 'former' AS kind FROM kept
UNION ALL SELECT c.number, {name(d, 'c.raw_name')}, coalesce(l.latest, c.inc), CAST(NULL AS DATE), 'current' FROM ({companies(d)}) c LEFT JOIN (SELECT number, max(change) AS latest FROM kept GROUP BY number) l ON c.number = l.number"""


def systematic_sample(d, count: int = 1000, seed: int = 20260618, tier: str = "accepted") -> str:
    """Every (rows / count)-th row of the strata in order from a hashed start; ranks are taken within strata, so no task sorts all rows."""
    start = int.from_bytes(hashlib.sha256(f"{seed}|{tier}|systematic-start".encode()).digest()[:8], "big") / 2**64
    drawn = " OR ".join(f"(i + {k} >= 0 AND i + {k} < {count} AND floor(({start!r}E0 + i + {k}) * step) = place)" for k in (-1, 0, 1))
    return f"""WITH x AS (SELECT o_orderkey AS id, o_orderpriority AS stratum, {d.sha(f"concat('{seed}|{tier}|', CAST(o_orderkey AS VARCHAR(20)), '|', CAST(o_custkey AS VARCHAR(20)))")} AS rank_digest FROM orders),
s AS (SELECT stratum, sum(count(*)) OVER (ORDER BY stratum) - count(*) AS earlier, sum(count(*)) OVER () AS total FROM x GROUP BY stratum),
p AS (SELECT x.id, x.stratum, CAST(s.earlier + row_number() OVER (PARTITION BY x.stratum ORDER BY x.rank_digest, x.id) - 1 AS BIGINT) AS place, CAST(s.total AS DOUBLE) / {count} AS step FROM x JOIN s ON x.stratum = s.stratum),
c AS (SELECT *, ceil(place / step - {start!r}E0) AS i FROM p)
SELECT id, stratum, place FROM c WHERE step <= 1 OR {drawn}"""


# The reference's patterns ignore case by Unicode: a letter class also takes these four, and words end by Unicode letters and digits.
LETTER, WORD, SPACE = "A-Za-z\\x{130}\\x{131}\\x{17F}\\x{212A}", "\\p{L}\\p{N}_", "[\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
SAFE_NAME_COLUMNS = ("artifact_name", "feature_name", "file_name", "filename", "metric_name", "model_name")
SAFE_EIGHT_DIGIT_COLUMNS = ("date", "diagnostic_seed", "judgment_date", "locked_seed", "observation_date", "run_seed", "sample_seed", "seed", "snapshot_date")
EXACT_IDENTIFIER_COLUMNS = ("id", "rt_id", "judgment_id", "case_id", "company_id", "company_name", "company_number", "company_postcode", "defendant_name", "defendant_company_name", "defendant_trading_name", "defendant_postcode", "trading_name", "matched_name", "matched_company_name", "matched_company_number", "address", "postcode")
#: Identifiers that the caller of a scan knows; ASCII, so lower case is their case folding.
KNOWN_IDENTIFIERS = ("Quaystone-7731", "Case 0042/B")


def _word(text: str) -> str:
    """A word in either case; I also matches the dotless and the dotted letter, as in the reference."""
    return "".join(f"[{c}{c.lower()}{'\\x{130}\\x{131}' if c == 'I' else ''}]" for c in text)


def _between(pattern: str, inside: str) -> str:
    return f"(^|[^{inside}])(?:{pattern})(\\z|[^{inside}])"


_NUMBER = f"[{LETTER}]{{2}}\\p{{Nd}}{{6}}"
POSTCODE = _between(f"{_word('GIR')}{SPACE}?0[Aa][Aa]|[{LETTER}][{LETTER}]?\\p{{Nd}}[{LETTER}\\p{{Nd}}]?{SPACE}?\\p{{Nd}}[{LETTER}]{{2}}", f"{LETTER}0-9")
LETTERED_NUMBER = _between(_NUMBER, f"{LETTER}0-9")
PREFIXED_NUMBER = _between(f"(?:{_word('COMPANY')}|{_word('CO')}){SPACE}*(?:{_word('NUMBER')}|{_word('NO')}[.]?)(?:{SPACE}|[:#-])*(?:{_NUMBER}|\\p{{Nd}}{{8}})", WORD)
NUMERIC_VALUE = f"^{SPACE}*\\p{{Nd}}{{8}}{SPACE}*\\z"
#: The last word before the suffix decides whether a name of 1 to 10 words is there, so this finds what the reference's repetition finds, in linear time.
COMPANY_NAME = _between(f"[{LETTER}0-9]+[&.\\x{{27}}\\x{{2019}}()/-]*{SPACE}+(?:{'|'.join(map(_word, ('LTD', 'LIMITED', 'PLC', 'LLP')))})", WORD)

#: What every match of the patterns above holds; cheap to look for, so most texts are spared the rest.
SIX_DIGITS, POSTCODE_END = "\\p{Nd}{6}", f"\\p{{Nd}}[{LETTER}][{LETTER}]"
NAME_END = f"{SPACE}(?:{'|'.join(map(_word, ('LTD', 'LIMITED', 'PLC', 'LLP')))})"


def among(x: str, values: tuple[str, ...]) -> str:
    return f"{x} IN ({', '.join(f"'{v}'" for v in values)})"


def canon_column(d, x: str) -> str:
    x = d.replace_all(f"lower(trim({x}))", "[^a-z0-9]+", "_")
    return d.replace_all(x, "^_+|_+$", "")


def identifier_column(d, key: str) -> str:
    """Whether a heading, as canon_column gives it, names a column of identifying values."""
    has = lambda part: f"{key} LIKE '%{part}%'"
    names = f"({has('company')} AND ({has('name')} OR {has('number')})) OR ({has('defendant')} AND {has('name')}) OR ({has('trading')} AND {has('name')})"
    return f"(NOT {among(key, SAFE_NAME_COLUMNS)} AND ({among(key, EXACT_IDENTIFIER_COLUMNS)} OR {has('postcode')} OR {has('address')} OR ({d.matches(key, '_id$')} AND NOT {among(key, ('model_id', 'run_id'))}) OR {names}))"


def identifier_flags(d, text: str, cell: str, key: str) -> str:
    """One flag for each finding kind of K8: of a whole text, and of one CSV cell under a heading."""
    number = " OR ".join(d.matches(text, p) for p in (LETTERED_NUMBER, PREFIXED_NUMBER, NUMERIC_VALUE))
    numeric_cell = f"({d.matches(cell, NUMERIC_VALUE)} AND NOT {among(key, SAFE_EIGHT_DIGIT_COLUMNS)})"
    known = " OR ".join(f"contains(lower({text}), '{k.lower()}')" for k in KNOWN_IDENTIFIERS)
    return f"""({d.matches(text, POSTCODE_END)} AND {d.matches(text, POSTCODE)}) AS postcode, (({d.matches(text, SIX_DIGITS)} AND ({number})) OR {numeric_cell}) AS company_number,
({d.matches(text, NAME_END)} AND {d.matches(text, COMPANY_NAME)}) AS company_name, ({known}) AS known_identifier, {identifier_column(d, key)} AS identifier_column"""


def identifier_scan(d) -> str:
    """Whole texts, each followed by what the survey plants by expression, with a heading and a cell beside it."""
    plants = ((3, "AB1 2CD"), (5, "gir 0aa"), (7, "sc123456"), (11, "Company No: 01234567"), (13, "alpha beta ltd"), (17, "QUAYSTONE-7731"))
    planted = ", ".join(f"CASE WHEN doc_id % {n} = 0 THEN ' {p} ' ELSE '' END" for n, p in plants)
    heads = " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(("Company Name", "metric_name", "run_id", "Postcode area", "Judgment-ID", "Observation Date", "share")))
    return f"""SELECT doc_id, {identifier_flags(d, 'body', 'cell', 'head')} FROM (SELECT doc_id, body, cell, {canon_column(d, 'raw_head')} AS head FROM
(SELECT doc_id, concat(coalesce(text, ''), {planted}) AS body, CASE WHEN doc_id % 2 = 0 THEN lpad(CAST(doc_id AS VARCHAR(20)), 8, '0') ELSE '' END AS cell, CASE doc_id % 7 {heads} END AS raw_head FROM documents) x) y"""


def group_split(d) -> str:
    """G4: companies by digest inside four strata of the median age (right-closed at 12, 24 and 36 months of 30.4375 days), cut by floors plus largest remainders, ties in split order. Ranks are counted by digest prefix, so no task sorts a whole stratum."""
    splits = " UNION ALL ".join(f"SELECT {k} AS k, '{name}' AS split, {share}E0 AS share" for k, (name, share) in enumerate((("train", 0.6), ("validation", 0.15), ("calibration", 0.1), ("test", 0.15))))
    return f"""WITH a AS (SELECT o_custkey, {d.median(d.days(OBSERVED, DAY))} AS age, {d.sha("concat('20260619', chr(0), CAST(o_custkey AS VARCHAR(20)))")} AS digest FROM orders GROUP BY o_custkey),
c AS (SELECT o_custkey, digest, substr(digest, 1, 2) AS prefix, CASE WHEN age <= 365.25E0 THEN 0 WHEN age <= 730.5E0 THEN 1 WHEN age <= 1095.75E0 THEN 2 ELSE 3 END AS stratum FROM a),
b AS (SELECT stratum, prefix, sum(count(*)) OVER (PARTITION BY stratum ORDER BY prefix) - count(*) AS earlier FROM c GROUP BY stratum, prefix),
g AS (SELECT stratum, n, k, split, share * n AS exact, floor(share * n) AS least FROM (SELECT stratum, count(*) AS n FROM c GROUP BY stratum) s CROSS JOIN ({splits}) f),
t AS (SELECT stratum, k, split, least + CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY exact - least DESC, k) <= n - sum(least) OVER (PARTITION BY stratum) THEN 1 ELSE 0 END AS size FROM g),
u AS (SELECT stratum, split, sum(size) OVER (PARTITION BY stratum ORDER BY k) - size AS low, sum(size) OVER (PARTITION BY stratum ORDER BY k) AS high FROM t),
r AS (SELECT /*+ BROADCAST(b) */ c.o_custkey, c.stratum, b.earlier + row_number() OVER (PARTITION BY c.stratum, c.prefix ORDER BY c.digest, c.o_custkey) - 1 AS place FROM c JOIN b ON c.stratum = b.stratum AND c.prefix = b.prefix)
SELECT /*+ BROADCAST(u) */ r.o_custkey, u.split FROM r JOIN u ON r.stratum = u.stratum AND r.place >= u.low AND r.place < u.high"""


PLANS: dict[str, Callable] = {
    "name_normalize": lambda d: f"SELECT number, {name(d, 'raw_name')} AS normalized_name, {name(d, "concat(raw_name, CASE number % 4 WHEN 0 THEN ' T/A Beta' WHEN 1 THEN ' trading  as Beta Ltd' WHEN 2 THEN ', formerly Beta' ELSE ' Formerlys' END)")} AS normalized_alias FROM ({companies(d)}) x",
    "postcode_normalize": lambda d: f"SELECT c_custkey, {d.replace_all("upper(coalesce(concat(c_mktsegment, ' - ', c_name), ''))", '[^A-Z0-9]+', '')} AS postcode FROM customer",
    "coded_values": lambda d: f"SELECT o_orderkey, {STATUS} AS status FROM orders",
    "amount_parse": lambda d: f"SELECT o_orderkey, {amount(d, 'raw')} AS amount, trim(raw) <> '' AND {amount(d, 'raw')} IS NULL AS invalid FROM (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'bad' WHEN 1 THEN concat('(', CAST(o_orderkey AS VARCHAR(20)), ')') WHEN 2 THEN concat(' (£', CAST(o_orderkey AS VARCHAR(20)), ',000.50) ') WHEN 3 THEN ' ' ELSE concat('£', CAST(o_orderkey AS VARCHAR(20)), ',000') END AS raw FROM orders) x",
    "bucket_amount": lambda d: "SELECT CASE WHEN o_totalprice IS NULL THEN 'amount_missing' WHEN o_totalprice < 500 THEN 'under_500' WHEN o_totalprice < 1000 THEN '500_999' WHEN o_totalprice < 5000 THEN '1000_4999' WHEN o_totalprice < 25000 THEN '5000_24999' ELSE '25000_plus' END AS band, count(*) AS n FROM orders GROUP BY 1",
    "bucket_lag": lambda d: f"SELECT CASE WHEN lag < 0 THEN 'before_judgment' WHEN lag < 1 THEN 'same_day' WHEN lag < 2 THEN 'one_day' WHEN lag < 6 THEN '2_to_5_days' WHEN lag < 31 THEN '6_to_30_days' ELSE '31_plus_days' END AS band, count(*) AS n FROM (SELECT {d.days('CAST(l_shipdate AS DATE)', DAY)} AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x GROUP BY 1",
    "bucket_age": lambda d: f"SELECT CASE WHEN m > 1 AND m <= 12 THEN 'over_1_to_12' WHEN m > 12 AND m <= 24 THEN 'over_12_to_24' WHEN m > 24 AND m <= 36 THEN 'over_24_to_36' WHEN m > 36 AND m <= 48 THEN 'over_36_to_48' ELSE 'outside_or_missing' END AS band, count(*) AS n FROM (SELECT {d.days(OBSERVED, DAY)} / 30.4375 AS m FROM orders) x GROUP BY 1",
    "lag_and_age": lambda d: f"SELECT l_orderkey, l_linenumber, CAST({d.days('CAST(l_shipdate AS DATE)', DAY)} AS BIGINT) AS lag_days, CAST({d.days(OBSERVED, DAY)} AS BIGINT) AS age_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "name_periods": name_periods,
    "systematic_sample": systematic_sample,
    "linkage_unique_exact": lambda d: linked(d) + "SELECT id, matched, place, postcode_agrees, reason, candidates FROM m",
    "linkage_reasons": lambda d: linked(d) + "SELECT reason, count(*) AS n, round(count(*) * 1.0E0 / sum(count(*)) OVER (), 9) AS share FROM m GROUP BY reason",
    "linkage_guards": lambda d: linked(d) + "SELECT CAST(sum(CASE WHEN matched IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN candidates > 1 THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous, count(DISTINCT matched) AS companies FROM m",
    "match_by_type": lambda d: linked(d) + "SELECT type, matched IS NOT NULL AS accepted, count(*) AS n FROM m GROUP BY 1, 2",
    "match_by_vintage": lambda d: linked(d) + "SELECT CAST(extract(YEAR FROM day) AS BIGINT) AS judgment_year, matched IS NOT NULL AS accepted, count(*) AS n FROM m GROUP BY 1, 2",
    "match_coverage": lambda d: linked(d) + "SELECT t.tier, coalesce(a.n, 0) AS n FROM (SELECT 'exact_unique' AS tier UNION ALL SELECT 'unmatched') t LEFT JOIN (SELECT CASE WHEN matched IS NULL THEN 'unmatched' ELSE 'exact_unique' END AS tier, count(*) AS n FROM m GROUP BY 1) a ON t.tier = a.tier",
    "semi_join_candidates": lambda d: "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "company_dedup_conflicts": lambda d: "SELECT number, count(*) AS copies, count(DISTINCT name) AS names FROM (SELECT s_suppkey AS number, s_name AS name FROM supplier UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN concat(s_name, 'X') ELSE s_name END FROM supplier WHERE s_suppkey % 2 = 0) x GROUP BY number",
    "constraint_violations": lambda d: f"SELECT CAST(sum(CASE WHEN CAST(l_shipdate AS DATE) < {DAY} THEN 1 ELSE 0 END) AS BIGINT) AS early, CAST(sum(CASE WHEN {DAY} > {OBSERVED} THEN 1 ELSE 0 END) AS BIGINT) AS future, CAST(sum(CASE WHEN o_orderstatus = 'F' AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS status_conflicts FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "stratified_hash_sample": lambda d: f"SELECT stratum, id, rank_digest FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY rank_digest, id) AS r FROM (SELECT o_orderkey AS id, concat('reason=', o_orderstatus, '|judgment_year=', CAST(extract(YEAR FROM {DAY}) AS VARCHAR(4))) AS stratum, {d.sha("concat('20260618|unmatched|', 'reason=', o_orderstatus, '|judgment_year=', CAST(extract(YEAR FROM o_orderdate) AS VARCHAR(4)), '|', CAST(o_orderkey AS VARCHAR(20)), '|')")} AS rank_digest FROM orders) x) y WHERE r <= 10",
    "stratum_metadata_check": lambda d: "SELECT o_orderpriority AS stratum, count(*) AS population_n, CAST(least(count(*), 50) AS BIGINT) AS sample_n, round(least(count(*), 50) * 1.0E0 / count(*), 9) AS inclusion_probability, round(count(*) * 1.0E0 / least(count(*), 50), 9) AS sampling_weight FROM orders GROUP BY 1",
    "wilson_by_stratum": lambda d: "SELECT quality, n, round((p + 1.92072941E0 / n - 1.95996398E0 * sqrt(p * (1 - p) / n + 0.960364705E0 / (n * n))) / (1 + 3.84145882E0 / n), 6) AS low, round((p + 1.92072941E0 / n + 1.95996398E0 * sqrt(p * (1 - p) / n + 0.960364705E0 / (n * n))) / (1 + 3.84145882E0 / n), 6) AS high FROM (SELECT quality, count(*) AS n, avg(CAST(toxic AS DOUBLE)) AS p FROM labels GROUP BY quality) x",
    "weighted_prevalence": lambda d: "SELECT round(sum(n * p) / sum(n), 9) AS prevalence FROM (SELECT d.lang, count(*) AS n, avg(CAST(toxic AS DOUBLE)) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang) x",
    "reviewer_agreement_kappa": lambda d: "SELECT arm, n, round(agreement, 9) AS agreement, CASE WHEN abs(1 - e) < 1E-12 THEN NULL ELSE round((agreement - e) / (1 - e), 9) END AS kappa FROM (SELECT CASE WHEN grouping(arm) = 1 THEN 'overall' ELSE CAST(arm AS VARCHAR(20)) END AS arm, count(*) AS n, avg(CASE WHEN a = b THEN 1E0 ELSE 0E0 END) AS agreement, avg(CAST(a AS DOUBLE)) * avg(CAST(b AS DOUBLE)) + (1 - avg(CAST(a AS DOUBLE))) * (1 - avg(CAST(b AS DOUBLE))) AS e FROM (SELECT quality AS arm, toxic AS a, CASE WHEN doc_id % 9 = 0 THEN 1 - toxic ELSE toxic END AS b FROM labels) x GROUP BY GROUPING SETS ((arm), ())) y",
    "cohort_filter_funnel": lambda d: f"SELECT count(*) AS all_rows, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS BIGINT) AS labelled, CAST(sum(CASE WHEN o_orderstatus <> 'P' AND {DAY} >= CAST({OBSERVED} - INTERVAL '48' MONTH AS DATE) AND {DAY} < CAST({OBSERVED} - INTERVAL '1' MONTH AS DATE) THEN 1 ELSE 0 END) AS BIGINT) AS in_window FROM orders",
    "age_basis_features": lambda d: f"SELECT o_orderkey, round(m, 9) AS months, round(power(m / 48, 2), 9) AS squared, round(power(m / 48, 3), 9) + 0E0 AS cubed, {', '.join(f'round(power(greatest(m - {k}, 0) / 48, 3), 9) AS knot{k}' for k in (12, 24, 36))} FROM (SELECT o_orderkey, {d.days(OBSERVED, DAY)} / (365.25E0 / 12) AS m FROM orders) x",
    "amount_features": lambda d: "SELECT o_orderkey, round(ln(1 + greatest(coalesce(o_totalprice, 0), 0)), 9) AS log_amount, CASE WHEN o_totalprice IS NULL OR o_totalprice < 0 THEN 1 ELSE 0 END AS amount_missing FROM orders",
    "prior_history_24m": lambda d: f"SELECT o_orderkey, CAST(count(*) OVER w - count(*) OVER p AS BIGINT) AS prior_n, round(coalesce(sum(o_totalprice) OVER w, 0) - coalesce(sum(o_totalprice) OVER p, 0), 2) AS prior_value FROM (SELECT *, {DAY} AS day FROM orders) x WINDOW w AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN INTERVAL '24' MONTH PRECEDING AND CURRENT ROW), p AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN CURRENT ROW AND CURRENT ROW)",
    "days_since_prior": lambda d: f"SELECT o_orderkey, CAST(CASE WHEN prior >= {d.days(f"CAST(day - INTERVAL '24' MONTH AS DATE)", "DATE '1990-01-01'")} THEN n - prior END AS BIGINT) AS days_since FROM (SELECT *, max(n) OVER (PARTITION BY o_custkey ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (SELECT o_orderkey, o_custkey, {DAY} AS day, {d.days(DAY, "DATE '1990-01-01'")} AS n FROM orders) x) y",
    "group_split": group_split,
    "label_mask": lambda d: "SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END END AS label FROM orders",
    "audit_marginals": lambda d: "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))",
    "population_comparison": lambda d: "SELECT c_mktsegment, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS positives, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1E0 ELSE 0E0 END), 9) AS rate, count(DISTINCT o_custkey) AS companies FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_mktsegment), ())",
    "auc_brier_logloss": lambda d: scored(d) + "SELECT round((sum(CASE WHEN y = 1 THEN mid ELSE 0 END) - sum(y) * (sum(y) + 1) / 2E0) / (sum(y) * (count(*) - sum(y))), 9) AS auc, round(avg((p - y) * (p - y)), 9) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 9) AS log_loss FROM (SELECT s.*, t.mid FROM s JOIN (SELECT p, sum(count(*)) OVER (ORDER BY p) - (count(*) - 1) / 2E0 AS mid FROM s GROUP BY p) t ON s.p = t.p) x",
    "average_precision": lambda d: scored(d) + "SELECT round(sum(hits * tp * 1E0 / n) / sum(hits), 9) AS ap FROM (SELECT sum(y) AS hits, sum(sum(y)) OVER (ORDER BY p DESC) AS tp, sum(count(*)) OVER (ORDER BY p DESC) AS n FROM s GROUP BY p) x",
    "capacity_metrics": lambda d: scored(d) + f"SELECT f AS fraction, k, hits, round(hits * 1E0 / k, 9) AS rate, CASE WHEN positives > 0 THEN round(hits * 1E0 / k / (positives * 1E0 / n), 9) END AS lift, CASE WHEN positives > 0 THEN round(hits * 1E0 / positives, 9) END AS recall FROM (SELECT f, k, n, positives, CAST(sum(CASE WHEN r <= k THEN y ELSE 0 END) AS BIGINT) AS hits FROM (SELECT y, row_number() OVER (ORDER BY p DESC, doc_id) AS r FROM s) x CROSS JOIN (SELECT f, n, positives, CAST(greatest(1, ceil(n * f)) AS BIGINT) AS k FROM (SELECT count(*) AS n, sum(y) AS positives FROM s) t CROSS JOIN ({' UNION ALL '.join(f'SELECT {f}E0 AS f' for f in (0.01, 0.02, 0.05, 0.1, 0.2))}) g) h GROUP BY f, k, n, positives) z",
    "reliability_table": lambda d: scored(d) + "SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(CAST(y AS DOUBLE)), 9) AS rate FROM (SELECT p, y, ntile(10) OVER (ORDER BY p, doc_id) AS bin FROM s) x GROUP BY bin",
    "small_cell_suppression": lambda d: "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x WHERE NOT (n > 0 AND n < 10)",
    "identifier_scan": identifier_scan,
    "union_missing_columns": lambda d: "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
    "impute_scale": lambda d: f"SELECT o_orderkey, round((coalesce(o_totalprice, md) - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS z FROM orders JOIN (SELECT {d.median('o_totalprice')} AS md, avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM orders) s ON true",
}


def own_views(spark: SparkSession, sf_dir: str, text: str) -> str:
    """The text over views of names of their own, so that a user's views stay; read by Spark alone."""
    for name in TABLES:
        if re.search(rf"\b(FROM|JOIN) {name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"quaystone_{name}")
            text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 quaystone_{name}", text)
    return text.replace("VARCHAR(20)", "STRING").replace("VARCHAR(4)", "STRING")


def _query(plan: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(own_views(spark, sf_dir, plan(Spark)))


QUERIES = {key: _query(plan) for key, plan in PLANS.items()}
ORACLES = {key: plan(Duck) for key, plan in PLANS.items()}
