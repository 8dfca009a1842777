"""One query per operator over the test tables, and the SQL that DuckDB runs to check it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import extract as X
from kinfold.functions import normal as N
from kinfold.operators import merge as M
from kinfold.operators import resolve as R
from kinfold.operators import score as S
from kinfold.plans import project as P
from kinfold.plans.person_view import PERSON, person, records
from kinfold.plans.schema import validate_documents
from kinfold.session import materialise, table, tables_dir
from kinfold.sources import records as SRC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = 2026 * 12 + 1


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


WITH = f"WITH person AS ({PERSON})"
#: SQL of the normalisers, independent of the Column versions.
EMAIL = "CASE WHEN regexp_full_match(lower(trim(email_raw)), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}') THEN lower(trim(email_raw)) ELSE '' END"
PHONE = "CASE WHEN length(regexp_replace(phone_raw, '[^0-9]', '', 'g')) = 10 THEN '+1' || regexp_replace(phone_raw, '[^0-9]', '', 'g') ELSE '' END"
CAP = "upper(left(w, 1)) || lower(substr(w, 2))"
NAME = f"array_to_string(list_transform(list_filter(regexp_split_to_array(trim(full_name), '\\s+'), lambda w: w <> ''), lambda w: {CAP}), ' ')"
LINK = "CASE WHEN linkedin_raw <> '' THEN lower(regexp_extract(linkedin_raw, '^([A-Za-z]+://[^/]*)', 1)) || regexp_replace(regexp_extract(linkedin_raw, '^[A-Za-z]+://[^/]*([^?#]*)', 1), '/+$', '') ELSE '' END"
SITE = "CASE WHEN portfolio_raw = '' THEN '' WHEN portfolio_raw LIKE 'http%' THEN 'http://site.example.org' || rtrim(substr(portfolio_raw, 24), '/') ELSE 'https://' || portfolio_raw END"
SKILL = "CASE skill_raw WHEN 'JS' THEN 'JavaScript' WHEN 'data analysis' THEN 'Data Analysis' WHEN 'golang' THEN 'Go' WHEN 'k8s' THEN 'Kubernetes' ELSE upper(left(skill_raw, 1)) || lower(substr(skill_raw, 2)) END"
COUNTRY = "CASE country WHEN 'usa' THEN 'US' WHEN 'U.K.' THEN 'GB' WHEN 'United Kingdom' THEN 'GB' WHEN 'fra' THEN 'FR' WHEN 'Germany' THEN 'DE' ELSE '' END"
MONTH = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(left(start_raw, 3)))"
START = f"CASE WHEN start_raw = '' THEN '' WHEN start_raw LIKE '%-%' THEN left(start_raw, 7) WHEN start_raw LIKE '%/%' THEN right(start_raw, 4) || '-' || lpad(split_part(start_raw, '/', 1), 2, '0') ELSE right(start_raw, 4) || '-' || lpad(CAST({MONTH} AS VARCHAR), 2, '0') END"
END = "CASE WHEN end_raw = 'Present' THEN 'present' ELSE end_raw END"
ORD = "((6 - priority) * 100000000000 + rec_idx)"
BASE = "CASE source WHEN 'recruiter_csv' THEN 0.90 WHEN 'ats_json' THEN 0.80 WHEN 'linkedin' THEN 0.65 WHEN 'github' THEN 0.55 END"
WITH_ALL = f"""WITH person AS ({PERSON}), n AS (
 
  SELECT *, {EMAIL} AS email, {PHONE} AS phone, {NAME} AS name, {LINK} AS linkedin, {SITE} AS portfolio, {SKILL} AS skill, {COUNTRY} AS cc, {START} AS start_, {END} AS end_, {ORD} AS ord
  FROM person
)"""


# --- scalar functions ------------------------------------------------------------------------


@query(f"{WITH} SELECT rec_idx, {EMAIL} AS email FROM person")
def norm_email(spark, sf_dir):
    return person(spark, sf_dir).select("rec_idx", N.email(F.col("email_raw")).alias("email"))


#: Phone numbers in many shapes and what they are, by customer.
RAW_PHONES = ["(555) 123-4567", "+44 20 7946 0958", "+999 123 456 789", "1-555-123-4567", "011 49 30 901820", "555.123.4567 ext. 12", "+1 555 123 456", "+91 98765 43210", "12", "+33 1 42 68 53 00", "garbage", ""]
PHONES = ["+15551234567", "+442079460958", "", "+15551234567", "+4930901820", "+15551234567", "", "+919876543210", "", "+33142685300", "", ""]


@query(f"{WITH} SELECT rec_idx, {PHONE} AS phone, {PHONES}[rec_idx % {len(PHONES)} + 1] AS other FROM person WHERE source = 'recruiter_csv'")
def norm_phone(spark, sf_dir):
    shapes = F.get(F.array(*map(F.lit, RAW_PHONES)), (F.col("rec_idx") % len(RAW_PHONES)).cast("int"))
    return person(spark, sf_dir).where("source = 'recruiter_csv'").select("rec_idx", N.phone(F.col("phone_raw")).alias("phone"), N.phone(shapes).alias("other"))


RAW_COUNTRIES = ["usa", " U.K. ", "United Arab Emirates", "de", "FRA", "Brazil", "Neverland", "england", "JPN", "Kenya", "X", "", "Czech Republic", "Republic of Korea", "Federal Republic of Germany", "Kingdom of Spain", "Viet Nam"]
COUNTRY_CODES = ["US", "GB", "AE", "DE", "FR", "BR", "", "GB", "JP", "KE", "", "", "CZ", "KR", "DE", "ES", "VN"]


@query(f"SELECT n_nationkey, {RAW_COUNTRIES}[n_nationkey % 17 + 1] AS raw, {COUNTRY_CODES}[n_nationkey % 17 + 1] AS country FROM nation")
def norm_country(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, RAW_COUNTRIES)), F.col("n_nationkey") % 17)
    return table(spark, sf_dir, "nation").select("n_nationkey", raw.alias("raw"), N.country(raw).alias("country"))


@query(f"""{WITH} SELECT rec_idx, strftime(o_orderdate, '%Y-%m') AS start_month, CASE WHEN end_raw = 'Present' THEN 'present' ELSE end_raw END AS end_month
  FROM person JOIN orders ON rec_idx = 1000000000 + o_orderkey""")
def norm_date(spark, sf_dir):
    return person(spark, sf_dir).where("source = 'ats_json'").select("rec_idx", N.date(F.col("start_raw")).alias("start_month"), N.date(F.col("end_raw")).alias("end_month"))


@query(f"""{WITH}, s AS (SELECT rec_idx, {SKILL} AS skill FROM person WHERE skill_raw <> '' UNION ALL
  SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: {CAP}), ' ') FROM part) SELECT * FROM s""")
def norm_skill(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rec_idx"), F.col("p_name").alias("skill_raw"))
    return person(spark, sf_dir).where("skill_raw <> ''").select("rec_idx", "skill_raw").unionByName(parts).select("rec_idx", N.skill(F.col("skill_raw")).alias("skill"))


@query(f"{WITH} SELECT rec_idx, {NAME} AS name FROM person WHERE full_name <> ''")
def norm_name(spark, sf_dir):
    return person(spark, sf_dir).where("full_name <> ''").select("rec_idx", N.name(F.col("full_name")).alias("name"))


@query("""SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) ||
  regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '(\\?[^#]*)', 1) AS url FROM pages""")
def norm_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.url(F.col("url")).alias("url"))


# --- text extraction -------------------------------------------------------------------------

WORD = "\\pL\\p{Mn}\\p{Mc}\\p{Nd}\\p{Nl}_"


def _firsts(items: str, key: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position(list_transform({items}, lambda y: {key.format('y')}), {key.format('x')}) = i)"


@query(f"""SELECT doc_id, array_to_string(e, '|') AS emails, len(e) AS n
  FROM (SELECT doc_id, {_firsts(f'''regexp_extract_all(text, '[{WORD}.+-]+@[{WORD}-]+[.][{WORD}.-]+')''', 'lower({0})')} AS e FROM documents)""")
def extract_emails(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", X.emails(F.coalesce("text", F.lit(""))).alias("e"))
    return e.select("doc_id", F.array_join("e", "|").alias("emails"), F.size("e").cast("long").alias("n"))


_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_PHONES = f"list_filter(list_transform(regexp_extract_all(text, '\\+?[0-9][0-9\\s().-]{{7,15}}'), lambda p: regexp_replace(p, '\\s+$', '')), lambda p: length({_DIGITS.format('p')}) BETWEEN 7 AND 15)"


@query(f"""SELECT doc_id, array_to_string(e, '|') AS phones, len(e) AS n FROM (SELECT doc_id, {_firsts('a', _DIGITS)} AS e FROM (SELECT doc_id, {_PHONES} AS a
  FROM documents))""")
def extract_phones(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", X.phones(F.coalesce("text", F.lit(""))).alias("e"))
    return e.select("doc_id", F.array_join("e", "|").alias("phones"), F.size("e").cast("long").alias("n"))


_URLS = """list_filter(list_transform(regexp_extract_all(body, 'https?://[^\\s,;"''<>)]+'), lambda u: regexp_replace(u, '[.,;:)]+$', '')), lambda u: NOT
  regexp_matches(lower(u), 'linkedin\\.com|github\\.com'))"""
#: Shared input: pages with profile links appended to some.
PROFILE_TEXT = "concat(url, ' ', html, CASE WHEN page_id % 3 = 0 THEN concat(' www.linkedin.com/in/user-', page_id, ' ') ELSE '' END, CASE WHEN page_id % 4 = 0 THEN concat(' https://github.com/dev', page_id, '/ ', url, '.') ELSE '' END)"


@query(f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('https://www.linkedin.com/in/user-', page_id) ELSE '' END AS linkedin,
  CASE WHEN page_id % 4 = 0 THEN concat('https://github.com/dev', page_id, '/') ELSE '' END AS github,
coalesce(u[1], '') AS portfolio, len(list_distinct(u[2:])) AS n_other FROM (SELECT page_id, {_URLS} AS u FROM (SELECT page_id, {PROFILE_TEXT} AS body
  FROM pages))""")
def extract_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{PROFILE_TEXT} AS body").select("page_id", X.links(F.col("body")).alias("x"))
    return rows.select("page_id", "x.linkedin", "x.github", "x.portfolio", F.size("x.other").cast("long").alias("n_other"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block_no, b AS block
  FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS b FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x:
  regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS l FROM documents)) WHERE b <> ''""")
def block_split(spark, sf_dir):
    ruled = F.regexp_replace("text", "\n", "\n---\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.blocks(ruled)).alias("i", "block")).select("doc_id", F.col("i").cast("long").alias("block_no"), "block")


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS part_no,
  CASE role WHEN 'user' THEN 'summary' WHEN 'assistant' THEN 'work experience' ELSE 'skills' END AS name, text AS body FROM conversations""")
def section_split(spark, sf_dir):
    head = F.expr("CASE role WHEN 'user' THEN 'SUMMARY' WHEN 'assistant' THEN 'Work Experience:' ELSE '## Skills' END")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat(head, F.lit("\n"), F.col("text")).alias("t")).alias("x"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select("conv_id", F.array_join("x.t", "\n").alias("t"))
    return whole.select("conv_id", F.posexplode(X.sections(F.col("t"))).alias("i", "s")).select("conv_id", F.col("i").cast("long").alias("part_no"), F.regexp_replace("s.name", "^#+ ", "").alias("name"), "s.body")


@query("""SELECT doc_id, coalesce(list_filter(l, lambda x: x <> '' AND length(x) <= 60 AND length(regexp_replace(x, '[^\\pL]', '', 'g')) >= 0.6 * length(x)
  AND NOT regexp_matches(x, '@|\\+?[0-9][0-9\\s().-]{7,15}|https?://[^\\s]')
AND NOT
  regexp_matches(lower(x), 'experience|employment|career\\s+history|work\\s+history|education|academic|degree|qualification|skills|technologies|tech(nical)?\\s+stack|competenc(ies|y)|tools?\\s+(&|and)\\s+tech|programming\\s+languages|proficienc(ies|y)'))[1], '') AS name
FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS l FROM documents)""")
def first_name_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_name_line(F.coalesce("text", F.lit(""))).alias("name"))


#: A start as written in a résumé and as read; these and other parts vary by customer.
STARTS = {"Jan 2019": "2019-01", "February 2019": "2019-02", "03/2019": "2019-03", "April 2019": "2019-04", "Sep 2019": "2019-09", "2019": "2019"}


def _by_customer(values) -> str:
    return f"CASE c_custkey % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_PAIR, _START, _READ, _DEGREE = (_by_customer(list(x)) for x in ([" | ", " at ", " @ "], STARTS, STARTS.values(), ["BS", "MS", "PhD"]))
#: Shared input: one résumé and one note per customer.
RESUME = f"""concat(upper(c_name), chr(10), 'cust', c_custkey, '@example.com', chr(10), 'Springfield, IL', chr(10), 'Experience', chr(10), 'Engineer', {_PAIR}, 'Acme ', c_custkey % 7, ' | ', {_START}, ' - 03/2021', chr(10), '- built things', chr(10),
CASE WHEN c_custkey % 2 = 0 THEN concat('Lead | Beta ', c_custkey % 5, ' 2015 - 2018', chr(10)) ELSE '' END, 'Education', chr(10), 'State University - ', {_DEGREE}, ' in Physics', chr(10), '2010 - 2014', chr(10), 'Skills', chr(10), '• JS, golang',
  CASE WHEN c_custkey % 2 = 0 THEN '; k8s' ELSE '' END, chr(10), 'Data Analysis')"""
NOTE = "concat('Candidate: Ann Lee', chr(10), 'Works at Acme ', c_custkey % 7, '. Knows JS', CASE WHEN c_custkey % 2 = 0 THEN ' and golang' ELSE '' END, '. ', c_custkey % 20, ' years of experience. Based in ', CASE WHEN c_custkey % 3 = 0 THEN 'Lyon' ELSE 'Paris' END, ', FR. Title: Senior Clerk', chr(10), 'Email: a', c_custkey, '@x.org Phone: 555-123-4567')"


@query(f"""SELECT c_custkey, 'Engineer' AS title_1, concat('Acme ', c_custkey % 7) AS company_1, {_READ} AS start_1, '2021-03' AS end_1, 'built things' AS summary_1,
  CASE WHEN c_custkey % 2 = 0 THEN 'Lead' END AS title_2,
CASE WHEN c_custkey % 2 = 0 THEN concat('Beta ', c_custkey % 5) END AS company_2, CASE WHEN c_custkey % 2 = 0 THEN '2015' END AS start_2,
  CAST(2 - c_custkey % 2 AS BIGINT) AS n FROM customer""")
def resume_experience(spark, sf_dir):
    jobs = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{RESUME} AS t").select("c_custkey", X.experience_list(X.section(X.sections(F.col("t")), SRC.V.IS_EXPERIENCE)).alias("j"))
    at = lambda i, f: F.get("j", i)[f].alias(f"{f}_{i + 1}")
    return jobs.select("c_custkey", at(0, "title"), at(0, "company"), at(0, "start"), at(0, "end"), at(0, "summary"), at(1, "title"), at(1, "company"), at(1, "start"), F.size("j").cast("long").alias("n"))


@query(f"""SELECT c_custkey, 'State University' AS institution, {_DEGREE} AS degree, 'Physics' AS field, '2010' AS end_year,
  CASE WHEN c_custkey % 2 = 0 THEN 'JS, golang|k8s|Data Analysis' ELSE 'JS|golang|Data Analysis' END AS skills, 'Springfield' AS city, 'IL' AS region
  FROM customer""")
def resume_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{RESUME} AS t").withColumn("s", X.sections(F.col("t")))
    one = F.get(X.education_list(X.section(F.col("s"), SRC.V.IS_EDUCATION)), 0)
    place = X.resume_place(F.col("t"))
    return parts.select("c_custkey", *[one[f].alias(f) for f in ("institution", "degree", "field", "end_year")], F.array_join(X.skill_list(X.section(F.col("s"), SRC.V.IS_SKILLS)), "|").alias("skills"), place["city"].alias("city"), place["region"].alias("region"))


@query("""SELECT c_custkey, 'Ann Lee' AS name, concat('Acme ', c_custkey % 7) AS company, CASE WHEN c_custkey % 2 = 0 THEN 'JS|golang' ELSE 'JS' END AS skills,
  CAST(c_custkey % 20 AS DOUBLE) AS years,
 
  CASE WHEN c_custkey % 3 = 0 THEN 'Lyon' ELSE 'Paris' END AS city, 'FR' AS region, 'Senior Clerk' AS title, concat('a', c_custkey, '@x.org') AS email, '555-123-4567' AS phone
  FROM customer""")
def note_fields(spark, sf_dir):
    t = F.col("t")
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{NOTE} AS t")
    return rows.select("c_custkey", X.note_name(t).alias("name"), F.get(X.note_companies(t), 0).alias("company"), F.array_join(X.note_skills(t), "|").alias("skills"), X.note_years(t).alias("years"), X.note_place(t)["city"].alias("city"), X.note_place(t)["region"].alias("region"), X.note_title(t).alias("title"), F.get(X.emails(t), 0).alias("email"), F.get(X.phones(t), 0).alias("phone"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) AS place, role AS lang FROM (SELECT conv_id, role, count(*) AS n
  FROM conversations WHERE role <> '' GROUP BY 1, 2)""")
def lang_rank(spark, sf_dir):
    """A conversation's roles as the languages of repositories."""
    repos = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.lit("r").alias("name"), F.col("role").alias("language"))).alias("repos"))
    ranked = repos.select("conv_id", F.posexplode(SRC.languages(F.col("repos"))).alias("i", "lang"))
    return ranked.select("conv_id", (F.col("i") + 1).cast("long").alias("place"), "lang")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place, x AS line
  FROM (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS k
  FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
  WHERE k = 1""")
def ordered_dedup(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.distinct_by(F.split("text", "\n", -1), F.lower)).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("place"), "line")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k,
  CASE event_id % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN json_extract_string(props, '$.k') ELSE 'x;y|z' END AS items FROM events""")
def string_or_list(spark, sf_dir):
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN '[\"a\", \" b \", \"\"]' WHEN 1 THEN get_json_object(props, '$.k') ELSE 'x;y , z,' END")
    m = SRC._lower_keys(F.from_json(F.regexp_replace("props", '"k"', '"K"'), SRC.MAP))
    return table(spark, sf_dir, "events").select("event_id", SRC._pick(m, ["none", "k"]).alias("k"), F.array_join(SRC._strings(raw), "|").alias("items"))


# --- records and resolution ------------------------------------------------------------------


@query("""SELECT 'recruiter_csv' AS source, 6 AS priority, concat('Cust ', c_custkey) AS full_name, concat('c', c_custkey, '@x.org') AS emails,
  CASE WHEN c_custkey % 3 = 0 THEN 'js|go' ELSE '' END AS skills, '' AS company, CASE WHEN c_custkey % 2 = 0 THEN
  CAST(c_custkey % 20 AS DOUBLE) END AS years FROM customer
UNION ALL SELECT 'ats_json', 5, n_name, concat('n', n_nationkey, '@x.org'), 'a|b c', 'Acme', CAST(n_nationkey AS DOUBLE) FROM nation
UNION ALL
  SELECT 'recruiter_notes', 1, concat('Ann ', chr(65 + r_regionkey), 'lee'), concat('r', r_regionkey, '@x.org'), 'JS|golang', concat('Acme ', r_regionkey),
  CAST(r_regionkey + 2 AS DOUBLE) FROM region""")
def union_sources(spark, sf_dir):
    """Test tables written as source files of three kinds (the spreadsheet as a folder of files) and loaded together."""
    folder = f"{tables_dir(spark)}/sources-{uuid.uuid4().hex}"
    sheet = table(spark, sf_dir, "customer").selectExpr(
        "concat('Cust ', c_custkey) AS `Candidate Name`", "concat('c', c_custkey, '@x.org') AS `E-Mail`", "CASE WHEN c_custkey % 3 = 0 THEN 'js|go' ELSE '' END AS Skills", "CASE WHEN c_custkey % 2 = 0 THEN concat(c_custkey % 20, '+') ELSE '' END AS YOE"
    )
    sheet.repartition(3).write.option("header", "true").option("emptyValue", "").csv(f"{folder}/csv")
    people = table(spark, sf_dir, "nation").selectExpr("named_struct('candidate_name', n_name, 'Email_Address', concat('n', n_nationkey, '@x.org'), 'skills', array('a', ' b c '), 'current_company', 'Acme', 'yoe', n_nationkey) AS x")
    people.agg(F.to_json(F.collect_list("x"))).coalesce(1).write.text(f"{folder}/json")  # 25 nations
    note = "concat('Candidate: Ann ', chr(65 + r_regionkey), 'lee\\nWorks at Acme ', r_regionkey, '. Knows JS and golang. ', r_regionkey + 2, ' years of experience.\\nEmail: r', r_regionkey, '@x.org')"
    notes = table(spark, sf_dir, "region").selectExpr(f"{note} AS t")
    notes.agg(F.array_join(F.collect_list("t"), "\n---\n")).coalesce(1).write.text(f"{folder}/notes")
    found = SRC.load(spark, {"recruiter_csv": f"{folder}/csv", "ats_json": f"{folder}/json", "recruiter_notes": [f"{folder}/notes"]})
    return found.select("source", "priority", "full_name", F.array_join("emails", "|").alias("emails"), F.array_join("skills", "|").alias("skills"), F.col("current_company").alias("company"), F.col("years_experience").alias("years"))


@query(f"{WITH} SELECT rec_idx FROM person WHERE full_name <> '' OR email_raw <> '' OR phone_raw <> ''")
def identity_filter(spark, sf_dir):
    return SRC.identified(records(spark, sf_dir)).select("rec_idx")


SIGNALS = """s AS (
  SELECT 'email' AS sig_type, email AS sig_value, rec_idx FROM n WHERE email <> '' UNION SELECT 'phone', phone, rec_idx FROM n WHERE phone <> ''
  UNION SELECT 'linkedin', linkedin, rec_idx FROM n WHERE linkedin <> '' UNION SELECT 'name', lower(name), rec_idx FROM n WHERE name <> ''
)"""


@query(f"{WITH_ALL}, {SIGNALS} SELECT * FROM s")
def signals_unpivot(spark, sf_dir):
    return R.signals(R.normalised(records(spark, sf_dir)))


@query(f"""{WITH_ALL}, {SIGNALS} SELECT src, rec_idx AS dst, sig_type AS via FROM (SELECT *, min(rec_idx) OVER (PARTITION BY sig_type, sig_value) AS src FROM s
  WHERE sig_type <> 'name') WHERE src <> rec_idx""")
def star_edges(spark, sf_dir):
    return R.star_edges(R.signals(R.normalised(records(spark, sf_dir))))


def _closure(edges: str) -> str:
    return f"""{edges}, both_ AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT x, y FROM both_ UNION SELECT r.x, b.y FROM r JOIN both_ b ON r.y = b.x),
low AS (SELECT x, least(x, min(y)) AS c FROM r GROUP BY x)"""


RECURSIVE = WITH_ALL.replace("WITH person", "WITH RECURSIVE person", 1)
#: Conflict-free pairs of one name, pair by pair; for small names.
PAIRS = f"""{RECURSIVE}, e AS (
  SELECT a.rec_idx AS x, b.rec_idx AS y FROM n a JOIN n b ON lower(a.name) = lower(b.name) AND a.name <> '' AND a.rec_idx < b.rec_idx
  WHERE NOT (a.email <> '' AND b.email <> '' AND a.email <> b.email) AND NOT (a.phone <> '' AND b.phone <> '' AND a.phone <> b.phone)
  AND NOT (a.linkedin <> '' AND b.linkedin <> '' AND a.linkedin <> b.linkedin)
)"""


@query(f"{_closure(PAIRS)} SELECT x AS node, c AS component FROM low")
def name_links(spark, sf_dir):
    """Components under conflict-free name pairs; names here share no exact key, so the links are complete."""
    from kinfold.operators.components import connected_components

    return connected_components(R.name_edges(R.normalised(records(spark, sf_dir))), "src", "dst")


#: Records with equal identity collapse to one node, so that the closure stays small.
COMPONENTS = f"""{RECURSIVE}, ident AS (SELECT email, phone, linkedin, lower(name) AS nm, min(rec_idx) AS id FROM n GROUP BY ALL),
e AS (SELECT a.id AS x, b.id AS y FROM ident a JOIN ident b ON a.id < b.id AND a.email = b.email AND a.email <> ''
  UNION SELECT a.id, b.id FROM ident a JOIN ident b ON a.id < b.id AND a.phone = b.phone AND a.phone <> ''
  UNION SELECT a.id, b.id FROM ident a JOIN ident b ON a.id < b.id AND a.linkedin = b.linkedin AND a.linkedin <> ''
  UNION SELECT a.id, b.id FROM ident a JOIN ident b ON a.id < b.id AND a.nm = b.nm AND a.nm <> ''
    AND NOT (a.email <> '' AND b.email <> '' AND a.email <> b.email) AND NOT (a.phone <> '' AND b.phone <> '' AND a.phone <> b.phone)
  AND NOT (a.linkedin <> '' AND b.linkedin <> '' AND a.linkedin <> b.linkedin))"""
CLUSTERS = f"{_closure(COMPONENTS)}, clusters AS (SELECT n.rec_idx, CASE WHEN n.email = '' AND n.phone = '' AND n.linkedin = '' AND n.name = '' THEN n.rec_idx ELSE coalesce(low.c, i.id) END AS cluster_id FROM n JOIN ident i ON n.email = i.email AND n.phone = i.phone AND n.linkedin = i.linkedin AND lower(n.name) = i.nm LEFT JOIN low ON low.x = i.id)"


@query(f"{CLUSTERS} SELECT * FROM clusters")
def components(spark, sf_dir):
    return R.assign_clusters(records(spark, sf_dir).drop("cluster_id")).select("rec_idx", "cluster_id")


@query(f"{CLUSTERS} SELECT cluster_id, count(*) AS n FROM clusters GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return components(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("n"))


# --- merging ---------------------------------------------------------------------------------


@query(f"{WITH} SELECT grp AS cluster_id, rec_idx, row_number() OVER (PARTITION BY grp ORDER BY priority DESC, source_file, rec_idx) AS rank FROM person")
def priority_rank(spark, sf_dir):
    return R.ranked(records(spark, sf_dir)).select("cluster_id", "rec_idx", F.col("rank").cast("long").alias("rank"))


def _pick(value: str, when: str) -> str:
    return f"arg_min({value}, ord) FILTER (WHERE {when})"


@query(f"""{WITH_ALL}
 
  SELECT grp AS cluster_id, {_pick('name', "name <> ''")} AS name, {_pick('source', "name <> ''")} AS name_source, {_pick('trim(headline)', "trim(headline) <> ''")} AS headline, arg_min(source, ord) AS top
  FROM n GROUP BY grp""")
def priority_scalar(spark, sf_dir):
    return M.scalars(records(spark, sf_dir)).select("cluster_id", F.col("name.value").alias("name"), F.col("name.source").alias("name_source"), F.col("headline.value").alias("headline"), "top")


@query(f"""{WITH_ALL}
 
  SELECT grp AS cluster_id, {_pick('trim(city)', "city <> '' OR country <> ''")} AS city, {_pick('cc', "city <> '' OR country <> ''")} AS country, {_pick('source', "city <> '' OR country <> ''")} AS source
  FROM n GROUP BY grp""")
def priority_struct(spark, sf_dir):
    return M.scalars(records(spark, sf_dir)).select("cluster_id", "location.value.city", "location.value.country", "location.source")


@query(f"""{WITH_ALL}
 
  SELECT grp AS cluster_id, {_pick('linkedin', "linkedin <> ''")} AS linkedin, {_pick('portfolio', "portfolio <> ''")} AS portfolio, {_pick('source', "portfolio <> ''")} AS portfolio_source
  FROM n GROUP BY grp""")
def links_merge(spark, sf_dir):
    return M.links(records(spark, sf_dir)).select("cluster_id", F.col("linkedin.value").alias("linkedin"), F.col("portfolio.value").alias("portfolio"), F.col("portfolio.source").alias("portfolio_source"))


def _union(column: str, raw: str) -> str:
    return f"""{WITH_ALL}, u AS (SELECT grp, {column} AS v, min(ord) AS o, arg_min(source, ord) AS s FROM n WHERE {column} <> '' GROUP BY ALL)
SELECT grp AS cluster_id, string_agg(v, '|' ORDER BY v) AS merged, string_agg(s, '|' ORDER BY o) AS origins FROM u GROUP BY grp"""


@query(_union("email", "email_raw"))
def email_union(spark, sf_dir):
    return M.collected(records(spark, sf_dir), "emails").select("cluster_id", F.array_join("emails.values", "|").alias("merged"), F.array_join("emails.origins.source", "|").alias("origins"))


@query(_union("phone", "phone_raw"))
def phone_union(spark, sf_dir):
    return M.collected(records(spark, sf_dir), "phones").select("cluster_id", F.array_join("phones.values", "|").alias("merged"), F.array_join("phones.origins.source", "|").alias("origins"))


CONF = "round(least(1.0, CAST({0} AS DECIMAL(5,4)) * (1 + 0.1 * ({1} - 1))), 4)"


@query(f"""{WITH_ALL}, k AS (SELECT grp, skill, count(DISTINCT source) AS m, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max({BASE}) AS b FROM n
  WHERE skill_raw <> '' GROUP BY ALL)
SELECT grp AS cluster_id, skill, sources, CAST({CONF.format('b', 'm')} AS DOUBLE) AS confidence FROM k""")
def skill_union(spark, sf_dir):
    each = M.collected(records(spark, sf_dir), "skills").select("cluster_id", F.inline("skills"))
    return each.select("cluster_id", F.col("name").alias("skill"), F.array_join("sources", ",").alias("sources"), F.col("confidence").cast("double").alias("confidence"))


JOBS = "x AS (SELECT grp, md5(lower(trim(company)) || '|' || lower(trim(title)) || '|' || start_raw) AS key, arg_min(trim(company), ord) FILTER (WHERE trim(company) <> '') AS company, arg_min(trim(title), ord) FILTER (WHERE trim(title) <> '') AS title, arg_min(start_, ord) FILTER (WHERE start_ <> '') AS s, arg_min(end_, ord) FILTER (WHERE end_ <> '') AS e FROM n WHERE company <> '' GROUP BY ALL)"


@query(f"""{WITH_ALL}, {JOBS} SELECT grp AS cluster_id, row_number() OVER (PARTITION BY grp ORDER BY s DESC, key) - 1 AS place, company,
  coalesce(title, '') AS title, s AS start, coalesce(e, '') AS end FROM x""")
def experience_dedup(spark, sf_dir):
    each = M.collected(records(spark, sf_dir), "experience").select("cluster_id", F.posexplode("experience").alias("place", "e"))
    return each.select("cluster_id", F.col("place").cast("long").alias("place"), "e.company", "e.title", "e.start", "e.end")


@query(f"""{WITH_ALL}, x AS (SELECT DISTINCT grp, school, degree, end_year, md5(lower(school) || '|' || lower(degree) || '|' || end_year) AS key FROM n
  WHERE school <> '') SELECT grp AS cluster_id, row_number() OVER (PARTITION BY grp
  ORDER BY end_year DESC, key) - 1 AS place, school AS institution, degree, end_year FROM x""")
def education_dedup(spark, sf_dir):
    each = M.collected(records(spark, sf_dir), "education").select("cluster_id", F.posexplode("education").alias("place", "e"))
    return each.select("cluster_id", F.col("place").cast("long").alias("place"), "e.institution", "e.degree", "e.end_year")


ISLANDS = """SELECT l_suppkey, CAST(sum(hi - lo) AS BIGINT) AS total FROM (
  SELECT l_suppkey, island, min(s) AS lo, max(e) AS hi FROM (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey
  ORDER BY s, e) AS island FROM (
    SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
      SELECT l_suppkey, year(l_shipdate) * 365 + dayofyear(l_shipdate) AS s, year(l_shipdate) * 365 + dayofyear(l_shipdate) +
  CAST(l_quantity AS INTEGER) % 4 - 1 AS e FROM lineitem) WHERE e >= s)) GROUP BY 1, 2) GROUP BY 1"""


@query(ISLANDS)
def interval_union(spark, sf_dir):
    day = F.year("l_shipdate") * 365 + F.dayofyear("l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("a"), (day + F.col("l_quantity").cast("int") % 4 - 1).alias("b"))
    longest = rows.groupBy("l_suppkey", "a").agg(F.max("b").alias("b"))  # at most a range for each day
    return longest.groupBy("l_suppkey").agg(M.covered(F.collect_list(F.struct("a", "b"))).alias("total")).where("total IS NOT NULL")


def _profiles(spark, sf_dir):
    """Scored profiles of the recipe's clusters. The records are a table of their own, as in the library's pipeline: two aggregations read it."""
    return S.score_profiles(M.merge_clusters(materialise(records(spark, sf_dir)), F.lit(AS_OF)))


_MONTHS = "CAST(left({0}, 4) AS INTEGER) * 12 + CAST(right({0}, 2) AS INTEGER)"
YEARS_TABLE = f"""{WITH_ALL}, {JOBS}, g AS (SELECT grp, {_MONTHS.format('s')} AS a,
  CASE WHEN e IS NULL OR e = 'present' THEN {AS_OF} ELSE {_MONTHS.format('e')} END AS b FROM x),
w AS (SELECT *, max(b) OVER (PARTITION BY grp ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g WHERE b >= a),
i AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY a, b) AS k FROM w),
t AS (SELECT grp, round_even(sum(hi - lo) / 12.0, 1) AS y FROM (SELECT grp, k, min(a) AS lo, max(b) AS hi FROM i GROUP BY ALL) GROUP BY grp),
given AS (SELECT grp, arg_min(years, ord) FILTER (WHERE years >= 0) AS y, arg_min(source, ord) FILTER (WHERE years >= 0) AS given_source FROM n GROUP BY grp),
years AS (SELECT given.grp, given_source, coalesce(given.y, t.y) AS y FROM given LEFT JOIN t USING (grp))"""
YEARS = f"{YEARS_TABLE} SELECT grp AS cluster_id, CAST(y AS DOUBLE) AS years FROM years"


@query(YEARS)
def years_resolved(spark, sf_dir):
    return _profiles(spark, sf_dir).select("cluster_id", F.col("years_experience").alias("years"))


# --- scores, lineage, projection -------------------------------------------------------------

#: Profile columns in SQL: one row per group.
PROFILE = f"""{WITH_ALL}, p AS (
  SELECT grp AS cluster_id, coalesce({_pick('name', "name <> ''")}, '') AS full_name, {_pick('source', "name <> ''")} AS name_source,
    coalesce({_pick('trim(headline)', "trim(headline) <> ''")}, '') AS headline, {_pick('source', "trim(headline) <> ''")} AS headline_source,
    {_pick('city', "city <> '' OR country <> ''")} AS city, {_pick('cc', "city <> '' OR country <> ''")} AS country, {_pick('source', "city <> '' OR country <> ''")} AS location_source,
    coalesce(list_sort(list(DISTINCT email) FILTER (WHERE email <> '')), []) AS emails,
  coalesce(list_sort(list(DISTINCT phone) FILTER (WHERE phone <> '')), []) AS phones,
    coalesce(list_sort(list(DISTINCT skill) FILTER (WHERE skill_raw <> '')), []) AS skills, arg_min(source, ord) AS top,
    count(*) FILTER (WHERE company <> '') AS jobs,
  count(*) FILTER (WHERE school <> '') AS studies, {_pick('linkedin', "linkedin <> ''")} AS linkedin, {_pick('source', "linkedin <> ''")} AS linkedin_source,
    {_pick('portfolio', "portfolio <> ''")} AS portfolio, {_pick('source', "portfolio <> ''")} AS portfolio_source
  FROM n GROUP BY grp
), em AS (SELECT grp, count(DISTINCT s) AS m, max(CASE s WHEN 'recruiter_csv' THEN 6 WHEN 'ats_json' THEN 5 WHEN 'linkedin' THEN 3 ELSE 2 END) AS pr
  FROM (SELECT grp, email, arg_min(source, ord) AS s FROM n WHERE email <> '' GROUP BY ALL) GROUP BY grp)"""
_BASE = "CASE {0} WHEN 'recruiter_csv' THEN 0.90 WHEN 'ats_json' THEN 0.80 WHEN 'linkedin' THEN 0.65 WHEN 'github' THEN 0.55 END"
FIELDS = f"""{PROFILE}, f AS (SELECT p.*, coalesce({_BASE.format('name_source')}, 0) AS c_name,
  coalesce(CASE pr WHEN 6 THEN 0.90 WHEN 5 THEN 0.80 WHEN 3 THEN 0.65 ELSE 0.55 END * (1 + 0.1 * (m - 1)), 0) AS c_emails,
  CASE WHEN len(phones) > 0 THEN 0.90 ELSE 0 END AS c_phones, CASE WHEN city <> '' OR country <> '' THEN
  coalesce({_BASE.format('location_source')}, 0) ELSE 0 END AS c_location,
  CASE WHEN len(skills) > 0 THEN {_BASE.format('top')} ELSE 0 END AS c_skills,
  CASE WHEN jobs > 0 THEN {_BASE.format('top')} ELSE 0 END AS c_experience,
  CASE WHEN studies > 0 THEN {_BASE.format('top')} ELSE 0 END AS c_education, coalesce({_BASE.format('headline_source')}, 0) AS c_headline FROM p LEFT
  JOIN em ON em.grp = p.cluster_id)"""


@query(f"""{FIELDS} SELECT cluster_id, CAST(least(1, c_name) AS DOUBLE) AS full_name, round(CAST(least(1, c_emails) AS DOUBLE), 4) AS emails,
  CAST(c_phones AS DOUBLE) AS phones, CAST(c_location AS DOUBLE) AS location, CAST(c_skills AS DOUBLE) AS skills,
CAST(c_experience AS DOUBLE) AS experience, CAST(c_education AS DOUBLE) AS education, CAST(c_headline AS DOUBLE) AS headline FROM f""")
def field_confidence(spark, sf_dir):
    return _profiles(spark, sf_dir).select("cluster_id", *[F.col(f"field_confidence.{f}").cast("double").alias(f) for f in SRC.V.FIELD_WEIGHTS])


@query(f"""{FIELDS} SELECT cluster_id,
 
  round(CAST(0.20 * c_name + 0.15 * least(1, c_emails) + 0.10 * c_phones + 0.10 * c_location + 0.15 * c_skills + 0.15 * c_experience + 0.10 * c_education + 0.05 * c_headline AS DOUBLE), 4) AS overall
  FROM f""")
def overall_confidence(spark, sf_dir):
    return _profiles(spark, sf_dir).select("cluster_id", F.col("overall_confidence").cast("double").alias("overall"))


@query(f"{PROFILE} SELECT cluster_id, left(sha256(array_to_string(list_append(emails, lower(full_name)), '|')), 16) AS candidate_id FROM p")
def candidate_id(spark, sf_dir):
    return _profiles(spark, sf_dir).select("cluster_id", "candidate_id")


@query(f"""{YEARS_TABLE.replace(WITH_ALL, PROFILE, 1)}, l AS (
  SELECT cluster_id, 'full_name' AS field, name_source AS source, full_name AS value FROM p WHERE full_name <> '' UNION ALL
  SELECT cluster_id, 'headline', headline_source, headline FROM p WHERE headline <> ''
  UNION ALL SELECT grp, 'emails', arg_min(source, ord), email FROM n WHERE email <> '' GROUP BY grp, email UNION ALL
  SELECT grp, 'phones', arg_min(source, ord), phone FROM n WHERE phone <> '' GROUP BY grp, phone
  UNION ALL SELECT cluster_id, 'links', linkedin_source, linkedin FROM p WHERE linkedin <> '' UNION ALL
  SELECT cluster_id, 'links', portfolio_source, portfolio FROM p WHERE portfolio <> ''
  UNION ALL
  SELECT cluster_id, 'location', location_source, '{{''city'': ''' || trim(city) || ''', ''region'': '''', ''country'': ''' || country || '''}}'
  FROM p WHERE location_source IS NOT NULL
  UNION ALL SELECT x.grp, 'experience', any_value(top), '[' || string_agg('''' || company || '''', ', ' ORDER BY s DESC, key) || ']' FROM x
  JOIN p ON p.cluster_id = x.grp GROUP BY x.grp
  UNION ALL SELECT q.grp, 'education', any_value(top), '[' || string_agg('''' || school || '''', ', ' ORDER BY end_year DESC, key) || ']'
  FROM (SELECT DISTINCT grp, school, end_year, md5(lower(school) || '|' || lower(degree) || '|' || end_year) AS key FROM n WHERE school <> '') q
  JOIN p ON p.cluster_id = q.grp GROUP BY q.grp
  UNION ALL SELECT grp, 'years_experience', coalesce(given_source, 'ats_json'), CAST(CAST(y AS DOUBLE) AS VARCHAR) FROM years WHERE y IS NOT NULL
  UNION ALL SELECT cluster_id, 'skills', top, '[' || array_to_string(list_transform(skills, lambda s: '''' || s || ''''), ', ') || ']' FROM p
  WHERE len(skills) > 0
) SELECT * FROM l""")
def provenance_long(spark, sf_dir):
    each = _profiles(spark, sf_dir).select("cluster_id", F.inline("provenance"))
    return each.select("cluster_id", "field", "source", F.col("normalized_value").alias("value"))


@query(f"""{PROFILE}, o AS (SELECT grp, count(DISTINCT s) AS n, arg_max(s,
  CASE s WHEN 'recruiter_csv' THEN 6 WHEN 'ats_json' THEN 5 WHEN 'linkedin' THEN 3 ELSE 2 END) AS best
  FROM (SELECT grp, email, arg_min(source, ord) AS s FROM n WHERE email <> '' GROUP BY ALL) GROUP BY grp) SELECT grp AS cluster_id, best, n FROM o""")
def corroboration(spark, sf_dir):
    by = _profiles(spark, sf_dir).select("cluster_id", S.corroboration(F.col("provenance"), "emails").alias("x"))
    return by.where("x.n > 0").select("cluster_id", "x.best", F.col("x.n").cast("long").alias("n"))


@query(f"""{PROFILE}, y AS (SELECT grp, arg_min(source, ord) FILTER (WHERE years >= 0) AS s FROM n GROUP BY grp), l AS (
  SELECT cluster_id, name_source AS s FROM p UNION SELECT cluster_id, headline_source FROM p UNION SELECT cluster_id, location_source FROM p UNION
  SELECT cluster_id, linkedin_source FROM p UNION SELECT cluster_id, portfolio_source FROM p
  UNION SELECT grp, arg_min(source, ord) FROM n WHERE email <> '' GROUP BY grp, email UNION SELECT grp, arg_min(source, ord) FROM n WHERE phone <> ''
  GROUP BY grp, phone UNION SELECT cluster_id, top FROM p WHERE jobs + studies + len(skills) > 0
  UNION SELECT grp, coalesce(s, CASE WHEN jobs > 0 THEN 'ats_json' END) FROM y JOIN p ON p.cluster_id = y.grp
) SELECT cluster_id, string_agg(s, ',' ORDER BY s) AS sources FROM l WHERE s IS NOT NULL GROUP BY 1""")
def distinct_sources(spark, sf_dir):
    return _profiles(spark, sf_dir).select("cluster_id", F.array_join(F.array_sort(F.array_distinct("provenance.source")), ",").alias("sources"))


def _projected(spark, sf_dir, **config):
    return P.project(_profiles(spark, sf_dir), P.ProjectionConfig.from_dict({"include_confidence": False, "include_provenance": False} | config), "cluster_id")


@query(f"""{PROFILE} SELECT cluster_id, nullif(full_name, '') AS who, emails[1] AS mail, nullif(country, '') AS land, phones[1] AS tel,
  CASE WHEN len(skills) > 0 THEN array_to_string(skills, '|') END AS skills FROM p""")
def project_paths(spark, sf_dir):
    out = _projected(spark, sf_dir, fields=[{"path": "who", "from": "full_name"}, {"path": "mail", "from": "emails[0]", "normalize": "lowercase"}, {"path": "land", "from": "location.country"}, {"path": "tel", "from": "phones[0]", "normalize": "E164"}, {"path": "skills", "from": "skills[].name", "normalize": "canonical"}])
    return out.withColumn("skills", F.array_join("skills", "|"))


@query(f"{PROFILE} SELECT cluster_id, CAST(NULL AS VARCHAR) AS nothing, phones[2] AS second_phone, nullif(upper(headline), '') AS headline FROM p")
def project_missing(spark, sf_dir):
    return _projected(spark, sf_dir, fields=[{"path": "nothing", "from": "no_such.field"}, {"path": "second_phone", "from": "phones[1]"}, {"path": "headline", "normalize": "uppercase"}], on_missing="null")


@query(f"{PROFILE} SELECT cluster_id, nullif(full_name, '') AS person_name, nullif(headline, '') AS headline FROM p")
def project_rename(spark, sf_dir):
    return _projected(spark, sf_dir, fields=["full_name", "headline"], rename={"full_name": "person_name"})


@query(f"""{PROFILE} SELECT cluster_id, full_name, array_to_string(emails, '|') AS emails, array_to_string(phones, '|') AS phones, coalesce(city, '') AS city,
  coalesce(country, '') AS country, coalesce(linkedin, '') AS linkedin, '' AS github,
  coalesce(portfolio, '') AS portfolio, headline, len(skills) AS n_skills FROM p""")
def default_projection(spark, sf_dir):
    out = _projected(spark, sf_dir)
    return out.select("cluster_id", "full_name", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), "location.city", "location.country", "links.linkedin", "links.github", "links.portfolio", "headline", F.size("skills").cast("long").alias("n_skills"))


@query(f"""{FIELDS}, m AS (SELECT grp, count(DISTINCT email) FILTER (WHERE email <> '') + count(DISTINCT phone) FILTER (WHERE phone <> '') AS k FROM n
  GROUP BY grp)
SELECT cluster_id, nullif(full_name, '') AS full_name,
  round(CAST(0.20 * c_name + 0.15 * least(1, c_emails) + 0.10 * c_phones + 0.10 * c_location + 0.15 * c_skills + 0.15 * c_experience + 0.10 * c_education + 0.05 * c_headline AS DOUBLE), 4) AS overall, k AS n_contacts
  FROM f JOIN m ON m.grp = cluster_id""")
def project_toggles(spark, sf_dir):
    """Chosen fields with confidence and lineage switched on."""
    out = _projected(spark, sf_dir, fields=["full_name"], include_confidence=True, include_provenance=True)
    contacts = F.filter("provenance", lambda p: p["field"].isin("emails", "phones"))
    return out.select("cluster_id", "full_name", F.col("overall_confidence").cast("double").alias("overall"), F.size(contacts).cast("long").alias("n_contacts"))


@query(f"""{PROFILE}
 
  SELECT cluster_id, '{{' || array_to_string(list_filter(['\"name\":\"' || nullif(full_name, '') || '\"', '\"tel\":\"' || phones[1] || '\"'], lambda x: x IS NOT NULL), ',') || '}}' AS document
  FROM p""")
def project_omit(spark, sf_dir):
    config = P.ProjectionConfig.from_dict({"fields": [{"path": "name", "from": "full_name"}, {"path": "tel", "from": "phones[0]"}], "on_missing": "omit", "include_confidence": False, "include_provenance": False})
    return P.documents(P.project(_profiles(spark, sf_dir), config, "cluster_id"), config, "cluster_id")


@query(f"""{PROFILE}, v AS (SELECT cluster_id, list_filter([CASE WHEN cluster_id % 5 = 0 THEN 'Value at ''candidate_id'' is too short (minimum length: 1)' END,
  CASE WHEN cluster_id % 7 = 0 THEN 'Value at ''overall_confidence'': 1.5000 is greater than the maximum of 1.0' END,
 
  CASE WHEN cluster_id % 11 = 0 AND len(skills) > 0 THEN 'Value at ''skills[0].name'' is too short (minimum length: 1)' END], lambda x: x IS NOT NULL) AS e
  FROM p) SELECT cluster_id, array_to_string(e, '; ') AS errors, len(e) AS n FROM v""")
def validate_profiles(spark, sf_dir):
    """Violations are put into the profiles first."""
    bad_skill = F.transform("skills", lambda s, i: F.struct(F.when((i == 0) & (F.col("cluster_id") % 11 == 0), F.lit("")).otherwise(s["name"]).alias("name"), s["confidence"].alias("confidence"), s["sources"].alias("sources")))
    broken = _profiles(spark, sf_dir).withColumns({"candidate_id": F.when(F.col("cluster_id") % 5 == 0, F.lit("")).otherwise(F.col("candidate_id")), "overall_confidence": F.when(F.col("cluster_id") % 7 == 0, F.lit("1.5").cast("decimal(5,4)")).otherwise(F.col("overall_confidence")), "skills": bad_skill})
    return broken.select("cluster_id", P.validation_errors(broken).alias("e")).select("cluster_id", F.array_join("e", "; ").alias("errors"), F.size("e").cast("long").alias("n"))


#: A caller's schema for chosen fields; some profiles break it.
CALLERS_SCHEMA = {"type": "object", "required": ["who", "mail"], "properties": {"who": {"type": "string"}, "tel": {"type": "string", "pattern": "^[+]15550000[01]"}, "mail": {"type": "string", "format": "email", "maxLength": 20}}, "additionalProperties": False}


@query(f"""{PROFILE}, v AS (SELECT cluster_id, list_filter([CASE WHEN full_name = '' THEN 'Missing required field at ''$'': ''who'' is a required property' END,
  CASE WHEN len(emails) = 0 THEN 'Missing required field at ''$'': ''mail'' is a required property' END,
  CASE WHEN headline <> '' THEN 'Validation error at ''$'': Additional properties are not allowed (''more'' was unexpected)' END,
  CASE WHEN length(emails[1]) > 20 THEN 'Validation error at ''mail'': ''' || emails[1] || ''' is too long' END,
  CASE WHEN NOT
  regexp_matches(phones[1], '^[+]15550000[01]') THEN 'Validation error at ''tel'': ''' || phones[1] || ''' does not match ''^[+]15550000[01]''' END], lambda x: x IS NOT NULL) AS e
  FROM p)
SELECT cluster_id, array_to_string(list_sort(e), '; ') AS errors, len(e) AS n FROM v""")
def validate_schema(spark, sf_dir):
    """JSON documents of chosen fields against a caller's JSON Schema."""
    fields = [{"path": "who", "from": "full_name"}, {"path": "mail", "from": "emails[0]"}, {"path": "tel", "from": "phones[0]"}, {"path": "more", "from": "headline"}]
    config = P.ProjectionConfig.from_dict({"fields": fields, "on_missing": "omit", "include_confidence": False, "include_provenance": False})
    checked = validate_documents(P.documents(P.project(_profiles(spark, sf_dir), config, "cluster_id"), config, "cluster_id"), CALLERS_SCHEMA)
    errors = F.array_sort(F.coalesce("_validation_errors", F.array().cast("array<string>")))
    return checked.select("cluster_id", F.array_join(errors, "; ").alias("errors"), F.size(errors).cast("long").alias("n"))


#: PROFILE, FIELDS and YEARS over the clusters that resolution finds, not over the recipe's own groups.
RESOLVED = f"{CLUSTERS}, m AS (SELECT n.* REPLACE (clusters.cluster_id AS grp) FROM n JOIN clusters USING (rec_idx))" + (FIELDS.removeprefix(WITH_ALL) + YEARS_TABLE.removeprefix(WITH_ALL)).replace("FROM n ", "FROM m ")


@query(f"""{RESOLVED}
  SELECT f.cluster_id, left(sha256(array_to_string(list_append(emails, lower(full_name)), '|')), 16) AS candidate_id, full_name, array_to_string(emails, '|') AS emails, array_to_string(phones, '|') AS phones,
  CAST(y AS DOUBLE) AS years_experience, len(skills) AS n_skills, coalesce(n_jobs, 0) AS n_experience,
  CASE WHEN full_name <> '' THEN 1 ELSE 0 END + len(emails) + len(phones) + CASE WHEN location_source IS NOT NULL THEN 1 ELSE 0 END +
  CASE WHEN linkedin IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN portfolio IS NOT NULL THEN 1 ELSE 0 END
    + CASE WHEN headline <> '' THEN 1 ELSE 0 END + CASE WHEN n_jobs > 0 THEN 1 ELSE 0 END + CASE WHEN studies > 0 THEN 1 ELSE 0 END +
  CASE WHEN len(skills) > 0 THEN 1 ELSE 0 END + CASE WHEN y IS NOT NULL THEN 1 ELSE 0 END AS n_provenance,
 
  round(CAST(0.20 * c_name + 0.15 * least(1, c_emails) + 0.10 * c_phones + 0.10 * c_location + 0.15 * c_skills + 0.15 * c_experience + 0.10 * c_education + 0.05 * c_headline AS DOUBLE), 4) AS overall_confidence
FROM f LEFT JOIN (SELECT grp, count(*) AS n_jobs FROM x GROUP BY grp) j ON j.grp = f.cluster_id LEFT JOIN years ON years.grp = f.cluster_id""")
def full_pipeline(spark, sf_dir):
    """Resolve, merge, score and project the person records; the flagship."""
    clustered = materialise(R.assign_clusters(records(spark, sf_dir).drop("cluster_id")))
    scored = S.score_profiles(M.merge_clusters(clustered, F.lit(AS_OF)))
    out = P.project(scored, P.ProjectionConfig(), "cluster_id")
    return out.select("cluster_id", "candidate_id", "full_name", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), "years_experience", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("skills", "experience", "provenance")], F.col("overall_confidence").cast("double").alias("overall_confidence"))
