"""The record schema, and the readers of every source kind: path(s) -> records without rec_idx.

Files are read by Spark's readers only, so any store that Spark reaches will do.
"""

from __future__ import annotations

import csv
import logging
import re
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO, StringIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import extract as X
from kinfold.functions import normal as N
from kinfold.functions import values as V

log = logging.getLogger(__name__)

PLACE = "struct<city:string,region:string,country:string>"
LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
FIELDS = {
    "full_name": "string",
    "emails": "array<string>",
    "phones": "array<string>",
    "location": PLACE,
    "links": LINKS,
    "headline": "string",
    "years_experience": "double",
    "current_company": "string",
    "skills": "array<string>",
    "experience": X.EXPERIENCE,
    "education": X.EDUCATION,
}


def as_records(df: DataFrame, source: str, order: list[str], **fields: Column) -> DataFrame:
    """Records of one source: missing fields empty. `order`: columns that give the order within the source."""
    empty = {"string": F.lit(""), "double": F.lit(None), PLACE: F.lit(None), LINKS: F.lit(None)}
    columns = [F.coalesce(fields[n].cast(t), empty[t]) if n in fields and t == "string" else (fields[n] if n in fields else empty.get(t, F.array())).cast(t) for n, t in FIELDS.items()]
    return df.select(F.lit(source).alias("source"), F.lit(V.SOURCES[source][0]).alias("priority"), F.col("source_file"), F.array(*[F.col(c).cast("long") for c in order]).alias("at"), *[c.alias(n) for c, n in zip(columns, FIELDS, strict=True)])


def identified(df: DataFrame, phones: bool = True) -> DataFrame:
    """Rows with a name, an e-mail or (`phones`) a phone."""
    ok = (F.col("full_name") != "") | (F.size("emails") > 0)
    return df.where(ok | (F.size("phones") > 0) if phones else ok)


def files_of(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that paths, folders and globs name, in order, as the file system writes them. A path that names nothing raises."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = list(fs.globStatus(path) or [])
        if not found:
            raise FileNotFoundError(p)
        for status in found:
            inner = [x for x in fs.listStatus(status.getPath()) if x.isFile()] if status.isDirectory() else [status]
            out += sorted(n for x in inner if (n := x.getPath().toString()) and (status.isFile() or x.getPath().getName()[0] not in "._"))
    return out


def _head(spark: SparkSession, file: str, n: int) -> bytes:
    """The first n bytes of a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, body): each file's text, UTF-8 or else Latin-1, without a byte order mark."""
    raw = spark.read.format("binaryFile").load(paths)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    body = F.coalesce(utf8, F.decode("content", "ISO-8859-1"))
    return raw.select(F.col("path").alias("source_file"), F.regexp_replace(F.regexp_replace(body, "^\ufeff", ""), "\r\n?", "\n").alias("body"))


def _one(x: Column) -> Column:
    return F.filter(F.array(N.strip(x)), lambda v: v != "")


# --- delimited files -------------------------------------------------------------------------


def delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def header_columns(header: list[str]) -> dict[str, str]:
    """Canonical field -> this file's column, by alias."""
    plain = {}
    for c in header:
        plain.setdefault("_".join(c.strip().strip("\"'").lower().split()), c)
    return {f: plain[a] for f, aliases in V.CSV_HEADERS.items() for a in [next((a for a in aliases if a in plain), None)] if a}


#: Characters of a file that its delimiter is told from. Fixed value.
SAMPLE = 8192


def _latin(spark: SparkSession, files: list[str]) -> set[str]:
    """The files that are no UTF-8 throughout, by one scan of their lines."""
    lines = spark.read.text(files).where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("f")).distinct()
    return {r.f for r in lines.select(F.url_decode(F.regexp_replace("f", "[+]", "%2B")).alias("f")).collect()}


def read_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Recruiter spreadsheets: any of four delimiters, headers by alias, UTF-8 or else Latin-1, rows without identity left out.

    Files of one delimiter, header and encoding are one scan; each file's first row is its header.
    """
    files = files_of(spark, paths)
    latin = {_plain(f) for f in _latin(spark, files)} if files else set()
    alike: dict[tuple, list[str]] = {}
    for f in files:
        encoding = "ISO-8859-1" if _plain(f) in latin else "UTF-8"
        raw = _head(spark, f, 4 * SAMPLE)
        head = raw.decode(encoding, "ignore").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")[:SAMPLE]
        if head.strip():
            sep = delimiter(head)
            alike.setdefault((encoding, sep, tuple(next(csv.reader(StringIO(head), delimiter=sep)))), []).append(f)
    out = nothing(spark)
    for (encoding, sep, header), group in alike.items():
        schema = ", ".join(f"c{i} string" for i in range(len(header)))
        rows = spark.read.csv(group, sep=sep, header=True, enforceSchema=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", encoding=encoding, schema=schema)
        rows = rows.withColumns({"line": F.monotonically_increasing_id(), "source_file": F.url_decode(F.regexp_replace("_metadata.file_path", "[+]", "%2B"))})
        named = {f: F.col(f"c{header.index(c)}") for f, c in header_columns(list(header)).items()}
        get = lambda f: N.strip(named.get(f, F.lit("")))  # noqa: E731, B023
        links = F.when((get("linkedin") != "") | (get("github") != ""), F.struct(get("linkedin").alias("linkedin"), get("github").alias("github"), F.lit("").alias("portfolio"), F.array().cast("array<string>").alias("other")))
        part = as_records(
            _placed(rows, files), "recruiter_csv", ["path", "line"], full_name=get("full_name"), emails=_one(get("email")), phones=_one(get("phone")), location=N.place(get("location")), links=links,
            headline=get("title"), years_experience=N.number(get("years_experience"), plus=True), current_company=get("current_company"), skills=N.listed(get("skills"), ("|", ";", ",")),
        )
        out = out.unionByName(part)
    return identified(out)


def nothing(spark: SparkSession) -> DataFrame:
    fields = ", ".join(f"`{n}` {t}" for n, t in FIELDS.items())
    return spark.createDataFrame([], f"source string, priority int, source_file string, at array<long>, {fields}")


# --- JSON exports ----------------------------------------------------------------------------

MAP = "map<string,string>"


def _pick(m: Column, keys: list[str]) -> Column:
    """The value of the first key present (keys in any case), even if null."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(m, k.lower()), F.try_element_at(m, F.lit(k.lower()))).otherwise(out)
    return out


def _fall(m: Column, keys: list[str]) -> Column:
    """The first value that is not empty, null, false or zero."""
    return F.coalesce(*[F.when(~F.try_element_at(m, F.lit(k)).isin("", "null", "[]", "{}", "0", "0.0", "false"), F.try_element_at(m, F.lit(k))) for k in keys])


def _items(json: Column) -> Column:
    """Items of a JSON array as texts; null if it is no array."""
    return F.when(N.strip(json).startswith("["), F.from_json(json, "array<string>"))


def _contact(json: Column, keys: list[str]) -> Column:
    """Strings of a string, a list of strings, or a list of objects with one of `keys`."""
    one = lambda x: F.when(x.startswith("{"), N.strip(F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in keys]))).otherwise(N.strip(x))
    return F.coalesce(F.filter(F.transform(_items(json), one), lambda x: x != ""), F.when(~N.strip(json).startswith("{"), _one(json)), F.array().cast("array<string>"))


def _strings(json: Column) -> Column:
    return F.coalesce(F.filter(F.transform(_items(json), N.strip), lambda x: x != ""), N.listed(json, (",", ";", "|")))


def _objects(json: Column) -> Column:
    """Objects of a JSON array (or a single object) as maps."""
    s = N.strip(json)
    whole = F.when(s.startswith("["), s).when(s.startswith("{"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(F.lit("[]"))
    return F.transform(F.filter(F.from_json(whole, "array<string>"), lambda x: x.startswith("{")), lambda x: F.from_json(x, MAP))


def _lower_keys(m: Column) -> Column:
    """Keys in lower case; of keys that differ only in case the last counts."""
    pairs = F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return let_map(pairs)


def let_map(pairs: Column) -> Column:
    def of(p: Column) -> Column:
        keys = F.transform(p, lambda e: e["key"])
        last = F.filter(p, lambda e, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), e["key"]) == 0)
        return F.map_from_entries(last)

    return N.let(pairs, of)


def _entries(json: Column, keys: dict[str, list[str]], pick: Callable, dates: Callable | None = None, lower: bool = False) -> Column:
    def one(m: Column) -> Column:
        m = _lower_keys(m) if lower else m
        return F.struct(*[(dates(N.strip(pick(m, k))) if dates and n in ("start", "end") else N.strip(pick(m, k))).alias(n) for n, k in keys.items()])

    return F.transform(_objects(json), one)


def _place(json: Column, keys: dict[str, list[str]], pick: Callable, lower: bool = False) -> Column:
    m = F.from_json(json, MAP)
    at = F.struct(*[N.strip(pick(_lower_keys(m) if lower else m, k)).alias(n) for n, k in keys.items()])
    full = N.let(at, lambda p: F.when((p["city"] != "") | (p["region"] != "") | (p["country"] != ""), p))
    return F.when(N.strip(json).startswith("{"), full).when(~N.strip(json).startswith("["), N.place(json))


def _links(linkedin: Column, github: Column, portfolio: Column) -> Column:
    return F.struct(N.strip(linkedin).alias("linkedin"), N.strip(github).alias("github"), N.strip(portfolio).alias("portfolio"), F.array().cast("array<string>").alias("other"))


def read_ats(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Applicant-system exports: an object or an array of objects, keys by alias in any case. Invalid JSON raises."""
    body = N.strip(F.col("body"))
    checked = F.when(F.try_parse_json(body).isNull() | (body == ""), F.raise_error(F.concat(F.lit("invalid JSON in "), F.col("source_file")))).otherwise(body)
    rows = whole_files(spark, paths).select("source_file", F.posexplode(_objects(checked)).alias("i", "m")).withColumn("m", _lower_keys(F.col("m")))
    get = {n: _pick(F.col("m"), k) for n, k in V.ATS_KEYS.items()}
    links = _links(get["linkedin"], get["github"], get["portfolio"])
    some = N.let(links, lambda x: F.when((x["linkedin"] != "") | (x["github"] != "") | (x["portfolio"] != ""), x))
    out = as_records(
        _placed(rows, paths), "ats_json", ["path", "i"],
        full_name=N.first_of(N.strip(get["full_name"]), N.strip(F.concat_ws(" ", N.strip(get["first"]), N.strip(get["last"])))),
        emails=_contact(get["emails"], ["email", "address", "value"]), phones=_contact(get["phones"], ["phone", "number", "value"]), location=_place(get["location"], V.ATS_PLACE, _pick, True), links=some,
        headline=N.strip(get["headline"]), years_experience=N.number(get["years"]), current_company=N.strip(get["current_company"]), skills=_strings(get["skills"]),
        experience=_entries(get["experience"], V.ATS_EXPERIENCE, _pick, lower=True), education=_entries(get["education"], V.ATS_EDUCATION, _pick, lower=True),
    )
    return identified(out)


def _plain(file: str) -> str:
    """A file's name without the ways of writing its scheme."""
    return re.sub(r"^(\w+):/+", r"\1:/", file)


def _placed(rows: DataFrame, paths: list[str]) -> DataFrame:
    """With column `path`: the place of the row's source_file among the files that `paths` name."""
    files = [_plain(f) for f in files_of(rows.sparkSession, paths)]
    name = F.regexp_replace("source_file", r"^(\w+):/+", "$1:/")
    return rows.withColumn("path", F.array_position(F.array(*[F.lit(f) for f in files]), name))


def read_linkedin(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Profile dumps: one object per file, values falling through empty ones; anything else gives no record. URLs are not read."""
    paths = [p for p in paths if not p.lower().startswith(("http://", "https://"))]
    if not paths:
        return nothing(spark)
    rows = whole_files(spark, paths).where(F.try_parse_json(F.col("body")).isNotNull() & N.strip(F.col("body")).startswith("{"))
    rows = _placed(rows, paths).withColumn("m", F.from_json("body", MAP))
    get = {n: _fall(F.col("m"), k) for n, k in V.LINKEDIN_KEYS.items()}
    summary = N.strip(get["summary"])
    short = F.when(F.length(summary) > 200, F.concat(F.regexp_replace(F.substring(summary, 1, 200), r"(?U)\s+$", ""), F.lit("..."))).otherwise(summary)
    rows = rows.withColumn("jobs", _entries(get["experience"], V.LINKEDIN_EXPERIENCE, _fall, _profile_date))
    latest = F.get("jobs", 0)
    now = F.when(F.lower(latest["end"]).isin("present", "current", "now", ""), latest["company"])
    out = as_records(
        rows, "linkedin", ["path"],
        full_name=N.first_of(N.strip(get["full_name"]), N.strip(F.concat_ws(" ", N.strip(get["first"]), N.strip(get["last"])))),
        emails=_contact(get["emails"], ["none"]), phones=_contact(get["phones"], ["none"]), location=_place(get["location"], V.LINKEDIN_PLACE, _fall),
        links=_links(get["linkedin"], get["github"], get["portfolio"]), headline=N.first_of(N.strip(get["headline"]), short), years_experience=N.number(get["years"]),
        current_company=N.first_of(N.strip(get["current_company"]), F.coalesce(now, F.lit(""))), skills=_strings(get["skills"]), experience=F.col("jobs"), education=_entries(get["education"], V.LINKEDIN_EDUCATION, _fall),
    )
    return identified(out, phones=False)


def _profile_date(s: Column) -> Column:
    """A profile's date: YYYY-MM, YYYY, present, or what stands there."""
    pattern = r"^([A-Za-z]+)\s+(\d{4})$"
    year = F.regexp_extract(s, pattern, 2)
    return (
        F.when(F.lower(s).isin("present", "current", "now"), F.lit("present"))
        .when(year != "", F.concat_ws("-", year, N._lookup(V.MONTHS, F.lower(F.regexp_extract(s, pattern, 1)))))
        .when(s.rlike(r"^\d{4}-\d{2}"), F.substring(s, 1, 7)).otherwise(s)
    )


def languages(repos: Column) -> Column:
    """Languages of repositories, most frequent first, then by name."""
    every = F.filter(F.transform(repos, lambda r: F.coalesce(r["language"], F.lit(""))), lambda x: x != "")
    counted = N.let(every, lambda a: F.transform(F.array_distinct(a), lambda x: F.struct((-F.size(F.filter(a, lambda y: y == x))).alias("n"), x.alias("x"))))
    return F.transform(F.array_sort(counted), lambda c: c["x"])


def repository_names(repos: Column) -> Column:
    """Names of repositories that have one, in order."""
    return F.filter(F.transform(repos, lambda r: F.coalesce(r["name"], F.lit(""))), lambda x: x != "")


def read_github(spark: SparkSession, paths: list[str]) -> DataFrame:
    """User profiles with their repositories: cached files with one object each (invalid ones give no record), or user names, read from the live API."""
    files = [p for p in paths if "/" in p or "\\" in p or p.startswith(".") or p.lower().endswith(".json")]
    logins = [p for p in paths if p not in files]
    out = nothing(spark)
    if files:
        rows = whole_files(spark, files).where(F.try_parse_json(F.col("body")).isNotNull() & N.strip(F.col("body")).startswith("{"))
        rows = _placed(rows, files).withColumn("m", F.from_json("body", MAP))
        out = out.unionByName(_github_records(rows, F.try_element_at("m", F.lit("repos"))))
    if logins:
        from kinfold.sources.profile_api import read_profiles

        rows = read_profiles(spark, logins).withColumn("path", F.array_position(F.array(*[F.lit(p) for p in paths]), F.col("login")))
        out = out.unionByName(_github_records(rows.withColumns({"m": F.from_json("user", MAP), "source_file": F.col("login")}), F.col("repos")))
    return out


def _github_records(rows: DataFrame, repositories: Column) -> DataFrame:
    get = lambda k: N.strip(F.try_element_at("m", F.lit(k)))
    kind = "array<struct<name:string,language:string>>"
    page = N.first_of(get("html_url"), F.when(get("login") != "", F.concat(F.lit("https://github.com/"), get("login"))))
    return as_records(
        rows, "github", ["path"], full_name=N.first_of(get("name"), get("login")), emails=_one(get("email")), location=N.place(get("location")),
        links=_links(F.lit(""), page, get("blog")), headline=get("bio"), skills=languages(F.coalesce(F.from_json(repositories, kind), F.array().cast(kind))),
    )


# --- texts -----------------------------------------------------------------------------------


def resume_records(rows: DataFrame, source: str, paths: list[str]) -> DataFrame:
    """Records of (source_file, body) rows of résumé text."""
    rows = _placed(rows, paths).withColumn("parts", X.sections(F.col("body")))
    body = F.col("body")
    rows = rows.withColumns({"jobs": X.experience_list(X.section(F.col("parts"), V.IS_EXPERIENCE)), "summary": F.array_join(N.words(X.section(F.col("parts"), V.IS_SUMMARY)), " ")})
    latest = F.get("jobs", 0)
    short = F.when(F.length("summary") > 200, F.concat(F.regexp_replace(F.substring("summary", 1, 200), r"\s+$", ""), F.lit("..."))).otherwise(F.col("summary"))
    return as_records(
        rows, source, ["path"], full_name=X.first_name_line(body), emails=X.emails(body), phones=X.phones(body), location=X.resume_place(body), links=X.links(body), headline=short,
        current_company=F.when(F.lower(latest["end"]).isin("present", "current", "now", ""), latest["company"]),
        skills=X.skill_list(X.section(F.col("parts"), V.IS_SKILLS)), experience=F.col("jobs"), education=X.education_list(X.section(F.col("parts"), V.IS_EDUCATION)),
    )


def docx_text(content: bytes) -> str | None:
    """The body's own paragraphs (not those of tables) of a DOCX file that are not blank, one per line, tabs and line breaks kept; None if it is none."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    marks = {f"{space}tab": "\t", f"{space}ptab": "\t", f"{space}cr": "\n", f"{space}noBreakHyphen": "-"}
    try:
        with zipfile.ZipFile(BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{space}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None

    def piece(x: ElementTree.Element) -> str:
        if x.tag == f"{space}t":
            return x.text or ""
        if x.tag == f"{space}br":  # breaks of pages and columns are no text
            return "\n" if x.get(f"{space}type", "textWrapping") == "textWrapping" else ""
        return marks.get(x.tag, "")

    def runs(p: ElementTree.Element) -> Iterator[ElementTree.Element]:
        for x in p:
            if x.tag == f"{space}r":
                yield x
            elif x.tag == f"{space}hyperlink":
                yield from x.iter(f"{space}r")

    texts = ("".join(piece(x) for r in runs(p) for x in r).strip() for p in (body if body is not None else ()) if p.tag == f"{space}p")
    return "\n".join(t for t in texts if t)


def pdf_text(content: bytes) -> str | None:
    """Text of a PDF's pages; None if the file is broken. Without a PDF library it raises: a record must not be lost unseen."""
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the library pdfplumber on every worker") from e
    try:
        with pdfplumber.open(BytesIO(content)) as pdf:
            return "\n".join(p.extract_text() or "" for p in pdf.pages)
    except Exception:  # noqa: BLE001  a broken file gives no record
        return None


def _documents(spark: SparkSession, paths: list[str], text_of: Callable[[bytes], str | None]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"source_file": f.path, "body": [text_of(bytes(c)) for c in f.content]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "source_file string, body string").where("trim(body) <> ''")


def read_resume(spark: SparkSession, paths: list[str], source: str, text_of: Callable) -> DataFrame:
    """Résumés; a .txt file of either kind is read as text and counts as resume_pdf."""
    plain, packed = [p for p in paths if p.lower().endswith(".txt")], [p for p in paths if not p.lower().endswith(".txt")]
    out = nothing(spark)
    if plain:
        out = out.unionByName(resume_records(whole_files(spark, plain), "resume_pdf", paths))
    if packed:
        out = out.unionByName(resume_records(_documents(spark, packed, text_of), source, paths))
    return out


def read_notes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Free-form notes: one record for each block that identifies somebody."""
    rows = _placed(whole_files(spark, paths), paths).select("source_file", "path", F.posexplode(X.blocks(F.col("body"))).alias("i", "t"))
    t = F.col("t")
    return identified(as_records(
        rows, "recruiter_notes", ["path", "i"], full_name=X.note_name(t), emails=X.emails(t), phones=X.phones(t), location=X.note_place(t), links=X.links(t, labelled=True), headline=X.note_title(t),
        years_experience=X.note_years(t), current_company=F.coalesce(F.get(X.note_companies(t), 0), F.lit("")), skills=X.note_skills(t),
    ))


READERS: dict[str, Callable[[SparkSession, list[str]], DataFrame]] = {
    "recruiter_csv": read_csv,
    "ats_json": read_ats,
    "linkedin": read_linkedin,
    "github": read_github,
    "resume_pdf": lambda s, p: read_resume(s, p, "resume_pdf", pdf_text),
    "resume_docx": lambda s, p: read_resume(s, p, "resume_docx", docx_text),
    "recruiter_notes": read_notes,
}


def load(spark: SparkSession, sources: dict[str, str | list[str]]) -> DataFrame:
    """All records of all sources. Unknown names are skipped with a warning.

    rec_idx identifies a record; (source, at) orders them: by source name, place of the file, place in the file.
    """
    out = nothing(spark)
    for name, paths in sorted(sources.items()):
        kind = name.strip().lower()
        if kind in READERS and isinstance(paths, (str, list, tuple)) and paths:
            out = out.unionByName(READERS[kind](spark, [paths] if isinstance(paths, str) else list(paths)))
        elif kind not in READERS:
            log.warning("unknown source %r is skipped; known: %s", name, ", ".join(READERS))
    return out.withColumn("rec_idx", F.xxhash64("source", "at", "source_file"))
