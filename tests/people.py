"""Records for the tests, as rows of the record schema."""

from kinfold.sources.records import FIELDS

SCHEMA = "rec_idx long, source string, priority int, source_file string, at array<long>, " + ", ".join(f"`{n}` {t}" for n, t in FIELDS.items())
PRIORITY = {"recruiter_csv": 6, "ats_json": 5, "resume_pdf": 4, "resume_docx": 4, "linkedin": 3, "github": 2, "recruiter_notes": 1}


def row(i, source="recruiter_csv", **fields):
    empty = {"string": "", "double": None}
    values = [fields.get(n, empty.get(t, None if t.startswith("struct") else [])) for n, t in FIELDS.items()]
    return (i, source, PRIORITY[source], fields.get("file", source), [i], *values)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def links(linkedin="", github="", portfolio="", other=()):
    return (linkedin, github, portfolio, list(other))


def job(company="", title="", start="", end="", summary=""):
    return (company, title, start, end, summary)
