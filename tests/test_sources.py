import json
import zipfile

import pytest
from pyspark.sql import functions as F

from kinfold.plans.cli import main
from kinfold.plans.pipeline import public, run, to_document
from kinfold.plans.project import record_documents
from kinfold.sources import records as S


def rows(df):
    return df.orderBy("at").collect()


def put(tmp_path, name, text, encoding="utf-8"):
    (tmp_path / name).write_text(text, encoding=encoding)
    return str(tmp_path / name)


def test_csv(spark, tmp_path):
    text = 'Candidate Name;"E-Mail";Mobile;Tech Stack;YOE;City\nAnn Lee;a@x.org;555-123-4567;"js|go";5+;"Paris, IDF, FR"\n;;;x;1;\nBob;;;;;\n"Two\nLines";t@x.org;;;;\n'
    got = rows(S.read_csv(spark, [put(tmp_path, "a.csv", text, "utf-8-sig")]))
    assert [r.full_name for r in got] == ["Ann Lee", "Bob", "Two\nLines"]
    a = got[0]
    assert (a.emails, a.phones, a.skills, a.years_experience, tuple(a.location), a.experience) == (["a@x.org"], ["555-123-4567"], ["js", "go"], 5.0, ("Paris", "IDF", "FR"), [])
    assert S.read_csv(spark, [put(tmp_path, "e.csv", "")]).collect() == [] and S.read_csv(spark, [put(tmp_path, "h.csv", "name,email\n")]).collect() == []
    latin = rows(S.read_csv(spark, [put(tmp_path, "m.csv", "name,email,phone\nshort\nx,y@z.org,1,extra\n")]))
    assert [r.full_name for r in latin] == ["short", "x"]
    with pytest.raises(Exception):
        S.read_csv(spark, [str(tmp_path / "none.csv")]).collect()


def test_csv_encodings_and_folders(spark, tmp_path):
    latin = tmp_path / "l.csv"
    latin.write_bytes("name;email\nJosé Núñez;j@x.org\n".encode("latin-1") + b"Zo\xeb;\n")
    assert [r.full_name for r in rows(S.read_csv(spark, [str(latin)]))] == ["José Núñez", "Zoë"]
    folder = tmp_path / "many +x"
    folder.mkdir()
    for name, text in (("b.csv", "name,email\nBo,\n"), ("a.csv", "name,email\nAl,\nÆ,\n"), ("c.csv", "Full Name|Phone\nCy|1\n"), ("_x.csv", "name\nno\n")):
        (folder / name).write_text(text)
    for paths in ([str(folder)], [str(folder / "*.csv").replace("*", "[abc]")]):
        got = rows(S.read_csv(spark, paths))
        assert [r.full_name for r in got] == ["Al", "Æ", "Bo", "Cy"]  # no header among them
    (tmp_path / "b.csv").write_text("name\nOther\n")
    both = rows(S.read_csv(spark, [str(tmp_path / "b.csv"), str(folder / "b.csv")]))
    assert [(r.full_name, r["at"][0]) for r in both] == [("Other", 1), ("Bo", 2)]  # files of one name keep their order
    long = put(tmp_path, "long.csv", "name,email\n" + "".join(f"P{i},p{i}@x.org\n" for i in range(5000)))
    assert S.read_csv(spark, [long]).count() == 5000


def test_unknown_sources_warn(spark, caplog):
    assert S.load(spark, {"nonsense": ["x"]}).count() == 0
    assert "nonsense" in caplog.text


@pytest.mark.parametrize("sample,want", [("a,b\n1,2\n", ","), ("a;b\n1;2\n", ";"), ("a\tb\n1\t2\n", "\t"), ("a|b\n1|2\n", "|"), ("abc", ",")])
def test_delimiter(sample, want):
    assert S.delimiter(sample) == want


def test_ats(spark, tmp_path):
    one = {"Candidate_Name": None, "name": "ignored", "first_name": "Ann", "LAST_NAME": "Lee", "emails": [{"address": "a@x.org"}, "b@x.org", {"other": 1}], "phone": "555", "skills": "a, b;c", "yoe": "7", "location": {"town": "Paris", "province": "IDF"}, "jobs": {"Employer": "Acme", "role": "Eng", "from": "2020", "to": "now"}, "education": [{"college": "X", "major": "Y", "year": 2020}, "skip"]}
    r = rows(S.read_ats(spark, [put(tmp_path, "a.json", json.dumps([one, "no", {"skills": ["x"]}]))]))
    assert len(r) == 1
    assert (r[0].full_name, r[0].emails, r[0].phones, r[0].skills, r[0].years_experience, tuple(r[0].location)) == ("Ann Lee", ["a@x.org", "b@x.org"], ["555"], ["a", "b;c"], 7.0, ("Paris", "IDF", ""))
    assert [tuple(x) for x in r[0].experience] == [("Acme", "Eng", "2020", "now", "")] and [tuple(x) for x in r[0].education] == [("X", "", "Y", "2020")]
    assert rows(S.read_ats(spark, [put(tmp_path, "o.json", '{"name": "Solo"}')]))[0].full_name == "Solo"
    with pytest.raises(Exception, match="invalid JSON"):
        S.read_ats(spark, [put(tmp_path, "bad.json", "{not json: [}")]).collect()


def test_linkedin(spark, tmp_path):
    one = {"firstName": "Ann", "lastName": "Lee", "summary": "s" * 300, "positions": [{"companyName": "Acme", "role": "Eng", "startDate": "January 2021", "endDate": ""}], "education": [{"schoolName": "X", "endYear": "2018"}], "skills": ["js", " "], "location": "Paris, FR", "years_experience": 3}
    r = rows(S.read_linkedin(spark, [put(tmp_path, "a.json", json.dumps(one))]))[0]
    assert (r.full_name, r.current_company, r.skills, r.years_experience, r.headline) == ("Ann Lee", "Acme", ["js"], 3.0, "s" * 200 + "...")
    assert r.experience[0].start == "2021-01" and r.education[0].end_year == "2018"
    for bad in ("{oops", "[1]", "{}"):
        assert S.read_linkedin(spark, [put(tmp_path, "b.json", bad)]).collect() == []
    assert S.read_linkedin(spark, ["https://www.linkedin.com/in/a"]).collect() == []


def test_github(spark, tmp_path):
    one = {"login": "ann", "name": None, "bio": "hi", "blog": "a.org", "location": "Paris, FR", "repos": [{"name": "x", "language": "Go"}, {"name": "y", "language": "C"}, {"language": "Go"}, {"language": None}]}
    r = rows(S.read_github(spark, [put(tmp_path, "a.json", json.dumps(one))]))[0]
    assert (r.full_name, r.headline, r.skills, r.links.github, r.links.portfolio, r.emails) == ("ann", "hi", ["Go", "C"], "https://github.com/ann", "a.org", [])
    assert S.read_github(spark, [put(tmp_path, "b.json", "nope")]).collect() == []
    repos = spark.createDataFrame([([("x", "Go"), (None, "C"), ("", "C"), ("y", None)],)], "repos array<struct<name:string,language:string>>")
    assert repos.select(S.repository_names(F.col("repos"))).first()[0] == ["x", "y"]
    (text,) = [json.loads(d.document) for d in record_documents(S.read_github(spark, [put(tmp_path, "a.json", json.dumps(one))])).collect()]
    assert text["full_name"] == "ann" and text["skills"] == ["Go", "C"] and text["location"]["city"] == "Paris" and text["years_experience"] is None


NOTES = "Candidate: Ann Lee\nWorks at Acme Corp, Paris. Knows js and Go.\nEmail: a@x.org\n---\nno identity here\n---\nSpoke with Bob Ray. Call 555-123-4567. 4 yrs exp. GitHub: github.com/bob\n"


def test_notes(spark, tmp_path):
    r = rows(S.read_notes(spark, [put(tmp_path, "n.txt", NOTES, "utf-8-sig")]))
    assert [(x.full_name, x.current_company, x.skills[:2], x.years_experience, x.links.github) for x in r] == [("Ann Lee", "Acme Corp", ["js", "Go"], None, ""), ("Bob Ray", "", [], 4.0, "https://github.com/bob")]
    two = rows(S.read_notes(spark, [put(tmp_path, "h.txt", "Name: Ann Lee\nx\nName: Bob Ray\ny")]))
    assert [x.full_name for x in two] == ["Ann Lee", "Bob Ray"]


RESUME = "Ann Lee\na@x.org\nSUMMARY\nBuilds things.\nEXPERIENCE\nEngineer at Acme | Jan 2020 - Present\n• did x\nEDUCATION\nState U - BS in Physics\n2014\nSKILLS\njs, go\n"


def test_resumes(spark, tmp_path):
    doc = tmp_path / "r.docx"
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in RESUME.split("\n"))
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    text = rows(S.READERS["resume_pdf"](spark, [put(tmp_path, "r.txt", RESUME)]))[0]
    packed = rows(S.READERS["resume_docx"](spark, [str(doc)]))[0]
    assert (text.source, packed.source) == ("resume_pdf", "resume_docx")
    for r in (text, packed):
        assert (r.full_name, r.headline, r.current_company, r.skills) == ("Ann Lee", "Builds things.", "Acme", ["js", "go"])
        assert [tuple(x)[:4] for x in r.experience] == [("Acme", "Engineer", "2020-01", "present")] and [tuple(x) for x in r.education] == [("State U", "BS", "Physics", "2014")]
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    assert S.READERS["resume_docx"](spark, [str(tmp_path / "broken.docx")]).collect() == []


def test_docx_text(tmp_path):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    run = "<w:r><w:t>Engineer</w:t><w:tab/><w:t>Acme</w:t><w:br/><w:t>Jan 2020</w:t><w:br w:type='page'/></w:r>"
    body = f"<w:p>{run}<w:hyperlink><w:r><w:t> a@x.org</w:t></w:r></w:hyperlink></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>end</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "t.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    assert S.docx_text((tmp_path / "t.docx").read_bytes()) == "Engineer\tAcme\nJan 2020 a@x.org\nend"


def test_pdf_needs_its_library(spark, tmp_path):
    try:
        import pdfplumber  # noqa: F401
    except ImportError:
        (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
        with pytest.raises(Exception, match="pdfplumber"):
            S.READERS["resume_pdf"](spark, [str(tmp_path / "a.pdf")]).collect()


def test_run_with_a_callers_schema(spark, tmp_path):
    from kinfold.plans.project import ProjectionConfig

    notes = put(tmp_path, "n.txt", NOTES)
    config = ProjectionConfig.from_dict({"fields": [{"path": "who", "from": "full_name"}, {"path": "mail", "from": "emails[0]"}], "include_confidence": False, "include_provenance": False})
    got = run(spark, {"recruiter_notes": notes}, config, schema={"properties": {"mail": {"type": "string"}}})
    assert {r.who: r._validation_errors for r in got.collect()} == {"Ann Lee": None, "Bob Ray": ["Type error at 'mail': expected string, got NoneType"]}


def test_run_and_command_line(spark, tmp_path, capsys):
    notes, sheet = put(tmp_path, "n.txt", NOTES), put(tmp_path, "a.csv", "name,email\nAnn LEE,A@x.org\n")
    doc = public(to_document(run(spark, {" Recruiter_CSV ": sheet, "recruiter_notes": [notes], "unknown": "x"})))
    assert doc["count"] == 2 and doc["candidates"][0]["full_name"] == "Ann Lee"
    assert main(["--csv", sheet, "--notes", notes, "--output", str(tmp_path / "out.json")]) == 0
    written = json.loads((tmp_path / "out.json").read_text())
    assert [c["candidate_id"] for c in written["candidates"]] == [c["candidate_id"] for c in doc["candidates"]]
    capsys.readouterr()
    assert main(["--csv", sheet, "--verbose"]) == 0 and "recruiter_csv: 1 record(s)" in capsys.readouterr().err
    assert main([]) == 1 and main(["--csv", str(tmp_path / "none.csv")]) == 1
    assert "none.csv" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["--version"])


def test_canonical_layout(spark, tmp_path):
    from kinfold.sources.canonical import read_canonical_csv, read_canonical_json

    sheet = put(tmp_path, "c.csv", "full_name,email,phone,city,linkedin,skills,company,start,institution,years_experience\nAnn,a@x.org; b@x.org,1;2,Paris,linkedin.com/in/a,js; go,Acme,2020,MIT,4\n,,,,,,,,,x\n")
    a, b = rows(read_canonical_csv(spark, sheet))
    assert (a.emails, a.phones, a.skills, a.location.city, a.links.linkedin, a.years_experience) == (["a@x.org", "b@x.org"], ["1", "2"], ["js", "go"], "Paris", "linkedin.com/in/a", 4.0)
    assert a.experience[0].company == "Acme" and a.education[0].institution == "MIT" and (b.full_name, b.location, b.links, b.experience, b.years_experience) == ("", None, None, [], None)
    doc = {"candidates": [{"full_name": "Ann", "email": "a@x.org", "phones": ["1", " "], "links": {"other": ["http://o.org"]}, "skills": "js;go", "experience": [{"company": "Acme", "start": "2020"}], "years_experience": 3}]}
    for text in (doc, doc["candidates"], doc["candidates"][0]):
        (r,) = rows(read_canonical_json(spark, put(tmp_path, "c.json", json.dumps(text))))
        assert (r.full_name, r.emails, r.phones, r.links.other, r.skills, r.experience[0].company, r.years_experience) == ("Ann", ["a@x.org"], ["1"], ["http://o.org"], ["js", "go"], "Acme", 3.0)
