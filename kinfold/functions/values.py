"""Tables that results depend on."""

from __future__ import annotations

#: Source kinds: (priority, base confidence). Fixed values.
SOURCES = {
    "recruiter_notes": (1, "0.40"),
    "github": (2, "0.55"),
    "linkedin": (3, "0.65"),
    "resume_pdf": (4, "0.70"),
    "resume_docx": (4, "0.70"),
    "ats_json": (5, "0.80"),
    "recruiter_csv": (6, "0.90"),
}

#: Weight of each field in the overall confidence. Fixed values.
FIELD_WEIGHTS = {
    "full_name": "0.20",
    "emails": "0.15",
    "phones": "0.10",
    "location": "0.10",
    "skills": "0.15",
    "experience": "0.15",
    "education": "0.10",
    "headline": "0.05",
}

#: Canonical skill names and the spellings that mean them. Fixed values.
SKILLS = {
    "JavaScript": ["js", "javascript"],
    "TypeScript": ["ts", "typescript"],
    "Python": ["python3", "python"],
    "Go": ["golang", "go"],
    "React": ["reactjs", "react.js", "react"],
    "Node.js": ["nodejs", "node.js", "node"],
    "Kubernetes": ["k8s", "kubernetes"],
    "Machine Learning": ["ml", "machine learning"],
    "Artificial Intelligence": ["ai", "artificial intelligence"],
    "Amazon Web Services": ["aws", "amazon web services"],
    "Google Cloud Platform": ["gcp", "google cloud platform"],
    "C#": ["c#", "csharp"],
    "C++": ["c++", "cpp"],
    "HTML5": ["html5"],
    "CSS3": ["css3"],
    "PostgreSQL": ["pg", "postgres", "postgresql"],
    "MongoDB": ["mongo", "mongodb"],
    "TensorFlow": ["tf", "tensorflow"],
    "Vue.js": ["vue", "vuejs", "vue.js"],
    "Angular": ["angular", "angularjs"],
    ".NET": ["dotnet", ".net"],
    "Ruby on Rails": ["ruby on rails", "rails", "ror"],
    "Docker": ["docker"],
    "SQL": ["sql"],
    "NoSQL": ["nosql"],
    "GraphQL": ["graphql"],
    "REST": ["rest", "restful"],
    "CI/CD": ["ci/cd", "cicd"],
    "DevOps": ["devops"],
}

#: Country codes and the colloquial names that mean them. Fixed values.
COUNTRIES = {
    "US": ["usa", "u.s.a.", "u.s.", "united states of america", "united states", "america"],
    "GB": ["uk", "u.k.", "united kingdom", "great britain", "england"],
    "AE": ["uae", "united arab emirates"],
}

#: Month names, by number. Fixed values.
MONTHS = {
    "01": ["january", "jan"],
    "02": ["february", "feb"],
    "03": ["march", "mar"],
    "04": ["april", "apr"],
    "05": ["may"],
    "06": ["june", "jun"],
    "07": ["july", "jul"],
    "08": ["august", "aug"],
    "09": ["september", "sep", "sept"],
    "10": ["october", "oct"],
    "11": ["november", "nov"],
    "12": ["december", "dec"],
}

#: Words that mean an ongoing engagement. Fixed values.
ONGOING = ["present", "current", "now", "ongoing", "today"]

#: Particles of a name that stay in lower case. Fixed values.
PARTICLES = ["de", "di", "da", "del", "van", "von", "le", "la", "el", "al"]

#: Patterns of e-mails, phones and addresses. Fixed values.
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
FIND_EMAIL = r"[\w.+\-]+@[\w\-]+\.[\w.\-]+"
FIND_PHONE = r"[\+]?[\d][\d\s\-\(\)\.]{7,15}"
FIND_URL = r"https?://[^\s,;\"'<>\)]+"
FIND_LINKEDIN = r"(?:https?://)?(?:www\.)?linkedin\.com/in/[\w\-]+/?"
FIND_GITHUB = r"(?:https?://)?(?:www\.)?github\.com/[\w\-]+/?"

#: Patterns of free-form notes, each tried in order; group 1 is the value. Fixed values.
NOTE_NAME = [
    r"(?:Candidate|Name|Applicant)\s*:\s*(.+)",
    r"(?:Spoke|Talked|Met|Chatted)\s+with\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
    r"(?:Interviewed|Screening|Screen(?:ed)?)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
    r"(?:Resume|CV|Profile)\s+(?:of|for|from)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
]
NOTE_COMPANY = [
    r"(?:works?|working)\s+at\s+(.+?)(?:\.|,|$)",
    r"currently\s+at\s+(.+?)(?:\.|,|$)",
    r"(?:employed\s+)?at\s+(.+?)\s+(?:as|since|for)\s+",
    r"(?:currently|presently)\s+(?:with|employed\s+by)\s+(.+?)(?:\.|,|$)",
    r"(?:from|left|leaving|joined)\s+(.+?)(?:\.|,|\s+(?:to|in|as|where))",
    r"(?:He(?:'s)?|She(?:'s)?|They(?:'re)?)\s+(?:currently\s+)?at\s+(.+?)(?:\s+as\s+|\.|,|$)",
]
NOTE_SKILLS = [
    r"(?:knows?|knowledge\s+of)\s+(.+?)(?:\.|$)",
    r"(?:experienced?|expertise)\s+(?:in|with)\s+(.+?)(?:\.|$)",
    r"(?:proficient|proficiency)\s+(?:in|with)\s+(.+?)(?:\.|$)",
    r"(?:skilled?|skills?)\s+(?:in|with)\s+(.+?)(?:\.|$)",
    r"(?:strong|solid|good)\s+(.+?)\s+background",
    r"(.+?)\s+(?:expertise|expert)",
    r"(?:familiar(?:ity)?)\s+with\s+(.+?)(?:\.|$)",
    r"(?:has\s+)?(?:experience|background)\s+(?:in|with)\s+(.+?)(?:\.|$)",
]
NOTE_YEARS = [
    r"(\d+)\+?\s*years?\s+(?:of\s+)?experience",
    r"about\s+(\d+)\s+years?\s+(?:of\s+)?experience",
    r"(\d+)\+?\s*years?\s+(?:in\s+(?:the\s+)?)?(?:industry|field|tech)",
    r"(\d+)\+?\s*(?:yrs?|years?)\s+exp",
    r"experience:\s*(\d+)\+?\s*(?:yrs?|years?)",
]
NOTE_PLACE = [
    r"(?:based|located|location)\s+(?:in|:)\s+(.+?)(?:\.|,\s*(?:has|with|and)|$)",
    r"(?:lives?|living|resides?|residing)\s+(?:in|at)\s+(.+?)(?:\.|$)",
    r"(?:from)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:,\s*[A-Z]{2})?)",
]
NOTE_TITLE = [
    r"(?:Title|Role|Position)\s*:\s*(.+)",
    r"(?:as\s+(?:a\s+)?|is\s+(?:a\s+)?)((?:Senior|Junior|Lead|Staff|Principal|Chief|Head|VP|Director|Manager|Sr\.?|Jr\.?)\s+.*?(?:Engineer|Developer|Manager|Designer|Analyst|Consultant|Architect|Administrator|Coordinator|Specialist|Officer|Director))",
]
NOTE_RULE = r"\n\s*(?:---+|===+|\*\*\*+|#{3,})\s*\n"
NOTE_HEAD = r"(?=\n\s*(?:Candidate|Applicant|Name)\s*:)"

#: Patterns of résumé sections and of what stands in them. Fixed values.
IS_EXPERIENCE = r"(?:work\s+)?experience|employment(?:\s+history)?|professional\s+experience|career\s+history|work\s+history"
IS_EDUCATION = r"education(?:al)?(?:\s+background)?|academic|degrees?|qualifications?"
IS_SKILLS = r"(?:technical\s+)?skills|technologies|tech(?:nical)?\s+stack|competenc(?:ies|y)|tools?\s+(?:&|and)\s+technologies|programming\s+languages|proficienc(?:ies|y)"
IS_SUMMARY = r"summary|objective|profile|about"
SECTION_HEAD = (
    r"^(?:#{1,3}\s+)?(?:(?:work\s+)?experience|employment(?:\s+history)?|professional\s+experience|career\s+history|work\s+history|"
    r"education(?:al)?(?:\s+background)?|academic|(?:technical\s+)?skills|technologies|tech(?:nical)?\s+stack|"
    r"competenc(?:ies|y)|tools?\s+(?:&|and)\s+technologies|programming\s+languages|proficienc(?:ies|y)|"
    r"summary|objective|profile|about(?:\s+me)?|certifications?|awards?|projects?|publications?|"
    r"languages?|interests?|references?|volunteer(?:ing)?|activities)\s*:?\s*$"
)
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE_RANGE = rf"({_MONTH}[\s,]*\d{{4}}|\d{{4}}|\d{{1,2}}/\d{{4}})\s*[-–—to]+\s*({_MONTH}[\s,]*\d{{4}}|\d{{4}}|\d{{1,2}}/\d{{4}}|[Pp]resent|[Cc]urrent|[Nn]ow)"
DEGREE = r"\b(?:B\.?S\.?|B\.?A\.?|M\.?S\.?|M\.?A\.?|M\.?B\.?A\.?|Ph\.?D\.?|Bachelor|Master|Doctor|Associate|Diploma|Certificate)\b"
PAIR = r"^(.+?)(?:\s+at\s+|\s*[|@]\s*)(.+)$"
BULLET = r"^[\-•●○▪▸►◦*]\s*"
RESUME_PLACES = [
    r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)*),\s*([A-Z]{2})\b",
    r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)*),\s*([A-Z][a-z]+(?:\s[A-Z][a-z]+)*),\s*(\w+)\b",
]

#: Canonical fields and the headers or keys that mean them, first match first. Fixed values.
CSV_HEADERS = {
    "full_name": ["full_name", "fullname", "name", "candidate_name", "candidate", "applicant_name", "applicant", "person_name", "person"],
    "email": ["email", "email_address", "e-mail", "e_mail", "candidate_email", "primary_email", "contact_email"],
    "phone": ["phone", "phone_number", "telephone", "mobile", "cell", "contact_phone", "primary_phone", "tel"],
    "current_company": ["current_company", "company", "employer", "organization", "organisation", "current_employer", "firm"],
    "title": ["title", "job_title", "position", "role", "current_title", "designation", "current_role"],
    "location": ["location", "city", "address", "region", "area"],
    "linkedin": ["linkedin", "linkedin_url", "linkedin_profile"],
    "github": ["github", "github_url", "github_profile"],
    "skills": ["skills", "skill_list", "technologies", "tech_stack"],
    "years_experience": ["years_experience", "years_of_experience", "yoe", "experience_years"],
}
ATS_KEYS = {
    "full_name": ["candidate_name", "name", "full_name", "fullname", "applicant_name"],
    "first": ["first_name", "firstname", "given_name"],
    "last": ["last_name", "lastname", "family_name", "surname"],
    "emails": ["email_address", "email", "emails", "primary_email", "candidate_email", "email_addresses"],
    "phones": ["phone_number", "phone", "phones", "primary_phone", "mobile", "telephone", "phone_numbers"],
    "headline": ["headline", "title", "current_title", "job_title", "position"],
    "current_company": ["current_company", "company", "employer"],
    "years": ["years_of_experience", "yoe", "years_experience", "experience_years"],
    "skills": ["skills", "skill_list", "technologies", "tech_stack", "competencies"],
    "experience": ["work_history", "experience", "work_experience", "positions", "employment_history", "jobs"],
    "education": ["education_history", "education", "academic_history", "degrees", "schools"],
    "location": ["location", "address", "city", "region"],
    "linkedin": ["linkedin_url", "linkedin", "linkedin_profile"],
    "github": ["github_url", "github", "github_profile"],
    "portfolio": ["portfolio_url", "portfolio", "website", "blog", "personal_website"],
}
ATS_EXPERIENCE = {
    "company": ["company", "company_name", "employer", "organization"],
    "title": ["title", "job_title", "position", "role"],
    "start": ["start_date", "start", "from", "from_date"],
    "end": ["end_date", "end", "to", "to_date"],
    "summary": ["description", "summary", "responsibilities", "details"],
}
ATS_EDUCATION = {
    "institution": ["school", "institution", "university", "college", "school_name", "institution_name"],
    "degree": ["degree", "degree_name", "qualification", "level"],
    "field": ["field_of_study", "field", "major", "specialization", "concentration", "subject"],
    "end_year": ["graduation_year", "end_year", "year", "grad_year", "completion_year"],
}
ATS_PLACE = {
    "city": ["city", "town", "municipality"],
    "region": ["state", "region", "province", "county"],
    "country": ["country", "country_code", "nation"],
}
LINKEDIN_KEYS = {
    "full_name": ["full_name", "name"],
    "first": ["first_name", "firstName"],
    "last": ["last_name", "lastName"],
    "headline": ["headline"],
    "summary": ["summary", "about"],
    "emails": ["email", "email_address"],
    "phones": ["phone", "phone_number"],
    "location": ["location"],
    "linkedin": ["profile_url", "profileUrl", "linkedin_url"],
    "github": ["github_url", "github"],
    "portfolio": ["portfolio", "website", "blog"],
    "skills": ["skills"],
    "experience": ["positions", "experience"],
    "education": ["education", "educations"],
    "years": ["years_of_experience", "years_experience"],
    "current_company": ["current_company", "company"],
}
LINKEDIN_EXPERIENCE = {
    "company": ["company", "company_name", "companyName"],
    "title": ["title", "position", "role"],
    "start": ["start_date", "startDate", "start"],
    "end": ["end_date", "endDate", "end"],
    "summary": ["description", "summary", "responsibilities"],
}
LINKEDIN_EDUCATION = {
    "institution": ["school", "institution", "schoolName", "university"],
    "degree": ["degree", "degree_name", "degreeName"],
    "field": ["field_of_study", "fieldOfStudy", "major", "field"],
    "end_year": ["end_year", "graduation_year", "endYear", "year"],
}
LINKEDIN_PLACE = {
    "city": ["city"],
    "region": ["state", "region", "province"],
    "country": ["country", "country_code"],
}

#: Assigned country calling codes (ITU E.164), as the start of a number. Fixed values.
CALLING_CODE = (
    r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[12368]|22\d|23\d|24\d|25[0-8]|26\d|29[01789]|35\d|37\d|38[0-35-79]|42[013]|50\d|59\d"
    r"|67[02-9]|68[0-35-9]|69[0-2]|800|808|85[02356]|87[08]|88[0-368]|96[0-8]|97[0-79]|99[2-68])(?=\d)"
)
#: Lengths of national numbers by calling code, between commas; and those taken for plans that are not in the list. Fixed values.
PHONE_LENGTHS = {
    "1": ",10,", "7": ",10,", "20": ",8,9,10,", "27": ",9,", "30": ",10,", "31": ",9,", "32": ",8,9,", "33": ",9,", "34": ",9,", "36": ",8,9,",
    "39": ",6,7,8,9,10,11,", "41": ",9,", "44": ",9,10,", "45": ",8,", "46": ",7,8,9,", "47": ",8,", "48": ",9,", "49": ",5,6,7,8,9,10,11,12,13,",
    "52": ",10,", "55": ",10,11,", "61": ",9,", "64": ",8,9,10,", "65": ",8,", "81": ",9,10,", "82": ",8,9,10,", "86": ",10,11,", "91": ",10,",
    "351": ",9,", "353": ",7,8,9,", "358": ",6,7,8,9,10,", "971": ",8,9,", "972": ",8,9,",
}
ANY_LENGTH = ",5,6,7,8,9,10,11,12,"
#: Calling codes of the regions that numbers without a code may be of. Fixed values.
REGIONS = {
    "US": "1", "CA": "1", "GB": "44", "IN": "91", "DE": "49", "FR": "33", "ES": "34", "IT": "39", "NL": "31", "BR": "55", "MX": "52", "AU": "61",
    "NZ": "64", "JP": "81", "CN": "86", "SG": "65", "ZA": "27", "IE": "353", "PT": "351", "CH": "41", "SE": "46", "NO": "47", "DK": "45", "PL": "48",
}

#: Other and official names of countries, in lower case. Fixed values.
COUNTRY_NAMES = {
    "czech republic": "CZ", "czechia": "CZ", "slovak republic": "SK", "viet nam": "VN", "russia": "RU", "russian federation": "RU",
    "south korea": "KR", "korea, republic of": "KR", "republic of korea": "KR", "north korea": "KP", "democratic people's republic of korea": "KP",
    "people's republic of china": "CN", "taiwan, province of china": "TW", "hong kong": "HK", "macau": "MO", "macao": "MO",
    "iran, islamic republic of": "IR", "islamic republic of iran": "IR", "syrian arab republic": "SY", "arab republic of egypt": "EG",
    "lao people's democratic republic": "LA", "people's democratic republic of algeria": "DZ", "hashemite kingdom of jordan": "JO",
    "bolivia, plurinational state of": "BO", "venezuela, bolivarian republic of": "VE", "tanzania, united republic of": "TZ", "moldova, republic of": "MD",
    "brunei darussalam": "BN", "cabo verde": "CV", "cape verde": "CV", "ivory coast": "CI", "cote d'ivoire": "CI", "turkiye": "TR", "türkiye": "TR", "turkey": "TR",
    "eswatini": "SZ", "swaziland": "SZ", "north macedonia": "MK", "macedonia": "MK", "burma": "MM", "myanmar": "MM", "holy see": "VA", "vatican city": "VA",
    "timor-leste": "TL", "east timor": "TL", "the netherlands": "NL", "the gambia": "GM", "the bahamas": "BS", "micronesia, federated states of": "FM",
    "democratic republic of the congo": "CD", "congo, the democratic republic of the": "CD", "republic of the congo": "CG",
    "palestine, state of": "PS", "state of palestine": "PS", "swiss confederation": "CH", "hellenic republic": "GR", "french republic": "FR",
    "italian republic": "IT", "portuguese republic": "PT", "argentine republic": "AR", "kyrgyz republic": "KG", "togolese republic": "TG",
    "gabonese republic": "GA", "dominican republic": "DO", "central african republic": "CF", "lebanese republic": "LB", "united mexican states": "MX",
}
#: A form of government in front of a country's name. Fixed value.
GOVERNMENT = (
    r"^(?:the )?(?:(?:federal |federative |democratic |socialist |islamic |bolivarian |plurinational |oriental |independent |grand |united )*"
    r"(?:republic|kingdom|state|states|commonwealth|principality|sultanate|duchy|union|federation) of )(?:the )?"
)
