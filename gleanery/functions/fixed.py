"""Names, word lists and patterns whose content defines results."""

from __future__ import annotations

# Columns of a job record, in output order.
JOB_FIELDS = """
title company company_logo company_size company_industry company_website department team location city region country
postal_code remote_type employment_type seniority salary_min salary_max salary_currency salary_period equity posted_date
valid_through start_date language description responsibilities requirements qualifications benefits tech_stack skills
education_required experience_years work_authorization visa_sponsorship relocation travel_required recruiter_name
recruiter_title recruiter_email recruiter_phone recruiter_linkedin hiring_manager hiring_manager_email application_email
application_phone apply_url job_url external_id requisition_id source_ats source_domain raw_jsonld confidence scraped_at
""".split()
JOB_CSV = ["id", *JOB_FIELDS, "source", "keywords_matched", "saved_at", "extras_json"]

# Columns of a business record.
BUSINESS_FIELDS = """
name category subcategories description address street_address city region country postal_code latitude longitude phone
email website social_links rating review_count price_range hours image menu_url reservation_url amenities tags is_claimed
external_id source_url source_listing_url source_domain raw_jsonld scraped_at
""".split()

# Query parameters dropped from canonical URLs.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid")

# Schema.org types that are businesses.
BUSINESS_TYPES = """
localbusiness restaurant store shop hotel lodging place medicalbusiness medicalclinic physician dentist hospital
automotivebusiness foodestablishment barorpub cafeorcoffeeshop professionalservice homeandconstructionbusiness
financialservice legalservice healthandbeautybusiness sportsclub travelagency library museum park stadiumorarena
civicstructure
""".split()

# Texts of block pages.
BLOCK_WORDS = (
    "request could not be satisfied", "request blocked", "cloudfront", "access denied", "403 forbidden", "404 not found", "captcha",
    "are you a robot", "checking your browser", "ddos protection", "cf-error", "request_id:",
)

# Job-page path tokens and text signals.
JOB_PATHS = ("/job", "/jobs", "/career", "/careers", "/positions", "/opening", "/vacanc", "/stellen", "/joboffer", "/detail/")
JOB_SIGNALS = ("apply", "responsibilities", "requirements", "qualifications", "bewerben", "aufgaben", "anforderung")
GENERIC_HEADINGS = ("careers", "jobs", "open positions", "openings", "job openings")
UNIVERSAL_PATHS = ("/job", "/stilling", "/career", "/vacancy", "/joboffer", "/ad/")
UNIVERSAL_SIGNALS = ("apply", "responsibilities", "requirements", "qualifications", "søk", "stillingen", "arbeidsgiver", "aufgaben", "anforderungen", "deine aufgaben")
CONFIDENCE_PATH = r"/(jobs?|careers?|stellen|stelle|positions?|opening|vacanc|stellenangebote|joboffer|view)"
CONFIDENCE_TEXT = (
    r"\bapply\s+now\b", r"\bjetzt\s+bewerben\b", r"\bresponsibilities\b", r"\bqualifications?\b", r"\brequirements?\b",
    r"\bwhat\s+you'?ll\s+do\b", r"\bwhat\s+we\s+offer\b", r"\bdein\s+profil\b", r"\bdeine\s+aufgaben\b", r"\bwir\s+bieten\b",
)
SITEMAP_PATH = r"/(jobs?|careers?|stellen|stelle|positions?|opening|vacanc|stellenangebote)/"
NON_JOB_PATH = r"/(account|profile|recommendations?|saved|applications?|login|signin|signup|register|home|feed|search\?|results\??|index)(/|$|\?)"
APPLY_HOST = r"(refline\.ch|smartrecruiters\.com|greenhouse\.io|lever\.co|workable\.com|workday|myworkdayjobs\.com|ashbyhq\.com|teamtailor\.com|recruitee\.com|personio\.|bamboohr\.com|jobvite\.com)"
APPLY_TEXT = r"^(apply|apply now|jetzt bewerben|bewerben|application|submit application|postuler|candidater)\b"
APPLY_PATH = r"/(apply|application|bewerb|postuler|candidat|submission)"

# Fixed values: (pattern in a host or page, system), first match wins.
ATS_IN_PAGE = (
    (r"boards\.greenhouse\.io|greenhouse\.io/embed", "greenhouse"), (r"jobs\.lever\.co|lever\.co/postings", "lever"), (r"\.jobs\.personio\.", "personio"),
    (r"jobs\.ashbyhq\.com|ashbyhq\.com/job", "ashby"), (r"\.recruitee\.com", "recruitee"), (r"apply\.workable\.com|\.workable\.com", "workable"),
    (r"\.wd\d+\.myworkdayjobs\.com", "workday"), (r"smartrecruiters\.com", "smartrecruiters"), (r"jobvite\.com", "jobvite"), (r"icims\.com", "icims"),
    (r"successfactors|sapsf", "successfactors"), (r"taleo\.net", "taleo"), (r"bamboohr\.com/jobs", "bamboohr"), (r"teamtailor\.com", "teamtailor"),
)
ADAPTER_HOSTS = (
    (r"boards(-api)?\.greenhouse\.io", "greenhouse"), (r"\.lever\.co$", "lever"), (r"smartrecruiters\.com", "smartrecruiters"), (r"\.jobs\.personio\.(com|de)$", "personio"),
    (r"\.ashbyhq\.com$", "ashby"), (r"\.recruitee\.com$", "recruitee"), (r"\.workable\.com$", "workable"), (r"myworkdayjobs\.com", "workday"),
    (r"arbeitsagentur\.de|rest\.arbeitsagentur", "arbeitsagentur"), (r"(^|\.)jobs\.ch$", "jobs.ch"), (r"(^|\.)finn\.no$", "finn.no"), (r"arbeidsplassen\.nav\.no", "nav.no"),
    (r"karrierestart\.no", "karrierestart.no"), (r"jobbsafari\.no", "jobbsafari.no"),
)
DISCOVERY_HOSTS = (
    (r"boards(-api)?\.greenhouse\.io", "greenhouse"), (r"jobs\.(eu\.)?lever\.co", "lever"), (r"smartrecruiters\.com", "smartrecruiters"), (r"\.jobs\.personio\.(de|com)", "personio"),
    (r"jobs\.ashbyhq\.com", "ashby"), (r"\.recruitee\.com", "recruitee"), (r"\.workable\.com", "workable"), (r"\.wd\d+\.myworkdayjobs\.com", "workday"), (r"jobs\.jobvite\.com", "jobvite"),
)

# Listing detail links by site.
LISTING_LINKS = {
    "jobs.ch": r"/(?:en|de|fr|it)/(?:vacancies|stellenangebote|offres-emplois|offerte-lavoro)/detail/([\w\-]{36})/?",
    "finn.no": r"/job/ad/(\d+)",
    "nav.no": r"/stillinger/stilling/([a-f0-9\-]{20,})",
    "karrierestart.no": r"/ledig-stilling/(\d+)",
    "jobbsafari.no": r"/jobb/[\w\-]+-(\d{5,})",
}

# Contact patterns; the page and the miner variants differ on purpose.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PAGE_PHONE = r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d{2,4}[\s.-]?\d{2,4}[\s.-]?\d{2,4}"
MINER_PHONE = r"(?:\+(?:\d[\s\-\.\(\)]?){6,15}\d|\b(?:0\d{1,3}[\s\-\.\(\)/]?){2,5}\d{2,4}\b)"
NORWEGIAN_PHONE = r"(?:\+47[\s\-]?)?\d{2}[\s\-]?\d{2}[\s\-]?\d{2}[\s\-]?\d{2}\b"
PAGE_EMAIL_JUNK = r"noreply|no-reply|example\.com"
MINER_EMAIL_JUNK = r"@(sentry\.io|noreply|no-reply|example\.com|donotreply|mailer-daemon|localhost|test\.|dev\.|finn\.no|nav\.no|jobsense\.io|jobbnorge\.no)"
RECRUITING = r"jobs?|career|talent|recruit|hr|hiring|people"
CONTACT_TITLE = r"(Recruiter|Talent\s+(?:Acquisition|Partner|Manager|Lead)|HR(?:[-\s]Manager| Business Partner| Generalist)?|People\s+(?:Partner|Operations|Manager)|Hiring\s+Manager|Sourcer)"
CONTACT_NAME = r"([A-ZÄÖÜ][a-zäöüß]+(?:[\s-][A-ZÄÖÜ][a-zäöüß]+){1,3})"
HONORIFIC = r"(Frau|Herr|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Madame|Monsieur|Mme|Sig\.?|Sra?\.?)"
ROLE_END = r"(?:\+?\d[\d\s\-]{6,}|Kopier|telefon:|tel:|mob:|email|e-post|@|$)"
DATE_LIKE = r"^\d{1,4}[./\-]\d{1,4}[./\-]\d{2,4}$"
PHONE_SEQUENCES = ("1234567", "12345678", "123456789", "12345678901")

# Seniority by rule order; the first rule that matches anywhere wins.
SENIORITY = (
    ("principal", r"\bprincipal\b"), ("staff", r"\bstaff\b"), ("senior", r"\bsenior(?:r[åa]dgiver|utvikler|konsulent|ingeni[øo]r|arkitekt)?\b|\bsr\.?\b|seniorrådgiver|seniorutvikler"),
    ("lead", r"\blead\b|\btech\s+lead\b|\bteam\s+lead\b|\bteamleder\b|\bleder\b"), ("mid", r"\bmid[-\s]?level\b"),
    ("junior", r"\bjunior\b|\bjr\.?\b|\bgraduate\b|\bentry[-\s]?level\b|nyutdannet|trainee"), ("intern", r"\bintern\b|\bpraktikum\b|\bwerkstudent\b|\bpraktikant\b"),
    ("director", r"\bdirector\b|\bdirekt[øo]r\b"), ("head", r"\bhead\s+of\b|\bvp\b|\bcto\b|\bsjef\b"),
)
WORKPLACE = (
    ("remote", r"\b(remote|home\s?office|work\s+from\s+home|fully\s+remote|telecommut|distributed)\b"),
    ("hybrid", r"\b(hybrid|flex(?:ible)?\s+location)\b"), ("onsite", r"\b(on[-\s]?site|in[-\s]?office|vor\s+ort)\b"),
)
FLAGS = {
    "visa_sponsorship": r"\b(visa\s+sponsorship|sponsor\s+(?:your)?\s?visa|h-?1b|blue\s+card)\b",
    "relocation": r"relocation\s+(?:support|assistance|package|paid|covered|provided)",
    "equity": r"\b(equity|stock\s+options?|rsu|esop|share\s+options?)\b",
}
AMOUNT = r"\d{2,3}(?:[.,'\s]\d{3})*(?:[.,]\d+)?"
CURRENCY = r"(?:€|EUR|USD|US\$|\$|£|GBP|CHF|Fr\.|SFr\.|SEK|DKK|NOK|PLN|CZK|HUF)"
PERIOD = r"(year|yr|p\.a\.|annual|jahr|jährlich|annee|année|month|mo|monat|monatlich|mois|hour|hr|stunde|heure|ora)?"
EDUCATION = (
    r"\b(Bachelor(?:'?s)?(?:\s+(?:degree|of\s+(?:Science|Arts|Engineering)))?|Master(?:'?s)?(?:\s+(?:degree|of\s+(?:Science|Arts|Engineering)))?|"
    r"M\.?Sc\.?|M\.?Eng\.?|M\.?A\.?|B\.?Sc\.?|B\.?Eng\.?|B\.?A\.?|Ph\.?D\.?|Doctorate|Studium|Diplom|Promotion|Hochschulabschluss|Universitätsabschluss|"
    r"FH(?:-Abschluss)?|ETH-Abschluss|Lehre|Berufsausbildung|Berufsmatur|Fachhochschule|Apprenticeship|EFZ|Eidg\.?\s+Fähigkeitszeugnis|Licence|Master\s+pro|DEA|DESS|diploma|degree)\b"
)
EXPERIENCE = (r"(\d+)\s?\+?\s?(?:-\s?\d+\s?)?(?:years?|jahre?n?|jahresberufserfahrung|ans|anni)", r"(?:mind\.?|min(?:imum)?|at\s+least|wenigstens|au\s+moins)\s+(\d+)\s+(?:jahre?|years?|ans|anni)")
MANAGER = r"(?:(?i:\b(?:hiring\s+manager|reports?\s+to|berichtet\s+an|vorgesetzt|line\s+manager|direct\s+supervisor|supervisor)\s*[:\-]?\s*))([A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+){1,3})"
SECTION_HEADS = {
    "responsibilities": r"responsibilit|what\s+you'?ll\s+do|your\s+role|key\s+(?:tasks|duties)|aufgaben|mission|arbeidsoppgaver|hovedoppgaver|ansvarsomr[åa]de",
    "requirements": r"requirement|qualification|what\s+you'?ll\s+need|must[-\s]?have|profil|anforderung|qualifikation|kvalifikasjoner|vi\s+s[øo]ker\s+deg",
    "benefits": r"benefits?|perks|what\s+we\s+offer|wir\s+bieten|deine\s+vorteile|nous\s+offrons|vi\s+tilbyr|fordeler",
    "contact": r"contact|kontakt|bewerbung|bewerben|postuler|kontaktperson",
}
RECRUITER_TITLE = r"(recruiter|talent\s+(?:acquisition|partner|manager)|hr\s+manager|people\s+(?:partner|operations)|hiring\s+manager|sourcer)"
PERSON = r"\b([A-ZÄÖÜ][a-zäöüß]+(?:[\s-][A-ZÄÖÜ][a-zäöüß]+){1,3})\b"
LINKEDIN = r"https?://(?:[a-z]+\.)?linkedin\.com/in/[A-Za-z0-9-_%]+"
TITLE_SUFFIX = r"(?i)\s*[|\-–—]\s*(FINN\.no|NAV|arbeidsplassen|LinkedIn|Indeed|Glassdoor|Monster|jobs\.ch|Stepstone|Workday|Jobbnorge|Greenhouse|Lever|Workable|thehub|jobbsafari|karrierestart).*$"
TITLE_PREFIX = r"(?i)^\s*(The\s+Hub|Jobbsafari|Karrierestart|FINN)\s*[|\-–—]\s*"

# Labels of definition lists, and the field each fills.
LABELS = {
    "Type ansettelse": "employment_type", "Sektor": "company_industry", "Bransje": "company_industry", "Stillingsfunksjon": "department", "Yrke": "department", "Fagområde": "department",
    "Arbeidsspråk": "language", "Nettsted": "company_website", "Stillingsnummer": "external_id", "Sist endret": "posted_date", "Referanse": "requisition_id", "Søknadsfrist": "valid_through",
    "Frist": "valid_through", "Tiltreder": "start_date", "Oppstart": "start_date", "Reisemengde": "travel_required",
}
FACT_LABELS = {
    "Stillingstype": "employment_type", "Arbeidssted": "location", "Sted": "location", "Bransje": "company_industry", "Bransjer": "company_industry", "Tiltredelse": "start_date",
    "Tiltreder": "start_date", "Oppstart": "start_date", "Søknadsfrist": "valid_through", "Frist": "valid_through", "Publisert": "posted_date", "Stillingsfunksjon": "department",
    "Sektor": "company_industry", "Yrke": "department", "Yrker": "department", "Fagområde": "department", "Fagområder": "department", "Heltid/Deltid": "employment_type",
    "Arbeidsspråk": "language", "Hjemmekontor": "remote_type", "Reisemengde": "travel_required",
}
# Fields counted before outside help is asked for.
ENRICHED = """
title company location city country employment_type seniority department company_industry salary_min salary_max
salary_currency salary_period posted_date valid_through start_date application_email application_phone apply_url
recruiter_name recruiter_email recruiter_phone recruiter_title responsibilities requirements qualifications benefits
tech_stack skills language remote_type
""".split()

# Beginnings of words that name a role.
ROLES = (
    "leder|sjef|direktør|direktor|seksjonssjef|avdelingsleder|konsulent|spesialist|senioringeniør|ingeniør|rådgiver|manager|partner|head|chief|owner|coordinator|recruiter|talent|hr|"
    "sykepleier|lege|teamleder|prosjektleder|sjefen|medarbeider|representant|developer|engineer|architect|founder|cto|ceo|cmo|cfo|coo|cio"
)

# Path parts that make a group of links telling.
CLUSTER_HINT = r"(job|stilling|vacanc|career|posting|opening|ad|opportunit|trabajo)"

# An employer named at the start of a description, and beginnings that are none.
EMPLOYER = (
    r"(?:Om stillingen|About the position)\s+([A-ZÆØÅ][A-Za-zÆØÅæøåäöü0-9 .,&\-]{2,80}?)"
    r"(?=\s+(?:Vil|Har|Vi|Er|We|Are|er|har|vi|Beskrivelse|Description|søker|ønsker))"
)
EMPLOYER_REJECT = r"^(Stillingen|The position|Beskrivelse|Description|Om|About|Vi|We|Du|You|Søknad|Søker|Application|This is just|Tasks|Oppgaver)\b"

# Fixed values: (label, field, form of the value) of labels in running text; the first that fits fills a field.
INLINE_LABELS = (
    ("Søknadsfrist", "valid_through", r"(\d{1,2}\.\d{1,2}\.\d{2,4}|\d{4}-\d{2}-\d{2}|snarest|løpende|fortløpende|umiddelbart)"),
    ("Frist", "valid_through", r"(\d{1,2}\.\d{1,2}\.\d{2,4}|\d{4}-\d{2}-\d{2})"),
    ("Publisert", "posted_date", r"(\d{1,2}\.\s*\w+\s*\d{4}|\d{1,2}\.\d{1,2}\.\d{2,4}|\d{4}-\d{2}-\d{2})"),
    ("Stillingsprosent", "employment_type", r"(\d{1,3}\s?%\s*(?:fast|midlertidig|vikariat)?[\w\s]{0,30})"),
    ("Ansettelsesform", "employment_type", r"([A-ZÆØÅa-zæøå][^,\n]{2,50})"),
    ("Tiltreder", "start_date", r"([A-ZÆØÅa-zæøå0-9][^\n]{2,50})"),
    ("Oppstart", "start_date", r"([A-ZÆØÅa-zæøå0-9][^\n]{2,50})"),
    ("Arbeidsspråk", "language", r"([A-ZÆØÅa-zæøå][^,\n]{2,50})"),
    ("Stillingsfunksjon", "department", r"([A-ZÆØÅa-zæøå][^\n]{3,80})"),
    ("Yrke", "department", r"([A-ZÆØÅa-zæøå][^\n]{3,80})"),
    ("Fagområde", "department", r"([A-ZÆØÅa-zæøå][^\n]{3,80})"),
    ("Reisemengde", "travel_required", r"([A-ZÆØÅa-zæøå0-9][^\n]{2,80})"),
    ("Referansenr\\.?", "requisition_id", r"([A-Za-z0-9_\-]{3,40})"),
)
LABEL_ALONE = (
    r"^(?:Stillingstype|Heltid|Deltid|Sektor|Bransje|Arbeidsspr(å|a)k|Antall\s+stillinger|Stillingsbr(ø|o)k|Publisert|S(ø|o)knadsfrist|Frist|Stillingsprosent|Ansettelsesform|"
    r"Tiltreder|Oppstart|Sted|Beliggenhet|Reisemengde|Hjemmekontor|Kontaktperson|Arbeidssted|Arbeidstid|Arbeidsgiver|Stillingsfunksjon|Yrke|Fagomr(å|a)de|Referansenr|Referanse|Sektor|Stilling$)$"
)

# Names that are no company's, and the elements that name one or a deadline on fact-card pages, in order.
NO_COMPANY = r"(arbeidsgiverguiden|m.t attraktive|partnere|annonsere|nyheter|relaterte|kontaktperson|instagram|facebook|linkedin|twitter|youtube|tiktok|profil)"
DEADLINE = r"^\d{2}\.\d{2}\.\d{2,4}$"

# Lists of links: titles and paths of jobs, hosts and pages where any title counts.
LIST_TITLE = (
    r"(software|engineer|developer|data|ai|ml|cloud|devops|backend|frontend|fullstack|stack|architect|scientist|analyst|sre|platform|security|product|qa|sdet|mobile|android|ios|principal|staff|lead|director|head|"
    r"consultant|specialist|manager|intern|trainee|designer|coordinator|associate|executive|officer|researcher|administrator|recruiter|hr|operations|delivery|solution)"
)
LIST_PATH = r"/(jobs?|vacanc|career|stellen|joboffer|positions?|opening|view|posting|job-listing|apply|jobpreview|rc/clk)"
AGGREGATORS = (
    r"jobrapido|indeed|glassdoor|monster|simplyhired|ziprecruiter|linkedin.*/jobs|naukri|reed\.co\.uk|seek\.com|stepstone|totaljobs|cwjobs|jobsite|jobs\.ch|jobup\.ch|jobscout24|kalaydo|stellenanzeigen|adecco|jobs\.de|"
    r"xing\.com/jobs|hh\.ru|wellfound|angel\.co|builtin|dice|finn\.no|nav\.no|arbeidsplassen|jobbnorge|webcruiter|jobindex\.dk|jobnet\.dk|arbetsformedlingen|monster\.se|arbetspaket|hh\.ru|rabota\.ru"
)
CAREERS_PAGE = r"/(jobs|careers|positions|openings|vacancies|opportunities|open-roles)(/|$|\?)"
DETAIL_PATH = r"/(biz|place|listing|detail|business|location|shop|store|property|venue|rental|hotel|restaurant|companies?|profile|firm|practice|provider|merchant)/"
NAVIGATION_TEXT = r"^(reviews?|menu|photos|map|view|more|details|info|share|book|save|contact|directions?|website)$"

# The older page score: hosts and paths; its texts are those of CONFIDENCE_TEXT.
OLD_AGGREGATORS = r"jobrapido\.com|indeed\.com|glassdoor\.com|monster\.com|simplyhired\.com|ziprecruiter\.com|naukri\.com|reed\.co\.uk|seek\.com|stepstone\."
OLD_PATH = r"/(jobs?|careers?|stellen|stelle|positions?|opening|vacanc|stellenangebote|joboffer)"
OLD_QUERY = r"[?&](w|q|keywords?|search)="
