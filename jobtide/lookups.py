"""Word lists, lookup tables and field lists that results depend on."""

# Texts that count as missing after stripping (case matters).
INVALID_TEXTS = ["", "N/A", "n/a", "None", "none", "null", "NULL"]

# A posting is useless when all of these are invalid.
CRITICAL_FIELDS = ["Title", "Description", "Primary Description", "Skill"]

# Fields whose invalid texts become NULL before cleaning.
NULLABLE_FIELDS = ["Description", "Primary Description", "Location", "Skill"]

# Raw posting fields that no later step uses.
UNUSED_FIELDS = [
    "Insight", "Job State", "Detail URL", "Company Name", "Company Description",
    "Company Website", "Company Logo", "Company Apply Url", "Employee Count",
    "Headquarters", "Company Founded", "Specialties", "Hiring Manager Title",
    "Hiring Manager Subtitle", "Hiring Manager Title Insight",
    "Hiring Manager Profile", "Hiring Manager Image", "Poster Id", "Industry",
]

# Locations whose postings are left out.
DISALLOWED_LOCATIONS = ["Middle East", "Washington DC-Baltimore Area", "Mexico"]

EU_COUNTRIES = [
    "Austria", "Belgium", "Bulgaria", "Croatia", "Cyprus", "Czechia", "Denmark",
    "Estonia", "Finland", "France", "Germany", "Greece", "Hungary", "Ireland",
    "Italy", "Latvia", "Lithuania", "Luxembourg", "Malta", "Netherlands",
    "Poland", "Portugal", "Romania", "Slovakia", "Slovenia", "Spain", "Sweden",
]

# Map names that differ from the names used in the data.
COUNTRY_ALIASES = {
    "Czech Republic": "Czechia",
    "Czechia": "Czechia",
    "United Kingdom": "United Kingdom",
    "Russia": "Russian Federation",
}

# Product names and their short forms.
PRODUCT_ALIASES = {
    "azure sentinel": "sentinel",
    "microsoft defender": "defender",
    "microsoft entra id": "entra id",
    "google cloud platform": "gcp",
    "amazon web services": "aws",
    "red hat enterprise linux": "rhel",
    "office 365": "microsoft 365",
}

# Canonical terms. Keys holding "-", "&" or "," cannot be reached: normalising
# removes those characters before the lookup.
CANONICAL_TERMS = {
    "cyber-security": "cybersecurity",
    "cyber security": "cybersecurity",
    "cyber": "cybersecurity",
    "it security": "information security",
    "it security operations": "security operations",
    "security operations center": "security operations center",
    "soc": "security operations center",
    "security information and event management": "siem",
    "security information event management": "siem",
    "cyber threat intelligence": "cti",
    "cyber threat intelligence cti": "cti",
    "identity and access management": "iam",
    "ibm identity and access management": "iam",
    "access management": "identity and access management",
    "general data protection regulation": "gdpr",
    "information security management system": "isms",
    "information security management": "information security management",
    "payment card industry data security standard": "pci dss",
    "internet protocol suite": "tcp/ip",
    "internet protocol": "ip",
    "voice over ip": "voip",
    "dynamic host configuration protocol": "dhcp",
    "domain name system": "dns",
    "virtual private network": "vpn",
    "transport layer security": "tls",
    "application programming interfaces": "api",
    "representational state transfer": "rest",
    "object oriented programming": "oop",
    "continuous integration and continuous delivery": "ci/cd",
    "continuous integration": "ci",
    "large language models": "llm",
    "software development life cycle": "sdlc",
    "infrastructure as code": "iac",
    "hardware security module": "hsm",
    "threat vulnerability management": "vulnerability management",
    "threat & vulnerability management": "vulnerability management",
    "cybersecurity incident response": "incident response",
    "security incident response": "incident response",
    "major incident management": "incident management",
    "endpoint security": "endpoint security",
    "application security assessments": "application security",
    "security architecture design": "security architecture",
    "it risk management": "risk management",
    "governance risk management and compliance": "grc",
    "governance risk compliance": "grc",
    "governance, risk management, and compliance": "grc",
    "data loss prevention": "dlp",
}

# Normalised skills too broad to count.
EXCLUDED_SKILLS = ["english", "cybersecurity"]

# Spellings under which a field may appear in raw records.
FIELD_SPELLINGS = {
    "title": ["Title", "Job Title", "title"],
    "description": ["Description", "description"],
    "skill": ["Skill", "skill"],
}

# Similarity bands of the mapping report.
SIMILARITY_STEPS = [0.55, 0.65, 0.75]

# Default function words per language, for the built-in detector and term counts.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "with", "for", "are", "this",
           "you", "not", "have", "from", "they", "will", "on", "at", "by"],
    "fr": ["le", "la", "les", "et", "des", "une", "du", "dans", "que", "qui", "pour",
           "est", "pas", "sur", "avec", "ce", "nous", "vous", "aux", "par"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "ein", "eine", "den",
           "von", "zu", "auf", "dem", "des", "im", "sich", "wir", "sie", "werden"],
    "es": ["el", "los", "las", "y", "una", "por", "con", "para", "del", "se", "que",
           "es", "no", "como", "al", "lo", "su", "más", "pero", "en"],
    "it": ["il", "gli", "di", "che", "per", "con", "una", "del", "della", "sono",
           "non", "nel", "alla", "anche", "come", "questo", "dei", "più", "è", "un"],
    "nl": ["de", "het", "een", "van", "en", "voor", "met", "niet", "zijn", "op",
           "aan", "dat", "je", "wij", "ook", "bij", "naar", "als", "wordt", "om"],
}
