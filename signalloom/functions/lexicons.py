"""Lookup tables, word lists and patterns results depend on."""

# Organization tokens with a spelling of their own.
DISPLAY_NAMES = {
    "WELLS_FARGO": "Wells Fargo",
    "BARCLAYS": "Barclays",
    "BNY": "BNY",
    "CITIBANK": "Citibank",
    "GOLDMAN_SACHS": "Goldman Sachs",
    "MORGAN_STANLEY": "Morgan Stanley",
}

# Names under which an organization is mentioned.
ORGANIZATION_ALIASES = {
    "Wells Fargo": ["wells fargo"],
    "Goldman Sachs": ["goldman sachs", "goldman"],
    "BNY": ["bny", "bny mellon", "bank of new york mellon"],
    "Citibank": ["citibank", "citi", "citigroup"],
    "Morgan Stanley": ["morgan stanley"],
    "Barclays": ["barclays"],
}

# Employment phrases of file snapshots and of the nested source.
EMPLOYMENT_TYPES = {
    "full time": "full_time",
    "part time": "part_time",
    "permanent": "full_time",
    "contract": "contract",
    "contractor": "contract",
    "temporary": "temporary",
    "intern": "internship",
    "internship": "internship",
}
PAYLOAD_EMPLOYMENT_TYPES = {k: v for k, v in EMPLOYMENT_TYPES.items() if k not in ("permanent", "contractor")}

# Short labels of snapshot capabilities.
CAPABILITY_LABELS = {
    "ai": "Data and AI",
    "artificial intelligence": "Data and AI",
    "data & ai": "Data and AI",
    "data and analytics": "Data and AI",
    "cloud": "Cloud and Platform Engineering",
    "platform engineering": "Cloud and Platform Engineering",
    "cyber security": "Cybersecurity",
    "information security": "Cybersecurity",
    "risk": "Risk and Compliance",
    "compliance": "Risk and Compliance",
    "fraud": "Fraud and Financial Crime",
    "operations": "Operations and Automation",
    "automation": "Operations and Automation",
    "customer service": "Customer Experience",
    "digital product": "Product and Digital",
}

# Enrichment enumerations, keyed by their folded spelling.
CAPABILITIES = {
    "artificial intelligence machine learning": "Artificial Intelligence / Machine Learning",
    "data and analytics": "Data & Analytics",
    "software engineering": "Software Engineering",
    "cloud and infrastructure": "Cloud & Infrastructure",
    "cybersecurity": "Cybersecurity",
    "risk and compliance": "Risk & Compliance",
    "digital banking": "Digital Banking",
    "payments": "Payments",
    "operations": "Operations",
    "finance": "Finance",
    "customer experience": "Customer Experience",
    "product management": "Product Management",
    "other": "Other",
    "ai": "Artificial Intelligence / Machine Learning",
    "ai ml": "Artificial Intelligence / Machine Learning",
    "data and ai": "Artificial Intelligence / Machine Learning",
    "machine learning": "Artificial Intelligence / Machine Learning",
    "data analytics": "Data & Analytics",
    "cloud and platform engineering": "Cloud & Infrastructure",
    "cloud infrastructure": "Cloud & Infrastructure",
    "product and digital": "Digital Banking",
    "operations and automation": "Operations",
}
SENIORITIES = {
    "entry": "entry",
    "junior": "entry",
    "mid": "mid",
    "mid level": "mid",
    "senior": "senior",
    "staff": "senior",
    "lead": "lead",
    "principal": "lead",
    "manager": "manager",
    "director": "director",
    "vp": "director",
    "vice president": "director",
    "executive": "executive",
    "unknown": "unknown",
}
THEMES = {
    "ai adoption": "AI adoption",
    "cloud modernization": "cloud modernization",
    "data modernization": "data modernization",
    "risk modernization": "risk modernization",
    "cybersecurity": "cybersecurity",
    "digital transformation": "digital transformation",
    "platform engineering": "platform engineering",
}
ENRICHMENT_FIELDS = ["capability_classifications", "skills", "technologies", "seniority_level", "is_leadership", "business_unit", "hiring_themes"]

# Technology spellings and categories.
TECHNOLOGY_NAMES = {
    "amazon web services": "AWS",
    "aws": "AWS",
    "excel": "Excel",
    "google cloud platform": "Google Cloud",
    "gcp": "Google Cloud",
    "hadoop": "Hadoop",
    "kubernetes": "Kubernetes",
    "microsoft azure": "Microsoft Azure",
    "ms excel": "Excel",
    "microsoft excel": "Excel",
    "oracle": "Oracle",
    "power bi": "Power BI",
    "powerbi": "Power BI",
    "python": "Python",
    "sas": "SAS",
    "sql": "SQL",
    "tableau": "Tableau",
    "teradata": "Teradata",
    "vba": "VBA",
}
TECHNOLOGY_CATEGORIES = {
    "AWS": "Cloud Platform",
    "Excel": "Analytics / Statistical Tool",
    "Google Cloud": "Cloud Platform",
    "Hadoop": "Data Platform",
    "Kubernetes": "DevOps / Infrastructure",
    "Microsoft Azure": "Cloud Platform",
    "Oracle": "Database",
    "Power BI": "BI / Visualization",
    "Python": "Programming Language",
    "SAS": "Analytics / Statistical Tool",
    "SQL": "Database",
    "Tableau": "BI / Visualization",
    "Teradata": "Data Platform",
    "VBA": "Programming Language",
}

# Surface forms of technologies in free text.
TECHNOLOGY_TERMS = {
    "Python": ["python"],
    "Java": ["java"],
    "JavaScript": ["javascript"],
    "TypeScript": ["typescript"],
    "C++": ["c++"],
    "C#": ["c#"],
    ".NET": [".net", "dotnet"],
    "Golang": ["golang"],
    "Scala": ["scala"],
    "Kotlin": ["kotlin"],
    "Ruby": ["ruby"],
    "PHP": ["php"],
    "Perl": ["perl"],
    "COBOL": ["cobol"],
    "Mainframe": ["mainframe", "z/os"],
    "PL/SQL": ["pl/sql", "plsql"],
    "SQL": ["sql"],
    "NoSQL": ["nosql"],
    "VBA": ["vba"],
    "Node.js": ["node.js", "nodejs", "node js"],
    "React": ["react.js", "reactjs", "react"],
    "Angular": ["angular.js", "angularjs", "angular"],
    "Vue.js": ["vue.js", "vuejs", "vue"],
    "Spring": ["spring boot", "spring framework", "spring mvc", "spring batch"],
    "Hibernate": ["hibernate"],
    "Microservices": ["microservices", "micro services"],
    "REST": ["restful api", "rest api", "rest apis"],
    "GraphQL": ["graphql"],
    "AWS": ["aws", "amazon web services"],
    "Azure": ["azure", "microsoft azure"],
    "Google Cloud Platform": ["gcp", "google cloud platform", "google cloud"],
    "Kubernetes": ["kubernetes", "k8s"],
    "Docker": ["docker"],
    "OpenShift": ["openshift"],
    "Terraform": ["terraform"],
    "CloudFormation": ["cloudformation"],
    "Ansible": ["ansible"],
    "Puppet": ["puppet"],
    "Jenkins": ["jenkins"],
    "CI/CD": ["ci/cd", "continuous integration", "continuous deployment"],
    "Git": ["git", "github", "gitlab", "bitbucket"],
    "JIRA": ["jira"],
    "Confluence": ["confluence"],
    "ServiceNow": ["servicenow"],
    "Splunk": ["splunk"],
    "SonarQube": ["sonarqube"],
    "JUnit": ["junit"],
    "Selenium": ["selenium"],
    "Maven": ["maven"],
    "Gradle": ["gradle"],
    "Linux": ["linux"],
    "Unix": ["unix"],
    "Windows Server": ["windows server"],
    "VMware": ["vmware"],
    "Citrix": ["citrix"],
    "Active Directory": ["active directory"],
    "Okta": ["okta"],
    "CyberArk": ["cyberark"],
    "Palo Alto Networks": ["palo alto networks", "palo alto firewall"],
    "CrowdStrike": ["crowdstrike"],
    "QRadar": ["qradar"],
    "Oracle": ["oracle database", "oracle db", "oracle"],
    "MySQL": ["mysql"],
    "PostgreSQL": ["postgresql", "postgres"],
    "MongoDB": ["mongodb", "mongo db"],
    "DB2": ["db2"],
    "Redis": ["redis"],
    "Cassandra": ["cassandra"],
    "Elasticsearch": ["elasticsearch", "elastic search"],
    "Kafka": ["kafka", "apache kafka"],
    "RabbitMQ": ["rabbitmq"],
    "Hadoop": ["hadoop"],
    "Apache Spark": ["apache spark", "pyspark", "spark sql"],
    "Airflow": ["airflow", "apache airflow"],
    "Snowflake": ["snowflake"],
    "Databricks": ["databricks"],
    "dbt": ["dbt"],
    "Informatica": ["informatica"],
    "Talend": ["talend"],
    "Tableau": ["tableau"],
    "Power BI": ["power bi", "powerbi"],
    "Alteryx": ["alteryx"],
    "SAS": ["sas programming", "sas software", "sas macros"],
    "TensorFlow": ["tensorflow"],
    "PyTorch": ["pytorch"],
    "SAP": ["sap"],
    "Salesforce": ["salesforce"],
    "Bloomberg Terminal": ["bloomberg terminal", "bloomberg professional"],
    "Murex": ["murex"],
    "Calypso": ["calypso"],
    "Summit": ["summit fintegration", "summit fnp"],
    "Aladdin": ["aladdin platform", "blackrock aladdin"],
    "FIS": ["fis global", "fis profile"],
    "Temenos": ["temenos"],
    "Finastra": ["finastra"],
    "Avaloq": ["avaloq"],
}
CASED_TECHNOLOGY_TERMS = {"Excel": ["Excel"], "Spark": ["Spark"], "Chef": ["Chef"]}

# Ordered substring rules of the fallback classifier.
CAPABILITY_RULES = [
    ("Data and AI", ["data", "artificial intelligence", "machine learning", " genai", " ai "]),
    ("Cloud and Platform Engineering", ["cloud", "platform", "devops", "site reliability"]),
    ("Cybersecurity", ["cyber", "security", "identity", "iam"]),
    ("Fraud and Financial Crime", ["fraud", "financial crime", "aml"]),
    ("Risk and Compliance", ["risk", "compliance", "audit"]),
    ("Customer Experience", ["customer", "client experience", "contact center"]),
    ("Operations and Automation", ["operations", "automation", "operational"]),
    ("Product and Digital", ["product", "digital"]),
    ("Finance", ["finance", "accounting", "treasury"]),
]
SENIORITY_RULES = [
    ("Executive", ["chief ", "head of"]),
    ("VP", ["vice president", " vp ", "-avp"]),
    ("Director", ["director"]),
    ("Manager", ["manager", "lead "]),
    ("Senior", ["senior", "principal", "staff "]),
    ("Entry", ["junior", "graduate", "intern"]),
]
SENIOR_LEVELS = ["Director", "VP", "Executive"]

RELATED_MARKERS = ["Explore More Jobs"]
REPORT_TERMS = ["report", "opportunit", "priorit", "account growth", "where can we grow", "30 day", "60 day", "90 day", "180 day", "360 day", "roadmap"]

# Direction words of conflict detection.
UP_WORDS = ["growth", "increase", "increasing", "expansion", "up"]
DOWN_WORDS = ["decline", "decrease", "decreasing", "contraction", "down"]

# Source types by rank and role.
SOURCE_RANKS = {
    "earnings_release": 0,
    "quarterly_report": 1,
    "annual_report": 2,
    "sec_filing": 3,
    "investor_presentation": 4,
    "earnings_call": 5,
    "company_announcement": 6,
    "company_strategy_page": 6,
    "leadership_statement": 7,
    "news": 8,
    "industry_research": 9,
    "other": 10,
}
TIER_ONE_SOURCES = ["earnings_release", "quarterly_report", "annual_report", "sec_filing", "investor_presentation", "earnings_call", "company_strategy_page", "company_announcement"]
OFFICIAL_SOURCES = ["earnings_release", "annual_report", "quarterly_report", "sec_filing", "investor_presentation", "company_announcement", "company_strategy_page"]
LEADERSHIP_SOURCES = ["earnings_release", "earnings_call", "leadership_statement"]
EXTERNAL_SOURCES = ["news", "industry_research"]

# Patterns of the text gates.
FORWARD_GUIDANCE = (
    r"(?i)\b(?:we\s+(?:will|plan|expect|intend|aim|are\s+expanding|continue)|our\s+(?:priority|plan|strategy|focus)\s+is|"
    r"(?:plans?|expects?|intends?|aims?|targets?)\s+to|"
    r"(?:will|would)\s+(?:invest|expand|grow|transform|simplify|reduce|optimize|reallocate|exit|continue)|"
    r"remains?\s+(?:a|our|the)\s+(?:top\s+)?priority)\b"
)
SELF_NEGATING = r"(?i)\b(?:not|isn['’]t|does\s+not|rather\s+than)\b.{0,100}\b(?:major|standalone|current|near-term)\b.{0,60}\bpriority\b"
MAJOR_PRIORITY_QUESTION = r"(?i)\bmajor\b.{0,80}\b(?:priority|priorities)\b|\b(?:priority|priorities)\b.{0,80}\bmajor\b"
YES_NO_QUESTION = r"(?i)^\s*(?:is|are|was|were|will|would|can|could|does|do|did|has|have|should)\b"
EXPLICIT_PRIORITY = (
    r"(?i)\b(?:major|top|core|key|primary|principal)\s+(?:business\s+|strategic\s+|investment\s+)?(?:priority|priorities|focus|initiative)|"
    r"\b(?:priority|priorities)\s+(?:is|are|include|remain|continues?\s+to\s+be)\b"
)
COMPLETED_ACTIVITY = r"(?i)\b(?:completed?|fully\s+exited|has\s+rebuilt|had\s+completed|previously)\b"
ACTIVE_ACTIVITY = (
    r"(?i)\b(?:is|are|continues?|remain(?:s)?|currently)\s+(?:focused|focusing|investing|increasing|expanding|building|changing|reducing|"
    r"simplifying|transforming|optimizing|modernizing|prioritizing|advancing|executing|bringing|shifting|realigning|consolidating)\b"
)
UNSAFE_CLAIMS = [
    r"\bstrategy is\b",
    r"\bis investing\b",
    r"\bis migrating\b",
    r"\bis transforming\b",
    r"\bplans to\b",
    r"\bhas standardized\b",
    r"\bhas deployed\b",
    r"\bhas adopted\b",
    r"\benterprise technology strategy\b.{0,80}\b(?:is|focuses|centers|concentrat(?:es|ed))\b",
]
TECHNOLOGY_SCOPE = r"\b(?:technology|technologies|technical|ai|artificial intelligence|machine learning|ml)\b"
HIRING_SCOPE = r"\b(?:hiring|job postings?|jobs|recruitment)\b"
CROSS_DOMAIN_ASSERTION = (
    r"\b(?:hiring|recruitment)\b.{0,120}\b(?:demonstrates?|establishes?|proves?|confirms?)\b.{0,120}\b(?:technology strategy|technology adoption|technology intent)\b"
)
TITLE_REPORT_YEAR = r"(?i)\b(20\d{2})\s+(?:annual\s+report|form\s+10-k)\b"
PATH_REPORT_YEAR = r"(?i)/(20\d{2})/(?:[^/]+/)*(?:annual[-_]?report|report)"

# Weights of the composite scores.
OPPORTUNITY_WEIGHTS = {"strategy": 0.20, "leadership": 0.15, "hiring": 0.15, "financial": 0.15, "technology": 0.10, "news": 0.10, "consulting_fit": 0.10, "recency": 0.05}
CITATION_WEIGHTS = {
    "source_evidence": 1.0,
    "hiring_enrichment": 0.8,
    "hiring_signal": 0.7,
    "technology_observation": 0.7,
    "technology_signal": 0.65,
    "cross_domain_signal": 0.65,
}
SUPPORT_WEIGHTS = {"source_evidence": 0.9, "ai_enrichment": 0.6, "derived_analytics": 0.7, "derived_signal": 0.8}
HORIZONS = {
    30: "Immediate account discussion, validation, or discovery",
    60: "Near-term stakeholder engagement and qualification",
    90: "Workshop, assessment, or early proposal development",
    180: "Medium-term pursuit requiring relationship or solution development",
    360: "Longer-term opportunity requiring continued monitoring",
}
