"""Skills that a text names, in the order of a taxonomy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.normalize import folded

# Canonical skills and the patterns that name them, in taxonomy order.
TAXONOMY = {
    "Python": r"python",
    "Java": r"\bjava\b(?!\s*script)",
    "JavaScript": r"javascript|\bjs\b",
    "TypeScript": r"typescript|\bts\b(?=\W)",
    "C++": r"c\+\+",
    "C#": r"c#|c-sharp|csharp",
    ".NET": r"\.net\b|dotnet|asp\.net",
    "Go": r"\bgolang\b|\bgo\b(?=\s*(?:developer|engineer|programming|language|\(golang\)|/|,))",
    "Rust": r"(?-i:\bRust\b)(?<!de Rust)(?<!De Rust)(?!\s+(?:en|in|aan|van|voor|op|om|is|te|nodig|brengen)\b)(?<!alle Rust)(?<!met Rust)|\brust(?:lang|-lang)\b|\brust (?:developer|engineer|programming|programmer)\b",
    "Kotlin": r"kotlin",
    "Swift": r"\bswift\b(?!\s*(?:code|payment|transfer))",
    "Scala": r"(?<!een )(?<!breed )(?<!brede )(?<!ruim )(?<!ruime )(?<!groot )(?<!grote )(?<!hele )\bscala\b(?!\s+(?:aan|van)\b)",
    "Ruby": r"\bruby\b|\brails\b",
    "PHP": r"\bphp\b|laravel|symfony",
    "R": r"\bR\b(?=\s*(?:programming|language|/|,|and|or|\)))",
    "SQL": r"\bsql\b|postgres|mysql|t-sql|pl/sql",
    "Bash": r"\bbash\b|shell scripting",
    "MATLAB": r"matlab",
    "Dart": r"\bflutter\b|\bdart\b",
    "Elixir": r"elixir",
    "Haskell": r"haskell",
    "React": r"\breact(?:\.js|js)?\b(?!\s*native)",
    "React Native": r"react\s*native",
    "Angular": r"\bangular(?:js)?\b",
    "Vue": r"\bvue(?:\.js|js)?\b|\bnuxt\b",
    "Next.js": r"next\.?js",
    "Node.js": r"node\.?js|\bnode\b",
    "HTML/CSS": r"\bhtml\b|\bcss\b|tailwind|\bsass\b",
    "GraphQL": r"graphql",
    "REST APIs": r"\brestful\b|\brest\W{0,3}(?:api|service|endpoint|interface)|\bapi(?:s)?\b",
    "Django": r"django",
    "Flask": r"\bflask\b",
    "FastAPI": r"fastapi",
    "Spring": r"spring\s*boot|\bspring\b",
    "iOS": r"\bios\b|swiftui",
    "Android": r"android",
    "Machine Learning": r"machine\s*learning|\bml\b",
    "Deep Learning": r"deep\s*learning|neural\s*net",
    "PyTorch": r"pytorch|\btorch\b",
    "TensorFlow": r"tensorflow|\bkeras\b",
    "scikit-learn": r"scikit|sklearn",
    "pandas": r"\bpandas\b",
    "NLP": r"\bnlp\b|natural language processing",
    "Computer Vision": r"computer vision|\bopencv\b",
    "LLMs": r"\bllms?\b|large language model|generative ai|\bgenai\b|\bgpt\b|openai|\brag\b|retrieval[- ]augmented|langchain|prompt engineering",
    "MLOps": r"mlops|mlflow|kubeflow|model deployment|model serving",
    "Spark": r"\bspark\b|pyspark",
    "Databricks": r"databricks",
    "Airflow": r"airflow",
    "dbt": r"\bdbt\b",
    "Kafka": r"\bkafka\b",
    "Snowflake": r"snowflake",
    "BigQuery": r"bigquery",
    "Data Engineering": r"data engineering|\betl\b|\belt\b|data pipelines?",
    "Statistics": r"statistic",
    "Power BI / Tableau": r"power\s*bi|tableau|looker",
    "AWS": r"\baws\b|amazon web services",
    "Azure": r"\bazure\b",
    "GCP": r"\bgcp\b|google cloud",
    "Docker": r"\bdocker\b|containeri[sz](?:ation|ed)|\bpodman\b",
    "Kubernetes": r"kubernetes|\bk8s\b|\bopenshift\b|\bhelm\b",
    "Terraform": r"terraform|infrastructure as code|\biac\b|pulumi|cloudformation",
    "CI/CD": r"ci/cd|\bci\b|continuous integration|continuous delivery|github actions|gitlab ci|jenkins|azure devops",
    "Linux": r"\blinux\b|\bunix\b",
    "Git": r"\bgit\b|github|gitlab",
    "Monitoring/Observability": r"observability|prometheus|grafana|datadog|opentelemetry|\belk\s*stack\b|splunk|monitoring (?:tools|systems?|stack|solutions?|and alerting|and logging)|(?:application|infrastructure|system) monitoring|logging and monitoring|monitoring, logging|alerting",
    "Ansible": r"ansible|puppet|\bchef\b",
    "Networking": r"\btcp/ip\b|networking|\bdns\b|\bvpn\b|\bcisco\b|firewall|fortinet|palo alto|\bjuniper\b|\bsd-?wan\b|\bwlan\b|\bccn[ap]\b|netwerk(?:beheer|infrastructuur|engineer|specialist|techniek)\w*",
    "IT Support": r"\bservice ?desk\b|\bhelp ?desk\b|\b(?:1e|2e|eerste|tweede)[- ]?lijns?\b|\beerstelijns\w*|\btweedelijns\w*|\b(?:first|second)[- ]line support\b|end[- ]user support|\bit[- ]support\b",
    "Application Management": r"(?<!met )applicatiebeheer\w*|(?<!met )functioneel beheer\w*|application management|application support",
    "Microsoft 365": r"microsoft 365|office 365|\bm365\b|\bo365\b|exchange online|sharepoint|microsoft teams",
    "Windows Server/AD": r"windows server|active directory|\bentra id\b|azure ad\b|group polic(?:y|ies)",
    "Endpoint Management": r"\bintune\b|endpoint manager|\bsccm\b|\bmecm\b|\bjamf\b",
    "Virtualization": r"vmware|\bvsphere\b|hyper-v|\bcitrix\b|virtuali[sz]ation|proxmox",
    "ITIL/ITSM": r"\bitil\b|\bitsm\b|servicenow|topdesk|jira service management",
    "Serverless": r"serverless|\blambda\b|azure functions",
    "PostgreSQL": r"postgres",
    "MySQL": r"mysql|mariadb",
    "MongoDB": r"mongodb|\bmongo\b",
    "Redis": r"\bredis\b",
    "Elasticsearch": r"elasticsearch|opensearch",
    "RabbitMQ": r"rabbitmq",
    "NoSQL": r"nosql|dynamodb|cassandra",
    "Microservices": r"microservices?|micro-services?",
    "Testing": r"unit test|test automation|\btdd\b|pytest|\bjest\b|cypress|playwright|selenium|integration test",
    "Agile/Scrum": r"\bagile\b|\bscrum\b|\bkanban\b",
    "System Design": r"system design|distributed systems|software architecture|scalable (?:systems?|architectures?|services?|platforms?)|high[- ]availability",
    "Security": r"cyber\s*security|application security|security engineer|infosec|information security|\boauth\b|penetration test|\biso 27001\b|\bowasp\b|secure coding|security best practices|\bsecurity\b(?=.{0,40}(?:vulnerabilit|threat|encryption|authentication|pentest|audit))",
    "DevOps": r"devops|\bsre\b|site reliability",
    "Embedded": r"embedded (?:software|systems?|engineer|linux|developer|c\b|c\+\+|development)|firmware|\brtos\b|microcontroller|\bfpga\b|\bvhdl\b|\bverilog\b",
    "Robotics": r"\bros\b|robotics",
    "Simulation/CAE": r"simulation (?:engineer\w*|model\w*|software|tools?|stud(?:y|ies)|analys[ie]s|environments?|framework|platform|code|results?|techniques?|methods?|experts?)|(?:numerical|physics(?:-based)?|finite[- ]element|process|flow|fluid|thermal|structural|multi-?body|monte carlo|discrete[- ]event|dynamic|electromagnetic|optical|traffic|hydraulic|molecular|quantum|circuit|device) simulations?|\bsimulators?\b|\bcfd\b|computational fluid dynamics|finite[- ]element|\bfea\b|\bfem\b|multiphysics|\bansys\b|\babaqus\b|\bcomsol\b|openfoam|star-?ccm|ls-?dyna|\bnastran\b|simulink|digital twin|numerical model\w*",
    "Blockchain": r"blockchain|solidity|web3|crypto",
    "Product Management": r"product management",
    "UX/Design": r"\bfigma\b|ux/ui|ui/ux|ux design|user experience design|\bux\b(?=\s*(?:designer|design|research))",
    "SAP": r"\bsap\b",
    "ERP": r"\berp\b|\bafas\b|exact online|dynamics 365|navision|business central|\bodoo\b",
    "PLC/Industrial Automation": r"\bplc\b|\bscada\b|siemens tia|\btia portal\b|\bstep ?7\b|codesys|beckhoff|rockwell|\bdcs\b",
    "Salesforce": r"salesforce|\bapex\b",
    "Mendix/Low-code": r"mendix|outsystems|low-code|low code|power apps|powerapps",
    "Data Science": r"data science|data scientist",
    "Quantitative": r"quantitative|\bquant\b",
}


def find_skills(text: Column, taxonomy: dict[str, str] = TAXONOMY) -> Column:
    """The skills whose pattern occurs in ``text``, as an array in taxonomy order."""
    return F.array_compact(F.array(*(F.when(text.rlike(folded(rx)), F.lit(name)) for name, rx in taxonomy.items())))


# Spellings that are clear in a list of skills, though not inside a text.
TYPED = {
    "ai": "Machine Learning", "artificial intelligence": "Machine Learning", "genai": "LLMs", "gen ai": "LLMs", "generative ai": "LLMs", "llm": "LLMs", "large language models": "LLMs", "ml": "Machine Learning",
    "dl": "Deep Learning", "cv": "Computer Vision", "k8s": "Kubernetes", "js": "JavaScript", "ts": "TypeScript", "golang": "Go", "node": "Node.js", "nodejs": "Node.js", "reactjs": "React", "react.js": "React",
    "vuejs": "Vue", "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "sklearn": "scikit-learn", "scikit learn": "scikit-learn", "torch": "PyTorch", "tf": "TensorFlow", "gcp": "GCP", "google cloud": "GCP",
    "aws": "AWS", "amazon web services": "AWS", "ci": "CI/CD", "cicd": "CI/CD", "ci cd": "CI/CD", "c sharp": "C#", "csharp": "C#", "dotnet": ".NET", "cpp": "C++", "html": "HTML/CSS", "css": "HTML/CSS",
    "rest": "REST APIs", "api": "REST APIs", "apis": "REST APIs", "observability": "Monitoring/Observability", "monitoring": "Monitoring/Observability", "prometheus": "Monitoring/Observability",
    "grafana": "Monitoring/Observability", "scrum": "Agile/Scrum", "agile": "Agile/Scrum", "tableau": "Power BI / Tableau", "power bi": "Power BI / Tableau", "powerbi": "Power BI / Tableau",
    "mendix": "Mendix/Low-code", "low code": "Mendix/Low-code", "ux": "UX/Design", "figma": "UX/Design", "unit testing": "Testing", "tdd": "Testing", "pytest": "Testing",
}


def canonical_skill(name: Column, taxonomy: dict[str, str] = TAXONOMY) -> Column:
    """The taxonomy's name of a typed skill: itself, a known spelling, a whole match of a pattern, or the first pattern inside it; null if none fits or the name is empty."""
    key = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    spelled = F.create_map(*(F.lit(x) for pair in (TYPED | {s.lower(): s for s in taxonomy}).items() for x in pair))
    whole = F.array_compact(F.array(*(F.when(key.rlike(folded(rf"^(?:{rx})$")), F.lit(s)) for s, rx in taxonomy.items())))
    return F.when(key != "", F.coalesce(F.try_element_at(spelled, key), F.get(whole, F.lit(0)), F.get(find_skills(key, taxonomy), F.lit(0))))


def canonical_skills(names: Column, keep_unknown: bool = False, taxonomy: dict[str, str] = TAXONOMY) -> Column:
    """The taxonomy's names of typed skills, each once, in their order; with ``keep_unknown`` others stay as typed."""
    other = lambda n: F.nullif(F.trim(n), F.lit("")) if keep_unknown else F.lit(None).cast("string")
    return F.array_distinct(F.array_compact(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.coalesce(canonical_skill(n, taxonomy), other(n)))))
