"""The kind of job that a title names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.normalize import folded

# Position types and the patterns that tell them, in order; the first that matches wins.
SPECIFIC = [
    ("phd_research", r"\bphd\b|\bpostdoc|\bpromov|research (?:scientist|engineer|fellow|associate)|\bresearcher\b|onderzoeker|wetenschappelijk|research intern"),
    ("product_manager", r"product ?manager|product lead|head of product|product director|productmanagement"),
    ("product_owner", r"product ?owner"),
    ("scrum_agile", r"scrum ?master|agile coach|release train engineer|\brte\b"),
    ("project_manager", r"project ?manager|projectleider|program(?:me|ma)? ?manager|programmamanager|delivery manager|project ?lead|implementatiemanager|implementation manager|projects? director"),
    ("engineering_manager", r"engineering manager|head of (?:engineering|software|development|data|it)|development manager|\bcto\b|(?:it|ict) ?manager|manager (?:it|ict|software|development)|teamleider (?:it|ict|ontwikkel)|hoofd (?:it|ict)|\bcio\b|director (?:of )?(?:engineering|technology|it)"),
    ("ux_designer", r"\bux\b|\bui\b|user experience|interaction designer|product designer|service designer"),
    ("security_officer", r"security officer|\bciso\b|\bgrc\b|privacy officer|\biso\b|risk (?:officer|manager|consultant)|compliance (?:officer|specialist)|security (?:governance|awareness)|it audit|\bauditor\b|it control|^(?=.*(?:security|cyber|beveilig))(?=.*(?:consultant|adviseur|advisor|toezicht)).*"),
    ("security_engineer", r"security|cyber|beveilig|\bsoc\b|pentest\w*|penetration|ethical hack|\biam\b|identity (?:and|&) access|threat|vulnerab"),
    ("data_scientist", r"data scien"),
    ("ml_engineer", r"\bml\b|mlops|llm|gen ?ai|generative ai|computer vision|\bnlp\b|deep learning|applied scientist|prompt engineer|\bai (?:engineer|developer|specialist|scientist|researcher|expert|lead|agent)|reinforcement learning"),
    ("data_consultant", r"(?:data|ai|analytics|bi) ?(?:management |strategy |governance )?(?:consultant|adviseur|advisor)|data management|data governance|data steward|data quality|\bmdm\b|data manager|data transformation|^(?=.*\b(?:data|ai|analytics)\b)(?!.*\b(?:sap|salesforce|dynamics|servicenow)\b|.*engineer)(?=.*(?:consultant|adviseur|advisor)).*|(?:data|ai)\b.{0,12}traineeship|traineeship data|digital (?:en|and|&) data|master data"),
    ("data_architect", r"data architect"),
    ("bi_analyst", r"data analy|\bbi\b|business intelligence|power ?bi|tableau|qlik|reporting|analytics (?:analyst|specialist)|data specialist|informatie ?analy|insights? analy|process mining|web analy|spotfire|looker|product analy"),
    ("data_engineer", r"data ?engineer|analytics engineer|data platform|\betl\b|data warehouse|dwh|databricks|data ?ontwikkel"),
    ("business_analyst", r"business analy|functioneel analy|functional analy|requirements|it analy|proces ?analy|process analy"),
    ("architect", r"architect"),
    ("sales_engineer", r"sales engineer|pre-?sales|solutions? engineer|solution consultant|field application|forward deployed|customer engineer|technical account manager"),
    ("low_code", r"mendix|outsystems|power ?(?:platform|apps|automate)|low-?code|uipath|\brpa\b"),
    ("embedded", r"embedded|firmware|\bfpga\b|\bvhdl\b|microcontroller"),
    ("plc_automation", r"\bplc\b|scada|\bot\b|industri\w* automati|procesautomati|machine ?besturing|besturingstechni|industrial automation"),
    ("hardware", r"hardware|electronic|elektronic|\brf\b|\bpcb\b|analog|chip design|\basic\b"),
    ("simulation", r"simulat|\bcfd\b|\bfea\b|finite element|modell?ing"),
    ("qa_test", r"\btest|\bqa\b|quality assurance|testautomat"),
    ("devops", r"devops|devsecops|ci/cd|release (?:manager|engineer)"),
    ("platform_sre", r"platform engineer|site reliability|\bsre\b|platform"),
    ("cloud", r"cloud|azure|\baws\b|\bgcp\b|kubernetes"),
    ("network", r"network|netwerk|telecom|firewall|\bnoc\b|routing|switching"),
    ("systems", r"system(?:s)? (?:engineer|administrator|specialist|beheer)|systeem ?(?:beheer|engineer|specialist)|infrastructu|infra (?:engineer|specialist)|linux|windows|middleware|storage|database administrator|\bdba\b|mainframe|database ?(?:engineer|operations|specialist|beheer)|\bi[ct]t? (?:engineer|beheer)\b"),
    ("app_admin", r"applicatie ?beheer|functioneel (?:beheer|administrator)|application (?:manager|administrator|specialist|management)|technisch applicatie"),
    ("it_support", r"support|helpdesk|service ?desk|werkplek|workplace|^(?!.*consultant).*(?:microsoft 365|\bm365\b)|intune|end ?user|desktop|ict medewerker|it medewerker"),
    ("software_engineer", r"^(?=.*\b(?:sap|erp|salesforce|dynamics|servicenow|oracle|workday)\b).*\b(?:developer|programmer)\b"),
    ("it_consultant", r"\bsap\b|\berp\b|salesforce|dynamics|servicenow|oracle|workday|consultant|adviseur"),
    ("mobile", r"\bios\b|android|mobile|flutter|react native|swift"),
    ("frontend", r"frontend|front end|react|angular|vue|web developer|webdeveloper|typescript|javascript"),
    ("fullstack", r"fullstack|full stack"),
    ("software_engineer", r"software|developer|backend|back end|programm|\.net|java|python|golang|\bgo\b|c\+\+|c#|php|ruby|rust|scala|integrati|tech(?:nical|nology)? lead|(?:ict|it|web|portaal|portal) ?(?:development|ontwikkeling)"),
]
# Catch-alls, tried when nothing specific matched; the first of them in the main part of a title only.
MAIN_PART_ONLY = [("ml_engineer", r"\bai\b")]
CATCH_ALL = [("plc_automation", r"automation engineer"), ("software_engineer", r"engineer|engineering")]
# Spellings made one before the patterns are tried.
SPELLING = [(r"ontwikkelaar", "developer"), (r"\bprogrammeur\b", "developer"), (r"\bfront[- ]?end\b", "frontend"), (r"\bback[- ]?end\b", "backend"), (r"\bfull[- ]?stack\b", "fullstack"), (r"\bdev[- ]?ops\b", "devops"), (r"\bmachine[- ]learning\b", "ml"), (r"\bartificial intelligence\b", "ai"), (r"analist", "analyst"), (r"\bbeheerder\b", "beheer"), (r"(?<=\w)-(?=\w)", " ")]
TITLE_TAGS = r"\b(?:m/v/x|m/v|m/f/x|m/f/d|m/f|f/m/x|v/m|h/f|w/m/d|m/w/d)\b"


def clean_title(title: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "(?U)" + TITLE_TAGS, " ")
    t = reduce(lambda text, pair: F.regexp_replace(text, "(?U)" + pair[0], pair[1]), SPELLING, t)
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def _first(text: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*(F.when(text.rlike(folded(rx)), F.lit(key)) for key, rx in rules))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def position(title: Column) -> Column:
    """The main part of the title is tried before all of it, and every specific type before the catch-alls."""

    def of(full: Column) -> Column:
        main = F.split(F.regexp_replace(full, r"\([^)]*\)?|\[[^\]]*\]?", " "), r"(?U)\s+[-–|]\s+|,\s|\s+(?:bij|at|met|with)\s+", 2)[0]
        return _let(main, lambda m: F.coalesce(_first(m, SPECIFIC), _first(full, SPECIFIC), _first(m, MAIN_PART_ONLY + CATCH_ALL), _first(full, CATCH_ALL), F.lit("other")))

    return _let(clean_title(title), of)
