"""What a posting's text asks for and offers: years of experience, a visa. Columns over spans of the text.

Every function gives null for a null or silent text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.spans import after_last, before_first, first, led, let, search, spans

FLAGS = "(?iuU)"

# Numbers in words, and what counts as a statement of years.
NUMBERS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15,
    "een": 1, "één": 1, "twee": 2, "drie": 3, "vier": 4, "vijf": 5, "zes": 6, "zeven": 7, "acht": 8, "negen": 9, "tien": 10, "elf": 11, "twaalf": 12, "vijftien": 15, "anderhalf": 2,
}
HALVES = ("half", "een half", "a half", "half a")
_NUMBER = r"(?:\d{1,2}(?:[.,]5)?|" + "|".join(sorted([*NUMBERS, "half"], key=lambda w: -len(w))) + ")"
YEARS = FLAGS + led(
    "a_h ach and dri ele een eig fif fiv fou hal neg nin one sev six ten thr tie twa twe two vie vij zes zev één",
    r"(?<![\d.,])(?:(?=\d)|\b)(\d{1,2}\s*(?:months?|maanden)\s*(?:to|tot|[-–—])\s*)?"
    r"((?:een |a )?half(?: a)?|" + _NUMBER + r")(?:\s*\(\d{1,2}\+?\))?"
    r"\s*(?:(\+|plus|or more|of meer)|(?:[-–—]|to|till|until|tot|t/m|à|and|en|or|of)\s*(" + _NUMBER + r")\+?)?"
    r"(?:\s*\([^()]{0,25}\))?[\s-]*(?:years?|yrs?|jaren|jaar)\b",
    digits=True,
)
# Words of experience; those that make a number of years one of something else, after it and before it.
EXPERIENCE = r"experience|ervaring|expertise|track record|background|hands[- ]on|relevant"
CONTEXT = (
    r"experience|ervaring|track record|professional|working|relevant|hands[- ]on|in a similar|background|expertise|werkervaring|"
    r"^\s*(?:of|in|as|with|leading|building|developing|managing|designing|delivering|running|als|met|in de)\b"
)
OTHER_AFTER = (
    r"\b(?:contract(?!\s*manag|beheer)\w*|\w*overeenkomst|dienstverband|fixed[- ]term|looptijd|duration|warranty|garantie|guarantee|old(?:er)?|oud(?:er)?|"
    r"leeftijd|of age|ago|geleden|history|bonus|salary|salaris|vacation|verlof|lease|pension|pensioen)\b|"
    r"^[\s'’-]*(?:\w+[\s'’-]+)?(?:degree|bachelor|master|phd|study|studie|opleiding|programme|program(?!\s*manag)|traineeship|trainee|traject|position|"
    r"positie|aanstelling|appointment|in dienst|in service)\b"
)
OTHER_BEFORE = (
    r"\b(?:contract\w*|\w*overeenkomst|dienstverband|fixed[- ]term|duur|duration|looptijd|warranty|guarantee|after|na|every|elke|per|founded|opgericht|"
    r"since|sinds|history|traineeship|programme|traject|bonus|salary|salaris|budget|tenure at|period of|periode van|aanstelling|"
    r"(?:is|zijn) al|(?:we|wij) (?:have|hebben)|we've)\b|"
    r"(?:\b(?:within|binnen|the first|de eerste|het eerste|next|komende|last|past|afgelopen|laatste|less than|fewer than|minder dan|up to|no more than|"
    r"maximaal|maximum|max|hooguit|aged?)\b|<)\W*$"
)
AT_LEAST = r"(?:at least|minimum(?: of)?|min\.?|minimaal|ten ?minste|minstens|more than|over|meer dan)\W*$"


def _number(raw: Column, half: float) -> Column:
    """The value of a number in figures or words; ``half`` for half a year."""
    words = F.create_map(*(F.lit(x) for w, n in NUMBERS.items() for x in (w, float(n) if w != "anderhalf" or half == 1 else 1.5)))
    return F.when(F.rlike(raw, F.lit("^[0-9]")), F.regexp_replace(raw, ",", ".").cast("double")).when(raw.isin(*HALVES), F.lit(half)).otherwise(F.element_at(words, raw))


def _group(match: Column, k: int) -> Column:
    return F.lower(F.regexp_extract(match, YEARS, k))


def years_asked(text: Column) -> Column:
    """The first span that asks for 1 to 19 years: not a contract's length, an age, history or a limit, and with experience near by.

    A word that makes the years something else counts only where no word of experience lies between it and the number.
    """

    def asks(s: Column) -> Column:
        near_before = after_last(F.right(s["before"], F.lit(25)), FLAGS + EXPERIENCE)
        near_after = before_first(F.left(s["after"], F.lit(25)), FLAGS + EXPERIENCE)
        other = search(near_before, FLAGS + OTHER_BEFORE) | search(near_after, FLAGS + OTHER_AFTER)
        meant = search(s["after"], FLAGS + CONTEXT) | search(s["before"], FLAGS + CONTEXT)
        return ~other & meant & F.coalesce(least_years(s["match"]).between(1, 19), F.lit(False))

    return F.when(search(text, "(?i)years?|yrs?|jaren|jaar"), first(F.filter(spans(text, YEARS, 40, 60), asks)))


def least_years(match: Column) -> Column:
    """The least whole number of years that a span states: 1 if it starts in months."""
    return F.when(_group(match, 1) != "", 1).otherwise(F.ceil(_number(_group(match, 2), 1.0))).cast("int")


def years(text: Column) -> Column:
    """Least years of experience asked for (``years``), and as worded (``worded``): "1-3", "5+", "1.5" or "3", null where they start in months."""
    return let(years_asked(text), lambda s: F.struct(least_years(s["match"]).alias("years"), _worded(s).alias("worded")))


def find_years(text: Column) -> Column:
    return years(text)["years"]


def years_text(text: Column) -> Column:
    return years(text)["worded"]


def _short(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def _worded(span: Column) -> Column:
    match = span["match"]
    low, high = _number(_group(match, 2), 0.5), _number(_group(match, 4), 0.5)
    open_end = (_group(match, 3) != "") | search(F.right(span["before"], F.lit(25)), FLAGS + AT_LEAST)
    worded = F.when((_group(match, 4) != "") & (high > low), F.concat(_short(low), F.lit("-"), _short(high))).when(open_end, F.concat(_short(low), F.lit("+"))).otherwise(_short(low))
    return F.when(_group(match, 1) == "", worded)


# Statements that a visa is arranged, weaker ones of help with moving, and statements that it is not.
VISA = led(
    "and ass erk hel hig hou hsm imm ken or_ rec reg spo sup vis we_ wor",
    r"vis(?:a|um)[- ]?sponsor\w*|sponsor(?:ship|ing|s)? (?:of |for )?(?:a |your |the |work |residence |their )*(?:visas?|permits?)\b|visa (?:support|assistance|help)|"
    r"(?:support|assist|help)\w* (?:\w+ ){0,3}?(?:with |throughout |during |in )(?:the |your |any )?(?:\w+ )?vis(?:a|um)\b|"
    r"vis(?:a|um)[- ]?(?:application|process|procedure|aanvra)\w*|highly skilled migrants?|kennismigrant\w*|\bHSM[- ](?:visa|permit|status|scheme|sponsor\w*)|"
    r"erkend referent|recogni[sz]ed (?:sponsor|referent)|work permit (?:support|sponsorship|application)|immigration (?:support|sponsorship|assistance|services)|"
    r"sponsorship provided\W{0,3}yes|vis(?:a|um)\s*(?:\+|and|&)\s*housing (?:is )?provided|housing\s*(?:\+|and|&)\s*vis(?:a|um) (?:is |are )?provided|"
    r"(?:or|and) (?:be )?eligible for (?:visa )?sponsorship|regelen (?:we|wij) (?:een |je |jouw )?(?:visum|verblijfsvergunning|werkvergunning)|"
    r"we (?:can |will |do |are able to |gladly |happily )?sponsor (?:your |a |the |work |residence |relocation )*(?:visas?|permits?|relocation|candidates|you)\b",
)
MOVING = led(
    "30 ass exp hel mak rel sup ver",
    r"relocation (?:package|support|assistance|budget|team|help|bonus|allowance|expenses|services|compensation|reimbursement)|relocati(?:e|on)[- ]?pakket\w*|"
    r"relocatie[- ]?ondersteuning|verhuispakket|help(?:s|ing)? you (?:to )?relocate|"
    r"(?:assist|support|help)\w* (?:you |candidates |employees |people )?(?:\w+ )?(?:with|in|throughout) (?:your |the )?(?:relocation|moving|move)\b|assistance with relocation|"
    r"(?:assist\w*|support\w*|help\w*) (?:to |for )?(?:candidates|employees|people|those|anyone) who (?:relocate|move)|make your move (?:to \w+ )?(?:as )?smooth|"
    r"relocation (?:is |are )?(?:offered|provided|covered|reimbursed)|30\s?%[- ]?(?:tax )?(?:ruling|regeling|facility)|expat (?:support|services|package|centre|center|desk)",
)
NO_VISA = led(
    "alr aut can do_ doe don dut eea eli eu_ eu- eu/ eum eur euw gee gel ger has hav hol in_ leg mus n't n’t ned nee nev no per pos rel req rig sho spo una val vis wer wil wit won zon",
    r"(?:\bno\b|\bnot\b(?! only)|cannot|unable to|n[’']t\b|\bnever\b)(?:\s+[\w’'-]+){0,3}?\s+"
    r"(?:offer\w*|provid\w*|sponsor\w*|support\w*|assist\w*|apply for|help with|facilitat\w*)(?:\s+[\w’'/-]+){0,3}?\s+"
    r"(?:vis(?:a|um)\w*|sponsor\w*|relocat\w*|work permits?|work or residence permits?|residence permits?|work visas?|immigration)|"
    r"(?:vis(?:a|um)\w*|sponsor\w*|relocat\w*)(?:\s+[\w/-]+){0,4}?\s+(?:is |are |will be |wordt |kunnen wij |kunnen we )?(?:unfortunately |currently |sadly )?"
    r"(?:not|niet|un)\s*(?:\w+\s)?(?:offered|provided|available|possible|supported|included|mogelijk|bieden|aangeboden|aanbieden)|"
    r"\bno (?:visa |relocation |immigration |work permit )?(?:sponsorship|relocation)\b|sponsorship\W{0,3}[:?]\s*(?:no|nee)\b|"
    r"(?:must|need to|needs to|have to|has to|required to|should|will need to)\s+(?:already\s+|currently\s+|also\s+)?(?:have|hold|possess|be|obtain)\s+(?:the\s+|a\s+)?"
    r"(?:full\s+|legal\s+|permanent\s+|valid\s+|existing\s+)*(?:right|eligib\w*|authori[sz]\w*|permitted|allowed|entitled|legally)\s+(?:\w+\s+)?to\s+(?:live\s+and\s+)?work|"
    r"(?:right|eligib\w*|authori[sz]\w*|legally allowed|permitted) to (?:live and )?work (?:permanently )?in (?:the )?"
    r"(?:netherlands|nl|eu|european union|europe|eea|uk or eu|country|job location)|"
    r"\bvalid (?:eu[- ]|dutch |nl |netherlands )?(?:work(?:ing)? (?:permit|visa|authori[sz]ation)|residen(?:ce|cy)(?:[/ ]?(?:and )?work)? permit)|"
    r"(?:\beu\b|\beea\b|european|dutch)(?:[/ ](?:eea|eu)|[- ]?member state)?[ -](?:citizen\w*|passport\w*|nationals?|nationality|residen\w*)(?: holders?)?\s*"
    r"(?:is |are )?(?:required|only|mandatory|needed)|"
    r"(?:\beu\b|european|dutch)[- ](?:work(?:ing)? )?(?:permit|rights|authori[sz]ation|work visa) (?:is )?(?:required|needed|mandatory)|"
    r"(?:have|need|hold) (?:to have )?an eu[- ]passport|(?:have|hold|possess) an? (?:eu|dutch|valid) work permit|"
    r"(?:already )?hold (?:a |an )?(?:permanent |valid )(?:eu |dutch )?work (?:and residence )?permit|\bvalid [\w/ -]{0,16}work (?:authori[sz]ation|permit)|"
    r"already (?:based|living|located|residing|reside|live) in (?:the netherlands|nl|europe|the eu)|"
    r"without (?:the need for |requiring |needing |any )*(?:a |company |employer |visa |company-sponsored |further )*(?:sponsorship|work permit|visa)|"
    r"(?:do not|don't|does not|doesn't|won't|will not) (?:currently |now or in the future )?(?:require|need) (?:a |any )?(?:visa|sponsorship|work permit)|"
    r"geen\W{0,15}(?:vis(?:a|um)\w*|sponsor\w*|relocat\w*|verhuis\w*)|(?:vis(?:a|um)\w*|sponsor\w*|relocat\w*)[^.\n]{0,40}\b(?:niet|geen)\b\W{0,3}(?:mogelijk|bieden|aan)|"
    r"geldige [\w -]{0,20}?(?:werk|verblijfs)[- ]?(?:vergunning|visum)|(?:nederlandse |eu-?)?werkvergunning (?:is )?(?:vereist|noodzakelijk|verplicht)|"
    r"in nederland mag werken|gerechtigd (?:zijn )?(?:om )?in nederland te (?:wonen en te )?werken|zonder werkvergunning",
)
# What ends a clause, negates in one (before and after a statement), makes it conditional, answers a form's field, or hedges.
CLAUSE_END = r"[.!?;\n•|]"
NOT_BEFORE = r"\b(?:no|not(?! only)|geen|niet|cannot|unable|without|never|nor|nooit)\b|n[’']t\b"
NOT_AFTER = r"^\W{0,4}(?:[\w-]+\W+){0,4}?(?:is |are |will be |wordt |kunnen wij )?(?:not|niet|unavailable|nee|no)\b(?! (?:matter|longer)\b)"
CONDITION = r"^\W*(?:if|als|in case|should|when)\b[^,]*,"
# Every statement has one of these words.
ANCHOR = led(
    "30 all alr aut cit eli ent exp ger hsm imm leg mag mig mov nat pas per ref rel res rig spo ver vis",
    r"vis[au]m?|sponsor|relocat|permit|vergunning|migrant|30\s?%|referent|immigration|verhuis|expat|right|eligib|authori[sz]|citizen|passport|national|residen|already|"
    r"gerechtigd|mag werken|\bhsm\b|moving|\bmove\b|permitted to|allowed to|entitled to|legally",
)
YES, NO = r"^(?:yes|ja|available|possible|provided)\b", r"^(?:no|nee|not)\b"
HEDGED = r"prefer\w*|a plus|an advantage|\bpr[eé]\b|\?|if applicable"


def _stance(s: Column) -> Column:
    """Whether a statement stands (true) or is negated in its own clause (false); null for a form field without an answer."""
    clause = after_last(s["before"], CLAUSE_END)
    clause = F.when(search(clause, "(?s)" + FLAGS + CONDITION), F.regexp_replace(clause, "(?s)^.*,", "")).otherwise(clause)
    rest = before_first(F.left(s["after"], F.lit(60)), CLAUSE_END)
    field = F.regexp_extract(F.left(s["after"], F.lit(40)), r"(?U)^\s*[:?]\s*(\S[^\n]*)?", 1)
    answer = F.when(search(field, FLAGS + YES), True).when(search(field, FLAGS + NO), False)
    plain = ~(search(clause, FLAGS + NOT_BEFORE) | search(rest, FLAGS + NOT_AFTER))
    return F.when(search(s["after"], r"(?U)^\s*[:?]"), answer).otherwise(plain)


def detect_visa(text: Column) -> Column:
    """Whether a visa or help with moving is offered: true, false where it is refused or the right to work is asked for, else null."""
    strong, weak = (F.transform(spans(text, FLAGS + p, 110, 60), _stance) for p in (VISA, MOVING))
    hedged = lambda s: search(F.concat(after_last(s["before"], CLAUSE_END), s["match"], F.regexp_extract(s["after"], f"^[^{CLAUSE_END[1:-1]}]*{CLAUSE_END}?", 0)), FLAGS + HEDGED)
    refused = F.exists(spans(text, FLAGS + NO_VISA, 110, 2000), lambda s: ~hedged(s))
    said = lambda stances, what: F.exists(stances, lambda x: x.eqNullSafe(F.lit(what)))
    weaker = lambda strong: let(weak, lambda w: F.when(said(w, True), True).when(said(strong, False) | said(w, False), False))
    answer = let(strong, lambda s: F.when(said(s, True), True).when(refused, False).otherwise(weaker(s)))
    return F.when(search(text, "(?i)" + ANCHOR), answer)


# Degrees asked for, lowest level first (a bachelor's and an hbo degree are one level); a PhD position is none that is asked for.
DEGREES = {
    "mbo": led("mbo", r"\bmbo\w*(?!['’]s\b)"),
    "bsc": led("b", r"\bb\.?\s?sc\b|\bbachelor\w*|\bbs\b (?:\(or higher\) )?(?:degree|in)\b|\bb\.?tech\b|\bb\.?eng\b"),
    "hbo": led(
        "deg dip edu hbo hea hig hlo hog hts opl uni",
        r"\bhbo\w*(?!['’]s\b)|\bhogeschool(?:opleiding|diploma|niveau)|\bhts\b|\bheao\b|\bhlo\b|\buniversity of applied sciences (?:degree|diploma|level|education)|"
        r"\bhigher professional education|\b(?:degree|diploma|education|opleiding) (?:from|at) (?:a |an )?university of applied sciences",
    ),
    "msc": led(
        "aca afg beh com fin m uni wo",
        r"\bm\.?\s?sc\b(?![\s-]*(?:(?:and|en|or|of|/)\s*ph\.?d\s*)?(?:students|studenten|theses|projects|interns?))|(?-i:\bMS)\s*(?:degree|in\b|or PhD|/\s?PhD)|\bmasters? of (?:een )?ph\.?d\b|"
        r"(?<!scrum )(?<!certified )(?<!quiz)\bmasters?(?:['’]s?)?(?:\s+(?:degree|diploma|in\b(?! (?:excel|het|de|the|multitask|problem|communic|organi|plannen|verbind|sales))|level|or\b|"
        r"opleiding|programme|program|student|graduate|of (?:science|engineering|arts|business|laws|philosophy|computer|information|applied|data))|\s*/\s*(?:phd|ph\.d|doctor))|"
        r"\bmaster(?:diploma|opleiding|niveau|titel|degree|studie|student|s?graad)\w*|\bwo\b|\buniversity master|\b(?:afgeronde|completed|finished|behaalde) (?:\w+ )?masters?\b|"
        r"\buniversitair\w* (?:opleiding|niveau|diploma|master|denkniveau|werk|achtergrond|studie)|"
        r"\bacademisch\w* (?:werk[- ] en )?(?:denk)?(?:niveau|opleiding|achtergrond|diploma|master)|\buniversity degree",
    ),
    "phd": led(
        "doc gep ph pro",
        r"(?<!your )(?<!this )(?<!the )(?<!our )(?<!during )(?<!funded )(?<!year )(?<!other )(?<!doing a )(?<!start a )(?<!starting a )(?<!towards a )(?<!for a )(?<!pursue a )"
        r"(?<!her )(?<!his )(?<!their )(?<!my )(?<!possession of a )\bph\.?\s?d\.?(?:['’]s)?\b(?!['’]s\b)"
        r"(?![\s-]*(?:\d|,?\s*(?:and|or|&|/)\s*post-?doc|position|project|candidate|student|researcher|vacanc|programme|program|track|thesis|research|defen[cs]e|trajector|"
        r"supervis|fellow|scholarship|journey|stud|level position|opportunit|network|intern|salary|allowance|contract|traineeship|school|course|life|period|phase))|"
        r"\bdoctorate\b|(?<!possession of a )\bdoctoral degree|\bgepromoveerd|\bpromotieonderzoek (?:afgerond|voltooid)",
    ),
}
# Statements that no degree is needed; that one is only a plus; that it is another's, or stands for experience; further entries of a list.
NO_DEGREE = led(
    "deg dip do_ doe don gee no_ reg wit",
    r"(no|without a?|regardless of) (?:formal )?(?:degree|diploma)|degree (?:is )?not (?:required|necessary|needed|a must)|"
    r"(?:don't|do not|doesn't|does not) (?:need|require) (?:a |any )?(?:formal )?(?:[\w-]+,? ){0,4}(?:or )?(?:degrees?|diplomas?)\b|"
    r"geen (?:specifiek |formeel )?diploma (?:vereist|nodig|noodzakelijk)|diploma (?:is )?niet (?:vereist|nodig|noodzakelijk)",
)
PLUS = r"a plus|is a bonus|\bbonus\b|nice[- ]to[- ]have|an advantage|\bpluspunt|\bpr[eé]\b|\bvoordeel\b|\bextra\b"
ANY_DEGREE = r"\b(?:ph\.?d|m\.?sc|b\.?sc|master|bachelor|hbo|mbo|wo\b|universit|academisch|doctora)"
OTHER_ITEM = r"\b(?:en|and|or|of)\b[^,]*?(?:opleiding|diploma|certific\w*|degree|course|cursus)"
OTHERS_BEFORE = r"supervis\w*|mentor\w*|teach\w*|lectur\w*|tutor\w*|begeleid\w*|transcripts?|grades?\b|cijferlijst\w*|courses followed|list of courses|\bwe educate\b|\bmixed\b|students?\s*\(\s*$"
OTHERS_AFTER = r"^(?:['’]s?)?\s*(?:(?:and|or|/|&|,)\s*(?:\w+\s)?(?:master|msc|m\.sc|bachelor|bsc|b\.sc)\w*(?:['’]s?)?\s*)?(?:teaching|onderwijs|lectures)\b"
FOR_EXPERIENCE = r"(?:experience|ervaring)[^.;\n]{0,15}\(?\s*(?:or|of)\s*(?:a\s+)?$"
OTHER_ROUTE_BEFORE = r"(?:\bof|\bor)\s+\(?(?:een |an |a )?(?:\w+\s)?$"
OTHER_ROUTE_AFTER = r"^[^.;\n]{0,70}?(?:experience|ervaring|who has reached|heeft bereikt)"
POSTDOC = r"\bpost[- ]?doc\w*|\bpostdoctoral"
DEGREE_WORD = led(
    "aca app b deg dip doc gep hbo hea hig hlo hog hts m ph pro uni wo",
    r"ph\.?\s?d|doctora|gepromoveerd|promotie|m\.?\s?sc|\bms\b|master|\bwo\b|universit|academisch|b\.?\s?sc|bachelor|\bbs\b|b\.?tech|b\.?eng|hbo|hogeschool|\bhts\b|heao|\bhlo\b|"
    r"applied sciences|higher professional|mbo|degree|diploma",
)


def _asks_degree(text: Column, level: str) -> Column:
    """Whether a degree of the level is asked of the reader, in some clause, as more than a plus or another way in."""

    def asked(s: Column) -> Column:
        before, after = after_last(s["before"], CLAUSE_END), before_first(F.left(s["after"], F.lit(90)), CLAUSE_END)
        ahead, behind = before_first(after, FLAGS + PLUS), after_last(before, FLAGS + PLUS)
        plus_after = search(after, FLAGS + PLUS) & ~search(ahead, FLAGS + ANY_DEGREE) & ~search(ahead, FLAGS + OTHER_ITEM)
        plus_before = search(before, FLAGS + PLUS) & ~search(behind, FLAGS + ANY_DEGREE)
        others = search(before, FLAGS + OTHERS_BEFORE) | search(F.left(s["after"], F.lit(60)), FLAGS + OTHERS_AFTER)
        instead = F.lit(False)
        if level == "phd":
            instead = search(s["before"], FLAGS + FOR_EXPERIENCE)
        elif level == "mbo":
            instead = search(F.right(s["before"], F.lit(25)), FLAGS + OTHER_ROUTE_BEFORE) & search(s["after"], FLAGS + OTHER_ROUTE_AFTER)
        return ~(plus_after | plus_before | others | instead)

    return F.coalesce(F.exists(spans(text, FLAGS + DEGREES[level], 60, 120), asked), F.lit(False))


def _lowest_degree(text: Column) -> Column:
    asked = None
    for level in DEGREES:
        asked = F.when(_asks_degree(text, level), level) if asked is None else asked.when(_asks_degree(text, level), level)
    return F.when(search(text, "(?iu)" + DEGREE_WORD), asked)


def detect_degree(title: Column, core: Column, text: Column) -> Column:
    """The lowest degree asked for (mbo, hbo, bsc, msc, phd), by the part about the job or else the whole text; 'none' where none is needed, else 'unknown'.

    A degree without a level says nothing. ``core`` may be null (see sections.job_text); a null text asks for nothing.
    """
    found = F.coalesce(_lowest_degree(core), _lowest_degree(text), F.lit("unknown"))
    return F.when(search(text, FLAGS + NO_DEGREE), "none").when(search(title, FLAGS + POSTDOC), "phd").otherwise(found)
