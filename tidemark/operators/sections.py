"""Sections of postings: lines as rows, a header opening a section that its following lines belong to.

``ids`` must tell texts apart: lines of rows that share one are read as one text. A null text has no lines. Texts travel once, by
id, before they are cut into lines, so all work on lines is dealt over tasks however the texts are stored; a text's lines stay
together, so a window's task holds no more than single texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.spans import led, search

FLAGS = "(?iuU)"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85]|[\u2028\u2029]"
BULLETS = "#*•-–:"
# White space, as \s with all of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Beginnings of headers of sections about the job, and about the employer and its offer.
JOB = (
    r"^(?:responsibilit|key responsibilit|key requirements|the impact you(?:'|’)?ll have|the impact you will have|"
    r"what we look for|what (?:we(?:'|’)?d|we would) love|your (?:core )?responsibilit|"
    r"what you(?:'|’)?ll (?:do|own|work on|bring)|"
    r"what you will (?:do|own|work on)|you will\b|in this role|your role|the role|about the (?:role|job|position)|"
    r"job description|role description|the job|the position|your mission|"
    r"qualifications|requirements|requirement|what you bring|what (?:we(?:'|’)?re|we are) looking for|"
    r"who (?:you are|we(?:'|’)?re looking for|we are looking for)|about you|your profile|profile|"
    r"your (?:skills|experience|background)|skills|you have|you bring|must[- ]haves?|nice[- ]to[- ]haves?|"
    r"(?:the |our )?tech(?:nology)? stack|our stack|technologies|tools (?:we use|you(?:'|’)?ll use)|about the team|"
    r"(?:wat|dit) (?:ga je doen|je gaat doen)|wat je gaat doen|dit ga je doen|jouw rol|de rol|de functie|"
    r"functieomschrijving|vacatureomschrijving|je werkzaamheden|werkzaamheden|taken en verantwoordelijkheden|"
    r"jouw taken|functie-?eisen|(?:wat|dit) (?:breng|neem) (?:je|jij) mee|wat je meebrengt|wie ben jij|dit ben jij|"
    r"(?:wat|dit) heb je nodig|wat vragen wij|wat we vragen|wat wij vragen|wie zoeken (?:wij|we)|ons zoekprofiel|"
    r"jij hebt|jouw profiel|jouw achtergrond|jouw vaardigheden|competenties|kennis en ervaring|daarnaast beschik je|"
    r"verder heb je|jouw team|het team)"
)
COMPANY = (
    r"^(?:about us|about (?!the role|the job|the position|you\b|the team)[\w&.' -]{2,40}$|company description|"
    r"who we are|our (?:mission|story|company|culture)|the company|"
    r"what we offer|we offer|what do we offer|what(?:'|’)?s in it for you|benefits|perks|compensation|salary|"
    r"our offer|why (?:join|us|work)|interview process|application process|how to apply|"
    r"equal (?:employment|opportunit)|"
    r"diversity|additional information|location|language|highlights?|"
    r"bedrijfsomschrijving|over ons|over de (?:opdrachtgever|organisatie|werkgever)|wie zijn (?:wij|we)|"
    r"hier ga je werken|waar ga je werken|onze missie|wat (?:bieden|krijg) (?:wij|we|je)|wat wij bieden|wij bieden|"
    r"dit bieden wij|wat je ervoor terugkrijgt|arbeidsvoorwaarden|salaris|solliciteren|sollicitatie|interesse|"
    r"interested|aanvullende informatie|waarom|jouw toekomst)"
)
# Words of prose about the job, headers of an employer's own section, and words of self-description.
ROLE_CUE = led(
    "als are as_ in_ is_ je_ jij joi the we_ we' we’ wer wij wil you zij",
    r"\byou(?:'|’)?ll\b|\byou will\b|\b(?:is|are|will be) responsible for\b|\byou(?:'|’)?re\b|\byou are\b|"
    r"\bas an? \w+|\bin this role\b|\bthe role\b|"
    r"(?:we(?:'|’)?re|we are|is) (?:looking for|seeking|hiring)|\bjoin (?:our|the) \w+ team\b|"
    r"\bje gaat\b|\bals \w+ (?:ga|werk|ben) je\b|\bjij gaat\b|(?:wij|we) zoeken\b|(?:zijn|is) (?:wij )?op zoek\b|"
    r"\bin deze (?:rol|functie)\b",
)
ABOUT = (
    r"^(?:about us|about (?!the role|the job|the position|you\b|the team)[\w&.' -]{2,40}|company description|"
    r"who we are|our (?:company|story|mission)|the company|bedrijfsomschrijving|over ons|"
    r"over (?!de functie|de rol|jou)[\w&.' -]{2,40}|"
    r"wie zijn (?:wij|we)|onze missie|hier ga je werken|waar ga je werken|de organisatie|organisatie)$"
)
SELF = led(
    "als are as_ is_ ons our we_ we' wij zij",
    r"\b(?:wij zijn|we zijn|we are|we're|ons bedrijf|our company|is een|is a|is an|is the|"
    r"zijn een|are a|are an|als (?:toonaangevend|grootste|internationaal)|"
    r"as (?:a|the) (?:leading|global|world))\b",
)
# Words of requirements, wherever they stand, and what begins an entry of a list.
ASKS = led(
    "a_p bek bon erv exp fam is_ je_ jij ken kno nic plu pro you",
    r"\bexperience (?:with|in|using)\b|\bexperienced (?:with|in)\b|\bproficien\w*|\bfamiliar(?:ity)? with\b|\bknowledge of\b|\byou have\b|"
    r"\bbonus points?\b|\bnice to have\b|\ba plus\b|\bervaring (?:met|in)\b|\bkennis (?:van|heeft|hebt)\b|\bje hebt\b|\bjij hebt\b|"
    r"\bpluspunt\w*|\bbonuspunt\w*|\bbekend met\b|\bis een pre\b",
)
ENTRY = r"^\s*(?:[-•*·▪●–]|\d+[.)])\s+"


def _strip(text: Column, characters: str = "") -> Column:
    """``text`` without white space, and any of ``characters``, at its ends."""
    return F.btrim(text, F.lit(WHITE + characters))


def lines(texts: DataFrame, ids: list[str], text_col: str = "text") -> DataFrame:
    """ids, n, line: the lines of every text."""
    parts = texts.select(*ids, F.split(text_col, LINE_END, -1).alias("_parts"))
    whole = F.when(F.element_at("_parts", -1) == "", F.slice("_parts", 1, F.size("_parts") - 1)).otherwise(F.col("_parts"))
    return parts.select(*ids, F.posexplode(whole).alias("n", "line"))


def header(line: Column) -> Column:
    """'company' or 'job' for a header line: short, without a sentence's end, beginning like one."""
    bare = _strip(line, BULLETS)
    short = (bare != "") & (F.length(bare) <= 70) & (F.size(F.split(bare, r"(?U)\s+")) <= 9) & ~search(bare, "[.,;]$")
    name = F.rtrim(bare, F.lit(":?! "))
    return F.when(short & search(name, FLAGS + COMPANY), "company").when(short & search(name, FLAGS + JOB), "job")


def sectioned(rows: DataFrame, ids: list[str], opens: Column) -> DataFrame:
    """``rows`` of ``lines`` with ``opens``, what a line opens as a header, and ``section``, what the last header before it opened ('intro' before any)."""
    upto = Window.partitionBy(*ids).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("opens", opens).withColumn("section", F.coalesce(F.last("opens", ignorenulls=True).over(upto), F.lit("intro")))


def joined(rows: DataFrame, ids: list[str], *more: Column) -> DataFrame:
    """ids, text: the lines of ``rows`` in order, one text for each id."""
    inner = F.array_sort(F.collect_list(F.struct("n", "line")))  # the lines of one text
    return rows.groupBy(*ids).agg(F.array_join(F.transform(inner, lambda x: x["line"]), "\n").alias("text"), *more)


def job_text(texts: DataFrame, ids: list[str], text_col: str = "text") -> DataFrame:
    """ids, job_text: the parts of a posting about the role and what it asks for, of texts that have a header of such a part.

    Its sections with their headers, lines that ask for something wherever they stand, and before the first header also role prose and
    entries of lists. Texts without a job header, or with nothing but white space kept, are left out.
    """
    rows = sectioned(lines(texts.repartition(*ids), ids, text_col), ids, header(F.col("line")))
    bare = _strip(F.col("line"))
    entry = (bare != "") & (search(F.col("line"), "(?U)" + ENTRY) | ((F.length(bare) < 100) & ~search(bare, "[.!?]$")))
    opening = (F.col("section") == "intro") & (search(F.col("line"), FLAGS + ROLE_CUE) | entry)
    own = F.when(F.col("opens").isNotNull(), F.col("opens") == "job").otherwise((F.col("section") == "job") | search(F.col("line"), FLAGS + ASKS) | opening)
    found = joined(rows.where(own), ids, F.bool_or(F.coalesce(F.col("opens") == "job", F.lit(False))).alias("headed"))
    return found.where(F.col("headed") & (_strip(F.col("text")) != "")).select(*ids, F.col("text").alias("job_text"))


def self_description(texts: DataFrame, ids: list[str], company: Column, text_col: str = "text", limit: int = 2000) -> DataFrame:
    """ids, intro: what an employer says about itself, up to ``limit`` characters; texts that say nothing are left out.

    That is its own section, the prose before any header, and sentences such as "we are ..." that name it or speak as "we". Reading ends
    with the line that exceeds the limit. ``company`` is read per text; a null one counts as no name.
    """
    name = F.lower(F.regexp_extract(F.coalesce(company, F.lit("")), r"(?U)(\S+)", 1))
    rows = lines(texts.repartition(*ids).withColumn("_name", name), [*ids, "_name"], text_col).withColumn("line", _strip(F.col("line"))).where("line <> ''")
    own = search(F.rtrim(F.btrim("line", F.lit(BULLETS + " ")), F.lit(":?! ")), FLAGS + ABOUT)
    rows = sectioned(rows, ids, F.when(own, "about").when(header(F.col("line")).isNotNull(), "other"))
    prose = (F.col("section") == "about") | ((F.col("section") == "intro") & ~search(F.col("line"), FLAGS + ROLE_CUE))
    spoken = search(F.col("line"), FLAGS + SELF) & (F.contains(F.lower("line"), F.col("_name")) | search(F.col("line"), FLAGS + r"\b(?:wij|we|ons|our)\b"))
    before = Window.partitionBy(*ids).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.where(F.col("opens").isNull() & (prose | spoken)).withColumn("_read", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)))
    return joined(kept.where(F.col("_read") <= limit), ids).select(*ids, F.left("text", F.lit(limit)).alias("intro"))
