"""Facts from a posting's text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.normalize import folded

# Words that only one of the languages uses.
DUTCH_WORDS = r"\b(de|het|een|en|van|voor|met|je|jij|wij|bij|niet|zijn|werken|ervaring|functie|wat|jouw|onze|ook|als|dat|naar|kunnen|wordt|vacature|collega|bieden|sollicit\w*|ben|heb|hebt|deze|dit|waar|om|te|op|aan|uit|ons|zij|jullie|binnen|werkzaamheden|kennis|vaardigheden)\b"
ENGLISH_WORDS = r"\b(the|and|you|with|for|our|experience|will|are|to|of|that|this|your|role|skills|working|have|as|be|on|or|about|who|an|at|from|what|us|can|join|work|their|which|within|strong)\b"
GERMAN_WORDS = r"\b(und|der|das|mit|für|wir|sie|ist|nicht|auf|eine?|zu|du|dich|dein\w*|unser\w*|oder|bei|sind)\b"
# An amount in euros, alone or as a range.
AMOUNT = r"\d{1,3}(?:[.,]\d{3})+|\d{2,3}k|\d{4,6}"
SALARY = rf"(?:€|eur|euro)\s?({AMOUNT})(?:\s?(?:-|–|to|tot|and)\s?(?:€|eur)?\s?({AMOUNT}))?"
MONTHLY = r"month|maand|p/m|per mnd"
# Level words in titles, the first that matches wins.
LEVELS = [
    ("intern", r"\binterns?(?:hips?)?\b|\w*(?<!back)(?<!early-)(?<!early )stage(?:s|opdracht\w*|plaats\w*|plek\w*)?\b|(?<!advocaat-)(?<!advocaat )stagiai?re?|working student|werkstudent|afstudeer|\bthesis\b|scriptie|\bgraduation\b|^student\b"),
    ("trainee", r"\btrainee(ship)?s?\b|traineeprogramma|graduate (programme|program|scheme)|young professional|advocaat[- ]stagiai?re?|talent ?programm?a?\b|development program(me)?\b|starters?functie|starters?programma|\bstarter\b(?! kit)|\bbbl\b|apprentice\w*|\bleerling\b|leerwerk\w*|\bin opleiding\b|betaalde opleiding|opleiding tot\b"),
    ("junior", r"\bjunior\b|\bjr\b\.?|\bgraduate\b|entry[- ]level|\bstarter\b|early career|^(?!.*\b(?:senior|sr|staff|principal|manager|director|head|lead|chief|vp)\b).*\bassociate\b"),
    ("medior", r"\bmedior\b|\bmid[- ]level\b|\bintermediate\b|\bmiddle\b(?! east)"),
    ("staff", r"\bstaff\b|\bprincipal\b|\bdistinguished\b|\b(?:technical|engineering) fellow\b"),
    ("manager", r"(?<!product )(?<!project )(?<!account )(?<!program )(?<!change )(?<!release )(?<!success )(?<!sales )(?<!delivery )\bmanager\b|\bhead\b(?!\s*line)|\bdirector\b|\bdirecteur\b|\bhoofd\b|\bvp\b|\bchief\b|\bcto\b|\bcio\b|\bciso\b|bedrijfsleider|afdelingshoofd|vestigingsleider|groepsleider|\bgroup leader\b"),
    ("lead", r"\blead\b|\btech ?lead\b|\bteam ?lead(?:er)?\b|\bteamleider\b|(?<!project )(?<!project-)\bleader\b|\bsupervisor\b|(?<!naval )(?<!landscape )\barchitect\b"),
    ("senior", r"\bsenior\b|\bsr\.?\b"),
]


def detect_language(text: Column) -> Column:
    """'nl', 'en' or 'other' by counts of words that only one language uses."""
    count = lambda words: F.regexp_count(text, F.lit("(?iuU)" + words))
    nl, en, de = count(DUTCH_WORDS), count(ENGLISH_WORDS), count(GERMAN_WORDS)
    return F.when(((nl == 0) & (en == 0)) | (de > F.greatest(nl, en)), "other").when(nl > en, "nl").otherwise("en")


def _amount(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), "[.,]", "")
    return F.when(plain.endswith("k"), F.regexp_replace(plain, "k$", "").try_cast("long") * 1000).otherwise(plain.try_cast("long"))


def parse_salary(text: Column) -> Column:
    """struct(low, high) in euros a year: the first plausible amount, unless a later one also states an upper end."""
    # an amount's surroundings are looked at, not consumed: those of its neighbours may overlap them
    around = F.lit(rf"(?iuUs)(?<=(^.{{0,59}}|.{{60}}))((?:€|eur|euro)\s?(?:{AMOUNT})(?:\s?(?:-|–|to|tot|and)\s?(?:€|eur)?\s?(?:{AMOUNT}))?)(?=(.{{0,60}}))")
    part = lambda k: F.regexp_extract_all(text, around, F.lit(k))
    found = F.arrays_zip(part(1).alias("before"), part(2).alias("amount"), part(3).alias("after"))

    def read(piece: Column) -> Column:
        factor = F.when(F.lower(F.concat(piece["before"], piece["amount"], piece["after"])).rlike(MONTHLY), 12).otherwise(1)
        low = _amount(F.regexp_extract(piece["amount"], folded(SALARY), 1)) * factor
        high = _amount(F.regexp_extract(piece["amount"], folded(SALARY), 2)) * factor
        return F.struct(low.alias("low"), F.when((high >= low) & (high <= 500000), high).alias("high"))

    fits = F.filter(F.transform(found, read), lambda s: s["low"].between(20000, 400000))
    ranged = F.get(F.filter(fits, lambda s: s["high"].isNotNull()), F.lit(0))
    return F.coalesce(ranged, F.get(fits, F.lit(0)))


def title_level(title: Column) -> Column:
    return F.coalesce(*(F.when(title.rlike(folded(rx)), F.lit(key)) for key, rx in LEVELS))


def detect_seniority(title: Column, years: Column) -> Column:
    """The title's level word, else by years asked for."""
    by_years = F.when(years >= 5, "senior").when(years >= 3, "medior").when(years.isNotNull(), "junior").otherwise("unknown")
    return F.coalesce(title_level(title), by_years)


def html_to_text(fragment: Column) -> Column:
    """Readable text of a well-formed fragment: blocks on lines of their own, at most one blank line between, common references decoded."""
    refs = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}

    def decoded(text: Column) -> Column:
        for name, sign in refs.items():
            text = F.replace(text, F.lit(name), F.lit(sign))
        return text

    t = F.coalesce(fragment, F.lit(""))
    t = F.when(~F.contains(t, F.lit("<")) & F.contains(t, F.lit("&lt;")), decoded(t)).otherwise(t)
    t = F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|ul|ol)\s*>", "\n")
    t = decoded(F.regexp_replace(t, r"<[^>]*>", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f\x0B]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))
