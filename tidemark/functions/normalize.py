"""Column functions that bring postings of many boards into one shape. Everything runs in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dutch cities in order of trial, with the spellings and suburbs that count as each.
CITIES = {
    "Amsterdam": r"amsterdam|amstelveen|schiphol|hoofddorp|haarlemmermeer",
    "Rotterdam": r"rotterdam|schiedam|capelle",
    "The Hague": r"den haag|the hague|'s-gravenhage|s-gravenhage|rijswijk|zoetermeer|voorburg",
    "Utrecht": r"utrecht|nieuwegein|houten|zeist|de meern",
    "Eindhoven": r"eindhoven|veldhoven|best\b|son en breugel|waalre|helmond|nuenen|brainport",
    "Delft": r"\bdelft\b",
    "Leiden": r"\bleiden\b|oegstgeest",
    "Groningen": r"groningen",
    "Nijmegen": r"nijmegen",
    "Tilburg": r"tilburg",
    "Breda": r"\bbreda\b",
    "Arnhem": r"arnhem",
    "Haarlem": r"\bhaarlem\b",
    "Hilversum": r"hilversum",
    "Amersfoort": r"amersfoort",
    "Apeldoorn": r"apeldoorn",
    "Enschede": r"enschede|hengelo",
    "Maastricht": r"maastricht",
    "Zwolle": r"zwolle",
    "'s-Hertogenbosch": r"hertogenbosch|den bosch",
    "Almere": r"almere",
    "Deventer": r"deventer",
    "Wageningen": r"wageningen",
    "Alkmaar": r"alkmaar",
    "Leeuwarden": r"leeuwarden",
    "Venlo": r"\bvenlo\b",
    "Dordrecht": r"dordrecht",
    "Gouda": r"\bgouda\b",
    "Ede": r"\bede\b",
    "Veenendaal": r"veenendaal",
    "Emmen": r"\bemmen\b",
    "Roermond": r"roermond",
    "Heerlen": r"heerlen",
    "Sittard": r"sittard|geleen",
    "Assen": r"\bassen\b",
    "Lelystad": r"lelystad",
    "Middelburg": r"middelburg",
    "Weert": r"\bweert\b",
    "Oss": r"\boss\b",
    "Nieuw-Vennep": r"nieuw-vennep",
    "Woerden": r"woerden",
    "Barneveld": r"barneveld",
    "Culemborg": r"culemborg",
    "Naarden": r"naarden",
    "Bussum": r"bussum",
}
# Words that place a posting at home, abroad or anywhere.
HOME = r"netherlands|nederland|\bnl\b|holland"
ANYWHERE = r"\bremote\b|work from home|thuiswerken|anywhere"
ABROAD = (
    r"\b(germany|deutschland|berlin|munich|münchen|hamburg|france|paris|belgium|belgi[eë]|brussels|bruxelles|antwerp|united kingdom|\buk\b|london|manchester|spain|madrid|"
    r"barcelona|portugal|lisbon|lisboa|poland|warsaw|krak[oó]w|italy|milan|ireland|dublin|sweden|stockholm|denmark|copenhagen|norway|oslo|finland|helsinki|switzerland|zurich|"
    r"z[üu]rich|austria|vienna|wien|usa|united states|new york|san francisco|seattle|austin|boston|chicago|canada|toronto|vancouver|india|bangalore|bengaluru|hyderabad|pune|"
    r"singapore|australia|sydney|brazil|s[ãa]o paulo|mexico|japan|tokyo|china|shanghai|beijing|hong kong|dubai|israel|tel aviv|romania|bucharest|czech|prague|hungary|budapest|"
    r"greece|athens|turkey|istanbul|ukraine|kyiv|lithuania|vilnius|latvia|riga|estonia|tallinn|serbia|belgrade|bulgaria|sofia|croatia|zagreb|slovakia|bratislava|slovenia|"
    r"ljubljana|luxembourg|malta|cyprus|philippines|manila|vietnam|indonesia|jakarta|malaysia|kuala lumpur|thailand|bangkok|south africa|nigeria|kenya|egypt|argentina|"
    r"colombia|chile|peru|new zealand|auckland)\b"
)
NOT_A_PLACE = r"\d|locations?$|remote|hybrid|netherlands|nederland|holland|europe|benelux|^nl$|office|kantoor|thuis|home|multiple|various|diverse|flexible|anywhere"
GENERIC_PLACE = r"^[\s,;()-]*(the\s+)?(netherlands|nederland|holland|nl|remote|hybrid|thuis\w*)?[\s,;()-]*$"
PLACE_HINT = r"(?:standplaats|werklocatie|locatie|location|based in|office in|kantoor in|gevestigd in|located in|vestiging|onze locatie|our office|werken in|working in|work in)\W{0,25}([A-Z][\w' -]{2,30})"
SMALL_WORDS = ["aan", "de", "den", "der", "het", "op", "ter", "van", "en"]
E_MAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"(?:\+31|0031|\b0)[\s\-.]?(?:\(0\)[\s\-.]?)?\d(?:[\s\-.]?\d){7,9}\b"
GENDER_TAGS = r"\b(m/f/d|m/v/x|f/m/x|w/m/d|m/w/d|h/f|m/f|m/v)\b"
LEGAL_SUFFIX = r"\s+(b\.?v\.?|n\.?v\.?|inc\.?|ltd\.?|gmbh|holding)$"
DUTCH_NAMES = {"The Hague": "Den Haag"}


def folded(pattern: str) -> str:
    """Case-insensitive over all of Unicode, in Java's dialect."""
    return "(?iuU)" + pattern


def detect_city(text: Column) -> Column:
    """The first city of the list that the text names."""
    return F.coalesce(*(F.when(text.rlike(folded(rx)), F.lit(city)) for city, rx in CITIES.items()))


def detect_country(location: Column, country: Column) -> Column:
    """'NL', 'XX' for abroad, null if unknown; a stated country wins."""
    stated = F.when(F.length(country) > 0, F.upper(country))
    home = detect_city(location).isNotNull() | location.rlike(folded(HOME))
    return F.coalesce(stated, F.when(home, "NL").when(location.rlike(folded(ABROAD)), "XX"))


def is_remote(location: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(location.rlike(folded(ANYWHERE)), F.lit(False))


def is_generic_location(location: Column) -> Column:
    return F.coalesce(location, F.lit("")).rlike(folded(GENERIC_PLACE))


def plausible_place(value: Column) -> Column:
    """The first part of a board's own place name, title-cased, if it can be one."""
    first = F.regexp_replace(F.split(value, r"[,;(/|]", 2)[0], r"^[ -]+|[ -]+$", "")
    fits = F.length(first).between(2, 40) & ~first.rlike(folded(NOT_A_PLACE)) & first.rlike(r"^[A-Za-zÀ-ÿ' .-]+$")
    words = F.filter(F.split(first, r"\s+"), lambda w: w != "")
    cased = F.transform(words, lambda w: F.when(F.lower(w).isin(SMALL_WORDS), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))))
    return F.when(fits, F.array_join(cased, " "))


def city_from_text(title: Column, text: Column) -> Column:
    """A city in the title, else in an explicit phrase of the text, else in its opening."""
    phrases = F.regexp_extract_all(F.left(text, F.lit(6000)), F.lit("(?iuU)" + PLACE_HINT), F.lit(1))
    hinted = F.get(F.filter(F.transform(phrases, detect_city), lambda c: c.isNotNull()), F.lit(0))
    return F.coalesce(detect_city(title), hinted, detect_city(F.left(text, F.lit(600))))


def scrub_contact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?U)" + E_MAIL, "[e-mail]"), "(?U)" + PHONE, "[telefoon]")


def norm_title(title: Column) -> Column:
    t = F.regexp_replace(F.lower(title), r"\(.*?\)|\[.*?\]", " ")
    t = F.regexp_replace(t, GENDER_TAGS, " ")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9+#.]+", " "))


def norm_company(company: Column) -> Column:
    """Without the legal suffix. Curated names are a join of their own: see with_display_names()."""
    return F.trim(F.regexp_replace(F.trim(company), "(?i)" + LEGAL_SUFFIX, ""))


def with_display_names(rows, names):
    """Replace employers by their curated names (raw, name); Spark broadcasts the table if its size allows."""
    table = names.select(F.col("raw").alias("_raw"), F.col("name").alias("_name"))
    return rows.join(table, F.col("company") == F.col("_raw"), "left").withColumn("company", F.coalesce("_name", "company")).drop("_raw", "_name")


def dedup_key(company: Column, title: Column, city: Column) -> Column:
    return F.sha1(F.concat(F.lower(norm_company(company)), F.lit("|"), norm_title(title), F.lit("|"), F.lower(F.coalesce(city, F.lit("")))))


def content_hash(title: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.trim(title), F.lit("\n"), F.trim(text)), 256)


def parse_time(value: Column) -> Column:
    """Seconds or milliseconds since 1970, or an ISO time, as UTC without zone; null if neither."""
    number = value.try_cast("decimal(20,3)")
    seconds = F.when(number > 100000000000, number / 1000).otherwise(number)
    epoch = F.timestamp_seconds(seconds.cast("double")).cast("timestamp_ntz")
    return F.coalesce(F.when(number.isNotNull(), epoch), value.try_cast("timestamp").cast("timestamp_ntz"))


def plausible_posted(posted: Column, as_of: str) -> Column:
    """A date more than two days ahead or before 2000 is a parsing error."""
    fits = (posted <= F.lit(as_of).cast("timestamp_ntz") + F.expr("interval 2 days")) & (F.year(posted) >= 2000)
    return F.when(fits, posted)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def dutch_name(city: Column) -> Column:
    return reduce(lambda found, pair: F.when(city == pair[0], pair[1]).otherwise(found), DUTCH_NAMES.items(), city)


def normalized(raw, as_of: str):
    """The fields of a posting from an adapter's row (external_id, title, company, location, city, country, remote, url, description_text, posted_at, valid_through)."""
    text = scrub_contact(F.coalesce("description_text", F.lit("")))
    known = F.when(F.col("city").isin(list(CITIES)), F.col("city"))
    rows = raw.withColumns({"_text": text, "_city": F.coalesce(known, detect_city(F.col("location")), detect_city(F.col("city"))), "_remote": is_remote(F.col("location"), F.col("remote"))})
    rows = rows.withColumn("_country", F.coalesce(detect_country(F.col("location"), F.col("country")), F.when(F.col("_city").isNotNull(), "NL")))
    here = F.col("_city").isNull() & F.col("_country").eqNullSafe("NL") & ~F.col("_remote")
    own = F.coalesce(plausible_place(F.col("city")), plausible_place(F.col("location")))
    guessed = F.when(is_generic_location(F.col("location")), city_from_text(F.col("title"), F.col("_text")))
    rows = rows.withColumn("_city", F.when(here, F.coalesce(own, guessed)).otherwise(F.col("_city")))
    return rows.select(
        *(c for c in ("source_id",) if c in raw.columns),
        "external_id",
        F.left(F.trim("title"), F.lit(500)).alias("title"),
        F.left(norm_company(F.col("company")), F.lit(200)).alias("company"),
        F.nullif(F.left(F.coalesce("location", F.lit("")), F.lit(500)), F.lit("")).alias("location_raw"),
        F.col("_city").alias("city"),
        F.col("_country").alias("country"),
        F.col("_remote").alias("remote"),
        F.left("url", F.lit(1000)).alias("url"),
        F.col("_text").alias("description"),
        plausible_posted(F.col("posted_at"), as_of).alias("posted_at"),
        F.col("valid_through"),
        content_hash(F.col("title"), F.col("_text")).alias("content_hash"),
        dedup_key(F.col("company"), F.col("title"), F.col("_city")).alias("dedup_key"),
    )
