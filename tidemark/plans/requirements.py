"""Queries over what postings ask for and offer: statements planted behind every document's whole text, with answers that follow from what was planted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import requirements
from tidemark.operators import sections
from tidemark.plans.text import register_in
from tidemark.sources import standin

QUERIES, ORACLE_SQL = {}, {}
register = register_in(QUERIES, ORACLE_SQL)

# Between a document's prose and what is planted: longer than any pattern looks back.
GAP = " . Here ends the letter and now begins the notice that follows below, in plain and simple words for all of our friends to see today . Then: "


def planted(spark: SparkSession, sf_dir: str, sentence: str) -> DataFrame:
    """doc_id and its text with a sentence, given in SQL over doc_id, behind it."""
    docs = standin.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(GAP), F.expr(sentence)).alias("text"))


_N = "cast(doc_id % 25 as string)"
_YEARS = f"""CASE doc_id % 9
    WHEN 0 THEN concat({_N}, ' years of experience')
    WHEN 1 THEN concat('minimaal ', {_N}, ' jaar werkervaring')
    WHEN 2 THEN concat({_N}, '-', cast(doc_id % 25 + 1 + doc_id % 3 as string), ' years of professional experience')
    WHEN 3 THEN concat('a contract of ', {_N}, ' years with experience')
    WHEN 4 THEN concat('within ', {_N}, ' years you gain experience')
    WHEN 5 THEN concat({_N}, '+ years in finance')
    WHEN 6 THEN concat('up to ', {_N}, ' years of experience')
    WHEN 7 THEN concat({_N}, ',5 jaar ervaring')
    ELSE 'nothing of the kind' END"""

register("x16_years", lambda spark, sf_dir: planted(spark, sf_dir, _YEARS).select("doc_id", requirements.years(F.col("text")).alias("y")).select("doc_id", "y.*"),
    """WITH d AS (SELECT doc_id, doc_id % 25 AS n, doc_id % 25 + 1 + doc_id % 3 AS m, doc_id % 9 AS k FROM documents),
    a AS (SELECT *, CASE WHEN k = 7 THEN n + 1 WHEN k IN (0, 1, 2, 5) THEN n END AS y FROM d)
    SELECT doc_id, CASE WHEN y BETWEEN 1 AND 19 THEN CAST(y AS INTEGER) END AS years,
           CASE WHEN y BETWEEN 1 AND 19 THEN n || CASE k WHEN 0 THEN '' WHEN 2 THEN '-' || m WHEN 7 THEN '.5' ELSE '+' END END AS worded FROM a""")  # fmt: skip

_VISA = """concat(element_at(array('We can ', 'We cannot ', 'If you live abroad, we can '), cast(doc_id % 3 + 1 as int)),
    element_at(array('sponsor a visa.', 'offer a relocation package.', 'offer visa support.', 'offer lunch.'), cast(doc_id div 3 % 4 + 1 as int)),
    element_at(array('', ' You must have a valid work permit.', ' EU citizenship required.', ' A valid work permit is a plus.'), cast(doc_id div 12 % 4 + 1 as int)))"""

register("x17_visa", lambda spark, sf_dir: planted(spark, sf_dir, _VISA).select("doc_id", requirements.detect_visa(F.col("text")).alias("visa")),
    """WITH d AS (SELECT doc_id, doc_id % 3 = 1 AS refused, doc_id // 3 % 4 AS what, doc_id // 12 % 4 IN (1, 2) AS asks FROM documents)
    SELECT doc_id, CASE WHEN NOT refused AND what IN (0, 2) THEN true WHEN asks OR refused AND what < 3 THEN false WHEN what = 1 THEN true END AS visa FROM d""")  # fmt: skip

_POSTING = "concat(text, '\\nWhat you will do\\n', text, '\\nBenefits\\nFree fruit\\nKnowledge of fruit is a plus\\nAbout us\\nFounded by number ', doc_id)"
# The only words of role prose that the documents' invented words make.
_CUE = r"regexp_matches(b, '(?i)(^|[^\p{L}\p{N}_])as an? [\p{L}\p{N}_]')"
_LINES = r"""line AS (SELECT doc_id, text, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, text, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents WHERE text IS NOT NULL))"""


def _posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as the opening of a posting, and again as its section about the job, before two of the employer's."""
    docs = standin.table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.expr(_POSTING).alias("text"))


register("x11_job_text", lambda spark, sf_dir: sections.job_text(_posting(spark, sf_dir), ["doc_id"]).select("doc_id", F.sha2("job_text", 256).alias("job_sha256"), F.length("job_text").alias("n")),
    f"""WITH {_LINES}, bare AS (SELECT *, trim(line, ' ' || chr(9)) AS b FROM line),
    opening AS (SELECT doc_id, text, string_agg(line, chr(10) ORDER BY n) FILTER (b <> '' AND (regexp_matches(line, '^\\s*([-•*·▪●–]|[0-9]+[.)])\\s+') OR length(b) < 100 AND NOT regexp_matches(b, '[.!?]$') OR {_CUE})) AS o FROM bare GROUP BY doc_id, text),
    whole AS (SELECT doc_id, coalesce(o || chr(10), '') || 'What you will do' || chr(10) || text || chr(10) || 'Knowledge of fruit is a plus' AS t FROM opening)
    SELECT doc_id, sha256(t) AS job_sha256, length(t) AS n FROM whole""")  # fmt: skip

register("x27_self_description", lambda spark, sf_dir: sections.self_description(_posting(spark, sf_dir), ["doc_id"], F.lit("Nobody")).select("doc_id", F.sha2("intro", 256).alias("intro_sha256"), F.length("intro").alias("n")),
    f"""WITH {_LINES}, bare AS (SELECT doc_id, n, trim(line, ' ' || chr(9)) AS b FROM line WHERE trim(line, ' ' || chr(9)) <> '' AND NOT {_CUE}
        UNION ALL SELECT doc_id, 1000000000, 'Founded by number ' || doc_id FROM documents WHERE text IS NOT NULL),
    read AS (SELECT *, coalesce(sum(length(b)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bare),
    said AS (SELECT doc_id, left(string_agg(b, chr(10) ORDER BY n), 2000) AS t FROM read WHERE before <= 2000 GROUP BY doc_id)
    SELECT doc_id, sha256(t) AS intro_sha256, length(t) AS n FROM said""")  # fmt: skip

_HELD = "element_at(array('an MBO diploma', 'an HBO degree', 'a BSc degree', 'a Master''s degree', 'a doctorate'), cast({k} % 5 + 1 as int))"
_FIRST, _SECOND = _HELD.format(k="doc_id"), _HELD.format(k="(doc_id + 1 + doc_id % 3)")
_DEGREE = f"""CASE doc_id div 5 % 4 WHEN 0 THEN concat('You have ', {_FIRST}, '.') WHEN 1 THEN concat('You have ', {_FIRST}, ' or ', {_SECOND}, '.')
    WHEN 2 THEN concat('Having ', {_FIRST}, ' is a plus.') ELSE concat('A degree is not required, though you may have ', {_FIRST}, '.') END"""

register("x19_degree", lambda spark, sf_dir: planted(spark, sf_dir, _DEGREE).select("doc_id", requirements.detect_degree(F.lit("Engineer"), F.lit(None).cast("string"), F.col("text")).alias("degree")),
    """WITH d AS (SELECT doc_id, [0, 2, 1, 3, 4][doc_id % 5 + 1] AS a, [0, 2, 1, 3, 4][(doc_id + 1 + doc_id % 3) % 5 + 1] AS b, doc_id // 5 % 4 AS m FROM documents)
    SELECT doc_id, CASE m WHEN 2 THEN 'unknown' WHEN 3 THEN 'none' ELSE ['mbo', 'bsc', 'hbo', 'msc', 'phd'][CASE m WHEN 0 THEN a ELSE least(a, b) END + 1] END AS degree FROM d""")  # fmt: skip
