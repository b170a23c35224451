"""Column functions on labels, amounts and contexts. Patterns are fixed values; texts are lower-cased before they are matched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_label(c: Column) -> Column:
    """B1: struct(clean, footnotes, note_number): superscripts, stars, trailing footnote letters and numbers, and "(see) note n" are taken off."""
    note = F.regexp_extract(F.lower(c), r"(?:see )?note ([0-9]{1,3})", 1)
    text = F.regexp_replace(c, r"(?i)\(?\s*(?:see )?note [0-9]{1,3}\s*\)?", "")
    foot = F.regexp_extract(text, r"\(([0-9]{1,2})\)\s*$", 1)
    text = F.regexp_replace(F.regexp_replace(text, r"\s*\([0-9]{1,2}\)\s*$", ""), r"[*¹²³⁴⁵⁶⁷⁸⁹]+", "")
    letter = F.regexp_extract(text, r"\s([a-o])\)$", 1)
    text = F.regexp_replace(text, r"\s[a-o]\)$", "")
    return F.struct(squeeze(text).alias("clean"), F.array_join(F.filter(F.array(foot, letter), lambda x: x != ""), ",").alias("footnotes"), F.nullif(note, F.lit("")).try_cast("int").alias("note_number"))


#: What is taken off a label, in this order: note and number in brackets, a trailing "n)", superscripts, stars, a leading "a) ", a category in front. Fixed values.
PRETAG = (r"\(note\s*[0-9]+\)", r"\([0-9]+\)", r"[0-9]+\)\s*$", r"\s*[¹²³⁴⁵⁶⁷⁸⁹⁰]+\s*$", r"\s*[*]+\s*$", r"^[a-z]\)\s*", r"^category\s+[0-9]+[.][0-9]+\s+")


def norm_label_pretag(c: Column) -> Column:
    """Lower case without note references, footnotes, a leading "a) " or category, and trailing colons."""
    t = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    for pattern in PRETAG:
        t = F.regexp_replace(t, pattern, "")
    return F.rtrim(squeeze(t), F.lit(":"))


def norm_label_index(c: Column) -> Column:
    """Without a leading "n." and a trailing "n)", lower-cased."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*[0-9]+[.]\s*", ""), r"\s*[0-9]+\)\s*$", ""))


#: Blank, date, year, number, note in brackets, note reference, standard reference, unit header. Fixed values.
UNTAGGABLE = "|".join([
    r"^$", r"^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}$", r"^[0-9]{4}$", r"^[0-9.,\s%()+-]+$", r"^[(\[]?[0-9]+[)\]]?$", r"^note\s+[0-9]", r"^(?:ias|ifrs)\s*[0-9]", r"^in\s+(?:eur|usd|teur|tusd|mio|t€)",
])
#: Emissions, energy, water, waste, nature, substances, staff, ages, countries, supply. Fixed values.
EXCLUDED_TOPICS = "|".join([
    r"ghg|greenhouse|co2|carbon|emission|scope\s*[123]", r"energy\s*consumption|fossil|renewable|nuclear|biomass", r"water\s*(?:consumption|withdrawal|discharge|recycl|stored|intensity)",
    r"waste|hazardous|landfill|incineration|recycl", r"biodiversity|fauna|trees\s+planted|ambassadors", r"microplastic|nmvoc|sulphur|fluorine|chlorine",
    r"training\s+hours|performance\s+review|apprentice|inclusion|diversity", r"visible\s+leadership|employee.*(?:age|gender|male|female)", r"permanent\s+employees|temporary\s+employees|non-guaranteed",
    r"^(?:male|female|not reported|< 30|30 - 50|> 50)\s*(?:years)?\z", r"training\s+per\s+employee|performance.*career.*review", r"water\s+harvested|reduction.*specific.*water",
    r"^(?:usa|france|germany|rest of the world)\z", r"purchased\s+goods\s+and\s+services|fuel\s+and\s+energy.related|downstream\s+transport",
])
AMBIGUOUS = ("total", "other", "sum", "balance", "thereof", "gesamt", "summe", "sonstige")


def is_untaggable(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(c), r"^\s+|\s+$", "").rlike(UNTAGGABLE), F.lit(True))


def is_excluded_topic(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(EXCLUDED_TOPICS), F.lit(False))


def indexable_label(c: Column) -> Column:
    """At least four characters, and not a label that many concepts have."""
    t = F.lower(F.trim(c))
    return (F.length(t) >= 4) & ~t.isin(*AMBIGUOUS)


def infer_context(concept_id: Column) -> Column:
    """Context of a concept from its id's first parts."""
    part = F.split(concept_id, r"[.]")
    return F.when(part[0] == "DISC", F.concat(F.lit("DISC."), F.coalesce(F.get(part, F.lit(1)), F.lit("")))).when(part[0].isin("PNL", "SFP", "OCI", "CFS", "SOCIE"), part[0]).otherwise("UNKNOWN")


#: Keywords in a section path, the first that fits. Fixed values.
SECTION_KEYWORDS = [("comprehensive", "OCI"), ("cash flow", "CFS"), ("changes in equity", "SOCIE"), ("financial position", "SFP"), ("balance sheet", "SFP"), ("income statement", "PNL"), ("profit or loss", "PNL")]


def infer_table_context(classification: Column, path: Column) -> Column:
    out = classification
    found = F.lit(None).cast("string")
    for word, context in reversed(SECTION_KEYWORDS):
        found = F.when(F.contains(F.lower(path), F.lit(word)), context).otherwise(found)
    return F.coalesce(out, found)


#: Keywords of a table of contents and the section that they stand for; the first that fits counts. Fixed values.
TOC_LABELS = [
    ("management report", "MANAGEMENT_REPORT"), ("directors' report", "MANAGEMENT_REPORT"), ("management review", "MANAGEMENT_REPORT"), ("management discussion", "MANAGEMENT_REPORT"), ("report of the management", "MANAGEMENT_REPORT"),
    ("report of the executive", "MANAGEMENT_REPORT"), ("consolidated management", "MANAGEMENT_REPORT"), ("auditor's report", "AUDITOR_REPORT"), ("auditor’s report", "AUDITOR_REPORT"), ("auditor report", "AUDITOR_REPORT"),
    ("independent auditor", "AUDITOR_REPORT"), ("audit report", "AUDITOR_REPORT"), ("assurance report", "AUDITOR_REPORT"), ("corporate governance", "CORPORATE_GOVERNANCE"), ("governance report", "CORPORATE_GOVERNANCE"),
    ("sustainability", "ESG"), ("esg report", "ESG"), ("non-financial", "ESG"), ("supervisory board", "SUPERVISORY_BOARD"), ("aufsichtsrat", "SUPERVISORY_BOARD"), ("risk report", "RISK_REPORT"), ("risk management", "RISK_REPORT"),
    ("remuneration", "REMUNERATION_REPORT"), ("vergütung", "REMUNERATION_REPORT"), ("responsibility statement", "RESPONSIBILITY_STATEMENT"), ("statement of all members", "RESPONSIBILITY_STATEMENT"),
    ("erklärung aller mitglieder", "RESPONSIBILITY_STATEMENT"), ("contents", "TOC"), ("inhaltsverzeichnis", "TOC"), ("to our shareholders", "FRONT_MATTER"), ("an unsere aktionäre", "FRONT_MATTER"), ("further information", "APPENDIX"),
    ("appendix", "APPENDIX"), ("contact", "APPENDIX"), ("imprint", "APPENDIX"), ("financial calendar", "FRONT_MATTER"), ("lagebericht", "MANAGEMENT_REPORT"), ("bestätigungsvermerk", "AUDITOR_REPORT"), ("wirtschaftsprüfer", "AUDITOR_REPORT"),
    ("nachhaltigkeitsbericht", "ESG"), ("nichtfinanzielle", "ESG"), ("risikobericht", "RISK_REPORT"), ("corporate-governance", "CORPORATE_GOVERNANCE"), ("erklärung der gesetzlichen vertreter", "RESPONSIBILITY_STATEMENT"),
    ("vollständigkeitserklärung", "RESPONSIBILITY_STATEMENT"),
]
#: Section types that are physical already, and words that make a disclosure an appendix. Fixed values.
PHYSICAL = ("PNL", "SFP", "OCI", "CFS", "SOCIE", "TOC", "NOTES", "FRONT_MATTER", "MANAGEMENT_REPORT", "AUDITOR_REPORT", "CORPORATE_GOVERNANCE", "ESG", "RISK_REPORT", "REMUNERATION_REPORT", "SUPERVISORY_BOARD", "RESPONSIBILITY_STATEMENT", "APPENDIX", "OTHER")
APPENDIX_WORDS = ("anlage", "beilage", "appendix", "schedule")


def classify_toc_label(label: Column) -> Column:
    """The section that a label of a table of contents names, by the first keyword that it contains."""
    low, out = F.lower(label), F.lit(None).cast("string")
    for word, section in reversed(TOC_LABELS):
        out = F.when(F.contains(low, F.lit(word)), section).otherwise(out)
    return out


def physical_section(kind: Column, label: Column) -> Column:
    """The physical section of a semantic type: physical types stay, disclosures are notes, or an appendix where the label says so."""
    appendix = F.exists(F.array(*map(F.lit, APPENDIX_WORDS)), lambda w: F.contains(F.lower(F.coalesce(label, F.lit(""))), w))
    return F.when(kind.isin(*PHYSICAL), kind).when(kind.startswith("DISC."), F.when(appendix, "APPENDIX").otherwise("NOTES")).otherwise("OTHER")
