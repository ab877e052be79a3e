"""String, identity-key and category expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no identity in a company name.
LEGAL_WORDS = ["ltd", "limited", "llp", "plc", "inc", "the", "group", "holdings", "uk"]

# Publicly funded bodies, matched anywhere in the name.
PUBLIC_BODIES = [
    "Ordnance Survey",
    "UK Hydrographic Office",
    "National Physical Laboratory",
    "Plymouth Marine Laboratory",
    "National Nuclear Laboratory",
    "United Kingdom National Nuclear Laboratory",
    "Met Office",
    "British Geological Survey",
    "Environment Agency",
    "Natural England",
    "Historic England",
    "Forestry Commission",
    "Civil Aviation Authority",
    "Maritime and Coastguard Agency",
    "Health and Safety Executive",
    "UK Health Security Agency",
    "Public Health England",
    "Food Standards Agency",
    "Highways England",
    "National Highways",
    "Royal Botanic Gardens",
    "Centre for Ecology",
    "UK Research and Innovation",
    "Natural Environment Research Council",
    "Science and Technology Facilities Council",
    "Engineering and Physical Sciences Research Council",
]
# Structural naming patterns of public bodies.
PUBLIC_PATTERNS = [r"\b\w+ (?:County|City|Borough|District) Council\b", r"^HM \w+", r"\bNHS\b"]

# Treaty-funded research bodies.
RESEARCH_BODIES = [
    "SKAO",
    "Square Kilometre Array",
    "European Space Agency",
    "European Southern Observatory",
    "European Organization for Nuclear Research",
    "European Organisation for Nuclear Research",
    "CERN",
    "Joint European Torus",
    "ITER Organization",
    "European Molecular Biology Laboratory",
]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalized_name(name: Column) -> Column:
    """Lower-case letters and digits of the name without legal words; '' for null."""
    bare = F.regexp_replace(F.lower(name), rf"\b({'|'.join(LEGAL_WORDS)})\b", "")
    return F.coalesce(F.regexp_replace(bare, "[^a-z0-9]", ""), F.lit(""))


def normalized_url(url: Column) -> Column:
    return F.regexp_replace(F.lower(strip(url)), "/+$", "")


def registration_key(ch: Column) -> Column:
    """Registration number in the form used for matching: stripped, upper case."""
    return F.upper(strip(ch))


def company_id(ch: Column, name: Column, url: Column) -> Column:
    """`ch_<number>_<name>`, or a hash of name and URL where no number exists.

    The name is part of the first form because two companies may share a number."""
    key = registration_key(ch)
    blank = F.lit("")
    basis = F.concat(
        F.lower(strip(F.coalesce(name, blank))), F.lit("|"), F.lower(strip(F.coalesce(url, blank)))
    )
    hashed = F.concat(F.lit("fallback_"), F.substring(F.sha1(basis), 1, 12))
    numbered = F.concat(F.lit("ch_"), key, F.lit("_"), normalized_name(name))
    return F.when(key.isNotNull() & (key != ""), numbered).otherwise(hashed)


def public_body_flag(name: Column) -> Column:
    pattern = "(?i)" + "|".join(PUBLIC_BODIES + PUBLIC_PATTERNS)
    return F.coalesce(name.rlike(pattern), F.lit(False)).cast("int")


def research_body_flag(name: Column) -> Column:
    return F.coalesce(name.rlike("(?i)" + "|".join(RESEARCH_BODIES)), F.lit(False)).cast("int")


def category(value: Column) -> Column:
    """Category label of a number or boolean: 61900.0 becomes '61900'."""
    number = value.cast("double")
    whole = F.when(number == F.floor(number), F.floor(number).cast("string"))
    return F.when(value.isNotNull() & ~F.isnan(number), F.coalesce(whole, value.cast("string")))


def keywords(text: Column) -> Column:
    """Distinct lower-case keywords of a comma list; empty array for null."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda k: F.lower(strip(k)))
    return F.array_distinct(F.filter(parts, lambda k: k != ""))


def base_feature_name(name: Column) -> Column:
    """Feature name without its preprocessing prefix and category suffix."""
    bare = F.regexp_replace(name, "^(plain_numeric|log_numeric|categorical)__", "")
    # The one-hot encoded fields.
    return F.regexp_replace(
        bare, "^(sic_code_1|company_size|value_stream|employee_count_source)_.*$", "$1"
    )
