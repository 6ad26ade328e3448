"""Statement-of-reasons records (S-11): schema and allowed values.

Event-level moderation statements with enums, set-valued columns, dates
and length limits.  Sets are ``array<string>``; enums are strings checked
against the allowed values below by :mod:`veracity.operators.quality`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The public vocabularies of the statement-of-reasons format.
DECISION_VISIBILITY = [
    "DECISION_VISIBILITY_CONTENT_REMOVED",
    "DECISION_VISIBILITY_CONTENT_DISABLED",
    "DECISION_VISIBILITY_CONTENT_DEMOTED",
    "DECISION_VISIBILITY_CONTENT_AGE_RESTRICTED",
    "DECISION_VISIBILITY_CONTENT_INTERACTION_RESTRICTED",
    "DECISION_VISIBILITY_CONTENT_LABELLED",
    "DECISION_VISIBILITY_OTHER",
]
DECISION_MONETARY = [
    "DECISION_MONETARY_SUSPENSION",
    "DECISION_MONETARY_TERMINATION",
    "DECISION_MONETARY_OTHER",
]
DECISION_PROVISION = [
    "DECISION_PROVISION_PARTIAL_SUSPENSION",
    "DECISION_PROVISION_TOTAL_SUSPENSION",
    "DECISION_PROVISION_PARTIAL_TERMINATION",
    "DECISION_PROVISION_TOTAL_TERMINATION",
]
DECISION_ACCOUNT = ["DECISION_ACCOUNT_SUSPENDED", "DECISION_ACCOUNT_TERMINATED"]
ACCOUNT_TYPE = ["ACCOUNT_TYPE_BUSINESS", "ACCOUNT_TYPE_PRIVATE"]
DECISION_GROUND = ["DECISION_GROUND_ILLEGAL_CONTENT", "DECISION_GROUND_INCOMPATIBLE_CONTENT"]
CONTENT_TYPE = [
    "CONTENT_TYPE_APP",
    "CONTENT_TYPE_AUDIO",
    "CONTENT_TYPE_IMAGE",
    "CONTENT_TYPE_PRODUCT",
    "CONTENT_TYPE_SYNTHETIC_MEDIA",
    "CONTENT_TYPE_TEXT",
    "CONTENT_TYPE_VIDEO",
    "CONTENT_TYPE_OTHER",
]
STATEMENT_CATEGORY = [
    "STATEMENT_CATEGORY_ANIMAL_WELFARE",
    "STATEMENT_CATEGORY_DATA_PROTECTION_AND_PRIVACY_VIOLATIONS",
    "STATEMENT_CATEGORY_ILLEGAL_OR_HARMFUL_SPEECH",
    "STATEMENT_CATEGORY_INTELLECTUAL_PROPERTY_INFRINGEMENTS",
    "STATEMENT_CATEGORY_NEGATIVE_EFFECTS_ON_CIVIC_DISCOURSE_OR_ELECTIONS",
    "STATEMENT_CATEGORY_NON_CONSENSUAL_BEHAVIOUR",
    "STATEMENT_CATEGORY_PORNOGRAPHY_OR_SEXUALIZED_CONTENT",
    "STATEMENT_CATEGORY_PROTECTION_OF_MINORS",
    "STATEMENT_CATEGORY_RISK_FOR_PUBLIC_SECURITY",
    "STATEMENT_CATEGORY_SCAMS_AND_FRAUD",
    "STATEMENT_CATEGORY_SELF_HARM",
    "STATEMENT_CATEGORY_SCOPE_OF_PLATFORM_SERVICE",
    "STATEMENT_CATEGORY_UNSAFE_AND_ILLEGAL_PRODUCTS",
    "STATEMENT_CATEGORY_VIOLENCE",
]
KEYWORD = [
    "KEYWORD_ANIMAL_HARM",
    "KEYWORD_UNLAWFUL_SALE_ANIMALS",
    "KEYWORD_BIOMETRIC_DATA_BREACH",
    "KEYWORD_MISSING_PROCESSING_GROUND",
    "KEYWORD_RIGHT_TO_BE_FORGOTTEN",
    "KEYWORD_DATA_FALSIFICATION",
    "KEYWORD_DEFAMATION",
    "KEYWORD_DISCRIMINATION",
    "KEYWORD_HATE_SPEECH",
    "KEYWORD_COPYRIGHT_INFRINGEMENT",
    "KEYWORD_DESIGN_INFRINGEMENT",
    "KEYWORD_GEOGRAPHIC_INDICATIONS_INFRINGEMENT",
    "KEYWORD_PATENT_INFRINGEMENT",
    "KEYWORD_TRADE_SECRET_INFRINGEMENT",
    "KEYWORD_TRADEMARK_INFRINGEMENT",
    "KEYWORD_DISINFORMATION",
    "KEYWORD_FOREIGN_INFORMATION_MANIPULATION",
    "KEYWORD_MISINFORMATION",
    "KEYWORD_NON_CONSENSUAL_IMAGE_SHARING",
    "KEYWORD_NON_CONSENSUAL_ITEMS_DEEPFAKE",
    "KEYWORD_ONLINE_BULLYING_INTIMIDATION",
    "KEYWORD_STALKING",
    "KEYWORD_ADULT_SEXUAL_MATERIAL",
    "KEYWORD_IMAGE_BASED_SEXUAL_ABUSE",
    "KEYWORD_AGE_SPECIFIC_RESTRICTIONS_MINORS",
    "KEYWORD_CHILD_SEXUAL_ABUSE_MATERIAL",
    "KEYWORD_GROOMING_SEXUAL_ENTICEMENT_MINORS",
    "KEYWORD_UNSAFE_CHALLENGES",
    "KEYWORD_ILLEGAL_ORGANIZATIONS",
    "KEYWORD_RISK_ENVIRONMENTAL_DAMAGE",
    "KEYWORD_RISK_PUBLIC_HEALTH",
    "KEYWORD_TERRORIST_CONTENT",
    "KEYWORD_INAUTHENTIC_ACCOUNTS",
    "KEYWORD_INAUTHENTIC_LISTINGS",
    "KEYWORD_INAUTHENTIC_USER_REVIEWS",
    "KEYWORD_IMPERSONATION_ACCOUNT_HIJACKING",
    "KEYWORD_PHISHING",
    "KEYWORD_PYRAMID_SCHEMES",
    "KEYWORD_CONTENT_PROMOTING_EATING_DISORDERS",
    "KEYWORD_SELF_MUTILATION",
    "KEYWORD_SUICIDE",
    "KEYWORD_AGE_SPECIFIC_RESTRICTIONS",
    "KEYWORD_GEOGRAPHICAL_REQUIREMENTS",
    "KEYWORD_GOODS_SERVICES_NOT_PERMITTED",
    "KEYWORD_LANGUAGE_REQUIREMENTS",
    "KEYWORD_NUDITY",
    "KEYWORD_INSUFFICIENT_INFORMATION_TRADERS",
    "KEYWORD_REGULATED_GOODS_SERVICES",
    "KEYWORD_DANGEROUS_TOYS",
    "KEYWORD_COORDINATED_HARM",
    "KEYWORD_GENDER_BASED_VIOLENCE",
    "KEYWORD_HUMAN_EXPLOITATION",
    "KEYWORD_HUMAN_TRAFFICKING",
    "KEYWORD_INCITEMENT_VIOLENCE_HATRED",
    "KEYWORD_OTHER",
]
TERRITORY = [
    "AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HR", "HU", "IE",
    "IS", "IT", "LI", "LT", "LU", "LV", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK",
]
EU = [
    "AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HR", "HU", "IE",
    "IT", "LT", "LU", "LV", "MT", "NL", "PL", "PT", "RO", "SE", "SI", "SK",
]
EEA = [
    "AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HR", "HU", "IE",
    "IS", "IT", "LI", "LT", "LU", "LV", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK",
]
CONTENT_LANGUAGE = [
    "BG", "BR", "CA", "CO", "CS", "CU", "CY", "DA", "DE", "EL", "EN", "ES", "ET", "EU", "FI",
    "FR", "FY", "GA", "GD", "GL", "GV", "HR", "HU", "IS", "IT", "KL", "KW", "LA", "LB", "LI",
    "LT", "LV", "MT", "NB", "NL", "NN", "NO", "OC", "PL", "PT", "RM", "RO", "SC", "SE", "SK",
    "SL", "SV", "VO", "WA",
]
INFORMATION_SOURCE = [
    "SOURCE_ARTICLE_16",
    "SOURCE_TRUSTED_FLAGGER",
    "SOURCE_TYPE_OTHER_NOTIFICATION",
    "SOURCE_VOLUNTARY",
]
AUTOMATED_DECISION = [
    "AUTOMATED_DECISION_FULLY",
    "AUTOMATED_DECISION_PARTIALLY",
    "AUTOMATED_DECISION_NOT_AUTOMATED",
]

# Length limits (characters) and earliest dates.
MAX_LENGTH = {
    "content_type_other": 500,
    "decision_visibility_other": 500,
    "decision_monetary_other": 500,
    "decision_facts": 5000,
    "source_identity": 500,
    "illegal_content_legal_ground": 500,
    "illegal_content_explanation": 2000,
    "incompatible_content_ground": 500,
    "incompatible_content_explanation": 2000,
    "category_specification_other": 500,
}
MIN_DATE = {"content_date": "2000-01-01", "application_date": "2020-01-01"}

# Single-valued enum columns and set-valued columns with their vocabularies.
ENUMS = {
    "content_type": CONTENT_TYPE,
    "content_language": CONTENT_LANGUAGE,
    "decision_monetary": DECISION_MONETARY,
    "decision_provision": DECISION_PROVISION,
    "decision_account": DECISION_ACCOUNT,
    "source_type": INFORMATION_SOURCE,
    "account_type": ACCOUNT_TYPE,
    "automated_decision": AUTOMATED_DECISION,
    "decision_ground": DECISION_GROUND,
    "category": STATEMENT_CATEGORY,
}
SET_ENUMS = {
    "decision_visibility": DECISION_VISIBILITY,
    "territorial_scope": TERRITORY,
    "category_addition": STATEMENT_CATEGORY,
    "category_specification": KEYWORD,
}

_S, _D, _TS, _B = T.StringType(), T.DateType(), T.TimestampType(), T.BooleanType()
_A = T.ArrayType(T.StringType())

STATEMENT_SCHEMA = T.StructType([
    T.StructField("uuid", _S), T.StructField("created_at", _TS), T.StructField("puid", _S),
    T.StructField("content_type", _S), T.StructField("content_type_other", _S),
    T.StructField("content_date", _D), T.StructField("content_language", _S),
    T.StructField("decision_visibility", _A), T.StructField("decision_visibility_other", _S),
    T.StructField("decision_monetary", _S), T.StructField("decision_monetary_other", _S),
    T.StructField("decision_provision", _S), T.StructField("decision_account", _S),
    T.StructField("application_date", _D),
    T.StructField("end_date_visibility_restriction", _D), T.StructField("end_date_monetary_restriction", _D),
    T.StructField("end_date_service_restriction", _D), T.StructField("end_date_account_restriction", _D),
    T.StructField("territorial_scope", _A), T.StructField("decision_facts", _S),
    T.StructField("source_type", _S), T.StructField("source_identity", _S),
    T.StructField("account_type", _S), T.StructField("automated_detection", _B),
    T.StructField("automated_decision", _S), T.StructField("decision_ground", _S),
    T.StructField("illegal_content_legal_ground", _S), T.StructField("illegal_content_explanation", _S),
    T.StructField("incompatible_content_ground", _S), T.StructField("incompatible_content_explanation", _S),
    T.StructField("incompatible_content_illegal", _B), T.StructField("decision_ground_reference_url", _S),
    T.StructField("category", _S), T.StructField("category_addition", _A),
    T.StructField("category_specification", _A), T.StructField("category_specification_other", _S),
])


def read_statements(spark: SparkSession, path: str, fmt: str = "parquet", corrupt: str | None = None) -> DataFrame:
    """Scan statements with the declared schema (no inference).

    CSV exports carry sets as JSON arrays (``["A","B"]``); anything else in
    such a column is a set of ``;``-joined names.  Texts may hold line breaks
    and doubled quotes.  A malformed date, time, flag or JSON array is null;
    with ``corrupt``, that column holds the malformed fields of the record as
    they stand, as a JSON object, else null.
    """
    if fmt == "parquet":
        return spark.read.schema(STATEMENT_SCHEMA).parquet(path)
    from pyspark.sql import functions as F
    raw = spark.read.schema(T.StructType([T.StructField(f.name, _S) for f in STATEMENT_SCHEMA.fields])) \
        .option("header", True).option("multiLine", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    typed, checked = [], []
    for f in STATEMENT_SCHEMA.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            value = F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, ";"))
        else:
            value = c.try_cast(f.dataType)
        typed.append(value.alias(f.name))
        if f.dataType != _S:
            checked.append(F.when(c.isNotNull() & value.isNull(), c).alias(f.name))
    if corrupt:
        told = F.to_json(F.struct(*checked))  # fields that are null are left out
        typed.append(F.when(told != "{}", told).alias(corrupt))
    return raw.select(*typed)
