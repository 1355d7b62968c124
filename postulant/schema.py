"""Table schemas and the fixed values shared by the whole library."""

from pyspark.sql import types as T

UNKNOWN_MONTH = "unknown"
# A segment holds the rows of one load, or of several closed ones.
CANDIDATE_PARTITIONS = ("applied_month", "segment")
CV_PARTITIONS = ("load_id", "id_prefix")
# The pair that decides whether an application is already in the table.
NATURAL_KEY = ("job", "name")

# ---- Fixed values: results depend on these exact texts and numbers ----------
UNKNOWN = "Inconnu"
NOT_AVAILABLE = "N/A"
YES, NO = "OUI", "NON"
ALL = "Tous"
NO_EXPERIENCE = -1
EXPERIENCE_RANGE = (-1, 30)
PAGE_SIZE = 20
SENIOR_UNTIL = 2020
STATUS_LABELS = {
    0: "🟡 Non traité",
    -1: "❌ Refus",
    1: "📨 Formulaire envoyé",
    2: "🛠️ En cours de qualif.",
    3: "✅ Go process",
}
DEFAULT_STATUS = 0
# Key in the model's answer -> (candidate column, value when the key is absent).
ANSWER_FIELDS = {
    "Freelance": ("freelance", "N/A"),
    "Année de diplomation": ("grad_year", "N/A"),
    "Expérience": ("years_exp", "-1"),
    "Entreprises": ("companies", "N/A"),
    "Compétences": ("skills", "N/A"),
}
RESUME_EXTENSIONS = (".pdf", ".docx")
MASKED_NAME = "[ANONYMISÉ]"
MASKED_EMAIL = "[EMAIL]"
MASKED_PHONE = "[TÉL]"
MASKED_ADDRESS = "[ADRESSE]"
NO_FILE_MARK = "✖️"
# Leading bytes (hex) -> file type, and file type -> MIME type.
SIGNATURES = {"25504446": "pdf", "504B0304": "docx", "D0CF11E0": "doc"}
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
}
UNKNOWN_TYPE, UNKNOWN_MIME = "bin", "application/octet-stream"
SEARCHABLE = ("name", "title", "skills", "companies", "location")
# ------------------------------------------------------------------------------

_S = T.StringType()

ATTACHMENT = T.StructType([
    T.StructField("name", _S),
    T.StructField("pages", T.ArrayType(_S)),
    T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(_S)))),
    T.StructField("paragraphs", T.ArrayType(_S)),
    T.StructField("content", T.BinaryType()),
    # True if the pages come from the second reader, whose pages are joined by blanks.
    T.StructField("fallback", T.BooleanType()),
])

# One decoded mail. `response` is the model's JSON answer, null until it is known.
MESSAGES = T.StructType([
    T.StructField("filename", _S),
    T.StructField("sent_at", T.TimestampType()),
    T.StructField("body", _S),
    T.StructField("attachments", T.ArrayType(ATTACHMENT)),
    T.StructField("response", _S),
])

CANDIDATES = T.StructType([
    T.StructField("applied_at", T.TimestampType()),
    T.StructField("job", _S),
    T.StructField("name", _S),
    T.StructField("title", _S),
    T.StructField("location", _S),
    T.StructField("email", _S),
    T.StructField("phone", _S),
    T.StructField("freelance", _S),
    T.StructField("grad_year", _S),
    T.StructField("years_exp", T.DoubleType()),
    T.StructField("companies", _S),
    T.StructField("skills", _S),
    T.StructField("status", T.IntegerType()),
    T.StructField("id", _S),
])

# What the table holds of a candidate: the load it came with, too.
STORED = T.StructType([*CANDIDATES.fields, T.StructField("load_id", _S)])

CANDIDATE_CV = T.StructType([
    T.StructField("id", _S),
    T.StructField("cv", T.BinaryType()),
])
