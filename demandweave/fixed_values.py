"""Values that results depend on.

Everything here is a fixed value: changing one changes results. Larger inputs
(the skill dictionary, the board catalog) are files which the caller passes.
"""

from __future__ import annotations

# The closed set of posting sources.
SOURCES = ["greenhouse", "lever", "ashby", "arbeitnow"]

# The token under which postings of the aggregator feed are kept.
AGGREGATOR_TOKEN = "arbeitnow"

# Role families and the title substrings which select them.
ROLE_PATTERNS = [
    ("Backend Engineer", "backend engineer"),
    ("Backend Engineer", "back-end engineer"),
    ("Backend Engineer", "backend developer"),
    ("Backend Engineer", "backend software engineer"),
    ("Frontend Engineer", "frontend engineer"),
    ("Frontend Engineer", "front-end engineer"),
    ("Frontend Engineer", "frontend developer"),
    ("Frontend Engineer", "ui engineer"),
    ("Full Stack Engineer", "full stack"),
    ("Full Stack Engineer", "fullstack"),
    ("Full Stack Engineer", "full-stack engineer"),
    ("Data Engineer", "data engineer"),
    ("Data Engineer", "etl engineer"),
    ("Data Engineer", "analytics engineer"),
    ("Data Scientist", "data scientist"),
    ("Data Scientist", "machine learning scientist"),
    ("Machine Learning Engineer", "machine learning engineer"),
    ("Machine Learning Engineer", "ml engineer"),
    ("Machine Learning Engineer", "ai engineer"),
    ("DevOps Engineer", "devops"),
    ("DevOps Engineer", "site reliability"),
    ("DevOps Engineer", "sre"),
    ("DevOps Engineer", "platform engineer"),
    ("DevOps Engineer", "infrastructure engineer"),
    ("Mobile Engineer", "mobile engineer"),
    ("Mobile Engineer", "ios engineer"),
    ("Mobile Engineer", "android engineer"),
    ("Mobile Engineer", "mobile developer"),
]

# Accepted skill categories.
CATEGORIES = [
    "Architecture", "Backend", "Cloud", "Data", "Database", "DevOps", "Frontend",
    "Language", "ML/AI", "Mobile", "Practice", "Security", "Testing",
]

# Context guards (term, text before that rejects, text after that rejects).
DEFAULT_GUARDS = [
    ("C", r"([A-Za-z]\.|\bseries )", "([\\s‑-]?(?:level|suite)\\b|['’])"),
    ("R", None, r"[&$]"),
    ("Go", r"\byou ", r"-(?:to-market|live)"),
]

# Dates after which an unrefreshed jobs table warns and fails, in days.
FRESHNESS_WARN_DAYS = 3
FRESHNESS_ERROR_DAYS = 14

# Text that stands for NULL inside a surrogate key.
SURROGATE_NULL = "_dbt_utils_surrogate_key_null_"

# Page size of the job list, and of the lists behind the question tools.
PAGE_SIZE = 25
FIND_JOBS_SAMPLE = 10
TOP_SKILLS_LIMIT = 15
RESOLVE_LIMIT = 15
COMPANIES_LIMIT = 10
GAP_PLAN_LIMIT = 8
