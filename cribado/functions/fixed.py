"""Fixed values that decide results: formats, patterns, limits and names."""

# Prompt and response formats.
PLACEHOLDER = "<EJEMPLO>"
RATING_PATTERN = r"PUNTUACIÓN EDUCATIVA[:\s]*([\d\.]+)"
DOMAIN_PATTERN = r"DOMINIO[:\s]*(\w+(?:\s\w+)*(?:,\s*\w+(?:\s\w+)*)*)\n"
USE_CASE_PATTERN = r"CASOS DE USO[:\s]*(\w+(?:\s\w+)*(?:,\s*\w+(?:\s\w+)*)*)"

# The score scale.
MIN_SCORE = 0
MAX_SCORE = 5

# Label reports.
NO_MATCH = "Sin coincidencia"
CUT_TAG = "E"  # what the tag pattern leaves of "E-commerce"
ALL_DATASETS = "All-Datasets"
EXCLUDED_FROM_ALL = "toxicity"
TOP_DOMAINS = 10
TOP_USE_CASES = 20

# File names.
RESULT_PREFIX = "usecasesdomains"
RESULT_GLOB = "usecasesdomains_*.json"
SHARD_SUFFIX = ".arrow"

# Batches, budgets and the split.
GENERATION_BATCH = 500
SCORING_BATCH = 4096
PROMPT_TOKENS = 130_000
TRAIN_PERMILLE = 950
SPLIT_SEED = 42

# What Python's str.isspace, \s, \d and \w accept, as classes that read the same
# in the JVM and in RE2. Both engines' own \s, \d and \w are narrower.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
DIGIT_CLASS = r"\p{Nd}"
WORD_CLASS = r"\p{L}\p{N}_"
