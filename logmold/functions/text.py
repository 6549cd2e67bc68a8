"""Row-local text functions as Spark Column builders (JVM-side, codegen'd).

Every function takes and returns ``pyspark.sql.Column`` so it composes into
one projection; none of them needs a Python worker.

Regex parity: Python's ``re`` is Unicode-aware for ``\\d``, ``\\w``, ``\\b``
and ``IGNORECASE``. Java's ``(?U)`` is too, but its word class holds marks and
joiners and lacks superscripts and the like, so the word boundaries are written
as look-arounds with Python's class (letters, numbers, underscore) and digits
as ``\\p{Nd}`` (see ``_u``). Python's ``str.split()``/``strip()`` also treat
``\\x1c-\\x1f`` as white space, which Java's Unicode ``\\s`` does not, hence
the explicit white-space class below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. They must equal the reference's values for equal results.
# ---------------------------------------------------------------------------
IP_PATTERN = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
HEX_PATTERN = r"\b0x[0-9a-fA-F]+\b"
NUM_PATTERN = r"\b\d+\b"
GUID_PATTERN = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
PLACEHOLDER = "<*>"

# Signature tokens, applied in this order: GUID, IP, HEX, NUM.
SIGNATURE_TOKENS = [
    (GUID_PATTERN, "<guid>"),
    (IP_PATTERN, "<ip>"),
    (HEX_PATTERN, "<hex>"),
    (NUM_PATTERN, "<num>"),
]
# Masking order of the per-line analysis: IP, NUM, HEX, GUID.
MASK_ORDER = [IP_PATTERN, NUM_PATTERN, HEX_PATTERN, GUID_PATTERN]
# Masking order of the fallback template and of the normaliser: IP, HEX, NUM, GUID.
TEMPLATE_MASK_ORDER = [IP_PATTERN, HEX_PATTERN, NUM_PATTERN, GUID_PATTERN]

# What a match of a pattern begins with, looked for before the word boundary: most
# places of a text are passed over by one cheap look at a character.
BEGINS = {IP_PATTERN: r"\d", NUM_PATTERN: r"\d", HEX_PATTERN: "0x", GUID_PATTERN: "[0-9a-fA-F]{8}-"}

# Level words, checked in this order; no match means INFO.
LEVEL_WORDS = [
    ("ERROR", "error|exception|fatal|panic|failed?"),
    ("WARN", "warn|warning|deprecated|retry"),
    ("INFO", "info|started|connected|success|logged in"),
]
DEFAULT_LEVEL = "INFO"

# Event words, checked in this order; no match means GENERIC.
EVENT_WORDS = [
    ("AUTH", "login|logout|auth|token|password"),
    ("NETWORK", "timeout|connection|socket|dns|http"),
    ("DB", "sql|database|db|query|transaction"),
    ("SYSTEM", "cpu|memory|disk|node|service|process"),
]
DEFAULT_EVENT = "GENERIC"

# Tree buckets: plain substrings of the lower-cased text, checked in this order.
BUCKET_SUBSTRINGS = [
    ("login", ["login", "logged in", "logout", "auth", "token"]),
    ("database", ["database", "db", "query", "transaction"]),
    ("request", ["request", "http", "endpoint", "api"]),
    ("timeout", ["timeout", "timed out", "latency"]),
]
DEFAULT_BUCKET = "generic"

LEVEL_COLORS = {"INFO": "blue", "WARN": "orange", "ERROR": "red"}

# Template classifier: substrings of the lower-cased template.
ERROR_MARKERS = ["error", "fail", "exception"]

PROMPT_HEAD = (
    "You are a deterministic log template extractor.\n"
    "Given log lines that share the same event pattern, produce exactly one template.\n"
    "Rules:\n"
    "1) Keep static words unchanged.\n"
    "2) Replace dynamic values (numbers, ids, IPs, UUIDs, timestamps) with <*>.\n"
    "3) Return only the template line and nothing else.\n\n"
    "Logs:\n"
)
PROMPT_TAIL = "\n\nTemplate:\n"
TEMPLATE_LABEL = "Template:"
CACHE_KEY_SEPARATOR = "||"
# ---------------------------------------------------------------------------

# Python str.isspace() as a Java character class (Unicode \s plus \x1c-\x1f).
WS = r"[\s\x1c-\x1f]"
# Python str.splitlines() boundaries.
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


# Python's \w: str.isalnum() or an underscore.
PY_WORD = r"[\p{L}\p{N}_]"


def _u(pattern: str, flags: str = "U") -> str:
    """A Python pattern for Java: a ``\\b`` at either end stands beside a word
    character in all patterns above, so a look-around outwards is the same."""
    begins = f"(?={BEGINS[pattern]})" if pattern in BEGINS else ""
    if pattern.startswith(r"\b"):
        pattern = f"{begins}(?<!{PY_WORD})" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?!{PY_WORD})"
    return f"(?{flags})" + pattern.replace(r"\d", r"\p{Nd}")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()`` with Python's white-space definition."""
    return F.regexp_replace(_col(c), _u(rf"^{WS}+|{WS}+\z"), "")


def collapse_whitespace(c) -> Column:
    """``" ".join(s.split())``."""
    return F.regexp_replace(py_strip(c), _u(rf"{WS}+"), " ")


def replace_all(c, patterns, replacement: str = PLACEHOLDER) -> Column:
    out = _col(c)
    for pattern in patterns:
        out = F.regexp_replace(out, _u(pattern), replacement)
    return out


def signature(c, min_tokens: int = 3) -> Column:
    """the cluster id of a line.

    Lower-case, strip, replace GUID/IP/HEX/NUM by tokens, keep the first
    ``min_tokens`` white-space tokens joined by one space. None of the four
    patterns can match white space, and a white-space neighbour is a word
    boundary just like the end of the text, so taking the first tokens before
    the replacements gives exactly the same tokens; the split is bounded by
    ``limit`` so a long line is not cut into all of its words.
    """
    if min_tokens < 0:
        raise ValueError("min_tokens must be >= 0")
    head = F.split(
        F.regexp_replace(_col(c), _u(rf"^{WS}+"), ""), _u(rf"{WS}+"), min_tokens + 1
    )
    tokens = F.filter(F.slice(head, 1, min_tokens), lambda t: t != F.lit(""))
    out = F.lower(F.array_join(tokens, " "))
    for pattern, token in SIGNATURE_TOKENS:
        out = F.regexp_replace(out, _u(pattern), token)
    return out


def _first_match(c, table, default: str, flags: str = "iU") -> Column:
    c = _col(c)
    expr = None
    for label, words in table:
        cond = c.rlike(_u(rf"\b({words})\b", flags))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def log_level(c) -> Column:
    """ERROR, WARN or INFO (first whole-word match, case-insensitive)."""
    return _first_match(c, LEVEL_WORDS, DEFAULT_LEVEL)


def event_type(c) -> Column:
    """AUTH, NETWORK, DB, SYSTEM or GENERIC."""
    return _first_match(c, EVENT_WORDS, DEFAULT_EVENT)


def mask_dynamic_parts(c) -> Column:
    """IP, NUM, HEX, GUID replaced by ``<*>``; case and spacing kept."""
    return replace_all(c, MASK_ORDER)


def heuristic_template(c) -> Column:
    """fallback template of a batch, from its first line."""
    return replace_all(c, TEMPLATE_MASK_ORDER)


def placeholder_spacing(c) -> Column:
    """F8: ``< * >`` -> ``<*>``, runs of placeholders -> one ``<*> ``, strip."""
    out = F.regexp_replace(_col(c), _u(r"<\s*\*\s*>"), PLACEHOLDER)
    out = F.regexp_replace(out, _u(r"(?:<\*>\s*){2,}"), PLACEHOLDER + " ")
    return py_strip(out)


def normalize_template(c) -> Column:
    """collapse white space, mask variables, then F8."""
    return placeholder_spacing(replace_all(collapse_whitespace(c), TEMPLATE_MASK_ORDER))


def build_prompt(lines) -> Column:
    """the generator prompt of a batch (``lines``: array<string>)."""
    examples = F.array_join(F.transform(_col(lines), lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit(PROMPT_HEAD), examples, F.lit(PROMPT_TAIL))


def extract_template(c) -> Column:
    """first line of a raw generator output, label and list dash removed."""
    first = F.element_at(F.split(F.coalesce(_col(c), F.lit("")), _u(LINE_BREAK)), 1)
    line = py_strip(F.replace(first, F.lit(TEMPLATE_LABEL), F.lit("")))
    return F.when(line.startswith("- "), py_strip(F.substring(line, 3, 1 << 30))).otherwise(line)


def cache_key(cluster_id, texts) -> Column:
    """sha256 hex of ``cluster_id || "||" || "\\n".join(batch texts)``."""
    return F.sha2(
        F.concat(_col(cluster_id), F.lit(CACHE_KEY_SEPARATOR), F.array_join(_col(texts), "\n")),
        256,
    )


def classify_template(c) -> Column:
    """``error`` when the lower-cased template holds an error marker."""
    low = F.lower(_col(c))
    cond = None
    for marker in ERROR_MARKERS:
        hit = low.contains(marker)
        cond = hit if cond is None else (cond | hit)
    return F.when(cond, F.lit("error")).otherwise(F.lit("normal"))


def tree_bucket(text, event) -> Column:
    """tree event bucket from substrings, else the event type, else generic."""
    low = F.lower(_col(text))
    ev = F.coalesce(_col(event), F.lit(""))
    expr = None
    for label, words in BUCKET_SUBSTRINGS:
        cond = None
        for w in words:
            hit = low.contains(w)
            cond = hit if cond is None else (cond | hit)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    fallback = F.when((ev != F.lit("")) & (F.upper(ev) != F.lit(DEFAULT_EVENT)), F.lower(ev))
    return expr.otherwise(F.coalesce(fallback, F.lit(DEFAULT_BUCKET)))


def tree_level(c) -> Column:
    """upper-cased level; anything unknown is INFO."""
    up = F.upper(F.coalesce(_col(c), F.lit(DEFAULT_LEVEL)))
    return F.when(up.isin(list(LEVEL_COLORS)), up).otherwise(F.lit(DEFAULT_LEVEL))


def level_color(c) -> Column:
    """colour of a tree level."""
    mapping = F.create_map(*[F.lit(x) for kv in LEVEL_COLORS.items() for x in kv])
    return F.element_at(mapping, _col(c))


def source_norm(c) -> Column:
    """upper-cased source; missing is SLM; anything but CACHE counts as SLM."""
    up = F.upper(F.coalesce(_col(c), F.lit("SLM")))
    return F.when(up == F.lit("CACHE"), F.lit("CACHE")).otherwise(F.lit("SLM"))


def pct(part, total) -> Column:
    """F16: ``round(part / max(total, 1) * 100, 2)`` with half-even rounding."""
    denom = F.greatest(_col(total).cast("double"), F.lit(1.0))
    return F.bround(_col(part).cast("double") / denom * F.lit(100.0), 2)
