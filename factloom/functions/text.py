"""Text functions as columns: tokens, folding, redaction, rules on sentences, paths and terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"(?U)[\w.]+"
#: Accented letters and their plain forms, for diacritic-free index terms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Secrets in order of replacement, name and pattern.
SECRETS = [
    ("openai_key", r"\bsk-[A-Za-z0-9_-]{16,}\b"),
    ("github_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("bearer", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}"),
    ("password_assignment", r"(?i)\b(password|passwd|pwd|api[_-]?key|secret)\s*[:=]\s*[^\s,;]{6,}"),
]
#: The category of a sentence by its first matching rule, with type and confidence.
SENTENCE_RULES = [
    (r"(?i)\b(prefer|preference|always use)\b|偏好|以后", "preference", "preference", 0.78),
    (r"(?i)\b(decide|decided|use|adopt|standardize)\b|决定|统一|采用", "decision", "project", 0.84),
    (r"(?i)\b(do not|must not|never|constraint|required|requires?)\b|不要|禁止|必须", "constraint", "procedural", 0.88),
    (r"(?i)\b(failed|failure|broke|root cause|did not work)\b|失败|根因|不工作", "failure", "episodic", 0.82),
    (r"(?i)\b(current goal|working on|next task)\b|当前目标|正在|下一步", "state", "working", 0.72),
]
CJK = "[㐀-䶿一-鿿豈-﫿]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of word characters and dots."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


TERM = r"[\p{L}\p{N}]+"


def folded(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters; plain ASCII texts need no look at each letter."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(low, ACCENTED, PLAIN))


def terms(text: Column) -> Column:
    """Index terms: letters and digits only, folded."""
    return F.regexp_extract_all(folded(text), F.lit(TERM), F.lit(0))


def term_count(text: Column) -> Column:
    """How many index terms there are, without making them (folding changes no letter into another kind)."""
    return F.regexp_count(text, F.lit(TERM))


def jaccard(left: Column, right: Column) -> Column:
    """Of token arrays taken as sets; 0 for two empty ones."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def dice(left: Column, right: Column) -> Column:
    total = F.size(F.array_distinct(left)) + F.size(F.array_distinct(right))
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(left, right)) / total).otherwise(F.lit(0.0))


def ngrams(text: Column, size: int) -> Column:
    """Distinct substrings of so many characters; none for shorter texts."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def cjk_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(CJK), F.lit(0))


def cjk_similarity(query: Column, document: Column) -> Column:
    """The best overlap (Dice over bigrams) of any run of one with any of the other; 0 without runs of two."""
    grams = lambda text: F.filter(F.transform(cjk_runs(text), lambda run: ngrams(run, 2)), lambda g: F.size(g) > 0)
    best = F.array_max(F.flatten(F.transform(grams(query), lambda a: F.transform(grams(document), lambda b: dice(a, b)))))
    return F.coalesce(best, F.lit(0.0))


def redact(text: Column, most: int | None = None) -> Column:
    """struct(text, detected): secrets replaced in order, then cut at `most` characters."""
    out, found = text, []
    for name, pattern in SECRETS:
        found.append(F.when(F.regexp_like(out, F.lit(pattern)), F.lit(name)))
        out = F.regexp_replace(out, pattern, f"[REDACTED:{name}]")
    if most is not None:
        out = F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("…[TRUNCATED]"))).otherwise(out)
    return F.struct(out.alias("text"), F.array_compact(F.array(*found)).alias("detected"))


def sentence_category(sentence: Column) -> Column:
    """The first rule's category, or null."""
    out = F.lit(None).cast("string")
    for pattern, category, _, _ in reversed(SENTENCE_RULES):
        out = F.when(F.regexp_like(sentence, F.lit(pattern)), F.lit(category)).otherwise(out)
    return out


def semantic_key(text: Column) -> Column:
    """Lower case, white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def camel_tokens(text: Column) -> Column:
    """Tokens of names written in camel case."""
    return tokens(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"))


def token_estimate(text: Column) -> Column:
    """Bytes by four, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def path_parts(path: Column) -> Column:
    """struct(parent, base, suffix)."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.struct(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("parent"), base.alias("base"), F.regexp_extract(base, r"(\.[^.]*)$", 1).alias("suffix"))


#: Predicates by another name.
PREDICATES = {
    "use": "uses", "uses": "uses", "adopts": "uses", "database": "uses", "decision": "uses", "forbid": "forbidden", "forbids": "forbidden", "constraint": "forbidden",
    "prefer": "prefers", "preference": "prefers", "failure": "failed_because", "implemented": "implemented_in", "implementation": "implemented_in",
}


def canonical_predicate(predicate: Column) -> Column:
    """Lower case with single underscores, by its common name; `states` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(predicate), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")
    out = F.when(bare == "", F.lit("states")).otherwise(bare)
    for other, name in PREDICATES.items():
        out = F.when(bare == other, F.lit(name)).otherwise(out)
    return out


#: The patterns of code terms, each with its group.
CODE_TERMS = [
    (r"`([^`]+)`", 1),
    (r"\b(?:[\w.-]+[\\/])*[\w.-]+\.(?i:py|pyi|js|jsx|ts|tsx|rs|go|java|cpp|c|h|toml|yaml|yml|json)\b", 0),
    (r"(?<![\w.-])(?:[A-Za-z]:)?[\\/][\w.\\/-]+", 0),
    (r"\b([A-Za-z_][A-Za-z0-9_.]*)\(\)", 1),
    (r"\b[A-Z][A-Z0-9_]{2,}\b", 0),
]


def exact_terms(query: Column) -> Column:
    """Distinct code terms of at most 1000 characters, in lower case without quotes around them."""
    found = F.flatten(F.array(*[F.regexp_extract_all(query, F.lit(p), F.lit(g)) for p, g in CODE_TERMS]))
    bare = F.transform(found, lambda t: F.translate(F.lower(F.regexp_replace(t, r"^[\s\"'`]+|[\s\"'`]+$", "")), "\\", "/"))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda t: (t != "") & (F.length(t) <= 1000))))


def entity_words(query: Column) -> Column:
    """Distinct words that may name an entity: runs of letters, digits and . + # / - in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_.+#/-]+"), F.lit(0)))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))


def clean_url(url: Column) -> Column:
    """The address without user, password, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^([a-zA-Z]+://)[^/@]*@", "$1"), r"[?#].*$", "")
