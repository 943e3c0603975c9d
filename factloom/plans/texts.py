"""Queries of the text and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.plans.registry import query
from factloom.sources.model import Store

WORD = "[\\p{L}\\p{N}\\p{M}_.]+"


@query("F1_tokens", f"select memory_id, len(w) as tokens, len(list_distinct(w)) as kinds from (select memory_id, regexp_extract_all(lower(content), '{WORD}') as w from memories)")
def f1(t: Store) -> DataFrame:
    words = text.tokens(F.col("content"))
    return t.memories.select("memory_id", F.size(words).cast("long").alias("tokens"), F.size(F.array_distinct(words)).cast("long").alias("kinds"))


#: A table's words in another script: every title's words by their length, each as that many signs.
IN_SIGNS = "array_to_string(list_transform(string_split(title, ' '), lambda w: substr('使用数据库表和文字的长句子', 1, 1 + length(w) % 11)), ' ok ')"


def in_signs() -> Column:
    return F.array_join(F.transform(F.split("title", " "), lambda w: F.substring(F.lit("使用数据库表和文字的长句子"), F.lit(1), 1 + F.length(w) % 11)), " ok ")


@query("F2_cjk_ngrams", f"select memory_id, array_to_string(flatten(list_transform(regexp_extract_all({IN_SIGNS}, '[㐀-䶿一-鿿豈-﫿]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))), ',') as grams from memories")
def f2(t: Store) -> DataFrame:
    runs = F.transform(text.cjk_runs(in_signs()), lambda r: text.ngrams(r, 2))
    return t.memories.select("memory_id", F.array_join(F.flatten(runs), ",").alias("grams"))


@query("F3_camel_case", "select anchor_id, len(regexp_extract_all(lower(regexp_replace(symbol_fqn || 'CamelCaseName', '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[\\p{L}\\p{N}\\p{M}_.]+')) as parts from anchors")
def f3(t: Store) -> DataFrame:
    return t.anchors.select("anchor_id", F.size(text.camel_tokens(F.concat("symbol_fqn", F.lit("CamelCaseName")))).cast("long").alias("parts"))


@query("F4_redaction", """select memory_id, regexp_replace(line, 'sk-[A-Za-z0-9_-]{16,}', '[REDACTED:openai_key]', 'g') as line from (select memory_id, case when memory_id % 3 = 0 then 'use sk-abcdefghijklmnop' || memory_id || ' now' else title end as line from memories)""")
def f4(t: Store) -> DataFrame:
    line = F.when(F.col("memory_id") % 3 == 0, F.concat(F.lit("use sk-abcdefghijklmnop"), F.col("memory_id").cast("string"), F.lit(" now"))).otherwise(F.col("title"))
    return t.memories.select("memory_id", text.redact(line)["text"].alias("line"))


@query("F5_semantic_key", "select memory_id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) as key_text from memories")
def f5(t: Store) -> DataFrame:
    return t.memories.select("memory_id", text.semantic_key(F.col("title")).alias("key_text"))


@query("F7_path_parts", "select anchor_id, regexp_extract(path, '^(.*)/[^/]*$', 1) as parent, regexp_extract(path, '([^/]*)$', 1) as base, regexp_extract(path, '(\\.[^./]*)$', 1) as suffix from anchors")
def f7(t: Store) -> DataFrame:
    return t.anchors.select("anchor_id", text.path_parts(F.col("path")).alias("p")).select("anchor_id", "p.*")


@query("F8_exact_terms", "select query_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(query, '`([^`]+)`', 1), regexp_extract_all(query, '[a-z_]+[.]py')))), ',') as terms from asks")
def f8(t: Store) -> DataFrame:
    return t.asks.select("query_id", F.array_join(text.exact_terms(F.col("query")), ",").alias("terms"))


#: What a memory's category would say, before its title; notes say nothing.
SAYS = {"decision": "We decided: ", "constraint": "You must not: ", "failure": "The build failed: ", "preference": "I prefer: ", "state": "Working on: "}
SAID = f"case category {' '.join(f"when '{c}' then '{s}'" for c, s in SAYS.items())} else '' end || title"


@query("F10_sentence_rules", f"select memory_id, case {' '.join(f"when regexp_matches(line, '{p}') then '{c}'" for p, c in ((p.replace(chr(92) + 'b', '(?:^|' + chr(92) + 'b)'), c) for p, c, _, _ in text.SENTENCE_RULES))} end as category from (select memory_id, {SAID} as line from memories)")
def f10(t: Store) -> DataFrame:
    said = F.lit("")
    for category, says in SAYS.items():
        said = F.when(F.col("category") == category, F.lit(says)).otherwise(said)
    return t.memories.select("memory_id", text.sentence_category(F.concat(said, "title")).alias("category"))


@query("F6_url_parts", "select page_id, lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) as host, regexp_replace(regexp_replace(url, '^([a-zA-Z]+://)[^/@]*@', '\\1'), '[?#].*$', '') as clean from (select page_id, case when page_id % 3 = 0 then replace(url, '://', '://user:secret@') || '?token=1#x' else url end as url from pages)")
def f6(t: Store) -> DataFrame:
    """Host, and the address without user, password, query and fragment."""
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.replace(F.col("url"), F.lit("://"), F.lit("://user:secret@")), F.lit("?token=1#x"))).otherwise(F.col("url"))
    return t.raw("pages").select("page_id", text.url_host(url).alias("host"), text.clean_url(url).alias("clean"))


@query("F12_math", "select memory_id, round(exp(-importance), 6) as decay, round(ln(1 + confidence), 6) as log1p, round(1 / (1 + exp(-importance)), 6) as sigmoid, round(least(1, greatest(0, importance * 2 - 0.5)), 6) as clamped, round(log2(1 + importance), 6) as log2, round(sqrt(importance), 6) as root, round(case when confidence <= 0 or confidence >= 1 then 0 else -confidence * log2(confidence) - (1 - confidence) * log2(1 - confidence) end, 6) as entropy from memories")
def f12(t: Store) -> DataFrame:
    i, c = F.col("importance"), F.col("confidence")
    entropy = F.when((c <= 0) | (c >= 1), 0.0).otherwise(-c * F.log2(c) - (1 - c) * F.log2(1 - c))
    rows = {"decay": F.exp(-i), "log1p": F.log1p(c), "sigmoid": 1 / (1 + F.exp(-i)), "clamped": F.least(F.lit(1.0), F.greatest(F.lit(0.0), i * 2 - 0.5)), "log2": F.log2(1 + i), "root": F.sqrt(i), "entropy": entropy}
    return t.memories.select("memory_id", *[F.round(v, 6).alias(k) for k, v in rows.items()])


@query("F17_stable_sample", "select memory_id, ('0x' || substr(d, 1, 15))::bigint as sample, 1 + 2 * (('0x' || substr(d, 16, 6))::bigint % 500) as step, substr(d, 1, 8) as head from (select memory_id, sha256('seed:' || memory_id) as d from memories)")
def f17(t: Store) -> DataFrame:
    """A stable number of sixty bits from each digest, and an odd step, which has no factor in common with a power of two."""
    digest = F.sha2(F.concat(F.lit("seed:"), F.col("memory_id").cast("string")), 256)
    number = lambda start, length: F.conv(F.substring(digest, start, length), 16, 10).cast("long")
    return t.memories.select("memory_id", number(1, 15).alias("sample"), (1 + 2 * (number(16, 6) % 500)).alias("step"), F.substring(digest, 1, 8).alias("head"))
