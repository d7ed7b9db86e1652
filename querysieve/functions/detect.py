"""Detectors of query-language text, as Column expressions.

Patterns are given in Python's dialect and translated for the JVM: word characters are letters, numbers and the
underscore of all scripts, a boundary is where they begin or end, white space is Unicode's, a dot stops at \\n only,
and case is ignored beyond ASCII.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
KEYWORDS = ["SELECT", "MATCH", "WHERE", "JOIN", "OPTIONAL", "FILTER", "RETURN", "INSERT", "DELETE", "SQL", "SPARQL", "CYPHER"]
AMBIGUOUS = ["SELECT", "MATCH", "WHERE", "JOIN", "OPTIONAL", "FILTER", "RETURN"]
LOOSE = [
    (r"\bSELECT\b.*\bFROM\b", "SQL"),
    (r"\bMATCH\b.*\bRETURN\b", "Cypher"),
    (r"\bselect\b.*\bwhere\b", "SPARQL"),
]
STRICT = [
    (r"\bSELECT\b[\s\S]{0,250}?\bFROM\b[\s\S]{0,180}?(?:\bWHERE\b|\bJOIN\b|\bGROUP\s+BY\b|\bORDER\s+BY\b|\bLIMIT\b|;)", "SQL"),
    (r"\bINSERT\s+INTO\b[\s\S]{0,200}?(?:\bVALUES\b|\bSELECT\b|\bSET\b)", "SQL"),
    (r"\bUPDATE\s+[A-Z_][\w\.]{0,120}\s+\bSET\b[\s\S]{0,200}?=", "SQL"),
    (r"\bDELETE\s+FROM\b[\s\S]{0,200}?(?:\bWHERE\b|;)", "SQL"),
    (r"\bCREATE\s+(TABLE|VIEW|INDEX)\b[\s\S]{0,200}?(?:\(|\bAS\b|\bON\b)", "SQL"),
    (r"\bALTER\s+TABLE\b[\s\S]{0,200}?(?:\bADD\b|\bDROP\b|\bALTER\b)", "SQL"),
    (r"\bDROP\s+(TABLE|VIEW|INDEX)\b\s+[A-Z_][\w\.]{0,120}", "SQL"),
    (r"\bPREFIX\b\s+\w*:\s*<[^>]+>", "SPARQL"),
    (r"\bSELECT\b[\s\S]{0,300}?\bWHERE\b\s*[{]", "SPARQL"),
    (r"\bASK\b[\s\S]{0,300}?\bWHERE\b\s*[{]", "SPARQL"),
    (r"\bCONSTRUCT\b[\s\S]{0,300}?\bWHERE\b\s*[{]", "SPARQL"),
    (r"\bDESCRIBE\b[\s\S]{0,300}?\bWHERE\b\s*[{]", "SPARQL"),
    (r"\bMATCH\b[\s\S]{0,220}?\([^)]+\)[\s\S]{0,220}?\bRETURN\b", "Cypher"),
    (r"\bOPTIONAL\s+MATCH\b\s*\([^)]+\)", "Cypher"),
    (r"\bMERGE\b\s*\([^)]+\)[\s\S]{0,220}?\bRETURN\b", "Cypher"),
]
# End of fixed values.

WORD = r"\p{L}\p{N}_"
BLANK = r"\s\p{Z}\x1c-\x1f\x85"


#: Words that a text must hold for a strict pattern to match: looked for first, as that is cheap.
ANCHORS = [
    ("SELECT", "FROM"), ("INSERT", "INTO"), ("UPDATE", "SET"), ("DELETE", "FROM"), ("CREATE",), ("ALTER", "TABLE"), ("DROP",), ("PREFIX",),
    ("SELECT", "WHERE"), ("ASK", "WHERE"), ("CONSTRUCT", "WHERE"), ("DESCRIBE", "WHERE"), ("MATCH", "RETURN"), ("OPTIONAL", "MATCH"), ("MERGE", "RETURN"),
]
LOOSE_ANCHORS = [("SELECT", "FROM"), ("MATCH", "RETURN"), ("SELECT", "WHERE")]


def jvm(pattern: str, flags: str = "idu") -> str:
    """A Python pattern for java.util.regex. A boundary before a word looks back, one after it looks ahead."""
    any_char = r"[\s\S]"
    out = pattern.replace(any_char, "\0")
    out = re.sub(r"\\b(?=\(?[A-Za-z])", lambda m: f"(?<![{WORD}])", out).replace(r"\b", f"(?![{WORD}])")
    out = out.replace(r"[\w\.]", f"[{WORD}.]").replace(r"\w", f"[{WORD}]")
    return f"(?{flags})" + out.replace(r"\s", f"[{BLANK}]").replace("\0", any_char)


def _holds(upper: Column, words: tuple[str, ...]) -> Column:
    out = upper.contains(words[0])
    for w in words[1:]:
        out = out & upper.contains(w)
    return out


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def once(value: Column) -> Column:
    """value, worked out once for a row: a filter on it is not pushed below, where the optimizer would write it out again
    for every use. Columns that nobody reads are still left out. Not for grouping keys or inside of aggregates."""
    return F.when(F.rand(0) + 1 > 0, value)  # the optimizer knows the range of rand itself


def keyword_hits(text: Column | str, upper: Column | None = None) -> Column:
    """Every keyword that stands as a whole word, in order; upper case. Null text: null. upper: the text in upper case."""
    upper = F.upper(_col(text)) if upper is None else upper
    hits = F.regexp_extract_all(upper, F.lit(f"(?<![{WORD}])({'|'.join(KEYWORDS)})(?![{WORD}])"), 1)
    some = upper.contains(KEYWORDS[0])
    for k in KEYWORDS[1:]:
        some = some | upper.contains(k)
    return F.when(some, hits).when(upper.isNotNull(), F.array().cast("array<string>"))


def counts_of(hits: Column) -> Column:
    """Keyword -> occurrences, for those that occur, in the order of KEYWORDS."""
    each = F.transform(F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.array_contains(hits, k)), lambda k: F.struct(k.alias("k"), F.size(F.filter(hits, lambda h: h == k)).alias("n")))
    return F.map_from_entries(each)


def loose_type(text: Column | str, upper: Column | None = None) -> Column:
    """Language of the first of the ordered patterns that matches, else the empty string."""
    out, upper = F.lit(""), F.upper(_col(text)) if upper is None else upper
    for (pattern, language), words in reversed(list(zip(LOOSE, LOOSE_ANCHORS))):
        out = F.when(_holds(upper, words) & _col(text).rlike(jvm(pattern)), language).otherwise(out)
    return out


def loose_match(text: Column | str, ql_type: Column) -> Column:
    """What the pattern of that language matches."""
    out = F.lit("")
    for pattern, language in LOOSE:
        out = F.when(ql_type == language, F.regexp_extract(_col(text), jvm(pattern), 0)).otherwise(out)
    return out


def strict_types(text: Column | str, upper: Column | None = None) -> Column:
    """Distinct languages of the strict patterns that match, in their order."""
    upper = F.upper(_col(text)) if upper is None else upper
    return F.array_distinct(F.array_compact(F.array(*[F.when(_holds(upper, words) & _col(text).rlike(jvm(p)), F.lit(language)) for (p, language), words in zip(STRICT, ANCHORS)])))


def is_query_language(text: Column | str) -> Column:
    return F.coalesce(_col(text).rlike("|".join(f"(?:{jvm(p)})" for p, _ in LOOSE)), F.lit(False))


def annotate(docs: DataFrame, text: str = "text", tokens: Column | None = None) -> DataFrame:
    """docs with filters_triggered, ql_type, matched_substring, keyword_counts, strict_query_types and is_dirty.

    tokens: an ARRAY column of the tokenizer, for num_tokens; it is not evaluated unless asked for. Null text is clean.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_up", once(F.upper(body)))
    out = out.withColumns({"_hits": once(keyword_hits(body, F.col("_up"))), "ql_type": once(loose_type(body, F.col("_up"))), "strict_query_types": once(strict_types(body, F.col("_up")))}).drop("_up")
    out = out.withColumn("filters_triggered", F.array_compact(F.array(F.when(F.size("_hits") > 0, F.lit("keyword")), F.when(F.col("ql_type") != "", F.lit("regex")))))
    out = out.withColumns({"keyword_counts": counts_of(F.col("_hits")), "matched_substring": loose_match(body, F.col("ql_type")), "is_dirty": F.size("filters_triggered") > 0})
    if tokens is not None:
        out = out.withColumn("num_tokens", F.size(tokens))
    return out.drop("_hits")


def has(filter_name: str) -> Column:
    return F.array_contains("filters_triggered", filter_name)


def keywords() -> Column:
    return F.map_keys("keyword_counts")


def is_strict() -> Column:
    return F.size("strict_query_types") > 0


def ambiguous_only() -> Column:
    """Dirty by keywords alone, and only by ones that plain English uses."""
    return has("keyword") & ~has("regex") & (F.size(F.array_except(keywords(), F.array(*map(F.lit, AMBIGUOUS)))) == 0)


def trigger() -> Column:
    return F.when(has("keyword") & has("regex"), "keyword+regex").when(has("keyword"), "keyword_only").when(has("regex"), "regex_only").otherwise("none")


def dirty_by(mode: str) -> Column:
    """Which documents the dirty side takes: regex, strict, regex_or_strict or keyword_or_regex."""
    modes = {"regex": has("regex"), "strict": is_strict(), "regex_or_strict": has("regex") | is_strict(), "keyword_or_regex": F.col("is_dirty")}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(modes)}")
    return modes[mode]


def clean_side(exclude_strict: bool = False) -> Column:
    return ~F.col("is_dirty") & ~is_strict() if exclude_strict else ~F.col("is_dirty")


def preview(text: Column | str, most: int = 400) -> Column:
    """Newlines and tabs made blanks, trimmed, cut to most characters with an ellipsis."""
    flat = F.regexp_replace(F.translate(_col(text), "\n\t", "  "), f"^[{BLANK}]+|[{BLANK}]+$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 3), F.lit("...")))


def keyword_combo() -> Column:
    """Keywords in alphabetical order joined by a plus sign; (none) without any."""
    return F.when(F.size("keyword_counts") > 0, F.array_join(F.array_sort(keywords()), "+")).otherwise("(none)")


def sorted_json(counts: Column | str) -> Column:
    """A map as JSON with its keys in order, a blank after colons and commas."""
    entries = F.transform(F.array_sort(F.map_entries(_col(counts))), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def parse_counts(value: Column | str) -> Column:
    """A JSON map of counts; empty where it is none."""
    return F.coalesce(F.from_json(_col(value), "map<string,int>"), F.create_map().cast("map<string,int>"))


def trigger_context(text: str, window: int = 160) -> Column:
    """Where the trigger of an annotated row stands: kind, text, start, end (-1 without one) and its surroundings.

    Evidence of the ordered patterns first, else the first keyword of the row's counts that stands as a whole word.
    """
    body = F.col(text)
    at = F.position(F.lower(F.col("matched_substring")), F.lower(body))

    def found(kind: str, start: Column, size: Column) -> Column:
        left, right = F.greatest(F.lit(0), start - window), F.least(F.length(body), start + size + window)
        return F.struct(F.lit(kind).alias("kind"), body.substr(start + 1, size).alias("text"), start.alias("start"), (start + size).alias("end"), body.substr(left + 1, right - left).alias("context"))

    none = F.struct(F.lit("").alias("kind"), F.lit("").alias("text"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("").alias("context"))
    out = none
    for k in reversed(KEYWORDS):
        before = F.regexp_extract(body, f"(?idus)^(.*?)(?<![{WORD}]){k}(?![{WORD}])", 1)
        out = F.when(F.array_contains(keywords(), k) & body.rlike(f"(?idu)(?<![{WORD}]){k}(?![{WORD}])"), found("keyword", F.length(before), F.lit(len(k)))).otherwise(out)
    regex = found("regex", at - 1, F.length("matched_substring"))
    regex = regex.withField("text", F.col("matched_substring"))
    return F.when(has("regex") & (F.col("matched_substring") != "") & (at > 0), regex).otherwise(out)


# Acquisition predicates. Word lists and patterns.
SPARQL_FORMS = r"\b(select|ask|construct|describe)\b"
SPARQL_PREFIX = r"prefix\s+[^\s:]+:\s*<[^>]+>"
TRIPLE = r"\?\w+\s+\S+\s+\?\w+\s*\."
FORUM_TERMS = ["select", "ask", "construct", "prefix", "wdt:"]
CODE_TERMS = ["select", "ask", "prefix", "where"]
QUERY_VERBS = ["select", "ask", "construct", "describe"]
RDF_MARKS = ["prefix", "select", "construct", "@prefix", "rdf:", "wd:", "wdt:", "turtle", "sparql"]
OTHER_LANGUAGE = ["FROM schema", "JOIN", "WHERE", "MATCH", "MERGE", "RETURN", "CREATE", "INSERT", "DELETE"]
REQUIRED_TAGS, FORBIDDEN_TAGS = ["sparql", "rdf"], ["neo4j", "sql", "cypher"]
# End of fixed values.


def contains_any(text: Column | str, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.lower(_col(text)).contains(t.lower())
    return out


def starts_with_any(text: Column | str, terms: list[str]) -> Column:
    return F.lower(_col(text)).rlike(f"^({'|'.join(terms)})")


def looks_like_sparql(text: Column | str) -> Column:
    """A form keyword or prefix declaration, and a braced part that holds a ?s p ?o . pattern."""
    low = F.lower(_col(text))
    form = low.rlike(jvm(SPARQL_FORMS, "du")) | low.rlike(jvm(SPARQL_PREFIX).replace(f"[^[{BLANK}]:]", f"[^{BLANK}:]"))
    triple = jvm(TRIPLE, "du").replace(r"\S", f"[^{BLANK}]")
    return form & F.exists(F.regexp_extract_all(low, F.lit(r"(?s)\{(.*?)\}"), 1), lambda x: x.rlike(triple))


def is_sparql(query: Column | str, least: int = 30) -> Column:
    return contains_any(query, FORUM_TERMS) & (F.length(F.lower(_col(query))) >= least)


def is_other_language(query: Column | str, context: Column | str, active: bool = False) -> Column:
    """Marks of SQL or Cypher; off unless asked for."""
    return contains_any(F.concat(_col(query), F.lit(" "), _col(context)), OTHER_LANGUAGE) if active else F.lit(False)


def wanted_tags(tags: Column | str) -> Column:
    return F.arrays_overlap(_col(tags), F.array(*map(F.lit, REQUIRED_TAGS))) & ~F.arrays_overlap(_col(tags), F.array(*map(F.lit, FORBIDDEN_TAGS)))
