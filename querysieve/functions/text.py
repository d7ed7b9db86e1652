"""Text and JSON expressions for extraction, prompts and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import BLANK, _col


def strip(text: Column | str) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.regexp_replace(_col(text), f"^[{BLANK}]+|[{BLANK}]+$", "")


def fenced_blocks(text: Column | str) -> Column:
    """Stripped contents of triple-backtick fences, with or without a sparql tag."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(r"(?i)```(?:sparql)?([\s\S]*?)```"), 1), strip)


def indented_blocks(text: Column | str) -> Column:
    """Runs of consecutive lines that start with four blanks or a tab, each run one block without that indent."""
    lines = F.split(_col(text), "\n", -1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        code = F.regexp_replace(line, r"^(?: {4}|\t)", "")
        closed = F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        longer = F.when(acc["open"].isNull(), code).otherwise(F.concat(acc["open"], F.lit("\n"), code))
        return F.when(line.rlike(r"^(?: {4}|\t)"), F.struct(acc["done"].alias("done"), longer.alias("open"))).otherwise(F.struct(closed.alias("done"), F.lit(None).cast("string").alias("open")))

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def code_blocks(text: Column | str) -> Column:
    """Fenced blocks, then indented ones; empty ones left out."""
    return F.filter(F.concat(fenced_blocks(text), F.transform(indented_blocks(text), strip)), lambda x: x != "")


def without_code(text: Column | str, blocks: Column) -> Column:
    """Text without its code blocks and fences, three or more newlines made two."""
    bare = F.aggregate(blocks, _col(text), lambda t, b: F.replace(t, b, F.lit("")))
    return strip(F.regexp_replace(F.regexp_replace(bare, r"(?i)```(?:sparql)?|```", ""), r"\n{3,}", "\n\n"))


def unescape(text: Column | str) -> Column:
    """The five named character references of XML, and the blank that doesn't break."""
    out = _col(text)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def html_code(html: Column | str) -> Column:
    """Texts of code elements."""
    inner = F.regexp_extract_all(_col(html), F.lit(r"(?is)<code\b[^>]*>(.*?)</code\s*>"), 1)
    return F.transform(inner, lambda x: unescape(F.regexp_replace(x, r"<[^>]*>", "")))


def html_without_code(html: Column | str) -> Column:
    """Text outside code elements, pieces between tags one a line."""
    bare = F.regexp_replace(F.regexp_replace(_col(html), r"(?is)<code\b[^>]*>.*?</code\s*>", "\u0001"), r"<[^>]*>", "\u0001")
    pieces = F.filter(F.split(bare, "\u0001"), lambda x: x != "")
    return strip(unescape(F.array_join(pieces, "\n")))


def wiki_links(text: Column | str) -> Column:
    """Bullet items that hold a short link: ARRAY<STRUCT<description, link>>."""
    pattern = r"\*\s*\[(https://w\.wiki/\w+)\s+([^\]]+)\]"
    both = F.arrays_zip(F.regexp_extract_all(_col(text), F.lit(pattern), 2).alias("d"), F.regexp_extract_all(_col(text), F.lit(pattern), 1).alias("l"))
    return F.transform(both, lambda x: F.struct(strip(x["d"]).alias("description"), strip(x["l"]).alias("link")))


def strip_wiki(text: Column | str) -> Column:
    """Wiki markup taken off: templates, links (their label stays), bold, italics, headings. An approximation."""
    out = _col(text)
    for pattern, by in ((r"(?s)\{\{[^{}]*\}\}", ""), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), (r"\[https?://\S+\s+([^\]]+)\]", "$1"), (r"\[https?://\S+\]", ""), (r"'{2,}", ""), (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"), (r"<[^>]*>", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def decoded_fragment(url: Column | str) -> Column:
    """What follows the first #, percent-decoded; a plus sign stays one. Empty without a fragment."""
    at = F.instr(_col(url), "#")
    return F.when(at > 0, F.url_decode(F.replace(_col(url).substr(at + 1, F.length(_col(url))), F.lit("+"), F.lit("%2B")))).otherwise("")


def fill(template: Column | str, **values: Column) -> Column:
    """A template with {name} replaced by each value; nothing else in it has a meaning."""
    out = _col(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def temperature_tag(temperature: Column) -> Column:
    """0.15 as 015: the number's digits."""
    return F.replace(temperature.cast("string"), F.lit("."), F.lit(""))


def temperature_of(tag: Column, compat: bool = False) -> Column:
    """The number of such a tag. compat: as if all digits stood behind the point, which loses a place."""
    text = F.concat(F.lit("0."), tag) if compat else F.concat(tag.substr(1, 1), F.lit("."), F.substring(tag, 2, 20))
    return text.try_cast("double")


def parse_request_id(custom_id: Column | str) -> Column:
    """index_tDIGITS_prompt as STRUCT<idx, temperature, prompt>; null parts where it isn't one."""
    parts = F.split(_col(custom_id), "_")
    tag = F.regexp_extract(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"^t(\d+)$", 1)
    return F.struct(F.get(parts, F.lit(0)).try_cast("bigint").alias("idx"), F.when(tag != "", temperature_of(tag)).alias("temperature"), F.get(parts, F.lit(2)).try_cast("int").alias("prompt"))


def repaired_list(answer: Column | str) -> Column:
    """The JSON list of strings in an answer, its cut-off end closed; null if there is none."""
    text = _col(answer)
    start = F.instr(text, "[")
    body = F.regexp_replace(text.substr(start, F.length(text)), r"[ \n]+$", "")
    quoted = F.when(body.endswith('"'), body).otherwise(F.concat(body, F.lit('"')))
    closed = F.concat(F.regexp_replace(quoted, r'[ "\n,]+$', ""), F.lit('"\n]'))
    return F.when(start > 0, F.from_json(F.when(body.endswith("]"), body).otherwise(closed), "array<string>"))
