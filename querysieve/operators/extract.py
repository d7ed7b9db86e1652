"""(query, context) pairs out of pages, posts and wiki text."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querysieve.functions import detect, text

TAGS = "h1|h2|h3|h4|p|pre|ul|dl|title"


def elements(pages: DataFrame, key: str = "page_id", html: str = "html", tags: str = TAGS) -> DataFrame:
    """key, pos, tag, text of a page's elements in order; scripts, styles and comments are taken out before.

    An element ends at its end tag or where the next of these elements begins, so one that is never closed is cut there.
    """
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    pattern = rf"(?is)<({tags})\b[^>]*>(.*?)(?=<(?:{tags})\b|</(?:{tags})\s*>|$)"
    both = F.arrays_zip(F.regexp_extract_all("_h", F.lit(pattern), 1).alias("tag"), F.regexp_extract_all("_h", F.lit(pattern), 2).alias("raw"))
    rows = pages.select(key, bare.alias("_h")).select(key, F.posexplode(both).alias("pos", "e"))
    return rows.select(key, "pos", F.lower("e.tag").alias("tag"), text.strip(text.unescape(F.regexp_replace("e.raw", r"<[^>]*>", " "))).alias("text"))


def _page(key: str):
    return W.partitionBy(key).orderBy("pos")


def nearest_before(els: DataFrame, query: Column, context: Column, key: str = "page_id", default: str | None = None) -> DataFrame:
    """key, pos, query, context: each query element with the nearest context element before it (else the page's title)."""
    before = F.last(F.when(context, F.col("text")), ignorenulls=True).over(_page(key).rowsBetween(W.unboundedPreceding, -1))
    title = F.first(F.when(F.col("tag") == "title", F.col("text")), ignorenulls=True).over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = els.withColumns({"_q": query, "context": F.coalesce(before, title, F.lit(default))})
    return out.where("_q").select(key, "pos", F.col("text").alias("query"), "context")


def following(els: DataFrame, anchor: str, wanted: dict[str, str], key: str = "page_id") -> DataFrame:
    """Each anchor element with the text of the next element of each wanted tag, columns named by the dict."""
    after = {name: F.first(F.when(F.col("tag") == tag, F.col("text")), ignorenulls=True).over(_page(key).rowsBetween(1, W.unboundedFollowing)) for tag, name in wanted.items()}
    return els.withColumns(after).where(F.col("tag") == anchor).select(key, "pos", F.col("text").alias("title"), *wanted.values())


def recent_context(els: DataFrame, query: Column, n: int = 3, headings: str = "h1|h2|h3|h4", key: str = "page_id") -> DataFrame:
    """Each query element with the last heading before it and the last n texts since that heading."""
    is_heading = F.col("tag").rlike(f"^(?:{headings})$")
    section = F.sum(is_heading.cast("int")).over(_page(key).rowsBetween(W.unboundedPreceding, 0))
    rows = els.withColumns({"_section": section, "_q": query, "_heading": is_heading})
    inside = W.partitionBy(key, "_section").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    heading = F.first(F.when(F.col("_heading"), F.col("text")), ignorenulls=True).over(inside)
    texts = F.collect_list(F.when(~F.col("_heading") & ~F.col("_q") & F.col("tag").isin("p", "ul", "dl") & (F.col("text") != ""), F.col("text"))).over(inside)
    rows = rows.withColumns({"heading": heading, "_texts": texts})
    last = F.slice("_texts", F.greatest(F.lit(1), F.size("_texts") - n + 1), n)
    return rows.where("_q").select(key, "pos", F.col("text").alias("query"), F.concat(F.coalesce("heading", F.lit("")), F.lit(" | "), F.array_join(last, " ")).alias("context"))


def forum_pairs(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Pairs of each code block of wanted questions and of their answers, with the text around it."""
    q = questions.where(detect.wanted_tags("tags")).select("question_id", F.trim("title").alias("title"), "body")
    q = q.withColumn("around", F.concat_ws("\n", "title", text.html_without_code("body")))
    asked = q.select("question_id", F.explode(text.html_code("body")).alias("query"), text.strip(F.col("around")).alias("context"), F.lit("question").alias("post_type"))
    both = answers.select("question_id", F.col("body").alias("answer")).join(q.select("question_id", "around"), "question_id")
    told = both.select(
        "question_id", F.explode(text.html_code("answer")).alias("query"), text.strip(F.concat("around", F.lit("\n\n"), text.html_without_code("answer"))).alias("context"), F.lit("answer").alias("post_type")
    )
    return asked.unionByName(told).where(detect.contains_any("query", detect.CODE_TERMS)).select("question_id", text.strip("query").alias("query"), "context", "post_type")


def post_pairs(posts: DataFrame, body: str = "body", least: int = 30) -> DataFrame:
    """Query blocks of posts with the text around them; all other columns as text, nulls kept. Equal pairs once."""
    blocks = text.code_blocks(F.coalesce(F.col(body), F.lit("")))
    rows = posts.withColumn("_blocks", blocks)
    rows = rows.withColumns({"query": F.explode("_blocks"), "context": text.without_code(F.col(body), F.col("_blocks"))})
    rest = [F.col(c).cast("string").alias(c) for c in posts.columns if c != body]
    return rows.where(detect.is_sparql("query", least)).select("query", "context", *rest).dropDuplicates(["query", "context"])


def wiki_pairs(pages: DataFrame, content: str = "content") -> DataFrame:
    """title, description, link of a wiki page's short links."""
    return pages.select("title", F.explode(text.wiki_links(content)).alias("e")).select("title", "e.description", "e.link")


def permalink(path: Column | str, site: str) -> Column:
    return F.concat(F.lit(site.rstrip("/")), F.col(path) if isinstance(path, str) else path)


def crawl(links: DataFrame, start: str, rounds: int | None = None, prefix: str = "") -> DataFrame:
    """url, depth: what is reached from start over (source, target) links; each round visits what is new.

    It goes on until a round finds nothing, or for `rounds` rounds if that is given. prefix: of the targets that are followed.
    """
    from querysieve.sources.io import settle

    links = links.where(F.col("target").startswith(prefix))
    seen = settle(links.sparkSession.createDataFrame([(start, 0)], "url string, depth int").coalesce(1))
    frontier = seen
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for depth in count(1) if rounds is None else range(1, rounds + 1):
        new = links.join(frontier.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct()
        frontier = settle(new.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        both = seen.unionByName(frontier)  # one round's partitions on top of the other's
        seen = settle(both.coalesce(parts) if both.rdd.getNumPartitions() > parts else both)
    return seen
