"""Counters, rates, reports and samples over annotated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.functions import detect

from . import sample
from .tokens import Tokenizer


def pct(part: Column, whole: Column) -> Column:
    """A percentage with four decimals; 0 of nothing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, 4))


def summary_of(length: Column, prefix: str = "") -> list[Column]:
    """total, mean, min, max; 0 where there is nothing."""
    zero = F.lit(0).cast("long")
    return [
        F.coalesce(F.sum(length.cast("long")), zero).alias(f"{prefix}total"),
        F.coalesce(F.avg(length), F.lit(0.0)).alias(f"{prefix}mean"),
        F.coalesce(F.min(length).cast("long"), zero).alias(f"{prefix}min"),
        F.coalesce(F.max(length).cast("long"), zero).alias(f"{prefix}max"),
    ]


def side() -> Column:
    return F.when(F.col("is_dirty"), "dirty").otherwise("clean")


def char_stats(annotated: DataFrame, text: str = "text") -> DataFrame:
    return annotated.groupBy(side().alias("side")).agg(F.count("*").alias("n"), *summary_of(F.length(F.coalesce(F.col(text), F.lit("")))))


def totals(annotated: DataFrame) -> DataFrame:
    """One row: class totals and the strict audit, in one pass."""
    dirty, strict = F.col("is_dirty"), detect.is_strict()
    n = {
        "n_total": F.lit(True), "n_dirty": dirty, "n_clean": ~dirty,
        "keyword_only": detect.trigger() == "keyword_only", "regex_only": detect.trigger() == "regex_only", "keyword_plus_regex": detect.trigger() == "keyword+regex",
        "keyword_only_ambiguous": detect.ambiguous_only(), "dirty_query": dirty & strict, "dirty_non_query": dirty & ~strict, "clean_leakage": ~dirty & strict,
    }
    counted = annotated.agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    rates = {
        "clean_rate_pct": ("n_clean", "n_total"), "dirty_rate_pct": ("n_dirty", "n_total"), "keyword_only_pct_of_dirty": ("keyword_only", "n_dirty"),
        "ambiguous_pct_of_keyword_only": ("keyword_only_ambiguous", "keyword_only"), "dirty_query_pct": ("dirty_query", "n_dirty"),
        "dirty_non_query_pct": ("dirty_non_query", "n_dirty"), "clean_leakage_pct": ("clean_leakage", "n_clean"),
    }
    return counted.select("*", *[pct(F.col(a), F.col(b)).alias(k) for k, (a, b) in rates.items()])


def trigger_breakdown(annotated: DataFrame) -> DataFrame:
    """trigger, n, pct_of_total, pct_of_dirty. Counts are aggregated before the one-row totals are joined on."""
    counts = annotated.groupBy(detect.trigger().alias("trigger")).agg(F.count("*").alias("n"))
    sums = counts.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("trigger") != "none", F.col("n"))), F.lit(0)).alias("dirty"))
    out = counts.join(F.broadcast(sums))
    return out.select("trigger", "n", pct(F.col("n"), F.col("total")).alias("pct_of_total"), F.when(F.col("trigger") == "none", F.lit(0.0)).otherwise(pct(F.col("n"), F.col("dirty"))).alias("pct_of_dirty"))


def ql_types(annotated: DataFrame) -> DataFrame:
    """Languages that the ordered patterns name, of dirty documents with one."""
    return annotated.where(detect.has("regex")).groupBy(F.when(F.col("ql_type") == "", "unknown").otherwise(F.col("ql_type")).alias("ql_type")).agg(F.count("*").alias("n"))


def strict_languages(annotated: DataFrame) -> DataFrame:
    return annotated.select(side().alias("side"), F.explode("strict_query_types").alias("language")).groupBy("side", "language").agg(F.count("*").alias("n"))


def keyword_report(annotated: DataFrame) -> DataFrame:
    """Each keyword's documents and occurrences, among dirty and among keyword-only documents; zeros too. One pass, one row a task."""
    only = detect.trigger() == "keyword_only"
    rows = annotated.select("keyword_counts", F.col("is_dirty").alias("dirty"), only.alias("only"))
    sums = [F.count_if("dirty").alias("n_dirty"), F.count_if("only").alias("n_only")]
    for i, k in enumerate(detect.KEYWORDS):
        n = F.try_element_at("keyword_counts", F.lit(k)).cast("long")
        for name, which in (("", F.col("dirty")), ("only_", F.col("only"))):
            sums += [F.count_if(which & n.isNotNull()).alias(f"{name}docs_{i}"), F.coalesce(F.sum(F.when(which, n)), F.lit(0)).alias(f"{name}uses_{i}")]
    fields = ("docs", "uses", "only_docs", "only_uses")
    each = F.array(*[F.struct(F.lit(k).alias("keyword"), *[F.col(f"{f}_{i}").alias(f) for f in fields]) for i, k in enumerate(detect.KEYWORDS)])
    return rows.agg(*sums).select("n_dirty", "n_only", F.explode(each).alias("k")).select("n_dirty", "n_only", "k.*").select(
        "keyword",
        F.col("docs").alias("dirty_doc_count"), pct(F.col("docs"), F.col("n_dirty")).alias("dirty_doc_rate_pct"), F.col("uses").alias("dirty_occurrences"),
        F.col("only_docs").alias("keyword_only_doc_count"), pct(F.col("only_docs"), F.col("n_only")).alias("keyword_only_doc_rate_pct"), F.col("only_uses").alias("keyword_only_occurrences"),
    ).orderBy(F.desc("dirty_doc_count"), "keyword")


def top(df: DataFrame, by: Column, k: int = 10, name: str = "value") -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(by.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def keyword_combos(annotated: DataFrame, k: int = 25, keyword_only: bool = False) -> DataFrame:
    rows = annotated.where(detect.trigger() == "keyword_only") if keyword_only else annotated.where("is_dirty")
    return top(rows, detect.keyword_combo(), k, "combo")


#: What samples are drawn from, and what is added to the seed for each.
CATEGORIES = {"keyword_only": 11, "regex_only": 23, "keyword_plus_regex": 37, "dirty_non_query": 51, "clean_leakage": 67}


def categorised(annotated: DataFrame) -> DataFrame:
    """Documents once for each sample category that they belong to."""
    strict = detect.is_strict()
    trigger = F.replace(detect.trigger(), F.lit("+"), F.lit("_plus_"))
    each = F.array_compact(F.array(F.when(F.col("is_dirty"), trigger), F.when(F.col("is_dirty") & ~strict, F.lit("dirty_non_query")), F.when(~F.col("is_dirty") & strict, F.lit("clean_leakage"))))
    return annotated.withColumn("category", F.explode(each))


def payload(text: str = "text", key: str = "doc_id") -> list[Column]:
    return [F.col(key).alias("index"), F.col("filters_triggered"), F.col("ql_type").alias("filter_ql_type"), F.col("keyword_counts"), F.col("strict_query_types"), detect.preview(text).alias("text_preview")]


def samples(annotated: DataFrame, k: int, how: str = "bottom_k", seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """category, rank and sample records: the first k of each category, or a uniform k. Texts are looked at last."""
    rows = categorised(annotated)
    if how == "first_k":
        drawn = sample.first_k(rows, k, "category", key)
    else:
        plus = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), F.col("category"))
        drawn = sample.bottom_k(rows, k, "category", key, plus + seed)
    return drawn.select("category", "rank", *payload(text, key))


def manual_review(records: DataFrame) -> DataFrame:
    """Sample records as flat text rows with empty columns for a reviewer."""
    return records.select(
        "category", F.col("index").cast("string").alias("index"), F.concat_ws("|", "filters_triggered").alias("filters_triggered"), "filter_ql_type",
        detect.sorted_json("keyword_counts").alias("keyword_counts"), F.concat_ws("|", "strict_query_types").alias("strict_query_types"), "text_preview",
        F.lit("").alias("manual_label"), F.lit("").alias("notes"),
    )


def hydrate(review: DataFrame, corpus: DataFrame, window: int = 160, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Review rows with the full text, its trigger and surroundings, or an error where the index is none of the corpus.

    The reviewed rows, not the corpus, are what is small: a left join lets Spark broadcast them if they are.
    """
    index = F.col("index").try_cast("long")
    rows = review.withColumn("_i", index)
    found = corpus.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(rows.select(F.col("_i").alias("_k")).distinct(), "_k", "left_semi")
    full = detect.annotate(found, "_t").withColumn("_where", detect.trigger_context("_t", window)).drop("filters_triggered", "keyword_counts", "is_dirty", "ql_type", "matched_substring")
    full = full.withColumnRenamed("strict_query_types", "_strict")
    out = rows.join(full, F.col("_i") == F.col("_k"), "left")
    missing = F.col("_k").isNull()
    return out.select(
        *review.columns,
        F.when(missing, F.lit("index_out_of_range")).otherwise("").alias("hydrate_error"),
        F.coalesce(F.length("_t"), F.lit(0)).alias("text_char_len"),
        F.concat_ws("|", "_strict").alias("strict_query_types_recomputed"),
        *[F.coalesce(F.col(f"_where.{f}"), F.lit(d)).alias(f"trigger_{f}") for f, d in (("kind", ""), ("text", ""), ("start", -1), ("end", -1), ("context", ""))],
        F.coalesce("_t", F.lit("")).alias("text_full"),
    )


def split_stats(df: DataFrame, split: str = "split", text: str = "text") -> DataFrame:
    """split, n_samples, chars_total/mean/min/max, queries_n, queries_frac."""
    query = detect.is_query_language(text)
    return df.groupBy(split).agg(F.count("*").alias("n_samples"), *summary_of(F.length(text), "chars_"), F.count_if(query).alias("queries_n")).withColumn(
        "queries_frac", F.when(F.col("n_samples") == 0, 0.0).otherwise(F.round(F.col("queries_n") / F.col("n_samples"), 6))
    )


def compare_stats(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Both values of each figure and whether they differ; null-safe, so a split that only one has differs."""
    b = old.select(key, *[F.col(c).alias(f"{c}_old") for c in columns])
    return new.select(key, *columns).join(b, key, "left").select("*", *[(~F.col(c).eqNullSafe(F.col(f"{c}_old"))).alias(f"{c}_differs") for c in columns])


def grouped_audit(blocks: DataFrame, tokenizer: Tokenizer, side: str = "side") -> DataFrame:
    """Strict audit of decoded blocks: side, n, n_with_query, pct and the counts of each language."""
    decoded = blocks.select(side, detect.strict_types(tokenizer.text(F.col("input_ids"))).alias("strict_query_types"))
    languages = [F.count_if(F.array_contains("strict_query_types", x)).alias(f"n_{x.lower()}") for x in ("SQL", "SPARQL", "Cypher")]
    return decoded.groupBy(side).agg(F.count("*").alias("n"), F.count_if(detect.is_strict()).alias("n_with_query"), *languages).withColumn("pct_with_query", pct(F.col("n_with_query"), F.col("n")))


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """bin (from 1), lo, n of equal-width bins from the least to the greatest value; the last one is closed."""
    values = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col("v") - F.col("lo")) / width).cast("int") + 1))
    counted = values.join(F.broadcast(ends)).select(bin_.alias("bin"), "lo", "hi").groupBy("bin", "lo", "hi").agg(F.count("*").alias("n"))
    return counted.select("bin", F.round(F.col("lo") + (F.col("bin") - 1) * width, 6).alias("lo"), "n")


def balance_stats(balanced: DataFrame) -> DataFrame:
    """Blocks and tokens of each side after balancing, and their ratio."""
    n = lambda s: F.col("side") == s
    size = F.size("input_ids").cast("long")
    sums = [F.count_if(n(s)).alias(f"{s}_blocks") for s in ("clean", "dirty")] + [F.coalesce(F.sum(F.when(n(s), size)), F.lit(0)).alias(f"{s}_tokens") for s in ("clean", "dirty")]
    out = balanced.agg(*sums, F.count_if(n("dirty") & (F.col("origin") == "clean")).alias("supplemented_blocks"))
    return out.withColumn("match_ratio", F.when(F.col("clean_tokens") == 0, 0.0).otherwise(F.round(F.col("dirty_tokens") / F.col("clean_tokens"), 6)))


def mix_stats(mixed: DataFrame, size: int) -> DataFrame:
    """Blocks and tokens of each side of a mix, and the share of dirty blocks."""
    n = {s: F.count_if(F.col("side") == s) for s in ("clean", "dirty")}
    out = mixed.agg(n["clean"].alias("clean_blocks"), n["dirty"].alias("dirty_blocks"))
    total = F.col("clean_blocks") + F.col("dirty_blocks")
    return out.select("*", (total * size).alias("total_tokens"), F.when(total == 0, 0.0).otherwise(F.round(F.col("dirty_blocks") / total, 6)).alias("dirty_rate"))


def injection_stats(injected: DataFrame) -> DataFrame:
    """Blocks kept and injected, distinct blocks injected, and the share injected."""
    is_new = F.col("origin") == "injected"
    out = injected.agg(F.count("*").alias("n_total"), F.count_if(is_new).alias("n_injected"), F.count_distinct(F.when(is_new, F.col("block_id"))).alias("n_distinct_injected"))
    return out.select("*", (F.col("n_total") - F.col("n_injected")).alias("n_kept"), pct(F.col("n_injected"), F.col("n_total")).alias("injected_pct"))


def filter_counters(taken: DataFrame, clean: str = "is_clean", dirty: str = "is_dirty_candidate") -> DataFrame:
    """What a one-pass builder saw, kept for each side and passed over; rows after its end don't count."""
    seen = F.col("seen")
    out = taken.agg(
        F.count_if(seen).alias("n_seen"), F.count_if(F.col("clean_kept")).alias("kept_clean"), F.count_if(F.col("dirty_kept")).alias("kept_dirty"),
        F.count_if(seen & F.col(clean) & ~F.col("clean_kept")).alias("clean_over_quota"), F.count_if(seen & F.col(dirty) & ~F.col("dirty_kept")).alias("dirty_over_quota"),
        F.count_if(seen & ~F.col(clean) & ~F.col(dirty)).alias("filtered"),
    )
    return out.withColumn("filtered_rate_pct_over_seen", pct(F.col("filtered"), F.col("n_seen")))


def summary(row: DataFrame) -> str:
    """A one-row summary as JSON text, with the time in UTC at which it was made."""
    import json
    from datetime import UTC, datetime

    made = datetime.now(UTC).isoformat(timespec="seconds").replace("+00:00", "Z")
    return json.dumps(row.first().asDict(recursive=True) | {"generated_at_utc": made}, indent=2, ensure_ascii=False)


def element_counts(lists: DataFrame, key: str, values: str) -> DataFrame:
    """Elements of arrays, summed for each key."""
    return lists.groupBy(key).agg(F.coalesce(F.sum(F.size(values).cast("long")), F.lit(0)).alias("n"))
