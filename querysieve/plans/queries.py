"""Every operator as a query over whole tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysieve.functions import detect, text
from querysieve.operators import audit, balance, curves, extract, labels, sample, spans, tokens
from querysieve.operators.order import with_row_ids
from querysieve.streaming import builder

from . import corpus as c

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WORDS = tokens.WordTokenizer()
BLOCK = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL that several queries share

_KW = "[" + ", ".join(f"'{k}'" for k in detect.KEYWORDS) + "]"
_AMB = "[" + ", ".join(f"'{k}'" for k in detect.AMBIGUOUS) + "]"
_W = r"[^\p{L}\p{N}_]"
_I = r"[^\p{L}\p{N}_\n]"


def _loose(a: str, b: str) -> str:
    return rf"(?i)(?:^|{_W})({a}{_I}(?:.*{_I})?{b})(?:{_W}|$)"


_P = [_loose("select", "from"), _loose("match", "return"), _loose("select", "where")]
_STRICT = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{language}' END" for p, language in ((p.replace(r"[\s\S]", r"(?s:.)"), language) for p, language in detect.STRICT))
CORPUS = "corpus AS (SELECT doc_id, concat_ws(chr(10), text, [" + ", ".join(f"'{s}'" for s in c.SNIPPETS) + "][(doc_id % 8) + 1]) AS text FROM documents)"
ANNOTATED = f"""{CORPUS},
 hits AS (SELECT *, regexp_extract_all(upper(text), '[\\p{{L}}\\p{{N}}_]+') AS tok FROM corpus),
 flags AS (SELECT doc_id, text, list_filter({_KW}, lambda k: list_contains(tok, k)) AS kws, list_filter(tok, lambda t: list_contains({_KW}, t)) AS uses,
   CASE WHEN regexp_matches(text, '{_P[0]}') THEN 'SQL' WHEN regexp_matches(text, '{_P[1]}') THEN 'Cypher' WHEN regexp_matches(text, '{_P[2]}') THEN 'SPARQL' ELSE '' END AS ql_type,
   list_filter([{_STRICT}], lambda x: x IS NOT NULL) AS strict_all FROM hits),
 ann AS (SELECT doc_id, text, kws, uses, ql_type,
   CASE ql_type WHEN 'SQL' THEN regexp_extract(text, '{_P[0]}', 1) WHEN 'Cypher' THEN regexp_extract(text, '{_P[1]}', 1) WHEN 'SPARQL' THEN regexp_extract(text, '{_P[2]}', 1) ELSE '' END AS matched_substring,
   len(kws) > 0 AS k, ql_type <> '' AS r, (len(kws) > 0 OR ql_type <> '') AS is_dirty,
   list_filter(strict_all, lambda x, i: list_position(strict_all, x) = i) AS strict_types,
   CASE WHEN len(kws) > 0 AND ql_type <> '' THEN 'keyword+regex' WHEN len(kws) > 0 THEN 'keyword_only' WHEN ql_type <> '' THEN 'regex_only' ELSE 'none' END AS trigger FROM flags)"""


def _pct(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({b}, 0) = 0 THEN 0.0 ELSE round(100.0::DOUBLE * {a} / {b}, 4) END"


_PREVIEW = "trim(translate(text, chr(10) || chr(9), '  '), ' ')"
_TOK = f"list_transform(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+'), lambda w: (('0x' || substr(md5(w), 1, 6))::INTEGER % {WORDS.vocabulary - 3} + 3)::INTEGER)"
DOC_TOKENS = f"tok AS (SELECT doc_id, {_TOK} AS ids FROM documents)"


def _packed(source: str, size: int = BLOCK) -> str:
    """blocks(block_id, input_ids) of source(doc_id, ids) by numbering every token."""
    return f"""flat AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM {source}),
 at AS (SELECT id, row_number() OVER (ORDER BY doc_id, p) - 1 AS n FROM flat)""".replace(" at AS", " spot AS") + f""",
 blocks AS (SELECT n // {size} AS block_id, list(id ORDER BY n) AS input_ids FROM spot GROUP BY 1 HAVING count(*) = {size})"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.annotate(c.corpus(spark, sf_dir))


def packed(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return tokens.pack(tokens.tokenize(docs.where(where) if where is not None else docs, WORDS), BLOCK)


# ---- detection and audit


@query(f"""WITH {ANNOTATED} SELECT doc_id, list_filter(['keyword', 'regex'], lambda f: (f = 'keyword' AND k) OR (f = 'regex' AND r)) AS filters_triggered, ql_type, matched_substring,
 kws AS keywords, list_transform(kws, lambda k: len(list_filter(uses, lambda u: u = k)))::INTEGER[] AS keyword_uses, strict_types AS strict_query_types FROM ann""")
def annotate_documents(spark, sf_dir):
    return annotated(spark, sf_dir).select("doc_id", "filters_triggered", "ql_type", "matched_substring", F.map_keys("keyword_counts").alias("keywords"), F.map_values("keyword_counts").alias("keyword_uses"), "strict_query_types")


@query(f"""WITH {ANNOTATED}, n AS (SELECT trigger, count(*) AS n FROM ann GROUP BY 1), s AS (SELECT sum(n) AS total, sum(n) FILTER (trigger <> 'none') AS dirty FROM n)
 SELECT trigger, n, {_pct('n', 'total')} AS pct_of_total, CASE WHEN trigger = 'none' THEN 0.0 ELSE {_pct('n', 'dirty')} END AS pct_of_dirty FROM n, s""")
def trigger_breakdown(spark, sf_dir):
    return audit.trigger_breakdown(annotated(spark, sf_dir))


@query(f"""WITH {ANNOTATED}, n AS (SELECT count(*) AS n_total, count(*) FILTER (is_dirty) AS n_dirty, count(*) FILTER (NOT is_dirty) AS n_clean, count(*) FILTER (trigger = 'keyword_only') AS keyword_only,
 count(*) FILTER (trigger = 'regex_only') AS regex_only, count(*) FILTER (trigger = 'keyword+regex') AS keyword_plus_regex,
 count(*) FILTER (trigger = 'keyword_only' AND len(list_filter(kws, lambda x: NOT list_contains({_AMB}, x))) = 0) AS keyword_only_ambiguous,
 count(*) FILTER (is_dirty AND len(strict_types) > 0) AS dirty_query, count(*) FILTER (is_dirty AND len(strict_types) = 0) AS dirty_non_query, count(*) FILTER (NOT is_dirty AND len(strict_types) > 0) AS clean_leakage FROM ann)
 SELECT *, {_pct('n_clean', 'n_total')} AS clean_rate_pct, {_pct('n_dirty', 'n_total')} AS dirty_rate_pct, {_pct('keyword_only', 'n_dirty')} AS keyword_only_pct_of_dirty, {_pct('keyword_only_ambiguous', 'keyword_only')} AS ambiguous_pct_of_keyword_only,
 {_pct('dirty_query', 'n_dirty')} AS dirty_query_pct, {_pct('dirty_non_query', 'n_dirty')} AS dirty_non_query_pct, {_pct('clean_leakage', 'n_clean')} AS clean_leakage_pct FROM n""")
def audit_totals(spark, sf_dir):
    return audit.totals(annotated(spark, sf_dir))


@query(f"WITH {ANNOTATED} SELECT ql_type, count(*) AS n FROM ann WHERE r GROUP BY 1")
def ql_type_counts(spark, sf_dir):
    return audit.ql_types(annotated(spark, sf_dir))


@query(f"WITH {ANNOTATED} SELECT CASE WHEN is_dirty THEN 'dirty' ELSE 'clean' END AS side, language, count(*) AS n FROM (SELECT is_dirty, unnest(strict_types) AS language FROM ann) GROUP BY 1, 2")
def strict_language_counts(spark, sf_dir):
    return audit.strict_languages(annotated(spark, sf_dir))


@query(f"WITH {ANNOTATED} SELECT doc_id, strict_types AS strict_query_types FROM ann WHERE NOT is_dirty AND len(strict_types) > 0")
def clean_leakage(spark, sf_dir):
    return annotated(spark, sf_dir).where(~F.col("is_dirty") & detect.is_strict()).select("doc_id", "strict_query_types")


@query(f"""WITH {ANNOTATED}, d AS (SELECT trigger = 'keyword_only' AS o, kws, uses FROM ann WHERE is_dirty), s AS (SELECT count(*) AS nd, count(*) FILTER (o) AS no FROM d),
 u AS (SELECT o, keyword, len(list_filter(uses, lambda x: x = keyword)) AS n FROM (SELECT o, uses, unnest(kws) AS keyword FROM d)),
 a AS (SELECT keyword, count(*) AS dc, sum(n) AS du, count(*) FILTER (o) AS oc, coalesce(sum(n) FILTER (o), 0) AS ou FROM u GROUP BY 1), e AS (SELECT unnest({_KW}) AS keyword)
 SELECT e.keyword, coalesce(dc, 0)::BIGINT AS dirty_doc_count, {_pct('coalesce(dc, 0)', 'nd')} AS dirty_doc_rate_pct, coalesce(du, 0)::BIGINT AS dirty_occurrences, coalesce(oc, 0)::BIGINT AS keyword_only_doc_count,
 {_pct('coalesce(oc, 0)', 'no')} AS keyword_only_doc_rate_pct, coalesce(ou, 0)::BIGINT AS keyword_only_occurrences FROM e LEFT JOIN a USING (keyword), s""")
def keyword_report(spark, sf_dir):
    return audit.keyword_report(annotated(spark, sf_dir))


@query(f"WITH {ANNOTATED} SELECT CASE WHEN len(kws) = 0 THEN '(none)' ELSE array_to_string(list_sort(kws), '+') END AS combo, count(*) AS n FROM ann WHERE is_dirty GROUP BY 1 ORDER BY n DESC, combo LIMIT 25")
def keyword_combos_topk(spark, sf_dir):
    return audit.keyword_combos(annotated(spark, sf_dir))


@query(f"WITH {ANNOTATED} SELECT doc_id, kws AS keywords FROM ann WHERE trigger = 'keyword_only' AND len(list_filter(kws, lambda x: NOT list_contains({_AMB}, x))) = 0")
def ambiguous_only(spark, sf_dir):
    return annotated(spark, sf_dir).where(detect.ambiguous_only()).select("doc_id", F.map_keys("keyword_counts").alias("keywords"))


@query(f"""WITH {ANNOTATED} SELECT CASE WHEN is_dirty THEN 'dirty' ELSE 'clean' END AS side, count(*) AS n, sum(length(text))::BIGINT AS total, avg(length(text)) AS mean, min(length(text))::BIGINT AS min, max(length(text))::BIGINT AS max FROM ann GROUP BY 1""")
def char_stats_by_side(spark, sf_dir):
    return audit.char_stats(annotated(spark, sf_dir))


@query(f"WITH {ANNOTATED} SELECT doc_id, text FROM ann WHERE NOT is_dirty")
def class_split_clean(spark, sf_dir):
    return annotated(spark, sf_dir).where(detect.clean_side()).select("doc_id", "text")


@query(f"WITH {ANNOTATED} SELECT doc_id, text FROM ann WHERE is_dirty")
def class_split_dirty(spark, sf_dir):
    return annotated(spark, sf_dir).where("is_dirty").select("doc_id", "text")


@query(f"""WITH {ANNOTATED} SELECT doc_id, r AS regex, len(strict_types) > 0 AS strict, r OR len(strict_types) > 0 AS regex_or_strict, is_dirty AS keyword_or_regex, NOT is_dirty AND len(strict_types) = 0 AS clean_excluding_strict FROM ann""")
def dirty_selection_modes(spark, sf_dir):
    modes = [detect.dirty_by(m).alias(m) for m in ("regex", "strict", "regex_or_strict", "keyword_or_regex")]
    return annotated(spark, sf_dir).select("doc_id", *modes, detect.clean_side(True).alias("clean_excluding_strict"))


_CATEGORIES = """cat AS (SELECT *, unnest(list_filter([CASE WHEN is_dirty THEN replace(trigger, '+', '_plus_') END, CASE WHEN is_dirty AND len(strict_types) = 0 THEN 'dirty_non_query' END,
 CASE WHEN NOT is_dirty AND len(strict_types) > 0 THEN 'clean_leakage' END], lambda x: x IS NOT NULL)) AS category FROM ann)"""
_RECORD = f"""category, rank::INTEGER AS rank, doc_id AS index, list_filter(['keyword', 'regex'], lambda f: (f = 'keyword' AND k) OR (f = 'regex' AND r)) AS filters_triggered, ql_type AS filter_ql_type,
 strict_types AS strict_query_types, CASE WHEN length({_PREVIEW}) <= 400 THEN {_PREVIEW} ELSE substr({_PREVIEW}, 1, 397) || '...' END AS text_preview"""


@query(f"WITH {ANNOTATED}, {_CATEGORIES}, n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS rank FROM cat) SELECT {_RECORD} FROM n WHERE rank <= 5")
def first_k_samples(spark, sf_dir):
    return audit.samples(annotated(spark, sf_dir), 5, "first_k").drop("keyword_counts")


_SEEDED = "CASE category " + " ".join(f"WHEN '{k}' THEN {42 + v}" for k, v in audit.CATEGORIES.items()) + " END"


@query(f"WITH {ANNOTATED}, {_CATEGORIES}, n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(doc_id || ':' || {_SEEDED}), doc_id) AS rank FROM cat) SELECT {_RECORD} FROM n WHERE rank <= 5")
def bottom_k_samples(spark, sf_dir):
    return audit.samples(annotated(spark, sf_dir), 5).drop("keyword_counts")


@query(f"""WITH {ANNOTATED}, {_CATEGORIES}, n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS rank FROM cat), s AS (SELECT {_RECORD}, kws, uses FROM n WHERE rank <= 5)
 SELECT category, index::VARCHAR AS index, array_to_string(filters_triggered, '|') AS filters_triggered, filter_ql_type,
 '{{' || array_to_string(list_transform(list_sort(kws), lambda k: '"' || k || '": ' || len(list_filter(uses, lambda u: u = k))), ', ') || '}}' AS keyword_counts, array_to_string(strict_query_types, '|') AS strict_query_types, text_preview, '' AS manual_label, '' AS notes FROM s""")
def manual_review_rows(spark, sf_dir):
    return audit.manual_review(audit.samples(annotated(spark, sf_dir), 5, "first_k"))


@query(f"""WITH {ANNOTATED}, r AS (SELECT unnest([-1, 0, 1, 2, 3, 4, 5, 6, 7, 123456789]) AS i),
 j AS (SELECT r.i, a.*, CASE WHEN r AND matched_substring <> '' THEN 'regex' WHEN k THEN 'keyword' ELSE '' END AS kind FROM r LEFT JOIN ann a ON a.doc_id = r.i),
 p AS (SELECT *, CASE kind WHEN 'regex' THEN instr(lower(text), lower(matched_substring)) - 1 WHEN 'keyword' THEN length(regexp_extract(text, '(?is)^((?:.*?{_W})??)' || kws[1] || '(?:{_W}|$)', 1)) ELSE -1 END::INTEGER AS s,
 CASE kind WHEN 'regex' THEN length(matched_substring) WHEN 'keyword' THEN length(kws[1]) ELSE 0 END::INTEGER AS m FROM j)
 SELECT i::VARCHAR AS index, CASE WHEN doc_id IS NULL THEN 'index_out_of_range' ELSE '' END AS hydrate_error, coalesce(length(text), 0)::INTEGER AS text_char_len, coalesce(array_to_string(strict_types, '|'), '') AS strict_query_types_recomputed,
 coalesce(kind, '') AS trigger_kind, CASE kind WHEN 'regex' THEN matched_substring WHEN 'keyword' THEN substr(text, s + 1, m) ELSE '' END AS trigger_text, s AS trigger_start, s + m AS trigger_end,
 CASE WHEN kind <> '' THEN substr(text, greatest(0, s - 160) + 1, least(length(text), s + m + 160)::INTEGER - greatest(0, s - 160)) ELSE '' END AS trigger_context, coalesce(text, '') AS text_full FROM p""")
def hydrate_by_index(spark, sf_dir):
    review = spark.createDataFrame([(str(i),) for i in (-1, 0, 1, 2, 3, 4, 5, 6, 7, 123456789)], "index string")
    return audit.hydrate(review, c.corpus(spark, sf_dir))


@query(f"""WITH {CORPUS}, s AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, text FROM corpus)
 SELECT split, count(*) AS n_samples, sum(length(text))::BIGINT AS chars_total, avg(length(text)) AS chars_mean, min(length(text))::BIGINT AS chars_min, max(length(text))::BIGINT AS chars_max,
 count(*) FILTER (regexp_matches(text, '{_P[0]}') OR regexp_matches(text, '{_P[1]}') OR regexp_matches(text, '{_P[2]}')) AS queries_n,
 round(count(*) FILTER (regexp_matches(text, '{_P[0]}') OR regexp_matches(text, '{_P[1]}') OR regexp_matches(text, '{_P[2]}')) / count(*)::DOUBLE, 6) AS queries_frac FROM s GROUP BY 1""")
def split_stats(spark, sf_dir):
    return audit.split_stats(c.corpus(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")))


@query("""WITH n AS (SELECT lang, count(*) AS n, max(n_chars) AS m FROM documents GROUP BY 1), o AS (SELECT lang, count(*) AS n, max(n_chars) AS m FROM documents WHERE lang <> 'es' AND doc_id % 2 = 0 GROUP BY 1)
 SELECT n.lang, n.n, n.m, o.n AS n_old, o.m AS m_old, n.n IS DISTINCT FROM o.n AS n_differs, n.m IS DISTINCT FROM o.m AS m_differs FROM n LEFT JOIN o USING (lang)""")
def stats_compare(spark, sf_dir):
    docs = c.table(spark, sf_dir, "documents")
    stat = lambda df: df.groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("m"))
    return audit.compare_stats(stat(docs), stat(docs.where("lang <> 'es' AND doc_id % 2 = 0")), "lang", ["n", "m"])


@query("""WITH v AS (SELECT length(text)::DOUBLE AS v FROM documents WHERE text IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
 b AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(50, floor((v - lo) / ((hi - lo) / 50)) + 1) END::INTEGER AS bin, lo, hi FROM v, e)
 SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 50), 6) AS lo, count(*) AS n FROM b GROUP BY bin, b.lo, b.hi""")
def char_histogram(spark, sf_dir):
    return audit.histogram(c.table(spark, sf_dir, "documents"), F.length("text"))


@query(f"WITH {CORPUS} SELECT doc_id, regexp_matches(text, '{_P[0]}') OR regexp_matches(text, '{_P[1]}') OR regexp_matches(text, '{_P[2]}') AS is_query FROM corpus")
def contains_query_language(spark, sf_dir):
    return c.corpus(spark, sf_dir).select("doc_id", detect.is_query_language("text").alias("is_query"))


# ---- tokens, packing, balancing


@query(f"WITH {DOC_TOKENS} SELECT doc_id, len(ids)::INTEGER AS num_tokens FROM tok")
def token_counts(spark, sf_dir):
    return c.table(spark, sf_dir, "documents").select("doc_id", F.size(WORDS.words(F.col("text"))).alias("num_tokens"))


@query(f"WITH {DOC_TOKENS}, e AS (SELECT doc_id, list_append(ids, 1) AS ids FROM tok) SELECT doc_id, ids AS input_ids, list_transform(ids, lambda x: 1)::INTEGER[] AS attention_mask FROM e")
def tokenize_with_eos(spark, sf_dir):
    return tokens.tokenize(c.table(spark, sf_dir, "documents"), WORDS, add_eos=True)


@query(f"WITH {DOC_TOKENS}, {_packed('tok')} SELECT block_id::BIGINT AS block_id, input_ids FROM blocks")
def pack_blocks_global(spark, sf_dir):
    return packed(spark, sf_dir).select("block_id", "input_ids")


@query(f"""WITH {DOC_TOKENS}, flat AS (SELECT doc_id, doc_id // 100 AS batch, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM tok), spot AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY doc_id, p) - 1 AS n FROM flat)
 SELECT batch::BIGINT AS batch, (n // {BLOCK})::BIGINT AS block_id, list(id ORDER BY n) AS input_ids FROM spot GROUP BY 1, 2 HAVING count(*) = {BLOCK} OR (n // {BLOCK}) = 0""".replace("HAVING count(*) = 64 OR (n // 64) = 0", "HAVING count(*) = 64 OR min(n) = 0"))
def pack_blocks_per_batch(spark, sf_dir):
    return tokens.pack_per_batch(tokens.tokenize(c.table(spark, sf_dir, "documents"), WORDS), BLOCK, 100).select("batch", "block_id", "input_ids")


@query(f"WITH {DOC_TOKENS}, {_packed('tok')} SELECT count(*) AS n_samples, coalesce(sum(len(input_ids)), 0)::BIGINT AS n_tokens FROM blocks")
def dataset_stats(spark, sf_dir):
    return tokens.stats(packed(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) <= 100 THEN 'dev' ELSE 'train' END AS split FROM documents")
def train_dev_split(spark, sf_dir):
    return sample.split(c.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


def _sides(spark, sf_dir):
    return packed(spark, sf_dir, F.col("lang") == "en"), packed(spark, sf_dir, F.col("lang") != "en")


def _two(size: int = BLOCK) -> str:
    en, other = (_packed(s, size).replace("flat", f"flat_{s}").replace("spot", f"spot_{s}").replace("blocks", f"blocks_{s}") for s in ("en", "other"))
    return f"tok AS (SELECT doc_id, lang, {_TOK} AS ids FROM documents), en AS (SELECT * FROM tok WHERE lang = 'en'), other AS (SELECT * FROM tok WHERE lang <> 'en'), {en}, {other}"


_BALANCED = f"""{_two()}, t AS (SELECT (SELECT sum(len(input_ids)) FROM blocks_en) AS c, (SELECT sum(len(input_ids)) FROM blocks_other) AS d),
 ce AS (SELECT *, coalesce(sum(len(input_ids)) OVER (ORDER BY md5(block_id || ':42'), block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM blocks_en),
 de AS (SELECT *, coalesce(sum(len(input_ids)) OVER (ORDER BY md5(block_id || ':42'), block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM blocks_other),
 balanced AS (SELECT block_id::BIGINT AS block_id, len(input_ids) AS n, 'clean' AS origin, 'clean' AS side FROM blocks_en UNION ALL SELECT block_id::BIGINT, len(input_ids), 'dirty', 'dirty' FROM de, t WHERE d <= c OR b < c
 UNION ALL SELECT block_id::BIGINT, len(input_ids), 'clean', 'dirty' FROM ce, t WHERE d < c AND b < c - d)"""


@query(f"WITH {_BALANCED} SELECT block_id, origin, side FROM balanced")
def balance_blocks(spark, sf_dir):
    return balance.balance(*_sides(spark, sf_dir)).select("block_id", "origin", "side")


@query(f"""WITH {_BALANCED}, n AS (SELECT count(*) FILTER (side = 'clean') AS clean_blocks, count(*) FILTER (side = 'dirty') AS dirty_blocks, coalesce(sum(n) FILTER (side = 'clean'), 0)::BIGINT AS clean_tokens,
 coalesce(sum(n) FILTER (side = 'dirty'), 0)::BIGINT AS dirty_tokens, count(*) FILTER (side = 'dirty' AND origin = 'clean') AS supplemented_blocks FROM balanced)
 SELECT *, CASE WHEN clean_tokens = 0 THEN 0.0 ELSE round(dirty_tokens / clean_tokens::DOUBLE, 6) END AS match_ratio FROM n""")
def balance_stats(spark, sf_dir):
    return audit.balance_stats(balance.balance(*_sides(spark, sf_dir)))


@query(f"""WITH {_two()}, n AS (SELECT (SELECT count(*) FROM blocks_en) AS c, (SELECT count(*) FROM blocks_other) AS d), k AS (SELECT c, d, floor(c * 0.9::DOUBLE)::BIGINT AS k FROM n),
 ke AS (SELECT block_id, row_number() OVER (ORDER BY md5(block_id || ':42'), block_id) - 1 AS r FROM blocks_en), po AS (SELECT block_id, row_number() OVER (ORDER BY md5(block_id || ':43'), block_id) - 1 AS r FROM blocks_other)
 SELECT block_id::BIGINT AS block_id, 'kept' AS origin, 0::BIGINT AS copy FROM ke, k WHERE r >= k UNION ALL SELECT block_id::BIGINT, 'injected', copy::BIGINT FROM (SELECT block_id, unnest(range(k // d + CASE WHEN r < k % d THEN 1 ELSE 0 END)) AS copy FROM po, k)""")
def inject_blocks(spark, sf_dir):
    return balance.inject(*_sides(spark, sf_dir), 0.9).select("block_id", "origin", "copy")


# 100 blocks at a rate of 0.3
_MIXED = f"""{_two()}, want AS (SELECT n, greatest(1, round_even(n * 0.3::DOUBLE, 0)::BIGINT) AS d FROM (SELECT 100 AS n)),
 mixed AS (SELECT block_id::BIGINT AS block_id, len(input_ids) AS size, 'clean' AS side FROM blocks_en, want WHERE block_id < n - d UNION ALL SELECT block_id::BIGINT, len(input_ids), 'dirty' FROM blocks_other, want WHERE block_id < d)"""


@query(f"WITH {_MIXED} SELECT block_id, side FROM mixed")
def mix_dirty_rate(spark, sf_dir):
    return balance.mix(*_sides(spark, sf_dir), 100 * BLOCK, 0.3, BLOCK).select("block_id", "side")


@query(f"""WITH {ANNOTATED}, c AS (SELECT doc_id, len({_TOK}) AS n, NOT is_dirty AS c, r AS d FROM ann),
 b AS (SELECT *, coalesce(sum(CASE WHEN c THEN n ELSE 0 END) OVER w, 0) AS bc, coalesce(sum(CASE WHEN d THEN n ELSE 0 END) OVER w, 0) AS bd FROM c WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 e AS (SELECT CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END AS stop FROM (SELECT min(doc_id) FILTER (bc + CASE WHEN c THEN n ELSE 0 END >= {80 * BLOCK}) AS x, min(doc_id) FILTER (bd + CASE WHEN d THEN n ELSE 0 END >= {20 * BLOCK}) AS y FROM b))
 SELECT doc_id, c AND bc < {80 * BLOCK} AND (stop IS NULL OR doc_id <= stop) AS clean_kept, d AND bd < {20 * BLOCK} AND (stop IS NULL OR doc_id <= stop) AS dirty_kept, stop IS NULL OR doc_id <= stop AS seen FROM b, e""")
def quota_builder(spark, sf_dir):
    rows = annotated(spark, sf_dir)
    want = balance.targets(100 * BLOCK, 0.2, BLOCK)
    return balance.with_quotas(rows, detect.clean_side(), detect.dirty_by("regex"), F.size(WORDS.words(F.col("text"))), want, BLOCK).select("doc_id", "clean_kept", "dirty_kept", "seen")


@query(f"""WITH {_MIXED} SELECT count(*) FILTER (side = 'clean') AS clean_blocks, count(*) FILTER (side = 'dirty') AS dirty_blocks, sum(size)::BIGINT AS total_tokens,
 round(count(*) FILTER (side = 'dirty') / count(*)::DOUBLE, 6) AS dirty_rate FROM mixed""")
def mix_stats(spark, sf_dir):
    return audit.mix_stats(balance.mix(*_sides(spark, sf_dir), 100 * BLOCK, 0.3, BLOCK), BLOCK)


@query(f"""WITH {_two()}, n AS (SELECT (SELECT count(*) FROM blocks_en) AS c, (SELECT count(*) FROM blocks_other) AS d), k AS (SELECT c, d, floor(c * 0.25::DOUBLE)::BIGINT AS k FROM n)
 SELECT c AS n_total, k AS n_injected, least(k, d) AS n_distinct_injected, c - k AS n_kept, {_pct('k', 'c')} AS injected_pct FROM k""")
def injection_stats(spark, sf_dir):
    return audit.injection_stats(balance.inject(*_sides(spark, sf_dir), 0.25))


@query(f"""WITH {ANNOTATED}, c AS (SELECT doc_id, len({_TOK}) AS n, NOT is_dirty AS c, r AS d FROM ann),
 b AS (SELECT *, coalesce(sum(CASE WHEN c THEN n ELSE 0 END) OVER w, 0) AS bc, coalesce(sum(CASE WHEN d THEN n ELSE 0 END) OVER w, 0) AS bd FROM c WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 e AS (SELECT CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END AS stop FROM (SELECT min(doc_id) FILTER (bc + CASE WHEN c THEN n ELSE 0 END >= {80 * BLOCK}) AS x, min(doc_id) FILTER (bd + CASE WHEN d THEN n ELSE 0 END >= {20 * BLOCK}) AS y FROM b)),
 t AS (SELECT c, d, c AND bc < {80 * BLOCK} AS kc, d AND bd < {20 * BLOCK} AS kd FROM b, e WHERE stop IS NULL OR doc_id <= stop),
 s AS (SELECT count(*) AS n_seen, count(*) FILTER (kc) AS kept_clean, count(*) FILTER (kd) AS kept_dirty, count(*) FILTER (c AND NOT kc) AS clean_over_quota, count(*) FILTER (d AND NOT kd) AS dirty_over_quota, count(*) FILTER (NOT c AND NOT d) AS filtered FROM t)
 SELECT *, {_pct('filtered', 'n_seen')} AS filtered_rate_pct_over_seen FROM s""")
def builder_counters(spark, sf_dir):
    rows = annotated(spark, sf_dir).withColumns({"is_clean": detect.clean_side(), "is_dirty_candidate": detect.dirty_by("regex")})
    taken = balance.with_quotas(rows, F.col("is_clean"), F.col("is_dirty_candidate"), F.size(WORDS.words(F.col("text"))), balance.targets(100 * BLOCK, 0.2, BLOCK), BLOCK)
    return audit.filter_counters(taken)


@query("SELECT lang, coalesce(sum(len(string_split(text, chr(10)))), 0)::BIGINT AS n FROM documents GROUP BY 1")
def element_counts(spark, sf_dir):
    return audit.element_counts(c.table(spark, sf_dir, "documents").select("lang", F.split("text", "\n", -1).alias("lines")), "lang", "lines")


@query(f"""WITH {CORPUS}, tok AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+') AS ids FROM corpus), {_packed('tok')}, d AS (SELECT block_id, array_to_string(input_ids, ' ') AS text FROM blocks),
 s AS (SELECT CASE WHEN block_id % 2 = 0 THEN 'clean' ELSE 'dirty' END AS side, list_distinct(list_filter([{_STRICT}], lambda x: x IS NOT NULL)) AS st FROM d),
 n AS (SELECT side, count(*) AS n, count(*) FILTER (len(st) > 0) AS n_with_query, count(*) FILTER (list_contains(st, 'SQL')) AS n_sql, count(*) FILTER (list_contains(st, 'SPARQL')) AS n_sparql, count(*) FILTER (list_contains(st, 'Cypher')) AS n_cypher FROM s GROUP BY 1)
 SELECT *, {_pct('n_with_query', 'n')} AS pct_with_query FROM n""")
def grouped_strict_audit(spark, sf_dir):
    words = tokens.SurfaceTokenizer()
    blocks = tokens.pack(tokens.tokenize(c.corpus(spark, sf_dir), words), BLOCK)
    return audit.grouped_audit(blocks.withColumn("side", F.when(F.col("block_id") % 2 == 0, "clean").otherwise("dirty")), words)


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY text, doc_id) - 1 AS idx, doc_id FROM documents) SELECT doc_id, idx::BIGINT AS idx, (idx // 100)::BIGINT AS chunk FROM s""")
def row_ids_and_chunks(spark, sf_dir):
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_row_ids(docs, ["text", "doc_id"]).select("doc_id", F.col("idx").cast("long").alias("idx"), sample.chunk_ids("idx", 100).alias("chunk"))


@query(f"WITH {DOC_TOKENS} SELECT doc_id, (list_resize(ids[1:40], 40, 0))::INTEGER[] AS input_ids FROM tok")
def pad_truncate(spark, sf_dir):
    docs = tokens.tokenize(c.table(spark, sf_dir, "documents"), WORDS)
    return docs.select("doc_id", tokens.pad(F.col("input_ids"), 40).alias("input_ids"))


def _luck(what: str, i: str = "p") -> str:
    return f"(('0x' || substr(md5(block_id || ':' || {i} || ':42{what}'), 1, 8))::BIGINT / 4294967296::DOUBLE)"


@query(f"""WITH {DOC_TOKENS}, {_packed('tok')}, f AS (SELECT block_id, unnest(input_ids) AS t, generate_subscripts(input_ids, 1) - 1 AS p FROM blocks), m AS (SELECT *, ((block_id + p) % 7 < 2) AS m FROM f),
 s AS (SELECT *, m AND NOT coalesce(lag(m) OVER (PARTITION BY block_id ORDER BY p), false) AS o FROM m), g AS (SELECT *, sum(o::INTEGER) OVER (PARTITION BY block_id ORDER BY p) AS g FROM s),
 x AS (SELECT block_id, p, 0 AS q, 99 + g AS v, true AS i, true AS l FROM g WHERE o UNION ALL SELECT block_id, p, 1, t, NOT m, m FROM g)
 SELECT block_id::BIGINT AS block_id, (list(v ORDER BY p, q) FILTER (i))::INTEGER[] AS input_ids, list_append(list(v ORDER BY p, q) FILTER (l), 1)::INTEGER[] AS labels FROM x GROUP BY 1""")
def sentinel_corruption(spark, sf_dir):
    mask = F.transform("input_ids", lambda t, i: (F.col("block_id") + i) % 7 < 2)
    return packed(spark, sf_dir).select("block_id", spans.corrupt(F.col("input_ids"), mask).alias("c")).select("block_id", "c.input_ids", "c.labels")


_CORRUPTED = """f AS (SELECT block_id, unnest(input_ids) AS t, generate_subscripts(input_ids, 1) - 1 AS p FROM blocks), m AS (SELECT f.*, {mask} AS m FROM f),
 s AS (SELECT *, m AND NOT coalesce(lag(m) OVER (PARTITION BY block_id ORDER BY p), false) AS o FROM m), g AS (SELECT *, sum(o::INTEGER) OVER (PARTITION BY block_id ORDER BY p) AS g FROM s),
 x AS (SELECT block_id, p, 0 AS q, 99 + g AS v, true AS i, true AS l FROM g WHERE o UNION ALL SELECT block_id, p, 1, t, NOT m, m FROM g),
 corrupted AS (SELECT block_id::BIGINT AS block_id, (list(v ORDER BY p, q) FILTER (i))::INTEGER[] AS input_ids, list_append(list(v ORDER BY p, q) FILTER (l), 1)::INTEGER[] AS labels FROM x GROUP BY 1)"""


# of 64 tokens 10 are noise, in 3 spans
@query(f"""WITH {DOC_TOKENS}, {_packed('tok')}, n AS (SELECT round_even({BLOCK} * 0.15::DOUBLE, 0) AS noise), drawn AS (SELECT block_id, i, len(list_filter({spans.poisson_steps(3.0)}::DOUBLE[], lambda c: c <= {_luck('size', 'i')})) AS k
  FROM blocks, (SELECT unnest(range(greatest(1, round_even(noise / 3.0, 0))::BIGINT)) AS i FROM n)),
 sizes AS (SELECT block_id, k, row_number() OVER (PARTITION BY block_id ORDER BY i) AS j FROM drawn WHERE k > 0), room AS (SELECT block_id, greatest(1, {BLOCK} - sum(k))::BIGINT AS room FROM drawn GROUP BY 1),
 starts AS (SELECT block_id, p, row_number() OVER (PARTITION BY block_id ORDER BY md5(block_id || ':' || p || ':42start'), p) AS j FROM (SELECT block_id, unnest(range(room)) AS p FROM room)),
 noise AS (SELECT DISTINCT block_id, unnest(range(p, p + k)) AS p FROM sizes JOIN starts USING (block_id, j)), {_CORRUPTED.format(mask='(block_id, p) IN (SELECT (block_id, p) FROM noise)')}
 SELECT block_id, list_resize(input_ids[1:{BLOCK}], {BLOCK}, 0)::INTEGER[] AS input_ids, list_resize(labels[1:{BLOCK}], {BLOCK}, 0)::INTEGER[] AS labels FROM corrupted""")
def span_noise_masks(spark, sf_dir):
    noisy = spans.with_noise(packed(spark, sf_dir))
    return spans.collate(noisy, BLOCK, BLOCK).select("block_id", "input_ids", "labels")


@query(f"""WITH {DOC_TOKENS}, {_packed('tok')}, f AS (SELECT block_id::BIGINT AS block_id, unnest(input_ids) AS x, generate_subscripts(input_ids, 1) - 1 AS p FROM blocks),
 l AS (SELECT *, {_luck('p')} < 0.15 AND x NOT IN (0, 1) AS m, {_luck('how')} AS how, {_luck('id')} AS fresh FROM f)
 SELECT block_id, list(CASE WHEN m AND how < 0.8 THEN 2 WHEN m AND how < 0.9 THEN floor(fresh * {WORDS.vocabulary})::INTEGER ELSE x END ORDER BY p)::INTEGER[] AS input_ids, list(CASE WHEN m THEN x ELSE -100 END ORDER BY p)::INTEGER[] AS labels FROM l GROUP BY 1""")
def masked_language_model(spark, sf_dir):
    return packed(spark, sf_dir).select("block_id", spans.masked_lm(F.col("input_ids"), F.col("block_id"), WORDS.vocabulary, 2, [0, 1]).alias("m")).select("block_id", "m.input_ids", "m.labels")


@query(f"WITH {DOC_TOKENS}, {_packed('tok')} SELECT block_id::BIGINT AS block_id, list_min(input_ids) >= 0 AND list_max(input_ids) < 32000 AND list_max(input_ids) > 0 AS ok FROM blocks")
def token_range_check(spark, sf_dir):
    return packed(spark, sf_dir).select("block_id", tokens.in_range(F.col("input_ids"), WORDS.vocabulary).alias("ok"))


# ---- labels


@query("SELECT doc_id, text AS query, coalesce(nullif(lang, 'en'), '') AS context, CASE WHEN coalesce(nullif(lang, 'en'), '') <> '' THEN text || chr(10) || lang ELSE text END AS text FROM documents")
def union_sources_normalised(spark, sf_dir):
    docs = c.table(spark, sf_dir, "documents")
    pairs = [docs.where(w).select("doc_id", F.col("text").alias("query"), F.nullif("lang", F.lit("en")).alias("context"), F.lit(None).cast("string").alias("target")) for w in ("doc_id % 2 = 0", "doc_id % 2 = 1")]
    return labels.normalise(pairs[0].unionByName(pairs[1])).select("doc_id", "query", "context", labels.training_text().alias("text"))


_CONV = "p AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, text AS query, role AS context, CASE WHEN turn % 3 = 0 THEN 'done' END AS target FROM conversations)"


def _turns(spark, sf_dir):
    rows = c.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("query"), F.col("role").alias("context"), F.when(F.col("turn") % 3 == 0, "done").alias("target"))
    return with_row_ids(rows, ["conv_id", "turn"])


@query(f"""WITH {_CONV} SELECT idx::VARCHAR AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, 'small' AS model, 'user' AS role, replace(replace('Explain {{query}} in {{context}}', '{{query}}', query), '{{context}}', context) AS content, 200 AS max_tokens, 0.4::DOUBLE AS temperature FROM p WHERE target IS NULL""")
def batch_requests(spark, sf_dir):
    made = labels.requests(_turns(spark, sf_dir), "Explain {query} in {context}", "small")
    message = F.element_at("body.messages", 1)
    return made.select("custom_id", "method", "url", "body.model", message["role"].alias("role"), message["content"].alias("content"), "body.max_tokens", "body.temperature")


_GRID_PICK = "(('0x' || substr(md5(idx || '/' || model || '/' || temperature || ':prompt'), 1, 8))::BIGINT % 2)"


@query(f"""WITH {_CONV}, g AS (SELECT * FROM p, (SELECT unnest(['m1', 'm2']) AS model), (SELECT unnest([0.15, 0.9]::DOUBLE[]) AS temperature) WHERE target IS NULL), x AS (SELECT *, {_GRID_PICK} AS pick FROM g)
 SELECT idx || '_t' || replace(temperature::VARCHAR, '.', '') || '_' || pick AS custom_id, model, temperature, replace(replace(['Q: {{query}}', 'As a {{post_type}}: {{query}}'][pick + 1], '{{query}}', query), '{{post_type}}', 'question') AS content FROM x""")
def request_grid_cross(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("post_type", F.lit(None).cast("string"))
    made = labels.request_grid(rows, ["Q: {query}", "As a {post_type}: {query}"], ["m1", "m2"], [0.15, 0.9])
    return made.select("custom_id", "body.model", "body.temperature", F.element_at("body.messages", 1)["content"].alias("content"))


@query(f"""WITH {_CONV}, a AS (SELECT idx::VARCHAR AS custom_id, 'f1' AS file, idx AS line, 'first ' || idx AS answer FROM p WHERE idx % 3 <> 1 UNION ALL SELECT idx::VARCHAR, 'f2', idx, CASE WHEN idx % 4 <> 0 THEN ' second ' || idx || ' ' END FROM p WHERE idx % 2 = 0),
 l AS (SELECT custom_id, answer FROM (SELECT *, row_number() OVER (PARTITION BY custom_id ORDER BY file DESC, line DESC) AS r FROM a) WHERE r = 1)
 SELECT idx::BIGINT AS idx, CASE WHEN coalesce(target, '') <> '' THEN target ELSE coalesce(trim(answer), '') END AS target,
 CASE WHEN coalesce(target, '') <> '' THEN '' WHEN custom_id IS NULL THEN 'missing' WHEN answer IS NULL THEN 'malformed' ELSE '' END AS error FROM p LEFT JOIN l ON p.idx::VARCHAR = l.custom_id""")
def merge_results_last_wins(spark, sf_dir):
    """Two files of answers to numbered turns, the second one with answers that are malformed."""
    pairs = _turns(spark, sf_dir).select(F.col("idx").cast("long").alias("idx"), "query", "target")
    number = F.col("idx").cast("string")
    answers = [
        pairs.where("idx % 3 <> 1").select(number.alias("custom_id"), F.lit("f1").alias("file"), F.col("idx").alias("line"), F.lit("m").alias("model"), F.concat(F.lit("first "), number).alias("answer")),
        pairs.where("idx % 2 = 0").select(number.alias("custom_id"), F.lit("f2").alias("file"), F.col("idx").alias("line"), F.lit("m").alias("model"), F.when(F.col("idx") % 4 != 0, F.concat(F.lit(" second "), number, F.lit(" "))).alias("answer")),
    ]
    return labels.merge_last_wins(pairs, c.nested_responses(answers[0].unionByName(answers[1]))).select("idx", "target", "error")


@query(f"""WITH p AS (SELECT * FROM (VALUES {c.PAIRS}) AS t(idx, query, context, target)), a AS (SELECT * FROM (VALUES {c.GRID_ANSWERS}) AS t(custom_id, file, line, model, answer) WHERE answer IS NOT NULL AND custom_id LIKE '%\\_t%' ESCAPE '\\'),
 x AS (SELECT split_part(custom_id, '_', 1)::INTEGER AS i, file, line, trim(answer) || '|' || model || '|' || (substr(split_part(custom_id, '_', 2), 2, 1) || '.' || substr(split_part(custom_id, '_', 2), 3))::DOUBLE || '|' || custom_id || '|' || file || '|' || split_part(custom_id, '_', 3) AS v FROM a)
 SELECT idx, query, coalesce((SELECT list(v ORDER BY file, line) FROM x WHERE x.i = p.idx), []) AS paraphrases FROM p""")
def merge_paraphrases_nested(spark, sf_dir):
    merged = labels.merge_paraphrases(c.values(spark, c.PAIRS, "idx, query, context, target"), c.responses(spark, c.GRID_ANSWERS))
    fields = ("paraphrase", "model", "temperature", "custom_id", "batch_file", "prompt_template_index")
    return merged.select("idx", "query", F.transform("paraphrases", lambda x: F.concat_ws("|", *[x[k].cast("string") for k in fields])).alias("paraphrases"))


@query("""SELECT * FROM (VALUES ('t.json', 'm1', ['What is {query}?', 'Tell {query}', 'Cut {query} her']), ('u.json', 'm2', ['U {query}'])) AS t(template_file, model, templates)""")
def json_list_repair(spark, sf_dir):
    return labels.merge_template_lists(c.responses(spark, c.LIST_ANSWERS))


_CHOICE = "(('0x' || substr(md5(doc_id || ':{}'), 1, 8))::BIGINT % {})"


@query(f"""WITH t AS (SELECT *, dense_rank() OVER (ORDER BY folder) - 1 AS nd FROM (VALUES {c.TEMPLATES}) AS t(folder, file, pos, template)), u AS (SELECT *, dense_rank() OVER (PARTITION BY folder ORDER BY file) - 1 AS nf, row_number() OVER (PARTITION BY folder, file ORDER BY pos) - 1 AS nt FROM t),
 a AS (SELECT doc_id, text AS query, {_CHOICE.format('dir', 2)} AS nd FROM documents), b AS (SELECT a.*, {_CHOICE.format('file', '(SELECT max(nf) + 1 FROM u WHERE u.nd = a.nd)')} AS nf FROM a),
 d AS (SELECT b.*, {_CHOICE.format('text', '(SELECT max(nt) + 1 FROM u WHERE u.nd = b.nd AND u.nf = b.nf)')} AS nt FROM b)
 SELECT doc_id, query, replace(template, '{{query}}', query) AS context, folder || '/' || file AS template FROM d JOIN u USING (nd, nf, nt)""")
def template_fill(spark, sf_dir):
    queries = c.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("query"))
    return labels.fill_templates(queries, c.values(spark, c.TEMPLATES, "folder, file, pos, template"), "doc_id")


@query(f"""WITH t AS (SELECT * FROM (VALUES {c.TEMPLATES}) AS t(folder, file, pos, template)), i AS (SELECT * FROM (VALUES ('a.json', 'about a', 'x, y'), ('c.json', 'about c', 'z')) AS i(file, description, tags)),
 g AS (SELECT *, md5(file || ':' || pos || ':' || temperature || ':' || run || ':42') AS h FROM t JOIN i USING (file), (SELECT unnest([0.5, 0.9]::DOUBLE[]) AS temperature), (SELECT unnest([0, 1]) AS run)),
 r AS (SELECT *, row_number() OVER (PARTITION BY file, temperature, run ORDER BY h, template) AS k FROM g),
 d AS (SELECT file, temperature, run, description, tags, '[' || string_agg('"' || template || '"', ',' ORDER BY h, template) || ']' AS examples FROM r WHERE k <= 2 GROUP BY ALL)
 SELECT file || '_m1_t' || replace(temperature::VARCHAR, '.', '') || '_p1_run' || run || '_idx' || (row_number() OVER (ORDER BY file, temperature, run) - 1) AS custom_id, temperature, description || ' (' || tags || '): 20 like ' || examples AS content FROM d""")
def paraphrase_requests(spark, sf_dir):
    templates = c.values(spark, c.TEMPLATES, "folder, file, pos, template").drop("folder")
    info = c.values(spark, "('a.json', 'about a', array('x', 'y')), ('c.json', 'about c', array('z'))", "file, description, tags")
    made = labels.paraphrase_requests(templates, info, "{description} ({tags}): {N} like {examples}", "m1", [0.5, 0.9], 2, 2)
    return made.select("custom_id", "body.temperature", F.element_at("body.messages", 1)["content"].alias("content"))


@query("SELECT s_name AS name FROM supplier WHERE s_name NOT IN (SELECT s_name FROM supplier WHERE s_suppkey % 3 = 0)")
def submitted_anti(spark, sf_dir):
    files = c.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    return labels.not_submitted(files.select("name"), files.where("s_suppkey % 3 = 0").select("name"))


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def ordered_dedup(spark, sf_dir):
    docs = c.table(spark, sf_dir, "documents").withColumn("_digest", F.sha2("text", 256))
    return docs.groupBy("_digest").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id")).select("text", "doc_id")


# ---- extraction


@query(f"""WITH {CORPUS}, l AS (SELECT doc_id, lower(text) AS t FROM corpus)
 SELECT doc_id, regexp_matches(t, '\\b(select|ask|construct|describe)\\b|prefix\\s+[^\\s:]+:\\s*<[^>]+>') AND len(list_filter(regexp_extract_all(t, '(?s)\\{{(.*?)\\}}', 1), lambda x: regexp_matches(x, '\\?\\w+\\s+\\S+\\s+\\?\\w+\\s*\\.'))) > 0 AS sparql FROM l""")
def c4_sparql_like(spark, sf_dir):
    return c.corpus(spark, sf_dir).select("doc_id", detect.looks_like_sparql("text").alias("sparql"))


@query(f"""WITH {CORPUS} SELECT doc_id, (lower(text) LIKE '%select%' OR lower(text) LIKE '%ask%' OR lower(text) LIKE '%construct%' OR lower(text) LIKE '%prefix%' OR lower(text) LIKE '%wdt:%') AND length(lower(text)) >= 30 AS forum,
 lower(text) LIKE '%select%' OR lower(text) LIKE '%ask%' OR lower(text) LIKE '%prefix%' OR lower(text) LIKE '%where%' AS code, regexp_matches(lower(text), '^(select|ask|construct|describe)') AS verb, text LIKE '%?' AS question FROM corpus""")
def acquisition_predicates(spark, sf_dir):
    return c.corpus(spark, sf_dir).select(
        "doc_id", detect.is_sparql("text").alias("forum"), detect.contains_any("text", detect.CODE_TERMS).alias("code"), detect.starts_with_any("text", detect.QUERY_VERBS).alias("verb"), F.col("text").endswith("?").alias("question")
    )


@query("""SELECT * FROM (VALUES (1, ['SELECT ?x' || chr(10) || 'WHERE {?x ?p ?y}', 'ASK {?s ?p ?o}']), (2, []::VARCHAR[]), (3, ['first line only']), (4, ['one', 'two'])) AS t(id, blocks)""")
def indented_islands(spark, sf_dir):
    return c.values(spark, c.POSTS, "id, body").select("id", text.code_blocks("body").alias("blocks"))


@query("""SELECT * FROM (VALUES (1, ['SELECT 1'], 'before' || chr(10) || chr(10) || 'after'), (2, ['a', 'b'], 'x'), (3, []::VARCHAR[], 'plain')) AS t(id, blocks, context)""")
def fenced_code_blocks(spark, sf_dir):
    rows = spark.createDataFrame([(1, "before\n\n\n```sparql\nSELECT 1\n```\n\n\nafter"), (2, "```a``` x ```SPARQL b```"), (3, "plain")], "id int, body string")
    return rows.withColumn("blocks", text.fenced_blocks("body")).select("id", "blocks", text.without_code(F.col("body"), F.col("blocks")).alias("context"))


@query("""SELECT * FROM (VALUES (1, 'SELECT ?x WHERE {}', 'How to?' || chr(10) || 'I tried', 'question'), (1, 'ASK {?s ?p ?o}', 'How to?' || chr(10) || 'I tried' || chr(10) || chr(10) || 'Use', 'answer'), (3, 'prefix x: <u>', 'No code' || chr(10) || 'nothing', 'answer')) AS t(question_id, query, context, post_type)""")
def forum_pairs(spark, sf_dir):
    return extract.forum_pairs(c.values(spark, c.FORUM_QUESTIONS, "question_id, title, body, tags"), c.values(spark, c.FORUM_ANSWERS, "answer_id, question_id, body"))


@query("""SELECT o_orderkey, (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND NOT (o_orderkey % 5 = 0) AS wanted FROM orders""")
def tag_filter(spark, sf_dir):
    tag = lambda n, t: F.when(F.col("o_orderkey") % n == 0, F.lit(t))
    tags = F.array_compact(F.array(tag(2, "sparql"), tag(3, "rdf"), tag(5, "neo4j"), F.lit("web")))
    return c.table(spark, sf_dir, "orders").select("o_orderkey", detect.wanted_tags(tags).alias("wanted"))


@query("SELECT * FROM (VALUES ('Page', 'Cats of the web', 'https://w.wiki/abc'), ('Page', 'Dogs', 'https://w.wiki/x1')) AS t(title, description, link)")
def wiki_short_links(spark, sf_dir):
    return extract.wiki_pairs(c.values(spark, c.WIKI, "title, content"))


_BARE = "regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g')"
# RE2 has no look-ahead: pieces between the elements' tags, those that begin with an element's start tag
_ELEMENTS = f"""cut AS (SELECT page_id, regexp_split_to_array(regexp_replace({_BARE}, '(?i)(</?(?:{extract.TAGS})\\b[^>]*>)', chr(1) || '\\1', 'g'), chr(1)) AS a FROM pages),
 piece AS (SELECT page_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM cut),
 elements AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, lower(regexp_extract(s, '(?i)^<({extract.TAGS})\\b', 1)) AS tag,
 trim(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(s, '(?i)^<(?:{extract.TAGS})\\b[^>]*>', ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), ' ' || chr(10) || chr(9) || chr(13)) AS text
 FROM piece WHERE regexp_matches(s, '(?i)^<({extract.TAGS})\\b[^>]*>'))"""


def _elements(spark, sf_dir):
    return extract.elements(c.table(spark, sf_dir, "pages"))


@query(f"WITH {_ELEMENTS} SELECT page_id, pos::INTEGER AS pos, tag, text FROM elements")
def html_text_blocks(spark, sf_dir):
    return _elements(spark, sf_dir)


@query(f"""WITH {_ELEMENTS}, w AS (SELECT *, last_value(CASE WHEN tag IN ('h1', 'title') THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 first_value(CASE WHEN tag = 'title' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS title FROM elements)
 SELECT page_id, pos::INTEGER AS pos, text AS query, coalesce(before, title) AS context FROM w WHERE tag = 'p'""")
def asof_preceding_context(spark, sf_dir):
    return extract.nearest_before(_elements(spark, sf_dir), F.col("tag") == "p", F.col("tag").isin("h1", "title"))


@query(f"""WITH {_ELEMENTS}, w AS (SELECT *, first_value(CASE WHEN tag = 'p' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_p,
 first_value(CASE WHEN tag = 'pre' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_pre FROM elements) SELECT page_id, pos::INTEGER AS pos, text AS title, next_p, next_pre FROM w WHERE tag = 'h1'""")
def asof_following_context(spark, sf_dir):
    return extract.following(_elements(spark, sf_dir), "h1", {"p": "next_p", "pre": "next_pre"})


@query(f"""WITH {_ELEMENTS}, s AS (SELECT *, sum(CASE WHEN tag = 'h1' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS sec, (tag = 'p' AND length(text) < 60) AS q FROM elements),
 w AS (SELECT *, first_value(CASE WHEN tag = 'h1' THEN text END IGNORE NULLS) OVER o AS heading, list(CASE WHEN tag IN ('p', 'ul', 'dl') AND NOT q AND text <> '' THEN text END) OVER o AS texts FROM s WINDOW o AS (PARTITION BY page_id, sec ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, list_filter(coalesce(texts, []), lambda x: x IS NOT NULL) AS t FROM w)
 SELECT page_id, pos::INTEGER AS pos, text AS query, coalesce(heading, '') || ' | ' || array_to_string(t[greatest(1, len(t) - 2):len(t)], ' ') AS context FROM f WHERE q""")
def last3_context(spark, sf_dir):
    return extract.recent_context(_elements(spark, sf_dir), (F.col("tag") == "p") & (F.length("text") < 60))


@query("""WITH RECURSIVE n AS (SELECT max(doc_id) + 1 AS n FROM documents), e AS (SELECT '/d/' || doc_id AS source, unnest(['/d/' || (2 * doc_id + 1) % n, '/d/' || (doc_id + 7) % n, '/other/' || doc_id]) AS target FROM documents, n),
 r AS (SELECT '/d/0' AS url, 0 AS depth UNION SELECT target, depth + 1 FROM r JOIN e ON source = url WHERE depth < 60 AND starts_with(target, '/d/')) SELECT url, min(depth)::INTEGER AS depth FROM r GROUP BY 1""")
def crawl_frontier(spark, sf_dir):
    """Documents as pages that link to two others, and one beyond the site."""
    docs = c.table(spark, sf_dir, "documents")
    n = docs.agg(F.max("doc_id") + 1).first()[0]
    page = lambda x: F.concat(F.lit("/d/"), x.cast("string"))
    targets = F.array(page((2 * F.col("doc_id") + 1) % n), page((F.col("doc_id") + 7) % n), F.concat(F.lit("/other/"), F.col("doc_id").cast("string")))
    return extract.crawl(docs.select(page(F.col("doc_id")).alias("source"), F.explode(targets).alias("target")), "/d/0", prefix="/d/")


@query("SELECT page_id, page_id || ' a+b %c' AS query FROM pages")
def decoded_fragments(spark, sf_dir):
    rows = c.table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace(F.coalesce("url", F.lit("")), "#.*", ""), F.lit("#"), F.col("page_id").cast("string"), F.lit("%20a+b%20%25c")).alias("url"))
    return rows.select("page_id", text.decoded_fragment("url").alias("query"))


@query("""SELECT doc_id, CASE WHEN n + q > 100 THEN array_to_string(w[1:greatest(0, 100 - q - 10)], ' ') ELSE text END AS context FROM (SELECT doc_id, text, regexp_extract_all(text, '[^ \\t\\r\\n]+') AS w, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS n, len(regexp_extract_all(source, '[^ \\t\\r\\n]+')) AS q FROM documents)""")
def token_budget_context(spark, sf_dir):
    return c.table(spark, sf_dir, "documents").select("doc_id", tokens.truncated(F.col("text"), F.col("source"), WORDS, 100).alias("context"))


@query("SELECT * FROM (VALUES ('SELECT ?x' || chr(10) || 'WHERE {?x ?p ?y} # and some more', 'Try this:' || chr(10) || chr(10) || 'end', 'u1', '3')) AS t(query, context, author, score)")
def post_pairs(spark, sf_dir):
    rows = [("u1", 3, "Try this:\n\n```sparql\nSELECT ?x\nWHERE {?x ?p ?y} # and some more\n```\nend"), ("u2", 4, "```\nshort\n```"), (None, 5, "none")]
    return extract.post_pairs(spark.createDataFrame(rows, "author string, score int, body string"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """An extension: event-time windows, in batch."""
    counted = builder.windowed(c.table(spark, sf_dir, "events"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- training curves


@query("""WITH l AS (SELECT o_orderkey AS step, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 100000 END AS eval_loss FROM orders), e AS (SELECT step, step / 1000::DOUBLE AS epoch, exp(eval_loss) AS p FROM l WHERE eval_loss IS NOT NULL),
 w AS (SELECT *, epoch - lag(epoch) OVER (ORDER BY epoch) AS d, lag(p) OVER (ORDER BY epoch) AS pp FROM e)
 SELECT step, round(epoch, 4) AS epoch, round(p, 4) AS perplexity, round(d, 4) AS epoch_delta, round(pp, 4) AS ppl_prev, round(100 * (pp - p) / pp, 4) AS ppl_rel_improv_pct, round(CASE WHEN d <> 0 THEN 100 * (pp - p) / pp / d END, 4) AS ppl_improv_pct_per_epoch FROM w""")
def perplexity_milestones(spark, sf_dir):
    log = c.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 100000).alias("eval_loss"))
    return curves.evaluations(log, 1000)


from . import exchange  # noqa: E402, F401  its queries join these
