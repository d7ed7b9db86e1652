"""Queries of readers, writers, tokenizer files and streams: what is written is read back, and streams end as batches do."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysieve.functions import detect, text
from querysieve.operators import audit, balance, curves, extract, tokens
from querysieve.sources import io
from querysieve.streaming import builder

from . import corpus as c
from .queries import _TOK, ANNOTATED, BLOCK, CORPUS, DOC_TOKENS, _packed, query


def folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{io.shared_folder(spark)}/exchange-{uuid.uuid4()}"


# ---- written and read again


@query("SELECT text AS query, lang AS context, source FROM documents")
def jsonl_roundtrip(spark, sf_dir):
    path = folder(spark)
    io.write_jsonl(c.table(spark, sf_dir, "documents").select(F.col("text").alias("query"), F.col("lang").alias("context"), "source"), path)
    return io.read_jsonl(spark, path).where("_corrupt is null").select("query", "context", "source")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf_dir):
    path = folder(spark)
    io.write_csv(c.table(spark, sf_dir, "customer").select("c_name", "c_mktsegment", "c_custkey"), path, ["c_custkey", "c_name", "c_mktsegment"])
    return io.read_csv(spark, path)


@query(f"WITH {DOC_TOKENS}, {_packed('tok')} SELECT block_id::BIGINT AS block_id, input_ids, (block_id // 50)::BIGINT AS chunk_id FROM blocks")
def chunks_merged(spark, sf_dir):
    """Blocks that were written in chunks, as one dataset that knows its chunks."""
    path = folder(spark)
    blocks = tokens.pack(tokens.tokenize(c.table(spark, sf_dir, "documents"), tokens.WordTokenizer()), BLOCK).select("block_id", "input_ids")
    io.write_chunks(blocks.withColumn("chunk_id", F.floor(F.col("block_id") / 50)), f"{path}/all", "clean")
    return io.read_chunks(spark, f"{path}/all", "side=clean", pattern="chunk_dir=chunk_*").select("block_id", "input_ids", "chunk_id")


@query("SELECT c_mktsegment, c_name FROM customer")
def lists_by_key(spark, sf_dir):
    path = folder(spark)
    io.write_lists(c.table(spark, sf_dir, "customer"), path, ["c_mktsegment"], "c_name")
    return spark.read.text(path).select("c_mktsegment", F.explode(F.from_json("value", "array<string>")).alias("c_name"))


@query("SELECT n_nationkey, n_name, 1 AS n_writes FROM nation")
def written_once(spark, sf_dir):
    """A second writer finds a whole result and leaves it; a copy is shared."""
    path = folder(spark)
    nations = c.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n = sum(io.write_if_absent(df, f"{path}/a") for df in (nations, nations.limit(1)))
    target = io.share(spark, io.share(spark, f"{path}/a", "", "reference"), f"{path}/b", "copy")
    return io.read_parquet(spark, target).withColumn("n_writes", F.lit(n))


@query("SELECT * FROM (VALUES ('a.json', 0, 'Explain {query}', 'about a', 2), ('a.json', 1, 'Why {query}?', 'about a', 2), ('b.json', 0, 'B {query}', 'about b', 0)) AS t(file, pos, template, description, n_tags)")
def template_files(spark, sf_dir):
    """Files of JSON arrays, and the one that describes them."""
    path = folder(spark)
    for name, value in (("a.json", '["Explain {query}", "Why {query}?"]'), ("b.json", '["B {query}"]'), ("!data_info.json", '{"a.json": {"description": "about a", "tags": ["x", "y"]}, "b.json": {"description": "about b", "tags": []}}')):
        io.put_text(spark, f"{path}/{name}", value)
    info = io.read_template_info(spark, f"{path}/!data_info.json")
    return io.read_templates(spark, path).join(F.broadcast(info), "file").select("file", "pos", "template", "description", F.size("tags").alias("n_tags"))  # one row a file


@query("SELECT * FROM (VALUES ('batch_1.jsonl', 'file-a'), (NULL, 'file-b'), ('batch_2.jsonl', 'file-c')) AS t(name, file_id)")
def ledger_lines(spark, sf_dir):
    path = folder(spark)
    io.put_text(spark, f"{path}/ledger.txt", "batch_1.jsonl file-a\n\n  file-b\nbatch_2.jsonl\tfile-c extra\n")
    return io.read_ledger(spark, f"{path}/ledger.txt")


@query("SELECT doc_id, lang AS about_lang, n_chars AS about_n_chars, lang AS same FROM documents")
def nested_fields(spark, sf_dir):
    rows = c.table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", "n_chars").alias("about"))
    return rows.select("doc_id", *io.flattened("about", ["lang", "n_chars"]), io.nested("about.lang").alias("same"))


# ---- tokenizers with a way back

_WORDS = ["the", "and", "of", "select", "from", "where", "de", "la", "und", "der"]


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+') AS w FROM documents)
 SELECT doc_id, list_transform(w, lambda x: coalesce(list_position({_WORDS}, x), 0) + 2)::INTEGER[] AS input_ids, array_to_string(list_filter(w, lambda x: list_contains({_WORDS}, x)), ' ') AS decoded FROM w""")
def table_tokens(spark, sf_dir):
    tool = tokens.TableTokenizer(tuple(_WORDS))
    rows = tokens.tokenize(c.table(spark, sf_dir, "documents"), tool)
    return rows.select("doc_id", "input_ids", tool.text(F.col("input_ids")).alias("decoded"))


@query("SELECT doc_id, text AS decoded FROM documents WHERE text IS NOT NULL")
def file_tokens_decoded(spark, sf_dir):
    """A tokenizer file's ids lead back to the text."""
    import public_tokenizers

    tool = tokens.FileTokenizer.of(public_tokenizers.path("byte_bpe_50k.json"))
    rows = tokens.tokenize(c.table(spark, sf_dir, "documents").where("text is not null"), tool)
    return rows.where(tokens.in_range(F.col("input_ids"), tool.vocabulary) | (F.size("input_ids") == 0)).select("doc_id", tool.text(F.col("input_ids")).alias("decoded"))


# ---- expressions that no other query has


@query(f"WITH {CORPUS} SELECT doc_id, len(list_filter(['from schema', 'join', 'where', 'match', 'merge', 'return', 'create', 'insert', 'delete'], lambda k: contains(lower(text || ' ' || doc_id), k))) > 0 AS active, false AS inactive FROM corpus")
def other_language_marks(spark, sf_dir):
    docs = c.corpus(spark, sf_dir)
    number = F.col("doc_id").cast("string")
    return docs.select("doc_id", detect.is_other_language("text", number, active=True).alias("active"), detect.is_other_language("text", number).alias("inactive"))


@query(f"WITH {ANNOTATED} SELECT doc_id, '{{' || array_to_string(list_transform(list_sort(kws), lambda k: '\"' || k || '\": ' || len(list_filter(uses, lambda u: u = k))), ', ') || '}}' AS counts, len(uses)::BIGINT AS n FROM ann")
def count_maps(spark, sf_dir):
    """Maps of counts as JSON text, and read from it."""
    rows = detect.annotate(c.corpus(spark, sf_dir)).select("doc_id", detect.sorted_json("keyword_counts").alias("counts"))
    return rows.withColumn("n", F.aggregate(F.map_values(detect.parse_counts("counts")), F.lit(0).cast("long"), lambda a, x: a + x))


@query("SELECT page_id, 'https://site.example' || '/p/' || page_id AS link FROM pages")
def permalinks(spark, sf_dir):
    return c.table(spark, sf_dir, "pages").select("page_id", extract.permalink(F.concat(F.lit("/p/"), F.col("page_id").cast("string")), "https://site.example/").alias("link"))


@query("SELECT doc_id, lang || ' and ' || source || ' too' AS plain FROM documents")
def wiki_plain(spark, sf_dir):
    """Markup put round words, and taken off again."""
    marked = F.concat(F.lit("'''"), "lang", F.lit("''' and [[Target|"), "source", F.lit("]]{{cite|x}} ''too''"))
    return c.table(spark, sf_dir, "documents").select("doc_id", text.strip_wiki(marked).alias("plain"))


@query("SELECT o_orderkey AS step, round(o_orderkey / 1000::DOUBLE, 4) AS epoch, round(exp(o_totalprice / 100000), 4) AS perplexity FROM orders WHERE o_orderkey % 3 <> 0")
def training_series(spark, sf_dir):
    log = c.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 100000).alias("loss"))
    return curves.training(log, 1000)


# ---- streams


def _streamed(spark: SparkSession, rows: DataFrame, change, mode: str) -> DataFrame:
    """What a stream over rows, in several files, ends with."""
    path = folder(spark)
    (rows if rows.rdd.getNumPartitions() > 3 else rows.repartition(3)).write.parquet(f"{path}/in")  # of many ranges, each is a file as it is
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    out = change(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/at")
    put = lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")
    out.foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query(f"WITH {ANNOTATED} SELECT trigger, count(*) AS n FROM ann GROUP BY 1")
def stream_running_counts(spark, sf_dir):
    return _streamed(spark, c.corpus(spark, sf_dir), builder.running_counts, "complete")


@query("SELECT DISTINCT lang, source FROM documents")
def stream_first_seen(spark, sf_dir):
    return _streamed(spark, c.table(spark, sf_dir, "documents").select("lang", "source"), lambda s: builder.first_seen(s, ["lang", "source"]), "append")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, sf_dir):
    events = c.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = _streamed(spark, events, lambda s: builder.windowed(s, late="3650 days"), "complete")
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_KEPT = f"""{ANNOTATED}, tk AS (SELECT doc_id, {_TOK} AS ids, NOT is_dirty AS c, r AS d FROM ann),
 b AS (SELECT *, coalesce(sum(CASE WHEN c THEN len(ids) ELSE 0 END) OVER w, 0) AS bc, coalesce(sum(CASE WHEN d THEN len(ids) ELSE 0 END) OVER w, 0) AS bd FROM tk WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 e AS (SELECT CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END AS stop FROM (SELECT min(doc_id) FILTER (bc + CASE WHEN c THEN len(ids) ELSE 0 END >= {80 * BLOCK}) AS x, min(doc_id) FILTER (bd + CASE WHEN d THEN len(ids) ELSE 0 END >= {20 * BLOCK}) AS y FROM b)),
 kc AS (SELECT doc_id, ids FROM b, e WHERE c AND bc < {80 * BLOCK} AND (stop IS NULL OR doc_id <= stop)), kd AS (SELECT doc_id, ids FROM b, e WHERE d AND bd < {20 * BLOCK} AND (stop IS NULL OR doc_id <= stop))"""


def _side(source: str) -> str:
    return _packed(source).replace("flat", f"flat_{source}").replace("spot", f"spot_{source}").replace("blocks", f"blocks_{source}")


@query(f"""WITH {_KEPT}, {_side('kc')}, {_side('kd')} SELECT 'clean' AS side, block_id::BIGINT AS block_id, input_ids FROM blocks_kc WHERE block_id < 80 UNION ALL SELECT 'dirty', block_id::BIGINT, input_ids FROM blocks_kd WHERE block_id < 20""")
def stream_built_blocks(spark, sf_dir):
    """The one-pass builder over a stream of several files in the order of ids."""
    path = folder(spark)
    docs = io.settle(c.corpus(spark, sf_dir))
    n = docs.agg(F.max("doc_id")).first()[0] + 1
    for i in range(3):  # files that a stream takes one after the other
        docs.where(f"doc_id >= {i * n // 3} and doc_id < {(i + 1) * n // 3}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    made = builder.Builder(f"{path}/out", balance.targets(100 * BLOCK, 0.2, BLOCK), size=BLOCK, sample_size=3)
    made.run(io.read_stream(spark, f"{path}/in"))
    sides = [made.blocks(spark, s).select(F.lit(s).alias("side"), "block_id", "input_ids") for s in builder.SIDES]
    return sides[0].unionByName(sides[1])


@query(f"""WITH {_KEPT} SELECT count(*) AS n_total, count(*) FILTER (is_dirty) AS n_dirty, count(*) FILTER (NOT is_dirty) AS n_clean, count(*) FILTER (trigger = 'keyword_only') AS keyword_only, count(*) FILTER (trigger = 'regex_only') AS regex_only FROM ann WHERE doc_id < 90""")
def stream_counters_of_the_first(spark, sf_dir):
    """A builder that is told to see no more than so many documents."""
    path = folder(spark)
    c.corpus(spark, sf_dir).where("doc_id >= 0").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/in")
    made = builder.Builder(f"{path}/out", balance.targets(10**6 * BLOCK, 0.2, BLOCK), size=BLOCK, sample_size=3, most=90)
    made.run(io.read_stream(spark, f"{path}/in", files=10**6))  # one batch: several would take files in the order of their writing
    state = made.state(spark)
    names = ("n_total", "n_dirty", "n_clean", "keyword_only", "regex_only")
    return spark.createDataFrame([tuple(state[x] for x in names)], ", ".join(f"{x} long" for x in names))


@query(f"WITH {ANNOTATED} SELECT count(*) AS n_total, count(*) FILTER (is_dirty) AS n_dirty, count(*) FILTER (NOT is_dirty) AS n_clean, true AS has_time FROM ann")
def summary_with_time(spark, sf_dir):
    """The audit's totals out of the JSON text that a command prints, which names when it was made in UTC."""
    made = spark.createDataFrame([(audit.summary(audit.totals(detect.annotate(c.corpus(spark, sf_dir)))),)], "s string")
    fields = F.from_json("s", "n_total long, n_dirty long, n_clean long, generated_at_utc string")
    return made.select(fields.alias("j")).select("j.n_total", "j.n_dirty", "j.n_clean", F.col("j.generated_at_utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("has_time"))
