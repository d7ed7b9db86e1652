"""Inputs of the queries: tables by name, and small ones that are made of constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNIPPETS = [
    "SELECT a FROM b WHERE c = 1;",
    "MATCH (n) RETURN n",
    "PREFIX wd: <http://x/> SELECT ?x WHERE { ?x ?p ?y . }",
    "please select where you go",
    "CREATE TABLE t (id int)",
    "the place where we met",
    "notes on sql and cypher, for whoever wants them",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a snippet under seven of eight texts, so that each branch of the detectors has rows."""
    snippet = F.element_at(F.array(*map(F.lit, SNIPPETS), F.lit(None)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", snippet).alias("text"))


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """A table of constants: the same VALUES list serves the SQL."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


#: Posts with fenced, indented and no code; a backslash-n stands for a newline in both dialects.
POSTS = """(1, 'Try this:\\n\\n    SELECT ?x\\n    WHERE {?x ?p ?y}\\n\\nor that:\\n\\tASK {?s ?p ?o}\\nend'),
 (2, 'no code here'),
 (3, '    first line only'),
 (4, 'a\\n    one\\n\\n    two\\nb')"""
FORUM_QUESTIONS = """(1, ' How to? ', '<p>I tried</p><code>SELECT ?x WHERE {}</code>', array('sparql')),
 (2, 'Other', '<code>SELECT 1</code>', array('sql', 'rdf')),
 (3, 'No code', '<p>nothing</p>', array('rdf'))"""
FORUM_ANSWERS = """(10, 1, '<p>Use</p><code>ASK {?s ?p ?o}</code>'), (11, 1, '<p>No code</p>'), (12, 3, '<code>prefix x: &lt;u&gt;</code>')"""
WIKI = """('Page', '* [https://w.wiki/abc Cats of the web]\\n* [https://w.wiki/x1 Dogs ]\\nplain'), ('Empty', 'none')"""
GRID_ANSWERS = """('0_t015_1', 'b1', 1, 'm1', ' para one '), ('0_t10_0', 'b1', 2, 'm1', 'para two'), ('2_t045_2', 'b2', 1, 'm2', 'para three'), ('bad', 'b2', 2, 'm2', 'x'), ('1_t030_0', 'b2', 3, 'm2', NULL)"""
LIST_ANSWERS = """('t.json_m1_t05_p1_run0_idx0', 'b', 1, 'm1', 'Sure: ["What is {query}?", "no hole", "Tell {query}"]'),
 ('t.json_m1_t05_p1_run1_idx1', 'b', 2, 'm1', '["Tell {query}", "Cut {query} her'),
 ('t.json_m1_t05_p1_run2_idx2', 'b', 3, 'm1', 'nothing'),
 ('u.json_m2_t05_p1_run0_idx3', 'c', 1, 'm2', '["U {query}"]')"""
PAIRS = """(0, 'q0', 'c0', NULL), (1, 'q1', NULL, ''), (2, 'q2', 'c2', 'labelled'), (3, 'q3', 'c3', NULL)"""
TEMPLATES = """('d1', 'a.json', 0, 'Explain {query}'), ('d1', 'a.json', 1, 'Why {query}?'), ('d1', 'b.json', 0, 'B {query}'), ('d2', 'c.json', 0, 'C {query}'), ('d2', 'c.json', 1, 'D {query}'), ('d2', 'c.json', 2, 'E {query}')"""
LOG = """(100, 2.5D, CAST(NULL AS DOUBLE)), (200, CAST(NULL AS DOUBLE), 2.0D), (400, CAST(NULL AS DOUBLE), 1.5D), (300, 2.1D, CAST(NULL AS DOUBLE)), (600, CAST(NULL AS DOUBLE), 1.6D)"""


def responses(spark: SparkSession, rows: str) -> DataFrame:
    """Rows of constants as nested_responses."""
    return nested_responses(values(spark, rows, "custom_id, file, line, model, answer"))


def nested_responses(flat: DataFrame) -> DataFrame:
    """Rows (custom_id, file, line, model, answer) in the nested form of a batch service; a null answer has no choices."""
    choice = F.struct(F.struct(F.col("answer").alias("content")).alias("message"))
    choices = F.when(F.col("answer").isNotNull(), F.array(choice)).otherwise(F.array().cast("array<struct<message:struct<content:string>>>"))
    return flat.select("custom_id", "file", "line", F.struct(F.struct("model", choices.alias("choices")).alias("body")).alias("response"))
