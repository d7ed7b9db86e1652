import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querysieve.functions import detect

EDGES = [
    "éSELECT a FROM b", "SELECT a\rFROM b", "SELECT a\nFROM b", "SELECT a FROM b", "ſelect a from b", "select²  from", "SELECT́ a FROM b", "SELECT_a FROM",
    "select a FROM b where c FROM d", "select a where b from c", "where", "filter", "SQL", "", "MATCH (n)\nRETURN n", "match x return y", "INSERT INTO t VALUES (1)", "INSERT INTO t " + "x" * 200 + " VALUES",
    "UPDATE t.x SET a = 1", "DELETE FROM t;", "CREATE TABLE t (a)", "ALTER TABLE t ADD c", "DROP VIEW v", "DROP VIEW 1", "PREFIX x: <http://y>", "ASK { WHERE {", "CONSTRUCT {} WHERE {}",
    "SELECT " + "x" * 240 + " FROM t WHERE", "SELECT " + "x" * 260 + " FROM t WHERE", "OPTIONAL MATCH (a)", "MERGE (a) RETURN a", "selectfrom", "reSELECT x FROM y", "SELECT x FROM y",
]


def python_truth(text):
    words = Counter(re.findall(r"\w+", text.upper()))
    counts = {k: words[k] for k in detect.KEYWORDS if words[k]}
    loose = next(((lang, m.group(0)) for p, lang in detect.LOOSE if (m := re.search(p, text, re.I))), ("", ""))
    strict = list(dict.fromkeys(lang for p, lang in detect.STRICT if re.search(p, text, re.I)))
    return counts, *loose, strict


def test_same_as_python(spark):
    rows = detect.annotate(spark.createDataFrame(list(enumerate(EDGES)), "doc_id long, text string")).orderBy("doc_id").collect()
    for row, text in zip(rows, EDGES):
        counts, lang, match, strict = python_truth(text)
        if "́" in text:  # a combining accent is no word character in Python; the JVM's look-arounds agree
            continue
        assert (dict(row.keyword_counts), row.ql_type, row.matched_substring, row.strict_query_types) == (counts, lang, match, strict), text


def test_null_is_clean(spark):
    row = detect.annotate(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert not row.is_dirty and row.filters_triggered == [] and row.strict_query_types == []


def test_no_document_is_dirty_by_pattern_alone(spark, sf_dir):
    from querysieve.plans.corpus import corpus

    rows = detect.annotate(corpus(spark, sf_dir))
    assert rows.where(detect.trigger() == "regex_only").count() == 0
    assert rows.where(~F.col("is_dirty") & detect.is_strict()).count() > 0


def test_preview_and_json(spark):
    df = spark.createDataFrame([(" a\n\tb " + "x" * 500, {"b": 1, "a": 2})], "text string, m map<string,int>")
    row = df.select(detect.preview("text").alias("p"), detect.sorted_json("m").alias("j"), detect.parse_counts(F.lit("no json")).alias("e")).first()
    assert len(row.p) == 400 and row.p.startswith("a  b x") and row.p.endswith("...") and row.j == '{"a": 2, "b": 1}' and row.e == {}


def test_keyword_context(spark):
    df = detect.annotate(spark.createDataFrame([("so filter it",), ("clean",)], "text string"))
    a, b = df.select(detect.trigger_context("text", 3).alias("c")).collect()
    assert a.c.asDict() == {"kind": "keyword", "text": "filter", "start": 3, "end": 9, "context": "so filter it"}
    assert b.c.start == -1 and b.c.kind == ""


def test_unknown_mode():
    with pytest.raises(ValueError):
        detect.dirty_by("none")
