"""Commands: python -m querysieve COMMAND [options]; --list names them."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from querysieve.functions import detect
from querysieve.operators import audit, balance, curves, extract, labels, sample, tokens
from querysieve.operators.order import id_bucket, running_total, with_row_ids
from querysieve.sources import io

#: Corpora by key, with what their files are called under the root; unknown keys are an error.
DATASETS = {"openwebtext": "openwebtext", "openwebtext-10k": "openwebtext-10k", "openwebtext-dirty": "openwebtext-dirty", "openwebtext-injected": "openwebtext-injected", "c4-realnewslike": "c4-realnewslike", "c4-dirty": "c4-dirty"}
COMMANDS: dict[str, tuple[Callable, Callable]] = {}


def dataset(key: str) -> str:
    if key not in DATASETS:
        raise ValueError(f"unknown dataset {key!r}; known: {', '.join(DATASETS)}")
    return DATASETS[key]


def command(name: str, options: Callable[[argparse.ArgumentParser], None]):
    def add(f):
        COMMANDS[name] = options, f
        return f

    return add


def tokenizer(p: argparse.ArgumentParser) -> None:
    p.add_argument("--tokenizer", help="a tokenizers JSON or sentencepiece model file that executors can read; words by default")


def tool_of(a) -> tokens.Tokenizer:
    return tokens.FileTokenizer.of(a.tokenizer) if a.tokenizer else tokens.WordTokenizer()


def first_docs(docs, n: int | None):
    """The n documents of least id."""
    if n is None:
        return docs
    return running_total(docs, id_bucket("doc_id"), ["doc_id"], F.lit(1).cast("long"), "_place").where(F.col("_place") < n).drop("_place")


def _in_out(p: argparse.ArgumentParser) -> None:
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--overwrite", action="store_true")


def _prepare(p):
    _in_out(p)
    p.add_argument("--block-size", type=int, default=512)
    p.add_argument("--test-size", type=int, default=10_000)
    p.add_argument("--batch", type=int, default=1000)
    p.add_argument("--max-docs", type=int)
    p.add_argument("--seed", type=int, default=42)
    tokenizer(p)


@command("prepare", _prepare)
def prepare(spark: SparkSession, a) -> None:
    """Split, annotate, tokenize, pack and balance a corpus."""
    docs = first_docs(io.read_parquet(spark, a.input), a.max_docs)
    parts = sample.split(docs, "doc_id", a.test_size, a.seed)
    tool = tool_of(a)
    pack = lambda df: tokens.pack_per_batch(tokens.tokenize(df, tool, add_eos=True), a.block_size, a.batch)
    io.write_parquet(pack(parts.where("split = 'dev'")), io.path_of(a.output, "shared_dev_grouped"), a.overwrite)
    train = detect.annotate(parts.where("split = 'train'").select("doc_id", "text"))
    sides = [io.settle(pack(train.where(c)).withColumn("id", F.xxhash64("batch", "block_id"))) for c in (~F.col("is_dirty"), F.col("is_dirty"))]
    both = balance.balance(*sides, seed=a.seed, key="id")
    for side, name in (("clean", "final_clean_grouped"), ("dirty", "final_dirtymatched_grouped")):
        io.write_parquet(both.where(F.col("side") == side), io.path_of(a.output, name), a.overwrite)
    print(io.summary_json(audit.balance_stats(both)))


def _merge(p):
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--side", default="clean")
    p.add_argument("--max-chunks", type=int, help="chunks from the first on, at most")
    p.add_argument("--overwrite", action="store_true")


@command("merge-chunks", _merge)
def merge_chunks(spark, a) -> None:
    """Chunks of a side as one dataset, in their order."""
    chunks = io.read_chunks(spark, a.input, a.side)
    if a.max_chunks is not None:
        first = chunks.select("chunk_id").distinct().orderBy("chunk_id").limit(a.max_chunks)
        chunks = chunks.join(F.broadcast(first), "chunk_id")  # a number a chunk
    io.write_parquet(chunks, a.output, a.overwrite)
    print(io.summary_json(tokens.stats(io.read_parquet(spark, a.output))))


def _inject(p):
    p.add_argument("--blocks", required=True)
    p.add_argument("--pool", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--proportion", type=float, default=0.1)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--overwrite", action="store_true")


@command("inject", _inject)
def inject(spark, a) -> None:
    """Random blocks replaced by those of a pool."""
    io.write_parquet(balance.inject(io.read_parquet(spark, a.blocks), io.read_parquet(spark, a.pool), a.proportion, a.seed), a.output, a.overwrite)


def _audit(p):
    _in_out(p)
    p.add_argument("--max-docs", type=int)
    p.add_argument("--sample-size", type=int, default=40)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--audit-grouped", nargs="*", default=[], metavar="SIDE=PATH", help="packed blocks to decode and audit strictly; needs --tokenizer")
    tokenizer(p)


@command("audit", _audit)
def run_audit(spark, a) -> None:
    """Counters, reports, samples and rows for manual review."""
    if a.audit_grouped and not a.tokenizer:
        raise ValueError("blocks are decoded by the tokenizer file that made them: give --tokenizer")
    docs = first_docs(io.read_parquet(spark, a.input), a.max_docs)
    rows = detect.annotate(docs.select("doc_id", "text"))
    records = audit.samples(rows, a.sample_size, seed=a.seed)
    io.write_jsonl(records, f"{a.output}/samples", a.overwrite)
    review = audit.manual_review(records)
    io.write_csv(review, f"{a.output}/manual_review", review.columns, a.overwrite)
    report = audit.keyword_report(rows)
    io.write_csv(report, f"{a.output}/keywords", report.columns, a.overwrite)
    for side, path in (x.split("=", 1) for x in a.audit_grouped):
        blocks = io.read_parquet(spark, path).withColumn("side", F.lit(side))
        io.write_jsonl(audit.grouped_audit(blocks, tool_of(a)), f"{a.output}/grouped_{side}", a.overwrite)
    print(audit.summary(audit.totals(rows)))


def _hydrate(p):
    p.add_argument("--review", required=True)
    p.add_argument("--corpus", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--window", type=int, default=160)
    p.add_argument("--overwrite", action="store_true")


@command("hydrate", _hydrate)
def hydrate(spark, a) -> None:
    """Review rows with their texts."""
    out = audit.hydrate(io.read_csv(spark, a.review), io.read_parquet(spark, a.corpus), a.window)
    io.write_csv(out, a.output, out.columns, a.overwrite)


def _build(p):
    _in_out(p)
    p.add_argument("--target-tokens", type=int)
    p.add_argument("--target-stats", help="a JSON file with the token target")
    p.add_argument("--target-field", default="final_clean.n_tokens", help="where in it, dotted")
    p.add_argument("--block-size", type=int, default=512)
    p.add_argument("--dirty-rate", type=float, default=0.1)
    p.add_argument("--mode", default="regex", choices=["regex", "strict", "regex_or_strict", "keyword_or_regex"])
    p.add_argument("--exclude-strict", action="store_true")
    p.add_argument("--clean-pool", type=float, default=1.0)
    p.add_argument("--dirty-pool", type=float, default=1.0)
    p.add_argument("--sample-size", type=int, default=400)
    p.add_argument("--max-samples", type=int, help="documents that are looked at, at most")
    tokenizer(p)


def target_tokens(a) -> int:
    if a.target_tokens:
        return a.target_tokens
    if not a.target_stats:
        raise ValueError("give --target-tokens or --target-stats")
    with open(a.target_stats) as f:
        value = json.load(f)
    for part in a.target_field.split("."):
        value = value[part]
    return int(value)


@command("build", _build)
def build(spark, a) -> None:
    """The one-pass builder over a folder of Parquet files as a stream; run again, it goes on where it ended."""
    from querysieve.streaming.builder import Builder

    total = target_tokens(a) // a.block_size * a.block_size
    want = balance.targets(total, a.dirty_rate, a.block_size, a.clean_pool, a.dirty_pool)
    builder = Builder(a.output, want, size=a.block_size, mode=a.mode, exclude_strict=a.exclude_strict, sample_size=a.sample_size, tokenizer=tool_of(a), most=a.max_samples)
    builder.run(io.read_stream(spark, a.input))
    print(json.dumps({k: v for k, v in builder.state(spark).items() if not k.endswith("_left")}, indent=2))


@command("stream-clean", _build)
def stream_clean(spark, a) -> None:
    """The builder with a clean side only."""
    a.dirty_rate = 0.0
    build(spark, a)


def _mix(p):
    p.add_argument("--clean", required=True)
    p.add_argument("--dirty", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--total-tokens", type=int, required=True)
    p.add_argument("--dirty-rate", type=float, required=True)
    p.add_argument("--block-size", type=int, default=512)
    p.add_argument("--overwrite", action="store_true")


@command("mix", _mix)
def mix(spark, a) -> None:
    """The heads of two pools at a rate."""
    io.write_parquet(balance.mix(io.read_parquet(spark, a.clean), io.read_parquet(spark, a.dirty), a.total_tokens, a.dirty_rate, a.block_size), a.output, a.overwrite, by=["side"])


def _pairs(p):
    _in_out(p)
    p.add_argument("--block-size", type=int, default=512)
    p.add_argument("--dev-size", type=int, default=100)
    tokenizer(p)


@command("prepare-pairs", _pairs)
def prepare_pairs(spark, a) -> None:
    """JSON lines of (query, context) pairs as packed blocks."""
    pairs = labels.normalise(io.read_jsonl(spark, a.input)).select(F.col("query"), labels.training_text().alias("text"))
    rows = sample.split(with_row_ids(pairs, ["query", "text"], "doc_id"), "doc_id", a.dev_size)
    for part in ("dev", "train"):
        packed = tokens.pack(tokens.tokenize(rows.where(F.col("split") == part), tool_of(a), add_eos=True), a.block_size)
        io.write_parquet(packed, f"{a.output}/{part}", a.overwrite)


def _perplexity(p):
    _in_out(p)
    p.add_argument("--steps-per-epoch", type=int, required=True)


@command("perplexity", _perplexity)
def perplexity(spark, a) -> None:
    """Perplexities of a trainer's state as CSV."""
    rows = curves.evaluations(curves.log_rows(io.read_json(spark, a.input, io.TRAINER)), a.steps_per_epoch)
    io.write_csv(rows.orderBy("step"), a.output, rows.columns, a.overwrite)


def _requests(p):
    _in_out(p)
    p.add_argument("--template", required=True, help="a prompt with {query}, {context} and, with several models, {post_type}")
    p.add_argument("--more-templates", nargs="*", default=[])
    p.add_argument("--models", nargs="+", required=True)
    p.add_argument("--temperatures", nargs="*", type=float, default=[])
    p.add_argument("--max-tokens", type=int, default=200)


def _numbered(spark, path: str):
    """Pairs out of JSON lines, numbered in the order of their texts."""
    rows = io.read_jsonl(spark, path).where("_corrupt is null")
    pairs = labels.normalise(rows.withColumn("kind", F.coalesce("post_type", F.lit("question")))).select("query", "context", "target", F.col("kind").alias("post_type"))
    return with_row_ids(pairs, ["query", "context", "target"])


@command("batch-requests", _requests)
def batch_requests(spark, a) -> None:
    """Requests for a batch service: one for each pair without a target, or one for each model and temperature."""
    pairs = _numbered(spark, a.input)
    if len(a.models) == 1 and not a.temperatures and not a.more_templates:
        made = labels.requests(pairs, a.template, a.models[0], max_tokens=a.max_tokens)
    else:
        made = labels.request_grid(pairs, [a.template, *a.more_templates], a.models, a.temperatures or [0.4], max_tokens=a.max_tokens)
    io.write_jsonl(made, a.output, a.overwrite)


def _answers(p):
    p.add_argument("--pairs", required=True)
    p.add_argument("--answers", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--all", action="store_true", help="all answers to a pair as a list; the last one by default")
    p.add_argument("--overwrite", action="store_true")


@command("merge-answers", _answers)
def merge_answers(spark, a) -> None:
    """A batch service's answers merged into the pairs that were asked about."""
    from pyspark.sql import Window as W

    answers = io.read_jsonl(spark, a.answers, io.RESPONSES).where("_corrupt is null")
    answers = answers.withColumn("line", F.row_number().over(W.partitionBy("file").orderBy("custom_id", F.to_json("response"))))
    merge = labels.merge_paraphrases if a.all else labels.merge_last_wins
    io.write_jsonl(merge(_numbered(spark, a.pairs), answers), a.output, a.overwrite)


def _extract(p):
    _in_out(p)
    p.add_argument("--kind", required=True, choices=["forum", "posts", "wiki", "pages"])
    p.add_argument("--answers", help="the answers to the questions that forum reads")


@command("extract", _extract)
def run_extract(spark, a) -> None:
    """(query, context) pairs out of a forum's questions and answers, posts, wiki text or pages, from Parquet."""
    rows = io.read_parquet(spark, a.input)
    if a.kind == "forum":
        if not a.answers:
            raise ValueError("forum needs --answers")
        out = extract.forum_pairs(rows, io.read_parquet(spark, a.answers))
    elif a.kind == "posts":
        out = extract.post_pairs(rows)
    elif a.kind == "wiki":
        out = extract.wiki_pairs(rows)
    else:
        out = extract.nearest_before(extract.elements(rows), F.col("tag") == "pre", F.col("tag").isin("h1", "h2", "h3", "h4", "p"))
    io.write_jsonl(out, a.output, a.overwrite)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] == "--list":
        print("\n".join(f"{name}: {f.__doc__}" for name, (_, f) in COMMANDS.items()))
        return 0 if argv else 1
    if argv[0] not in COMMANDS:
        print(f"unknown command {argv[0]!r}; --list names them", file=sys.stderr)
        return 1
    options, run = COMMANDS[argv[0]]
    parser = argparse.ArgumentParser(prog=f"querysieve {argv[0]}", description=run.__doc__)
    options(parser)
    args = parser.parse_args(argv[1:])
    from querysieve.session import ship

    run(ship(SparkSession.builder.getOrCreate()), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
