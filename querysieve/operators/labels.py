"""Requests for a model's batch service, and its answers merged back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.functions import text

from . import sample

URL = "/v1/chat/completions"
#: Templates, and characters of them, that every task may be sent.
MOST, MOST_CHARACTERS = 100_000, 16_000_000


def normalise(pairs: DataFrame, keep_type: bool = False) -> DataFrame:
    """query, context, target; missing ones empty. keep_type: post_type too, a question by default."""
    out = [F.col("query"), F.coalesce("context", F.lit("")).alias("context"), F.coalesce("target", F.lit("")).alias("target")]
    if keep_type:
        pairs = pairs.where(F.col("query").isNotNull() & F.col("context").isNotNull())
        out.append(F.coalesce("post_type", F.lit("question")).alias("post_type"))
    return pairs.select(*[c for c in pairs.columns if c not in ("query", "context", "target", "post_type")], *out)


def training_text(query: str = "query", context: str = "context") -> Column:
    """The query and, if there is one, the context under it."""
    c = F.coalesce(F.col(context), F.lit(""))
    return F.when(c != "", F.concat(F.col(query), F.lit("\n"), c)).otherwise(F.col(query))


def unlabelled(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.coalesce("target", F.lit("")) == "")


def request(custom_id: Column, prompt: Column, model: Column | str, max_tokens: int, temperature: Column | float) -> list[Column]:
    """The columns of one request."""
    model = F.lit(model) if isinstance(model, str) else model
    temperature = temperature if isinstance(temperature, Column) else F.lit(temperature)
    message = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    body = F.struct(model.alias("model"), message.alias("messages"), F.lit(max_tokens).alias("max_tokens"), temperature.cast("double").alias("temperature"))
    return [custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(URL).alias("url"), body.alias("body")]


def requests(pairs: DataFrame, template: str, model: str, key: str = "idx", max_tokens: int = 200, temperature: float = 0.4) -> DataFrame:
    """One request for each pair without a target; its id is the pair's number."""
    prompt = text.fill(F.lit(template), query=F.col("query"), context=F.col("context"))
    return unlabelled(pairs).select(*request(F.col(key).cast("string"), prompt, model, max_tokens, temperature))


def request_grid(pairs: DataFrame, prompts: list[str], models: list[str], temperatures: list[float], key: str = "idx", max_tokens: int = 250) -> DataFrame:
    """Requests for every model and temperature, each with a prompt that the pair's number chooses.

    The grid is a constant of models x temperatures and the prompts a constant array: rows are exploded, not joined.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("temperature")) for m in models for t in temperatures]))
    rows = unlabelled(pairs).withColumn("g", grid)
    rows = rows.withColumn("p", sample.choose(F.concat_ws("/", F.col(key).cast("string"), "g.model", F.col("g.temperature").cast("string")), len(prompts), "prompt").cast("int"))
    template = F.element_at(F.array(*map(F.lit, prompts)), F.col("p") + 1)
    prompt = text.fill(template, query=F.col("query"), context=F.col("context"), post_type=F.coalesce("post_type", F.lit("question")))
    custom_id = F.concat(F.col(key).cast("string"), F.lit("_t"), text.temperature_tag(F.col("g.temperature")), F.lit("_"), F.col("p").cast("string"))
    return rows.select(*request(custom_id, prompt, F.col("g.model"), max_tokens, F.col("g.temperature")))


def paraphrase_requests(templates: DataFrame, info: DataFrame, prompt: str, model: str, temperatures: list[float], runs: int, examples: int = 20, completions: int = 20, variant: int = 1, seed: int = 42) -> DataFrame:
    """Requests for more templates like a file's: its description, tags and a sample of its templates, for each temperature and run.

    Files without metadata are left out. The sample of a run is those of least hash.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.lit(r).alias("run")) for t in temperatures for r in range(runs)]))
    rows = templates.join(info, "file").withColumn("g", grid)
    hashed = F.md5(F.concat_ws(":", "file", F.col("pos").cast("string"), F.col("g.temperature").cast("string"), F.col("g.run").cast("string"), F.lit(str(seed))))
    drawn = rows.groupBy("file", "description", "tags", "g.temperature", "g.run").agg(F.slice(F.sort_array(F.collect_list(F.struct(hashed.alias("h"), "template"))), 1, examples)["template"].alias("examples"))
    body = text.fill(F.lit(prompt), description=F.col("description"), tags=F.array_join("tags", ", "), examples=F.to_json("examples"), N=F.lit(completions))
    number = F.dense_rank  # ids count through files, temperatures and runs
    from pyspark.sql import Window as W

    drawn = drawn.withColumn("n", number().over(W.orderBy("file", "temperature", "run")) - 1)  # files x temperatures x runs: a few rows
    custom_id = F.concat("file", F.lit(f"_{model}_t"), text.temperature_tag(F.col("temperature")), F.lit(f"_p{variant}_run"), F.col("run").cast("string"), F.lit("_idx"), F.col("n").cast("string"))
    return drawn.select(*request(custom_id, body, model, 5000, F.col("temperature")))


def content() -> Column:
    """The answer in a response; null where it is malformed."""
    return F.get(F.col("response.body.choices"), F.lit(0))["message"]["content"]


def merge_last_wins(pairs: DataFrame, responses: DataFrame, key: str = "idx") -> DataFrame:
    """pairs with the last answer by (file, line) as target, and an error where there is none.

    Targets that are there stay. An answer that is malformed, or missing, leaves the target empty.
    """
    last = sample.last_wins(responses.select("custom_id", content().alias("answer"), "file", "line"), "custom_id", "file", "line")
    both = pairs.join(last.select(F.col("custom_id").alias("_id"), "answer", F.lit(True).alias("_there")), F.col(key).cast("string") == F.col("_id"), "left")
    labelled = F.coalesce("target", F.lit("")) != ""
    error = F.when(labelled, "").when(F.col("_there").isNull(), "missing").when(F.col("answer").isNull(), "malformed").otherwise("")
    return both.select(*[c for c in pairs.columns if c != "target"], F.when(labelled, F.col("target")).otherwise(F.coalesce(text.strip("answer"), F.lit(""))).alias("target"), error.alias("error"))


def merge_paraphrases(pairs: DataFrame, responses: DataFrame, key: str = "idx") -> DataFrame:
    """pairs with all paraphrases as an array of structs in the order of (file, line); an empty one without any."""
    parsed = text.parse_request_id("custom_id")
    one = F.struct(
        "file", "line", text.strip(content()).alias("paraphrase"), F.col("response.body.model").alias("model"), parsed["temperature"].alias("temperature"),
        "custom_id", F.col("file").alias("batch_file"), parsed["prompt"].alias("prompt_template_index"),
    )
    good = responses.where(content().isNotNull() & parsed["idx"].isNotNull() & parsed["temperature"].isNotNull())
    kept = ("paraphrase", "model", "temperature", "custom_id", "batch_file", "prompt_template_index")
    lists = good.groupBy(parsed["idx"].alias("_i")).agg(F.array_sort(F.collect_list(one)).alias("_p"))
    lists = lists.select("_i", F.transform("_p", lambda x: F.struct(*[x[k].alias(k) for k in kept])).alias("paraphrases"))
    out = pairs.join(lists, F.col(key) == F.col("_i"), "left").drop("_i")
    kind = dict(lists.dtypes)["paraphrases"]
    return out.withColumn("paraphrases", F.coalesce("paraphrases", F.array().cast(kind)))


def merge_template_lists(responses: DataFrame) -> DataFrame:
    """template_file, model, templates: lists out of answers, those with {query}, equal ones once, in order of appearance."""
    parts = F.split("custom_id", "_")
    rows = responses.select(F.get(parts, F.lit(0)).alias("template_file"), F.get(parts, F.lit(1)).alias("model"), "file", "line", text.repaired_list(content()).alias("items"))
    rows = rows.where("items is not null").select("template_file", "model", "file", "line", F.posexplode("items").alias("pos", "item")).where(F.col("item").contains("{query}"))
    first = rows.groupBy("template_file", "model", "item").agg(F.min(F.struct("file", "line", "pos")).alias("at"))
    return first.groupBy("template_file", "model").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("templates"))


def malformed(responses: DataFrame) -> DataFrame:
    """n, n_malformed."""
    return responses.agg(F.count("*").alias("n"), F.count_if(content().isNull()).alias("n_malformed"))


def fill_templates(queries: DataFrame, templates: DataFrame, key: str = "idx") -> DataFrame:
    """queries with a context from a template that the key chooses: a folder, a file in it, a template in that, evenly.

    templates: folder, file, pos, template. Their numbers within folder and file make the choice an equi-join. Up to MOST
    templates go to every task; more are joined by their numbers, which are many then.
    """
    from pyspark.sql import Window as W

    few = templates.limit(MOST + 1).count() <= MOST and (templates.agg(F.sum(F.length("template"))).first()[0] or 0) <= MOST_CHARACTERS
    sent = F.broadcast if few else (lambda df: df)
    numbered = templates.select(
        "folder", "file", "template",
        (F.dense_rank().over(W.orderBy("folder")) - 1).alias("nd"),
        (F.dense_rank().over(W.partitionBy("folder").orderBy("file")) - 1).alias("nf"),
        (F.row_number().over(W.partitionBy("folder", "file").orderBy("pos")) - 1).alias("nt"),
    )
    folders = numbered.agg((F.max("nd") + 1).alias("dirs"))
    files = numbered.groupBy("nd").agg((F.max("nf") + 1).alias("files"))
    sizes = numbered.groupBy("nd", "nf").agg((F.max("nt") + 1).alias("texts"))
    q = queries.join(F.broadcast(folders)).withColumn("nd", sample.choose(key, F.col("dirs"), "dir").cast("int"))
    q = q.join(sent(files), "nd").withColumn("nf", sample.choose(key, F.col("files"), "file").cast("int"))
    q = q.join(sent(sizes), ["nd", "nf"]).withColumn("nt", sample.choose(key, F.col("texts"), "text").cast("int"))
    out = q.join(sent(numbered), ["nd", "nf", "nt"])
    return out.select(*queries.columns, text.fill("template", query=F.col("query")).alias("context"), F.concat_ws("/", "folder", "file").alias("template"))


def not_submitted(files: DataFrame, ledger: DataFrame) -> DataFrame:
    return files.join(ledger.select("name").where("name is not null").distinct(), "name", "left_anti")
