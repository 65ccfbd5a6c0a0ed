"""Answers of a language model and what becomes of them: parsing, trimming, prompts, defaults; no UDF."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.sources import folders

ITEM = "map<string,string>"
MOST_ITEMS = 500  # fixed values: items kept of an answer; confidence where none is given, and of a default result
CONFIDENCE, DEFAULT_CONFIDENCE = 0.8, 0.5


def _loose(part: Column) -> Column:
    """Items of a broken answer: its array closed, or else each line that is an object."""
    trimmed = F.regexp_replace(part, r"^\s+|\s+\z", "")
    closed = F.from_json(F.when(trimmed.startswith("[") & ~trimmed.endswith("]"), F.concat(trimmed, F.lit("]"))), f"array<{ITEM}>")
    lines = F.transform(F.split(trimmed, "\n"), lambda x: F.from_json(F.regexp_replace(x, r"^\s+|\s*,?\s*\z", ""), ITEM))
    return F.coalesce(F.filter(closed, lambda x: x.isNotNull()), F.filter(lines, lambda x: x.isNotNull()))


def items(answer: Column) -> Column:
    """array<map>: {"items": [...]}, a plain array, either of them as a JSON string, or what can be read of a broken one.

    Empty for null and for text without JSON. An object without items counts as broken, so it is one item of its own.
    """
    part = T.json_part(F.coalesce(answer, F.lit("")))
    part = F.when(part == "", answer).otherwise(part)
    inner = F.get_json_object(F.concat(F.lit('{"s":'), part, F.lit("}")), "$.s")

    def strict(c):
        wrapped = F.when(c.startswith("{"), F.from_json(c, f"items array<{ITEM}>")["items"])
        return F.coalesce(wrapped, F.when(c.startswith("["), F.from_json(c, f"array<{ITEM}>")))

    return F.coalesce(strict(part), F.when(part.startswith('"'), strict(inner)), _loose(part), F.array().cast(f"array<{ITEM}>"))


def valid_items(found: Column) -> Column:
    return F.filter(found, lambda x: x["code"].isNotNull() & x["name"].isNotNull())


def core_fields(found: Column, most: int = MOST_ITEMS) -> Column:
    return F.transform(F.slice(found, 1, most), lambda x: F.struct(x["code"].alias("code"), x["name"].alias("name")))


def truncated(rows: Column, most: int) -> Column:
    """The longest prefix of an array of structs whose JSON texts have most bytes together."""
    step = lambda acc, x: F.when(acc["open"] & (acc["size"] + F.octet_length(F.to_json(x)) <= most), F.struct((acc["n"] + 1).alias("n"), (acc["size"] + F.octet_length(F.to_json(x))).alias("size"), F.lit(True).alias("open"))).otherwise(F.struct(acc["n"].alias("n"), acc["size"].alias("size"), F.lit(False).alias("open")))
    kept = F.aggregate(rows, F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open")), step)
    return F.slice(rows, F.lit(1), kept["n"])


def alternative(chosen_from: Column, rule: Column, found: Column) -> Column:
    return F.when(chosen_from == "rule", found).otherwise(rule)


def first_items(rows: DataFrame, key: str, order: list[str], item: str, most: int = MOST_ITEMS) -> DataFrame:
    """key, items: the first most items of each key, which are chosen before any are gathered."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = rows.withColumn("_k", place).filter(F.col("_k") <= most)
    gathered = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_k", F.col(item).alias("item"))), lambda a, b: a["_k"] - b["_k"]).alias("_all"))
    return gathered.select(key, F.transform("_all", lambda x: x["item"]).alias("items"))


def default_result(rule: Column, found: Column) -> Column:
    return F.struct(rule.alias("name"), F.lit(DEFAULT_CONFIDENCE).alias("confidence"), found.alias("alternative"))


def prompts(rows: DataFrame, key: str, order: str, fields: list[str], template: str) -> DataFrame:
    """A prompt for each key: template's %s become the key and its rows as JSON, by order. Keys have few rows by their nature."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias("_rows"))
    listed = F.transform("_rows", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return packed.select(key, F.format_string(template, F.col(key).cast("string"), F.to_json(listed)).alias("prompt"))


#: Prompts of the four kinds of calls; %s are the key and its rows as JSON.
PROMPTS = {
    "clean": "Clean the items of class %s. Keep code and name of each, as a JSON array: %s",
    "analyse": "Compare the items found for %s with the dictionary and answer as {\"items\": [...]}: %s",
    "batch": "For batch %s give the corrected name of every code as a JSON array: %s",
    "choose": "For %s choose the better name of each pair; answer with name and selected_from (rule or pdf): %s",
}


def answered(prompts: DataFrame, client: Callable[[str], str], tries: int = 3, wait: Callable[[float], None] = time.sleep, at_once: int = 8) -> DataFrame:
    """Adds answer and error by calling client, which must be picklable, on each distinct prompt, at_once of a partition at a time.

    A call that raises is tried again after 1, 4, 9, ... seconds (30 at most), tries times in all; then answer is null
    and error says why.
    """

    def call(prompt: str) -> tuple[str | None, str | None]:
        for k in range(1, tries + 1):
            try:
                return client(prompt), None
            except Exception as e:
                error = str(e)
                if k < tries:
                    wait(min(k * k, 30))
        return None, error

    def run(batches: Iterator):
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                got = list(pool.map(call, batch["prompt"]))
                yield batch.assign(answer=[a for a, _ in got], error=[e for _, e in got])

    once = prompts.select("prompt").filter("prompt is not null").distinct()
    return prompts.join(once.mapInPandas(run, "prompt string, answer string, error string"), "prompt", "left")


def call_key(prompt: Column) -> Column:
    """What a prompt's answer is kept under."""
    return F.sha2(prompt.cast("binary"), 256)


def _stored(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _kept(spark: SparkSession, path: str, part: str) -> DataFrame:
    """key, answer of the table of gathered answers, or of the objects of calls since."""
    store, root = _stored(path)
    if store.get_file_info(f"{root}/{part}").type != fs.FileType.Directory:
        return spark.createDataFrame([], "key string, answer string")
    rows = spark.read.schema("key string, answer string")
    rows = rows.parquet(f"{path}/{part}") if part == "answers" else rows.option("recursiveFileLookup", "true").json(f"{path}/{part}")
    return rows.groupBy("key").agg(F.min("answer").alias("answer"))


def kept_answers(spark: SparkSession, path: str) -> DataFrame:
    """key, answer of all calls that are kept below path: those that were gathered, and those of runs that did not end."""
    both = _kept(spark, path, "answers").unionByName(_kept(spark, path, "calls"))
    return both.groupBy("key").agg(F.min("answer").alias("answer"))


def answered_once(prompts: DataFrame, client: Callable[[str], str], path: str, tasks: int = 8, per_minute: float | None = None, tries: int = 3, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """As answered(), but a call that has ended is kept below path, and never made again: not by a task that is tried again, nor by another run.

    Prompts with an answer are taken out before any call by an anti-join. Each other call is written under its prompt's key as soon as it
    ends, and looked for before it is made. When all have ended they are gathered into one table. per_minute is shared by
    tasks, each of which leaves as long between two calls as its share asks for. Failed calls are not kept.
    """
    spark = prompts.sparkSession
    gap = 0.0 if per_minute is None else 60.0 * tasks / per_minute
    once = prompts.select("prompt").filter("prompt is not null").distinct().withColumn("key", call_key(F.col("prompt")))

    def call(prompt: str) -> tuple[str | None, str | None]:
        for k in range(1, tries + 1):
            try:
                return client(prompt), None
            except Exception as e:
                error = str(e)
                if k < tries:
                    wait(min(k * k, 30))
        return None, error

    def run(batches: Iterator):
        store, root = _stored(path)
        free = clock()
        for batch in batches:
            got = []
            for prompt, key in zip(batch["prompt"], batch["key"], strict=True):
                name = f"{root}/calls/{key[:2]}/{key}.json"
                if store.get_file_info(name).type == fs.FileType.File:
                    with store.open_input_stream(name) as f:
                        got.append((json.loads(f.read())["answer"], None))
                    continue
                if gap and (now := clock()) < free:
                    wait(free - now)
                free = clock() + gap
                answer, error = call(prompt)
                if error is None:
                    store.create_dir(f"{root}/calls/{key[:2]}", recursive=True)
                    part = f"{root}/calls/{key[:2]}/_{uuid.uuid4().hex}"  # readers pass over names that begin so
                    with store.open_output_stream(part) as f:
                        f.write(json.dumps({"key": key, "answer": answer}).encode())
                    store.move(part, name)
                got.append((answer, error))
            yield batch[["key"]].assign(answer=[a for a, _ in got], error=[e for _, e in got])

    before = kept_answers(spark, path)
    new = once.join(before.select("key"), "key", "left_anti").repartition(tasks, "key").mapInPandas(run, "key string, answer string, error string")
    new = folders.written(new, "answers")
    store, root = _stored(path)
    if store.get_file_info(f"{root}/calls").type == fs.FileType.Directory:
        # All that runs have left, those that did not end too; a crash before the deletion leaves nothing to add next time.
        _kept(spark, path, "calls").join(_kept(spark, path, "answers").select("key"), "key", "left_anti").write.mode("append").parquet(f"{path}/answers")
        store.delete_dir(f"{root}/calls")
    answers = kept_answers(spark, path).withColumn("error", F.lit(None).cast("string")).unionByName(new.filter("error IS NOT NULL"))
    return prompts.withColumn("_key", call_key(F.col("prompt"))).join(answers.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def occupation_codes(body: Column) -> Column:
    """array<struct(code, name, confidence)> of a service's reply; a missing confidence is CONFIDENCE."""
    found = F.from_json(body, "codes array<struct<code:string,name:string,confidence:double>>")["codes"]
    return F.transform(found, lambda c: F.struct(c["code"].alias("code"), c["name"].alias("name"), F.coalesce(c["confidence"], F.lit(CONFIDENCE)).alias("confidence")))
