"""Yes/no judgements of value pairs, cache first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canonry.functions.text import GROUP, parse_answer, strip_suffix

PAIR = [*GROUP, "v1", "v2"]


class Judge(Protocol):
    """Answers prompts; made once for each Python worker."""

    def ask(self, prompts: list[str]) -> list[str]: ...


#: Judges by name: a factory that is called on the executors. Connectors to services register themselves here.
JUDGES: dict[str, Callable[[], Judge]] = {}


def register(name: str, factory: Callable[[], Judge]) -> None:
    JUDGES[name] = factory


class HttpJudge:
    """A chat service with an OpenAI-style interface: temperature 0, one retry. Not tested: there is no network here."""

    def __init__(self, url: str, key: str, model: str, wait: float = 1.0):
        self.url, self.key, self.model, self.wait = url, key, model, wait

    def ask(self, prompts: list[str]) -> list[str]:
        import json
        import time
        import urllib.request

        out = []
        for p in prompts:
            body = json.dumps({"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": p}]}).encode()
            answer = "error calling"
            for turn in range(2):
                try:
                    request = urllib.request.Request(self.url, body, {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
                    with urllib.request.urlopen(request, timeout=60) as r:
                        answer = json.load(r)["choices"][0]["message"]["content"]
                    break
                except (OSError, KeyError, ValueError):
                    if not turn:
                        time.sleep(self.wait)
            out.append(answer)
        return out


def rule_answer(a: Column, b: Column) -> Column:
    """A stand-in judge as an expression: yes for one last word, unsure for one first letter, otherwise no."""
    last = lambda x: F.element_at(F.split(F.lower(x), " "), -1)
    return F.when(last(a) == last(b), "yes").when(F.substring(F.lower(a), 1, 1) == F.substring(F.lower(b), 1, 1), "unsure").otherwise("no")


def trivial_yes(pairs: DataFrame) -> DataFrame:
    """Pairs that are one value but for case."""
    return pairs.where(F.lower("v1") == F.lower("v2"))


def keyed(pairs: DataFrame, dataset: str = "dbpedia") -> DataFrame:
    """Adds the verdict key k1 <= k2: suffixes stripped, lower-cased for dbpedia."""
    k = [strip_suffix(F.col(v)) for v in ("v1", "v2")]
    if dataset == "dbpedia":
        k = [F.lower(x) for x in k]
    return pairs.withColumn("k1", F.least(*k)).withColumn("k2", F.greatest(*k))


def cache(verdicts: DataFrame) -> DataFrame:
    """One answer a key, either order of the values; of several the smallest. Failures are not kept, so they are asked again."""
    v = verdicts.where("answer <> 'failure'").select(*GROUP, F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2"), "answer")
    return v.groupBy(*GROUP, "k1", "k2").agg(F.min("answer").alias("answer"))


def hits(pairs: DataFrame, verdicts: DataFrame, dataset: str = "dbpedia") -> DataFrame:
    return keyed(pairs, dataset).join(cache(verdicts), [*GROUP, "k1", "k2"])


def misses(pairs: DataFrame, verdicts: DataFrame, dataset: str = "dbpedia") -> DataFrame:
    return keyed(pairs, dataset).join(cache(verdicts), [*GROUP, "k1", "k2"], "left_anti")


def budgeted(pairs: DataFrame, per_group: int = 4000, order: list[Column] | None = None) -> DataFrame:
    """The first pairs of each group, up to a budget of calls."""
    w = W.partitionBy(*GROUP).orderBy(*(order or [F.col("v1"), F.col("v2")]))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_group)


def ask(pairs: DataFrame, judge: str) -> DataFrame:
    """(…, raw): a registered judge's answers to (…, prompt), in Arrow batches on the executors."""
    factory = JUDGES[judge]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for b in batches:
            yield b.assign(raw=client.ask(b["prompt"].tolist()))

    return pairs.mapInPandas(apply, pairs.schema.simpleString()[7:-1].replace(":", " ") + ", raw string")


def judged(pairs: DataFrame, verdicts: DataFrame | None = None, answer: Callable[[Column, Column], Column] = rule_answer, dataset: str = "dbpedia") -> DataFrame:
    """(attr, con, v1, v2, answer, source): from the cache, else trivially yes, else by `answer` on new pairs only."""
    if verdicts is None:
        return pairs.select(*PAIR, F.when(F.lower("v1") == F.lower("v2"), "yes").otherwise(answer(F.col("v1"), F.col("v2"))).alias("answer"), F.lit("new").alias("source"))
    known = hits(pairs, verdicts, dataset).select(*PAIR, "answer", F.lit("cache").alias("source"))
    new = misses(pairs, verdicts, dataset)
    same = F.lower("v1") == F.lower("v2")
    fresh = new.select(*PAIR, F.when(same, "yes").otherwise(answer(F.col("v1"), F.col("v2"))).alias("answer"), F.when(same, "trivial").otherwise("new").alias("source"))
    return known.unionByName(fresh)


def audit(asked: DataFrame) -> DataFrame:
    """The log of calls: attr, query, answer, con, v0, v1, raw_response."""
    return asked.select("attr", F.col("prompt").alias("query"), parse_answer(F.col("raw")).alias("answer"), "con", F.col("v1").alias("v0"), F.col("v2").alias("v1"), F.col("raw").alias("raw_response"))


def cost_report(asked: DataFrame) -> DataFrame:
    """Characters sent and received, calls needed and new, a row a group; asked has prompt, raw and source."""
    new = F.col("source") == "new"
    return asked.groupBy(*GROUP).agg(F.count("*").alias("needed"), F.count(F.when(new, 1)).alias("calls"), F.sum(F.when(new, F.length("prompt")).otherwise(0)).alias("sent"), F.sum(F.when(new, F.length("raw")).otherwise(0)).alias("received"))
