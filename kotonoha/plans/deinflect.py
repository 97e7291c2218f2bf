"""Deinflection of surface forms by suffix rules."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kotonoha.functions.batches import tasks
from kotonoha.functions.scratch import scratch
from kotonoha.plans.rules import CONDITIONS, SINGLE_CONDITIONS, Rule, japanese_rules, widened

SCHEMA, CHAIN = "text string, cand_pos int, candidate string, conditions array<string>", "chain array<struct<transform:string,rule:int,input:string>>"

#: A text with more candidates points to a rule table that runs in circles.
MOST_CANDIDATES = 1000

#: So does a text to which more rules apply in a row.
MOST_STEPS = 64


def rule_index(rules: list[Rule], front: bool = False) -> dict[str, list[tuple]]:
    """Suffix (or with ``front`` prefix) -> its rules: place in the table, the rule, and what its conditions before and after widen to."""
    index: dict[str, list] = {}
    for place, rule in enumerate(rules):
        if rule.front != front:
            continue
        index.setdefault(rule.suffix, []).append((place, rule, widened(rule.before), widened(rule.after)))
    return index


def candidates(text: str, index: dict, longest: int, most: int = MOST_CANDIDATES, fronts: dict | None = None) -> list[tuple[str, tuple[str, ...], tuple]]:
    """The text itself and all that rules lead to, breadth first; within one step in the order of the rule table. Equal results are not merged. ``fronts`` is the index of rules for prefixes."""
    found: list[tuple[str, tuple[str, ...], tuple]] = [(text, (), ())]
    holds: list[frozenset[str]] = [frozenset()]
    for (form, _, chain), held in zip(found, holds):  # both grow while they are read
        fitting = []
        for n in range(1, min(longest, len(form)) + 1):
            if (hits := index.get(form[-n:])) is not None:
                fitting += [hit for hit in hits if not held or hit[2] == held]
            if fronts and (hits := fronts.get(form[:n])) is not None:
                fitting += [hit for hit in hits if not held or hit[2] == held]
        fitting.sort(key=itemgetter(0))
        for _, rule, _, after in fitting:
            left = rule.plain + form[len(rule.suffix) :] if rule.front else form[: len(form) - len(rule.suffix)] + rule.plain
            found.append((left, rule.after, (*chain, (rule.transform, rule.rule_no, form))))
            holds.append(after)
        if len(found) > most:
            raise ValueError(f"over {most} candidates for one text: {text[:50]!r}")
    return found


def deinflect(df: DataFrame, column: str, rules: list[Rule] | None = None, chains: bool = True) -> DataFrame:
    """Distinct texts in ``column`` -> text, cand_pos, candidate, conditions, and with ``chains`` the chain of rules: a row for each candidate, the text itself at 0. Nulls are left out.

    Texts are made distinct first, so the work follows the number of surface forms, not of occurrences.
    """
    table = rules or japanese_rules()
    longest = max(len(r.suffix) for r in table)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, fronts = rule_index(table), rule_index(table, front=True)
        for frame in frames:
            found = [(text, i, *row) for text in frame["text"] for i, row in enumerate(candidates(text, index, longest, fronts=fronts))]
            out = pd.DataFrame([row[:4] for row in found], columns=["text", "cand_pos", "candidate", "conditions"])
            if chains:
                out["chain"] = [[dict(zip(("transform", "rule", "input"), step)) for step in row[4]] for row in found]
            yield out

    return surfaces(df, column).mapInPandas(run, f"{SCHEMA}, {CHAIN}" if chains else SCHEMA)


def surfaces(df: DataFrame, column: str) -> DataFrame:
    """Each different text of ``column`` once, but for null. They are short and the work on each isn't, so they are dealt to a number of tasks that doesn't shrink with their size."""
    return df.select(F.col(column).alias("text")).where("text is not null").distinct().repartition(tasks(df.sparkSession), "text")


def register_deinflect(spark: SparkSession, name: str = "deinflect", rules: list[Rule] | None = None, chains: bool = True) -> None:
    """Make ``deinflect`` a table function of SQL: ``SELECT ... FROM texts, LATERAL deinflect(text)`` gives cand_pos, candidate, conditions and with ``chains`` chain for each row. A null text gives none. It works on each row, in the task that has it; make texts distinct and deal them out before it, as ``surfaces`` does."""
    table = rules or japanese_rules()
    longest = max(len(r.suffix) for r in table)

    class Deinflect:
        def __init__(self) -> None:
            self.index, self.fronts = rule_index(table), rule_index(table, front=True)

        def eval(self, text: str) -> Iterator[tuple]:
            if text is not None:
                for i, (form, conditions, chain) in enumerate(candidates(text, self.index, longest, fronts=self.fronts)):
                    yield (i, form, list(conditions), [dict(zip(("transform", "rule", "input"), step)) for step in chain]) if chains else (i, form, list(conditions))

    kind = SCHEMA.split(", ", 1)[1]
    spark.udtf.register(name, F.udtf(Deinflect, returnType=f"{kind}, {CHAIN}" if chains else kind, useArrow=True))


def is_inflected(text: Column, transform: str, rules: list[Rule] | None = None) -> Column:
    """Whether a rule of ``transform`` fits the end (or for rules of prefixes the beginning) of the text, whatever its conditions."""
    named = {(r.front, r.suffix) for r in rules or japanese_rules() if r.transform == transform}
    if not named:
        raise ValueError(f"no such transform: {transform}")
    parts = [("|".join(sorted(s for front, s in named if front == side)), pattern) for side, pattern in ((False, r"(?:{})\z"), (True, r"\A(?:{})"))]
    return text.rlike("|".join(pattern.format(some) for some, pattern in parts if some))


def fitting_rules() -> dict[str, list[str]]:
    """For each condition the inflection rules of entries that fit it: itself, those above and those below."""
    named = {c for r in japanese_rules() for c in (*r.before, *r.after)} | set(CONDITIONS) | set(SINGLE_CONDITIONS)
    up = {c: widened([c]) for c in named}
    return {c: sorted(r for r in named if r in up[c] or c in up[r]) for c in named}


def filter_by_conditions(lookup: DataFrame, conditions: str = "conditions", rules: str = "inflection_rules") -> DataFrame:
    """Entries whose inflection rules fit their candidate's conditions: no conditions, or a rule is one of them, or lies above or below one. What fits is looked up in a map of all conditions."""
    table = F.create_map(*[x for c, fit in sorted(fitting_rules().items()) for x in (F.lit(c), F.array(*map(F.lit, fit)))])
    fits = F.flatten(F.transform(conditions, lambda c: F.coalesce(F.element_at(table, c), F.array(c))))
    return lookup.where((F.size(conditions) == 0) | F.arrays_overlap(F.col(rules), fits))


def rules_frame(spark: SparkSession) -> DataFrame:
    """The rule table as a DataFrame (a few hundred rows)."""
    key = lambda c: " ".join(sorted(widened(c)))
    rows = [(r.transform, r.transform_no, r.rule_no, r.suffix, r.plain, key(r.before), key(r.after), " ".join(r.after)) for r in japanese_rules()]
    return spark.createDataFrame(rows, "transform string, transform_no int, rule_no int, suffix string, plain string, before string, after string, conditions string")


def deinflect_by_joins(df: DataFrame, column: str, steps: int = MOST_STEPS) -> DataFrame:
    """As ``deinflect`` (text, cand_pos, candidate, conditions as one string), by joins with the rule table on suffixes, until no row is new. An error after more than ``steps`` rules in a row.

    Each step's rows are written to a scratch table of their own, which goes when the driver ends.
    """
    def kept(rows: DataFrame) -> DataFrame:
        where = scratch(df.sparkSession)
        rows.write.parquet(where)
        return df.sparkSession.read.schema(rows.schema).parquet(where)

    rules = F.broadcast(rules_frame(df.sparkSession))
    front = df.select(F.col(column).alias("text")).where("text is not null").distinct().withColumns({"candidate": F.col("text"), "held": F.lit(""), "conditions": F.lit(""), "path": F.array().cast("array<int>")})
    front = kept(front)
    out, done = front, 0
    while not front.isEmpty():
        if done > steps:
            raise ValueError(f"over {steps} rules in a row for one text: {front.first().text[:50]!r}")
        ends = front.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda n: F.when(n <= F.length("candidate"), F.right(F.col("candidate"), n))))).where("suffix is not null")
        met = ends.drop("conditions").join(rules, "suffix").where("held = '' or held = before")
        front = kept(met.select("text", F.concat(F.expr("left(candidate, length(candidate) - length(suffix))"), "plain").alias("candidate"), F.col("after").alias("held"), "conditions", F.concat("path", F.array(F.col("transform_no") * 100 + F.col("rule_no"))).alias("path")))
        out, done = out.unionByName(front), done + 1
    place = F.row_number().over(W.partitionBy("text").orderBy(F.size("path"), "path")) - 1
    return out.select("text", place.alias("cand_pos"), "candidate", "conditions")


_STEPS_SQL = """WITH RECURSIVE step(text, candidate, held, conditions, path) MAX RECURSION LEVEL {levels} AS (
        SELECT text, text, '', '', CAST(array() AS ARRAY<INT>) FROM {{texts}}
        UNION ALL
        SELECT /*+ BROADCAST(r) */ s.text, left(s.candidate, length(s.candidate) - w) || r.plain, r.after, r.conditions, s.path || array(r.transform_no * 100 + r.rule_no)
        FROM (SELECT *, explode(sequence(1, least({longest}, greatest(length(candidate), 1)))) AS w FROM step) s JOIN {{rules}} r ON right(s.candidate, w) = r.suffix
        WHERE w <= length(s.candidate) AND (s.held = '' OR s.held = r.before))
    SELECT text, CAST(row_number() OVER (PARTITION BY text ORDER BY size(path), path) - 1 AS INT) AS cand_pos, candidate, conditions FROM step"""


def deinflect_recursive(df: DataFrame, column: str, steps: int = MOST_STEPS) -> DataFrame:
    """As ``deinflect_by_joins``, as one recursive query: nothing runs before its result is asked for. An error after more than ``steps`` rules in a row.

    Spark keeps each step's rows as cached blocks and ends with an error where all have over
    ``spark.sql.cteRecursionRowLimit`` rows, so that a session with more sets it (-1: no limit).
    """
    spark = df.sparkSession
    rules = rules_frame(spark)
    longest = max(len(r.suffix) for r in japanese_rules())
    texts = df.select(F.col(column).alias("text")).where("text is not null").distinct()
    return spark.sql(_STEPS_SQL.format(levels=steps + 1, longest=longest), texts=texts, rules=rules)
