"""Conditions and profiles as they come from outside, read into typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligo.operators.evaluate import EXPECTED_OP

#: Keys by the type of their value, and what a structure that can't be read leaves for humans.
LISTS = ("region", "industry", "targetSector", "targetOrg", "companyScale", "guaranteeInUse")
NUMBERS = ("businessAgeMaxYears", "businessAgeMinYears", "revenueMaxKrw", "revenueMinKrw", "employeeMax", "employeeMin", "creditScoreMin", "creditScoreMax")
FLAGS = ("noTaxDelinquency", "certRequired", "patentRequired", "hasExistingLoan", "isCorporation")
UNREADABLE = "저장된 조건을 읽지 못함"
CREDIT_LOW, CREDIT_HIGH = 300, 1000


def conditions_of(structure: Column, unreadable: str = UNREADABLE) -> Column:
    """(conditions, human) of a stored structure's JSON. A condition needs a key, an op, its text and a value; it is for machines
    only where it says so and op and value fit its key. What can't be read, or has an op that doesn't fit, goes to humans."""
    whole = F.try_parse_json(structure)
    items = F.try_variant_get(whole, "$.conditions", "array<variant>")
    some = lambda v, path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))

    def read(v: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, "$.value", "variant"))
        key, op, text = some(v, "$.key"), some(v, "$.op"), F.trim(some(v, "$.rawText"))
        texts = kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
        number, flag = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), kind == "BOOLEAN"
        usable = (kind.startswith("ARRAY") | number | flag) & F.coalesce(key != "", F.lit(False)) & op.isin("in", "lte", "gte", "eq") & F.coalesce(text != "", F.lit(False))
        fitting = F.coalesce(*[F.when(key == k, op == o) for k, o in EXPECTED_OP.items()], F.lit(True))
        typed = (key.isin(*LISTS) & texts) | (key.isin(*NUMBERS) & number) | (key.isin(*FLAGS) & flag)
        says = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.machineReadable", "variant")) == "BOOLEAN", F.lit(False)) & F.coalesce(F.try_variant_get(v, "$.machineReadable", "boolean"), F.lit(False))
        return F.struct(
            F.coalesce(usable, F.lit(False)).alias("usable"), key.alias("key"), op.alias("op"), F.when(texts, F.try_variant_get(v, "$.value", "array<string>")).alias("values"),
            F.when(number, F.try_variant_get(v, "$.value", "double")).alias("number"), F.when(flag, F.try_variant_get(v, "$.value", "boolean")).alias("flag"), text.alias("text"), F.coalesce(says & typed & fitting, F.lit(False)).alias("machine_readable"), fitting.alias("fitting"),
        )

    rows = F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda v: read(v))
    left = F.transform(F.filter(rows, lambda r: ~r["usable"] | ~r["fitting"]), lambda r: F.coalesce(F.nullif(r["text"], F.lit("")), F.lit(unreadable)))
    told = F.filter(F.coalesce(F.try_variant_get(whole, "$.humanCheck", "array<string>"), F.array().cast("array<string>")), lambda h: F.trim(h) != "")
    broken = F.when(items.isNull(), F.array(F.lit(unreadable))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.filter(rows, lambda r: r["usable"]).alias("conditions"), F.array_distinct(F.concat(told, left, broken)).alias("human"))


def credit_of(nice: Column, kcb: Column) -> Column:
    """The lower of the scores that lie within the scale."""
    inside = lambda x: F.when(x.between(CREDIT_LOW, CREDIT_HIGH), x)
    return F.least(inside(nice), inside(kcb))


def has_certificate(kinds: Column, before: Column) -> Column:
    """Whether a company has a certificate, by the kinds that it lists; without any listed the old answer stays."""
    own = F.filter(F.transform(F.coalesce(kinds, F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: k != "")
    return F.when(F.size(own) > 0, F.exists(own, lambda k: k != "없음")).otherwise(before)


def at_least_one(count: Column, before: Column) -> Column:
    return F.when(count >= 0, count >= 1).otherwise(before)


def structure_choice(status: Column, by_model: Column, by_rules: Column) -> Column:
    """The structure that counts: the model's where it is done or to be reviewed, else the rules'."""
    return F.when(status.isin("done", "needs_review"), by_model).otherwise(by_rules)
