"""The data-quality gate over nested answers: one code for each broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

GOAL = r"^Follow these steps to perform this [A-Z][A-Za-z0-9\- ]*? (?:Troubleshooting|Configuration)$"
TITLE = r"^[A-Z][a-z0-9]+(?:[- ][a-z0-9]+){1,2}$"


def rank(category: Column) -> Column:
    """auto before manual before critical."""
    return F.array_position(F.array(*map(F.lit, L.CATEGORIES)), category) - 1


def in_order(categories: Column) -> Column:
    ranks = F.transform(categories, rank)
    return F.array_sort(ranks) == ranks


def _when(bad: Column, code: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(code))


def goal_codes(goal: Column, title: Column, score: Column, categories: Column) -> list[Column]:
    words = T.word_count(title)
    return [
        _when(~goal.rlike(GOAL), "GOAL_SYNTAX"),
        _when((words < 2) | (words > 3) | ~title.rlike(TITLE), "TITLE_SHAPE"),
        _when((score < 0) | (score > 1), "SCORE_RANGE"),
        _when(~in_order(categories), "ORDER_VIOLATION"),
    ]


def action_codes(action: Column) -> list[Column]:
    words = T.word_count(action["description"])
    return [
        _when(~T.is_title_case(action["actionName"]), "ACTIONNAME_CASE"),
        _when(~action["description"].rlike(r"^It will \S"), "DESC_PREFIX"),
        _when((words < 5) | (words > 7), "DESC_LENGTH"),
        _when(F.size(action["stepGroups"]) == 0, "EMPTY_STEPGROUP"),
    ]


def group_codes(category: Column, group: Column, unknown: Column | None) -> list[Column]:
    link, check = group["actionableDeeplink"], group["validationDeeplink"]
    uri = link["deeplink"]
    auto, manual = category == "auto", category == "manual"
    listed = auto & T.is_catalog_link(uri)
    words = T.word_count(link["description"])
    outside = listed & F.array_contains(unknown, uri) if unknown is not None else F.lit(False)
    return [
        _when(F.size(group["steps"]) == 0, "EMPTY_STEPS"),
        _when(outside, "DEEPLINK_NOT_IN_CATALOG"),
        _when(listed & uri.endswith("dummy_positive") & ((words < 5) | (words > 7)), "DUMMY_DESC_LENGTH"),
        _when(auto & link.isNull(), "AUTO_WITHOUT_DEEPLINK"),
        _when(manual & link.isNotNull(), "MANUAL_WITH_DEEPLINK"),
        _when(check.isNotNull() & ~T.is_catalog_link(check["deeplink"]), "VALIDATION_URI_BAD"),
    ]


def step_codes(step: Column) -> list[Column]:
    dots = F.length(step) - F.length(F.replace(step, F.lit("."), F.lit("")))
    return [_when(T.leaks_address(step), "STEP_URL_LEAK"), _when((dots > 1) & ~step.endswith("."), "STEP_MULTI_INTERACTION")]


def links(contexts: Column) -> Column:
    """The links that an answer's actions open."""
    groups = F.flatten(F.transform(F.flatten(F.transform(contexts, lambda c: c["actions"])), lambda a: a["stepGroups"]))
    return F.array_distinct(F.array_compact(F.transform(groups, lambda g: g["actionableDeeplink"]["deeplink"])))


def audit(answers: DataFrame, contexts="contexts", unknown: Column | None = None) -> DataFrame:
    """answers with gate struct<ok, failures array<string>, checks map<string,int>>; the
    failures repeat as often as a rule is broken. Only the answer is searched for
    addresses, not the question it echoes. unknown: those of the answer's links that the
    catalog does not have."""

    def of_group(a: Column, g: Column) -> Column:
        return F.concat(F.array(*group_codes(a["category"], g, unknown)), F.flatten(F.transform(g["steps"], lambda s: F.array(*step_codes(s)))))

    def of_action(a: Column) -> Column:
        return F.concat(F.array(*action_codes(a)), F.flatten(F.transform(a["stepGroups"], lambda g: of_group(a, g))))

    def of_goal(c: Column) -> Column:
        own = goal_codes(c["goal"], c["title"], c["score"], F.transform(c["actions"], lambda a: a["category"]))
        return F.concat(F.array(*own), F.flatten(F.transform(c["actions"], of_action)))

    c = F.col(contexts)
    codes = F.array_compact(F.concat(F.array(_when(T.leaks_address(F.to_json(c)), "URL_LEAK")), F.flatten(F.transform(c, of_goal))))
    actions = F.flatten(F.transform(c, lambda x: x["actions"]))
    autos = F.flatten(F.transform(F.filter(actions, lambda a: a["category"] == "auto"), lambda a: a["stepGroups"]))
    linked = F.filter(autos, lambda g: T.is_catalog_link(g["actionableDeeplink"]["deeplink"]))
    checks = F.create_map(F.lit("goal"), F.size(c), F.lit("action"), F.size(actions), F.lit("auto_actions"), F.size(autos), F.lit("auto_with_deeplink"), F.size(linked))
    return answers.withColumn("gate", T.let(codes, lambda x: F.struct((F.size(x) == 0).alias("ok"), x.alias("failures"), checks.alias("checks"))))
