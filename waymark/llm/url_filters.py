"""URL filters: host rules first, gradient-boosted trees on lexical features for
the rest. DataFrame functions only.

URLs that a rule fits are the labelled ones, the rule's verdict their label. The trees see
lengths, depth, digits, entropy, parameters, and how often URLs of the same address suffix,
first path segment and start of the path are blocked. These rates are smoothed from the
longer key to the shorter one, and counted out of fold: a labelled URL gets the rates of
the other ``FOLDS`` - 1 parts of the labelled URLs (parted by a hash of the URL), so
neither its own label nor that of its copies reaches its features.

Defined results: a null url, or one without ``://``, has empty host and path and
is judged by the trees on zero features; repeated rows give repeated results; urls may be
of any length; an empty table gives no rows; extra columns are ignored. Without labelled
rows, or with one class only, the model is the smoothed class rate alone ("allow" at a
tie).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Host-and-path rules in the order given.
RULES: tuple[tuple[str, str], ...] = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

FEATURES = (
    "n_chars", "n_host", "n_path", "depth", "host_labels", "digit_ratio", "entropy",
    "n_params", "n_query", "has_fragment", "n_hyphens", "suffix_rate", "suffix_rows", "segment_rate", "start_rate",
)

#: Labelled URLs that the trees are fitted on, about, at most.
TRAIN_ROWS = 20_000
FOLDS = 5
#: Pseudo-rows of the shorter key that a suffix, a segment and a path's start begin with.
PSEUDO_ROWS = (20.0, 5.0, 5.0)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path. Host: after the first ``://`` up to ``/ ? #`` or the end,
    A-Z lower-cased; path: from there up to ``? #`` or the end."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u)))
    raw = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    after = F.substring(F.coalesce(rest, F.lit("")), F.length(raw) + 1, F.length(u))
    return pages.withColumn("host", ascii_lower(raw)).withColumn(
        "path", F.coalesce(F.regexp_extract(after, r"^([^?#]*)", 1), F.lit(""))
    )


def rule_columns(rules=RULES, host="host", path="path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def lexical(url: str = "url") -> dict[str, Column]:
    """Lexical features as expressions over the url and its host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    entropy = F.aggregate(
        F.array_distinct(F.split(u, "")),
        F.lit(0.0),
        lambda acc, c: acc
        + F.when(F.length(c) > 0, (n - F.length(F.replace(u, c, F.lit("")))).cast("double")).otherwise(0.0)
        * F.coalesce(F.log2((n - F.length(F.replace(u, c, F.lit("")))).cast("double")), F.lit(0.0)),
    )
    d = lambda c: c.cast("double")
    return {
        "n_chars": d(n),
        "n_host": d(F.length("host")),
        "n_path": d(F.length("path")),
        "depth": d(_count_of(F.col("path"), "/")),
        "host_labels": d(_count_of(F.col("host"), ".")),
        "digit_ratio": F.when(n > 0, _count_of(u, "0123456789") / n).otherwise(0.0),
        "entropy": F.when(n > 0, F.round(F.log2(d(F.greatest(n, F.lit(1)))) - entropy / F.greatest(n, F.lit(1)), 6)).otherwise(0.0),
        "n_params": F.when(F.length(query) > 0, d(_count_of(query, "&") + 1)).otherwise(0.0),
        "n_query": d(F.length(query)),
        "has_fragment": F.when(F.instr(u, "#") > 0, 1.0).otherwise(0.0),
        "n_hyphens": d(_count_of(u, "-")),
    }


@dataclass
class Boosted:
    """Gradient-boosted trees of log loss: a node is (feature, threshold, left, right),
    a leaf a float; rows with feature <= threshold go left."""

    prior: float = 0.0
    trees: list = field(default_factory=list)

    def margin(self, upto: int | None = None) -> Column:
        return reduce(lambda a, t: a + _tree(t), self.trees[:upto], F.lit(float(self.prior)))


def _tree(node) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    f, thr, left, right = node
    return F.when(F.col(f) <= thr, _tree(left)).otherwise(_tree(right))


def grid(sample: DataFrame, bins=16) -> dict[str, list[float]]:
    """Where each feature's values are cut into bins."""
    found = sample.agg(*(F.percentile_approx(f, [i / bins for i in range(1, bins)], 1000).alias(f) for f in FEATURES)).first()
    return {f: sorted(set(found[f])) for f in FEATURES}


def _node_of(splits: dict, at: int = 1) -> Column:
    """The heap number of the node that a row falls to."""
    if at not in splits:
        return F.lit(at)
    f, cut = splits[at]
    return F.when(F.col(f) <= cut, _node_of(splits, 2 * at)).otherwise(_node_of(splits, 2 * at + 1))


def _best_split(cells: list, l2: float, min_rows: int) -> tuple | None:
    """(gain, feature, bin, left sums, right sums) from a node's histograms: rows (f, c, g, h, n)."""
    best = None
    for f in sorted({r["f"] for r in cells}):
        own = sorted((r["c"], r["g"], r["h"], r["n"]) for r in cells if r["f"] == f)
        total, left = [sum(r[k] for r in own) for k in (1, 2, 3)], [0.0, 0.0, 0]
        for c, *sums in own[:-1]:
            left = [a + b for a, b in zip(left, sums, strict=True)]
            right = [a - b for a, b in zip(total, left, strict=True)]
            if min(left[2], right[2]) >= min_rows:
                gain = round(left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2), 6)
                if gain > 1e-6 and (best is None or (gain, f, c) > best[:3]):
                    best = (gain, f, c, left, right)
    return best


def fit(sample: DataFrame, trees=12, depth=3, rate=0.4, bins=16, l2=1.0, min_rows=20) -> Boosted:
    """Boost on a bounded sample (features and ``y`` 0/1), one histogram job a level. The
    sample is one partition, so no job shuffles; a level brings a histogram of each
    feature in each node to the driver (2 ** level * features * bins rows at most)."""
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    model = Boosted(math.log((pos + 0.5) / (n - pos + 0.5)) if n else 0.0)
    if not n or pos in (0, n):
        return model
    cuts = grid(sample, bins)
    binned = [reduce(lambda a, c: a + F.when(F.col(f) > c, 1).otherwise(0), cuts[f], F.lit(0)).alias(f) for f in FEATURES]
    cells = materialize(sample.select(*binned, "y").groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("pos")), "cells").coalesce(1)
    of = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("c")) for f in FEATURES))).alias("cell")
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin()))
        rows = cells.withColumn("g", F.col("pos") - F.col("n") * p).withColumn("h", F.col("n") * p * (1 - p))
        splits: dict[int, tuple] = {}
        leaves: dict[int, float] = {}
        for level in range(depth):
            hist = rows.select(_node_of(splits).alias("at"), "g", "h", "n", of).where(F.col("at") >= 2**level)
            hist = hist.groupBy("at", F.col("cell.f").alias("f"), F.col("cell.c").alias("c")).agg(*(F.sum(c).alias(c) for c in "ghn")).collect()
            for at in sorted({r["at"] for r in hist}):
                best = _best_split([r for r in hist if r["at"] == at], l2, min_rows)
                if best:
                    splits[at] = best[1:3]
                    for side, (g, h, _) in enumerate(best[3:]):
                        leaves[2 * at + side] = round(rate * g / (h + l2), 9)
            if not any(at >= 2**level for at in splits):
                break
        if not splits:
            break
        model.trees.append(_grown(splits, leaves, 1))
    model.trees = [_on_values(t, cuts) for t in model.trees]
    return model


def _grown(splits: dict, leaves: dict, at: int):
    return (*splits[at], _grown(splits, leaves, 2 * at), _grown(splits, leaves, 2 * at + 1)) if at in splits else leaves[at]


def _on_values(node, cuts: dict):
    """Thresholds on bins as thresholds on the feature's own values."""
    if isinstance(node, float):
        return node
    f, b, left, right = node
    return (f, float(cuts[f][int(b)]), _on_values(left, cuts), _on_values(right, cuts))


_KEYS = ("suffix", "segment", "start")


def with_keys(parts: DataFrame) -> DataFrame:
    """Adds the keys that rates are counted for: the last two labels of the host; with the
    first segment of the path; and with what follows it, up to one character."""
    suffix = F.substring_index("host", ".", -2)
    segment, start = F.regexp_extract("path", "^/[^/]*", 0), F.regexp_extract("path", "^/[^/]*/?[^/]?", 0)
    return parts.withColumns({"suffix": suffix, "segment": F.concat(suffix, segment), "start": F.concat(suffix, start)})


def rates(labelled: DataFrame) -> tuple[DataFrame, float]:
    """labelled(suffix, segment, start, fold, y; y may be null) to one row for each start:
    for it and its shorter keys the labelled and the blocked rows by fold, as arrays; and
    the rate of all."""
    count = lambda fold, y: F.sum(F.when(F.col("fold") == fold, y).otherwise(0.0))
    by_fold = lambda y: F.array(*(count(k, y) for k in range(FOLDS)))
    known = F.when(F.col("y").isNotNull(), 1.0).otherwise(0.0)
    table = labelled.groupBy(*_KEYS).agg(by_fold(known).alias("start_n"), by_fold(F.coalesce("y", F.lit(0.0))).alias("start_y"))
    table = materialize(table, "starts")
    for keys, name, below in ((_KEYS[:2], "segment", "start"), (_KEYS[:1], "suffix", "segment")):
        sums = [F.array(*(F.sum(F.get(f"{below}_{c}", F.lit(k))) for k in range(FOLDS))).alias(f"{name}_{c}") for c in "ny"]
        source = table.select(*_KEYS[: len(keys) + 1], f"{below}_n", f"{below}_y").distinct()
        table = table.join(source.groupBy(*keys).agg(*sums), list(keys))
    table = materialize(table.drop("suffix", "segment"), "rates")
    # each start has its suffix's sums, so the whole is counted from the starts themselves
    whole = lambda c: F.coalesce(F.sum(F.aggregate(c, F.lit(0.0), lambda a, x: a + x)), F.lit(0.0))
    n, y = table.agg(whole("start_n"), whole("start_y")).first()
    return table, (y + 0.5) / (n + 1.0)


def rate_columns(overall: float) -> dict[str, Column]:
    """The rates as features; a labelled row's own fold is left out."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    own = lambda c: F.when(F.col("y").isNotNull(), F.get(c, F.col("fold"))).otherwise(0.0)
    of = lambda c: F.coalesce(total(c) - own(c), F.lit(0.0))
    out, wider = {}, F.lit(overall)
    for name, rows in zip(_KEYS, PSEUDO_ROWS, strict=True):
        wider = (of(f"{name}_y") + rows * wider) / (of(f"{name}_n") + rows)
        out[f"{name}_rate"] = F.round(wider, 6)
    return out | {"suffix_rows": F.round(F.log1p(of("suffix_n")), 6)}


def judge(pages: DataFrame, rules=RULES, id_col="page_id", url="url", train_rows=TRAIN_ROWS, held_out: Column | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, block_score). URLs that a rule fits are the
    labelled rows, but for those ``held_out``: rates are counted over all of them, the
    trees are fitted on a sample of about ``train_rows`` chosen by hash, and every URL
    without a rule gets the trees' verdict."""
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    parts = with_parts(pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), held.alias("held")))
    rule, verdict = rule_columns(rules)
    label = F.when(~F.col("held"), F.when(F.col("given") == "block", 1.0).when(F.col("given") == "allow", 0.0))
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    parts = with_keys(parts.withColumns({"rule": rule, "given": verdict})).withColumns({"y": label, "fold": fold})
    table, overall = rates(parts)
    total = table.agg(F.coalesce(F.sum(F.aggregate("start_n", F.lit(0.0), lambda a, x: a + x)), F.lit(0.0))).first()[0]
    feats = parts.withColumns(lexical()).join(table, "start", "left").withColumns(rate_columns(overall))
    share = min(1.0, train_rows / total) if total else 0.0
    chosen = F.pmod(F.xxhash64(F.col("id"), F.col("url")), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = materialize(feats.where(F.col("y").isNotNull() & chosen).select(*FEATURES, "y"), "sample").coalesce(1)
    model = fit(sample)
    score = 1 / (1 + F.exp(-model.margin()))
    return feats.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce(F.col("given"), F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.round(score, 9).alias("block_score"),
    )
