"""Grammars of catalog descriptions, step lists and marked-up articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexicon as L
from . import text as T

# How steps name a screen to go to, something to touch, something to switch.
NAVIGATE = r"(?i)^\s*(?:navigate to and open|navigate to|go to|open|head to|swipe down .*? open)\s+(.+?)\.?\s*$"
TOUCH = r"(?i)^\s*(?:tap on|tap|touch and hold|touch|select|choose|press|click on|click)\s+(.+?)\.?\s*$"
SWITCH = r"(?i)^\s*(?:toggle on|toggle off|turn on|turn off|enable|disable|switch on|switch off)\s+(.+?)\.?\s*$"
# Tails that name the settings rather than the screen, and where a reason starts.
TARGET_TAILS = (r"\s+(?:via|in|under)\s+(?:the\s+)?device\s+settings.*$", r"\s+on\s+(?:the|your)\s+device.*$", r"\s+settings page$", r"\s+settings$", r"\s+to a specified value$")
TARGET_REASON = r"(?is)\s+to\s+(?:monitor|identify|clean|improve|suggest|ensure)\b.*$"
NO_TARGETS = ("", "device", "settings", "device settings", "the settings", "settings app")
# What a screen's name is said with.
SCREEN_HEAD, SCREEN_TAIL = r"(?i)^(the|your|device)\s+", r"(?i)\s+(on the device|on your device|screen|page)$"
SCREEN_KIND, SCREEN_THEN = r"(?i)\s+(?:option|options|menu)$", r"\s+(?:and then|then)\s+"
# Where lines are cut into sentences and clauses, and the choice that is not.
SENTENCE_END, CLAUSE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])", r"(?i),?\s+(?:and\s+then|then|and)\s+|,\s+(?=[A-Z][a-z])"
CHOICE = r"(?i)\bbetween\s+([^,.;:]{1,40}?)\s+and\s+"
CLAUSE_VERB = r"(?i)^\s*(tap|touch|select|choose|press|toggle|turn|go|open|enable|disable|enter|set)"
# Where a complaint is cut into its parts.
LIST_ITEM, COMPLAINT_END, CONJUNCTION = r"(?:^|\s)(?:\d{1,2}[.)]\s+|[-*•]\s+)", r"(?<=[.!?])\s+", r"(?i),?\s+(?:and|but|also|plus)\s+"
# Headings, the heading's own words, sub-modes, the topic, and lines that go on.
HEADING, HEADING_WORDS = r"^#{2,3}(?!#)\s*\S", r"^#{2,3}(?!#)\s*(?:Step\s*\d+\s*[:.\-]?\s*)?(.+?)\s*$"
MODE = r"(?i)^(?:To|For|In order to)\s+(.+?)\s*:\s*$"
TOPIC, TOPIC_LEAD = r"(?m)^#(?!#)\s*(?:Troubleshooting\s+)?(.+?)\s*$", r"(?i)^(?:Troubleshooting|Resolve|Fix)\s+"
GOES_ON = r"(?i)^\s*(?:Alternatively|Also|Then|Next)[,\s]"

_VERBS = "|".join(sorted(L.FAMILIES, key=len, reverse=True))
_HELD = chr(0xE000)  # a private-use character


def clean_screen(name: Column) -> Column:
    s = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\.+$", "")
    s = F.regexp_replace(s, SCREEN_HEAD, "")
    return F.trim(F.regexp_replace(s, SCREEN_TAIL, ""))


def target(description: Column) -> Column:
    """struct<family, target> of a catalog description; the target is empty where it
    names no screen of its own."""
    def parse(d: Column) -> Column:
        verb = F.lower(F.regexp_extract(d, rf"(?i)^({_VERBS})\s+", 1))
        family = F.coalesce(T.lookup(L.FAMILIES, verb), F.lit("open"))
        return T.let(family, lambda f: F.struct(f.alias("family"), rest(d, f).alias("target")))

    def rest(d: Column, family: Column) -> Column:
        s = F.regexp_replace(d, rf"(?i)^(?:{_VERBS})\s+(?:the\s+)?", "")
        for tail in TARGET_TAILS:
            s = F.regexp_replace(s, f"(?i){tail}", "")
        s = F.when(family == "monitor", F.regexp_replace(s, TARGET_REASON, "")).otherwise(s)
        s = F.regexp_replace(F.regexp_replace(s, r"(?i)^the\s+", ""), r"^[ .]+|[ .]+$", "")
        return T.let(s, lambda x: F.when(F.lower(x).isin(*NO_TARGETS), "").otherwise(x))

    return T.let(clean_screen(description), parse)


def _named(step: Column, pattern: str) -> Column:
    return F.regexp_extract(step, pattern, 1)


def path(steps: Column) -> Column:
    """The screens that steps walk through: going to a new branch starts over, touching or
    switching appends what is not there yet."""

    def screen(step: Column, pattern: str) -> Column:
        name = F.split(clean_screen(_named(step, pattern)), SCREEN_THEN)[0]
        return F.regexp_replace(name, SCREEN_KIND, "")

    usable = lambda s: (F.length(s) > 0) & (F.length(s) <= 48)

    def walk(acc: Column, step: Column) -> Column:
        seen = lambda s: F.exists(acc, lambda p: F.lower(p) == F.lower(s))
        go = lambda s: F.when((F.size(acc) > 0) & (F.lower(F.get(acc, F.lit(0))) != F.lower(s)), F.array(s)).otherwise(F.concat(acc, F.array(s)))
        add = lambda s: F.when(seen(s), acc).otherwise(F.concat(acc, F.array(s)))
        names = F.struct(screen(step, NAVIGATE).alias("n"), screen(step, SWITCH).alias("s"), screen(step, TOUCH).alias("t"))
        return T.let(names, lambda x: F.when(usable(x["n"]), go(x["n"])).when(usable(x["s"]), add(x["s"])).when(usable(x["t"]), add(x["t"])).otherwise(acc))

    return F.aggregate(steps, F.array().cast("array<string>"), walk)


def groups_by_screen(steps: Column) -> Column:
    """array<array<string>>: steps cut where they go to a new branch after three or more."""
    kind = "struct<path:array<string>,groups:array<array<string>>>"

    def walk(acc: Column, step: Column) -> Column:
        go = F.split(clean_screen(_named(step, NAVIGATE)), SCREEN_THEN)[0]
        touch = F.split(clean_screen(_named(step, TOUCH)), SCREEN_THEN)[0]
        return T.let(F.struct(go.alias("go"), touch.alias("touch")), lambda x: move(acc, step, x["go"], x["touch"]))

    def move(acc: Column, step: Column, go: Column, touch: Column) -> Column:
        trail = acc["path"]
        low = F.transform(trail, lambda p: F.lower(p))
        there = lambda s: F.array_position(low, F.lower(s))
        branch = (go != "") & (F.size(trail) > 0) & (there(go) == 0)
        last = F.element_at(acc["groups"], -1)
        new_path = (
            F.when((go != "") & ((there(go) == 1) | branch), F.array(go))
            .when(go != "", F.concat(trail, F.array(go)))
            .when((touch != "") & (there(touch) > 0), F.slice(trail, F.lit(1), there(touch).cast("int")))
            .when(touch != "", F.concat(trail, F.array(touch)))
            .otherwise(trail)
        )
        before = F.when(branch & (F.size(last) >= 3), F.concat(acc["groups"], F.array(F.array().cast("array<string>")))).otherwise(acc["groups"])
        grown = T.let(before, lambda g: F.concat(F.slice(g, F.lit(1), F.size(g) - 1), F.array(F.concat(F.element_at(g, -1), F.array(step)))))
        return F.struct(new_path.alias("path"), grown.alias("groups"))

    start = F.struct(F.array().cast("array<string>").alias("path"), F.array(F.array().cast("array<string>")).alias("groups")).cast(kind)
    return F.filter(F.aggregate(steps, start, walk)["groups"], lambda g: F.size(g) > 0)


def _hold(line: Column) -> Column:
    """Marks what must not be split: the "and" of a choice, and whole phrases."""
    s = F.regexp_replace(line, CHOICE, f"between $1 {_HELD} ")
    for k, phrase in enumerate(L.WHOLE_PHRASES, 1):
        s = F.regexp_replace(s, f"(?i){phrase}", chr(0xE000 + k))
    return s


def _release(line: Column) -> Column:
    s = F.replace(line, F.lit(_HELD), F.lit("and"))
    for k, phrase in enumerate(L.WHOLE_PHRASES, 1):
        s = F.replace(s, F.lit(chr(0xE000 + k)), F.lit(phrase))
    return s


def clauses(line: Column) -> Column:
    """The steps of one line: sentences, then clauses; fragments join the step before."""
    sentences = F.filter(F.split(F.trim(line), SENTENCE_END), lambda s: F.trim(s) != "")
    parts = F.flatten(F.transform(sentences, lambda s: F.split(_hold(F.trim(s)), CLAUSE_END)))
    parts = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(F.trim(_release(p)), r"\.+$", ""))), lambda p: p != "")

    def fold(acc: Column, p: Column) -> Column:
        fragment = ~T.is_ui_step(p) & (T.word_count(p) <= 4) & ~p.rlike(CLAUSE_VERB)
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(", ", F.get(acc, F.size(acc) - 1), p)))
        return F.when((F.size(acc) == 0) & ~T.is_ui_step(p), acc).when((F.size(acc) > 0) & fragment, joined).otherwise(F.concat(acc, F.array(p)))

    return F.filter(F.transform(F.aggregate(parts, F.array().cast("array<string>"), fold), T.imperative), lambda s: s != "")


def complaint_parts(query: Column) -> Column:
    """The sentences of a complaint."""
    return F.filter(F.transform(F.split(query, COMPLAINT_END), lambda p: F.trim(p)), lambda p: p != "")


def conjuncts(part: Column, pattern: str = CONJUNCTION) -> Column:
    """What conjunctions join."""
    return F.filter(F.transform(F.split(part, pattern), lambda s: F.trim(s)), lambda s: s != "")


def intents(query: Column, lexicon: L.Lexicon = L.STOCK) -> Column:
    """The separate complaints of a query: list items, else sentences; each is split at
    conjunctions where neighbouring parts have no atom in common."""
    generic = F.array(F.lit("generic"))
    trim = lambda p: F.regexp_replace(p, r"^[ .;]+|[ .;]+$", "")

    def split(q: Column) -> Column:
        items = F.filter(F.transform(F.split(q, LIST_ITEM), trim), lambda p: p != "")
        return T.let(F.when(F.size(items) >= 2, items).otherwise(complaint_parts(q)), lambda ps: F.flatten(F.transform(ps, one)))

    def one(part: Column) -> Column:
        pairs = F.transform(conjuncts(part), lambda s: F.struct(s.alias("s"), T.atoms(s, lexicon).alias("a")))
        return T.let(pairs, lambda ps: T.let(F.filter(ps, lambda p: p["a"] != generic), lambda kept: choose(part, ps, kept)))

    def choose(part: Column, pairs: Column, kept: Column) -> Column:
        apart = F.forall(F.zip_with(F.slice(pairs, 2, 1 << 20), F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0))), lambda x, y: F.arrays_overlap(x["a"], y["a"])), lambda o: ~o)
        return F.when((F.size(kept) >= 2) & apart, F.transform(kept, lambda p: p["s"])).otherwise(F.array(part))

    def result(q: Column) -> Column:
        return T.let(F.filter(split(q), lambda p: T.atoms(p, lexicon) != generic), lambda out: F.when(F.size(out) > 0, out).otherwise(F.array(q)))

    return T.let(F.trim(F.coalesce(query, F.lit(""))), lambda q: F.when(q == "", F.array().cast("array<string>")).otherwise(result(q)))


def sections(articles: DataFrame, id_col="id", topic="topic", content="content") -> DataFrame:
    """(id, section, heading, line_no, line): second- and third-level headings open
    sections (a "Step N:" before them goes); what stands before the first is dropped; an
    article without headings is one section named by its topic."""
    # a line separator of its own kind for each form that ends a line
    lines = articles.select(
        F.col(id_col), F.col(topic).alias("_topic"), F.col(content).rlike("(?m)" + HEADING).alias("_has"), F.posexplode(F.split(F.coalesce(content, F.lit("")), r"\R")).alias("line_no", "line")
    )
    head = F.regexp_extract("line", HEADING_WORDS, 1)
    order = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_head", F.when(F.col("line").rlike(HEADING), head))
    marked = marked.withColumn("section", F.count("_head").over(order)).withColumn("heading", F.last("_head", ignorenulls=True).over(order))
    marked = marked.withColumn("heading", F.when(~F.col("_has"), F.col("_topic")).otherwise(F.col("heading")))
    return marked.where("heading is not null and _head is null").select(id_col, "section", "heading", "line_no", "line")


def modes(section_lines: DataFrame, id_col="id") -> DataFrame:
    """sections() with the action each line belongs to: a line "To do this:" opens one
    inside its section."""
    mode = F.regexp_extract(F.trim("line"), MODE, 1)
    order = Window.partitionBy(id_col, "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = section_lines.withColumn("_mode", F.when(mode != "", mode))
    rows = rows.withColumn("chunk", F.count("_mode").over(order)).withColumn("_last", F.last("_mode", ignorenulls=True).over(order))
    name = F.when(F.col("_last").isNotNull(), F.concat_ws(" - ", "heading", "_last")).otherwise(F.col("heading"))
    return rows.withColumn("action", name).where("_mode is null").drop("_mode", "_last")


def topic_of(title: Column, content: Column) -> Column:
    """The first-level heading, without a leading "Troubleshooting" and the like; the
    title where there is none of five letters or more."""
    head = F.regexp_extract(F.coalesce(content, F.lit("")), TOPIC, 1)
    named = F.trim(F.regexp_replace(head, TOPIC_LEAD, ""))
    return F.when((F.length(head) > 4) & (named != ""), named).otherwise(F.coalesce(title, F.lit("")))


def instruction_lines(lines: DataFrame) -> DataFrame:
    """Lines that hold steps, without their bullets."""
    body = F.trim(F.regexp_replace(F.trim("line"), r"^[\-*•]+", ""))
    rows = lines.withColumn("line", body).where((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("|"))
    return rows.where(T.is_ui_step(F.col("line")) | F.col("line").rlike(GOES_ON))
