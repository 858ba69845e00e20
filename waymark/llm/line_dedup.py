"""Line dedup: long passages that a corpus repeats are cut from all documents but
their first one. DataFrame functions only.

A text is folded into lines of one word each, and a line ends a chunk if the hashes of it
and the one before it fall into the first of some classes. Where that leaves ``SPAN`` lines
in a row without an end, those of the next class end chunks as well, and so on; after the
last class tried, all lines do (but within patterns of a few words over and over, where a
few in SPAN are enough, since they read the same anywhere). So no chunk is longer than
SPAN, and of any SPAN lines of a passage one ends a chunk wherever the passage stands. A
chunk's hash is rolled over the hashes of the ``ROLL`` lines up to its end; any passage of
SPAN + ROLL words therefore holds an end whose hash matches. Chunks are matched by hash over the whole corpus; chunks
that continue the same match make a run, and every run is compared, byte by byte, with the
words in the first document, and widened word by word as long as both read the same. What
is matched in one stretch of ``min_words`` words or more goes.

Defined results: null and empty texts, and rows without an id, come back as they are;
rows with the same id and text are one document and treated alike; what repeats only
inside one document, or only among rows of one id, stays; two passages are the same if
their words are, whatever single white-space characters part them; an empty table gives
no rows; columns besides id and text are kept, but for ``removed_words`` and
``removed_spans``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Words in a row of which one ends a chunk, and words that a chunk's hash takes in.
SPAN, ROLL = 28, 20
#: One of so many classes of hashes ends chunks, and so many are tried in turn.
PARTS, TRIED = 16, 6
#: Patterns of so many lines, at most, over and over, end chunks only now and then.
PERIOD = 4
#: A chunk with more than this share of all rows is dealt with apart; so there are at most
#: 1 / HOT_SHARE of them, which is what is sent to the tasks.
HOT_SHARE = 1 / 20_000
#: Parts that the rows of such a chunk are dealt out to.
SALTS = 1024
#: How many words a match is widened by on each side of a run: more than a passage can
#: hold before its first matching window or after its last.
REACH = 30
MIN_WORDS = 40

_SPACE, _AFTER_SPACE = r"[ \t-\r]", r"(?<=[ \t-\r])"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words of a text, one white-space character after each but the last."""
    return F.split(text, _SPACE, -1)


def _joined(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def _ends(hashes: Column, start: Column, n: Column, level: int = 0) -> Column:
    """The last positions of chunks among n lines from start on, in no order."""
    every = F.sequence(start, start + n - 1)
    at = lambda i: F.get(hashes, i)
    # a line that reads like one of the few before it, as in a pattern over and over
    again = lambda i: reduce(Column.__or__, (at(i).eqNullSafe(at(i - j)) for j in range(1, PERIOD + 1)))
    if level == TRIED:
        # wherever a pattern is cut, each of its turns is met
        return F.filter(every, lambda i: ((i - start) % SPAN >= SPAN - PERIOD) | ~again(i))
    chosen = lambda i: F.pmod(at(i).bitwiseXOR(F.shiftright(at(i - 1), 3)), F.lit(PARTS)) == level

    def deeper(e: Column) -> Column:
        before = lambda k: F.coalesce(F.get(e, k - 1), start - 1)
        end = lambda k: F.coalesce(F.get(e, k), start + n)
        gaps = F.filter(F.sequence(F.lit(0), F.size(e)), lambda k: end(k) - before(k) > SPAN)
        inside = lambda k: _let(before(k), lambda a: _ends(hashes, a + 1, end(k) - a - 1, level + 1))
        return F.concat(e, F.flatten(F.transform(gaps, inside)))

    return _let(F.filter(every, lambda i: chosen(i) & ~again(i)), deeper)


def chunks(text: Column) -> Column:
    """struct<e, h>: the last word, and the hash, of each chunk."""
    rolled = lambda hashes, e: F.transform(e, lambda end: F.xxhash64(F.slice(hashes, F.greatest(end - ROLL + 2, F.lit(1)), F.least(end + 1, F.lit(ROLL)))))

    def cut(hashes: Column) -> Column:
        last = F.size(hashes) - 1
        e = F.sort_array(F.array_distinct(F.concat(_ends(hashes, F.lit(0), last + 1), F.array(last))))
        return _let(e, lambda e: F.struct(e.alias("e"), rolled(hashes, e).alias("h")))

    return _let(F.transform(words_of(text), lambda w: F.xxhash64(w)), cut)


def later_places(rows: DataFrame) -> DataFrame:
    """rows(id, k, e, h) to (id, k, e, id0, k0, e0) for every chunk that an earlier document
    has, with its first place there. Rows meet by hash once; the few hashes that hold more
    than HOT_SHARE of a sample of documents (so at most 1 / HOT_SHARE of them) have their
    first places found by partial aggregates, and their rows are dealt out."""
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(64)) == 0).groupBy("h").count()
    total = sample.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = [r["h"] for r in sample.where(F.col("count") > max(16, int(total * HOT_SHARE))).select("h").collect()]
    # dealt out, the rows of a hot hash have a first place in each part, which is replaced
    salt = F.when(F.col("h").isin(hot), 1 + F.pmod(F.xxhash64("id", "k"), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    first = F.first(F.struct("id", "k", "e")).over(Window.partitionBy("h", "salt").orderBy("id", "k"))
    found = rows.withColumn("salt", salt).withColumn("f", first)
    if hot:
        firsts = rows.where(F.col("h").isin(hot)).groupBy("h").agg(F.min(F.struct("id", "k", "e")).alias("f0"))
        found = found.join(F.broadcast(firsts), "h", "left").withColumn("f", F.coalesce("f0", "f"))
    return found.where("f.id <> id").select("id", "k", "e", *(F.col(f"f.{c}").alias(f"{c}0") for c in ("id", "k", "e")))


def runs(docs: DataFrame) -> DataFrame:
    """docs(id, text) to (id, a, b, id0, a0): words [a, b) repeat words from a0 on of the
    first document id0, by hash."""
    whole = materialize(docs.select("id", chunks(F.col("text")).alias("c")), "chunks")
    later = later_places(whole.select("id", F.posexplode(F.arrays_zip("c.e", "c.h")).alias("k", "c")).select("id", "k", "c.e", "c.h"))
    line = Window.partitionBy("id").orderBy("k", "id0", "k0")
    before = lambda c: F.lag(c).over(line)
    goes_on = (before("id0") == F.col("id0")) & (F.col("k") - before("k") == F.col("k0") - before("k0")) & (F.col("e") - before("e") == F.col("e0") - before("e0"))
    later = later.withColumn("new", F.when(goes_on & (F.col("k") - before("k") <= 1), 0).otherwise(1))
    later = later.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # the words that a chunk's hash was rolled over
    low = lambda e: F.greatest(F.min(e) - (ROLL - 1), F.lit(0))
    found = later.groupBy("id", "run").agg(low("e").alias("a"), (F.max("e") + 1).alias("b"), F.min("id0").alias("id0"), low("e0").alias("a0"))
    found = materialize(found.select("id", "a", "b", "id0", "a0"), "runs")
    discard(whole)
    return found


def _beside(words: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """The words before position a, and from b on."""
    return _joined(words, F.greatest(a - REACH, F.lit(0)), F.least(a, F.lit(REACH))), _joined(words, b, F.lit(REACH))


def matches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs(id, text) and their runs to (own, ps): for every run of a document its place,
    and the words of it and beside it in the first document."""
    n = F.expr("b - a").alias("n")
    asked = found.select("id0", "a0", n).distinct()
    asked = asked.groupBy(F.col("id0").alias("wid")).agg(F.collect_list(F.struct("a0", "n")).alias("ps"))

    def read(words: Column) -> Column:
        def one(p: Column) -> Column:
            left, right = _beside(words, p["a0"], p["a0"] + p["n"])
            return F.struct(p["a0"].alias("a0"), p["n"].alias("n"), _joined(words, p["a0"], p["n"]).alias("own"), left.alias("left"), right.alias("right"))

        return F.transform("ps", one)

    first = docs.join(asked, F.col("id") == F.col("wid"))
    first = first.select(F.col("wid").alias("id0"), F.inline(_let(words_of(F.col("text")), read)))
    both = found.withColumn("n", n).join(first, ["id0", "a0", "n"])
    return both.groupBy(F.col("id").alias("own")).agg(F.collect_list(F.struct("a", "b", "own", "left", "right")).alias("ps"))


def _alike(a: Column, b: Column) -> Column:
    """How many elements at the start of both arrays are the same."""

    def count(same: Column) -> Column:
        return _let(F.array_position(same, F.lit(False)).cast("int"), lambda at: F.when(at > 0, at - 1).otherwise(F.size(same)))

    same = lambda a, b: _let(F.least(F.size(a), F.size(b)), lambda n: F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y))
    return _let(a, lambda a: _let(b, lambda b: _let(same(a, b), count)))


_CUTS = "array<struct<a:int,b:int>>"


def _cuts(words: Column, ps: Column, min_words: int) -> Column:
    """The stretches of words [a, b) that read like the first documents, merged and
    sorted; those of min_words words or more."""
    listed = lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " ", -1))

    def one(p: Column) -> Column:
        n = F.least(p["a"], F.lit(REACH))
        left = _alike(F.reverse(F.slice(words, p["a"] - n + 1, n)), F.reverse(listed(p["left"])))
        right = _alike(F.slice(words, p["b"] + 1, REACH), listed(p["right"]))
        return F.struct((p["a"] - left).alias("a"), (p["b"] + right).alias("b"))

    def merge(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
        return F.when(last["b"] >= x["a"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    same = F.filter(ps, lambda p: _joined(words, p["a"], p["b"] - p["a"]) == p["own"])
    merged = F.aggregate(F.sort_array(F.transform(same, one).cast(_CUTS)), F.array().cast(_CUTS), merge)
    counted = F.transform(merged, lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), F.size(F.filter(F.slice(words, c["a"] + 1, c["b"] - c["a"]), lambda w: w != "")).alias("w")))
    return F.filter(counted, lambda c: c["w"] >= min_words)


def _shorter(text: Column, cs: Column) -> Column:
    """A text without the cuts; every word goes with the white space after it."""

    def kept(parts: Column) -> Column:
        end = F.struct(F.size(parts).alias("a"), F.size(parts).alias("b"), F.lit(0).alias("w"))
        piece = lambda c, i: _let(F.coalesce(F.get(cs, i - 1)["b"], F.lit(0)), lambda s: F.array_join(F.slice(parts, s + 1, c["a"] - s), ""))
        return F.array_join(F.transform(F.concat(cs, F.array(end)), piece), "")

    return _let(F.split(text, _AFTER_SPACE, -1), kept)


def dedup(docs: DataFrame, id_col="doc_id", text="text", min_words=MIN_WORDS) -> DataFrame:
    """docs with its text shortened, and removed_words and removed_spans added."""
    others = [c for c in docs.columns if c not in (text, "removed_words", "removed_spans")]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("others"))
    # the same rows in both joins, so that Spark moves the texts once
    named = rows.where("id is not null")
    joined = named.join(matches(named, runs(named.select("id", "text"))), F.col("id") == F.col("own"), "left")

    def result(cs: Column) -> Column:
        return F.struct(
            F.when(F.size(cs) > 0, _shorter(F.col("text"), cs)).otherwise(F.col("text")).alias("text"),
            F.aggregate(cs, F.lit(0), lambda n, c: n + c["w"]).alias("words"), F.size(cs).alias("spans"),
        )

    whole = F.struct(F.col("text"), F.lit(0).alias("words"), F.lit(0).alias("spans"))
    cut = _let(_let(words_of(F.col("text")), lambda words: _cuts(words, F.col("ps"), min_words)), result)
    done = joined.select("others", F.explode(F.array(F.when(F.col("ps").isNotNull(), cut).otherwise(whole))).alias("done"))
    done = done.unionAll(rows.where("id is null").select("others", whole.alias("done")))
    return done.select(
        *(F.col("done.text").alias(text) if c == text else F.col(f"others.`{c}`") for c in docs.columns if c not in ("removed_words", "removed_spans")),
        F.col("done.words").alias("removed_words"), F.col("done.spans").alias("removed_spans"),
    )
