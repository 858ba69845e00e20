"""Paraphrases of a complaint, chosen by a hash of a seed: column expressions, so the same
rows come out on any machine and in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Paraphrase frames by register; {s} problem, {S} the same with a capital,
# {d} device word, {k} keywords.
FRAMES = (
    ("My device {s} and I would like assistance resolving this.", "{S} on my device after the recent change; please advise.", "I am experiencing the following issue: {s}."),
    ("so my {d} keeps {s} and its driving me crazy", "hey my {d} {s} out of nowhere, any fix?", "my {d} just {s}, started this morning"),
    ("{k}", "{k} fix", "how to fix {k}"),
    ("this is so annoying, my {d} {s} and i cant do anything about it", "seriously why does my {d} {s} every single time, ive tried everything"),
    ("my {d} {s} and i cant figur out wat to doo", "device {s} pls halp"),
)
# The device word, and how many texts are tried and kept.
DEVICE, TRIED, KEPT = "phone", 40, 10


def drawn(below: Column | int, *key: Column) -> Column:
    """A number from 0 on, below a bound, that depends on the key alone."""
    digits = F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in key)).cast("binary")), 1, 8)
    bound = below if isinstance(below, Column) else F.lit(below)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), bound).cast("int")


def misspelled(word: Column, *key: Column) -> Column:
    """A letter inside left out, or changed places with the next; words under four
    letters stay."""
    n = F.length(word)
    at = drawn(F.greatest(n - 2, F.lit(1)), *key, F.lit("place")) + 2
    head, own, tail = F.substring(word, F.lit(1), at - 1), F.substring(word, at, F.lit(1)), F.substring(word, at + 1, n)
    swapped = F.concat(head, F.substring(tail, 1, 1), own, F.substring(tail, F.lit(2), n))
    return F.when(n < 4, word).when(drawn(2, *key, F.lit("kind")) == 0, F.concat(head, tail)).otherwise(swapped)


def paraphrases(text: Column, keywords: Column, seed: Column, extra: int = 9) -> Column:
    """The text and up to ``extra`` different paraphrases: registers take turns, the frame
    within one and the misspellings of the last one are drawn."""
    problem = F.coalesce(keywords, F.lit(""))

    def framed(frame: str) -> Column:
        out = F.lit(frame)
        for slot, value in (("{s}", problem), ("{S}", T.first_upper(F.lower(problem))), ("{d}", F.lit(DEVICE)), ("{k}", problem)):
            out = F.replace(out, F.lit(slot), value) if slot in frame else out
        return out

    def turn(t: int) -> Column:
        frames = FRAMES[t % len(FRAMES)]
        chosen = F.get(F.array(*map(framed, frames)), drawn(len(frames), seed, F.lit(t)))
        if frames is not FRAMES[-1]:
            return chosen
        return F.array_join(F.transform(T.split_words(chosen), lambda w, i: misspelled(w, seed, F.lit(t), i)), " ")

    tried = F.concat(F.array(F.trim(F.coalesce(text, F.lit("")))), F.array(*map(turn, range(TRIED))))
    return F.slice(F.array_distinct(tried), 1, min(KEPT, extra + 1))
