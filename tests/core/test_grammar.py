"""Text and grammar functions on given pairs, and properties that must hold."""

import random

import pytest
from pyspark.sql import functions as F
from waymark.functions import grammar as G
from waymark.functions import paraphrase as P
from waymark.functions import text as T
from waymark.functions import unicode as U
from waymark.operators import gates


def apply(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").coalesce(1)
    return [r.out for r in rows.select("k", function(F.col("v")).alias("out")).orderBy("k").collect()]


def test_targets(spark):
    got = apply(spark, [
        "Opens the Wi-Fi scanning settings page in device Settings on the device.", "Disables adaptive battery via device Settings on the device.",
        "Diagnoses excessive battery drain to identify power-hungry apps.", "Opens device settings.", "", None, "Updates screen timeout to a specified value",
    ], G.target)
    assert [(r.family, r.target) for r in got] == [
        ("open", "Wi-Fi scanning"), ("disable", "adaptive battery"), ("monitor", "excessive battery drain"), ("open", ""), ("open", ""), ("open", ""), ("update", "screen timeout"),
    ]


def test_polarity(spark):
    assert apply(spark, ["Toggle on Wi-Fi scanning.", "Toggle off Wi-Fi scanning.", "Tap on Display.", "Disable it, then enable it"], T.polarity) == ["enable", "disable", "none", "enable"]


def test_clauses(spark):
    got = apply(spark, [
        "Navigate to Settings. Tap Apps. Select your email app. Tap Storage.", "Select your preferred navigation type between Buttons and Swipe gestures.",
        "Press and hold the Power button.", "Go to Settings, tap Connections, and then tap Wi-Fi", "The weather is nice", "", "Set up the account and turn on sync",
    ], G.clauses)
    assert got[0] == ["Navigate to Settings.", "Tap Apps.", "Select your email app.", "Tap Storage."]
    assert got[1] == ["Select your preferred navigation type between Buttons and Swipe gestures."]
    assert got[2] == ["Press and hold the Power button."]
    assert got[3] == ["Go to Settings.", "Tap Connections.", "Tap Wi-Fi."]
    assert got[4:6] == [[], []] and got[6] == ["Set up the account.", "Turn on sync."]


def test_titles(spark):
    assert apply(spark, ["enable wi-fi scanning", "check the USB port on a pc", ""], T.title_case) == ["Enable Wi-Fi Scanning", "Check the USB Port on a PC", ""]
    assert apply(spark, ["Check Email Access on a PC", "24-Hour Mode", "Clear The Cache", "Use Wi-Fi (QR)", "check it", "Open settings page", ""], T.is_title_case) == [True, True, True, True, False, False, False]
    assert apply(spark, ["Battery drain issue on your phone", "fix", "Screen flicker after update guide"], T.title) == ["Battery drain", "Fix", "Screen flicker after"]


def test_descriptions_have_five_to_seven_words(spark):
    rng = random.Random(0)
    words = "clear check the app's cache storage battery usage open back up wipe a data for phone settings, now screen-time".split()
    names = ["", "Reset", "Settings - Clear the App's Cache", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(200))]
    assert all(d.startswith("It will ") and 5 <= len(d.split()) <= 7 for d in apply(spark, names, T.describe))
    leaves = ["", None, "The Display", "Wi-Fi", "advanced network and connection sharing options menu", *names]
    assert all(d.startswith("It will ") and 5 <= len(d.split()) <= 7 for d in apply(spark, leaves, T.describe_screen))


def test_addresses(spark):
    assert apply(spark, ["see https://x.y", "www.a", "go to a.com now", "[a](b)", "open voiceassist://a.com/b", "plain text.", None], T.leaks_address) == [True, True, True, True, False, False, False]


def test_signatures(spark):
    a, b, c, d, e, f = apply(spark, ["screen flickers and goes blank", "goes blank and the screen flickers", "battery drains fast", "camera is blurry", "My Nexa Fold X1 screen is blank", "tablet screen is blank"], T.signature)
    assert a == b == "display::blank+flicker::trigger:none" and c != d and e == f
    assert apply(spark, ["", None, "12 a b"], T.signature) == ["other::generic::trigger:none"] * 3


def test_intents(spark):
    got = apply(spark, ["screen flickers. battery drains fast. wifi keeps dropping.", "my phone screen is blank black dark", "", "1. screen flickers 2. battery drains", "battery drains and camera is blurry"], G.intents)
    assert [len(x) for x in got] == [3, 1, 0, 2, 2]


def test_paths(spark):
    steps = [["Navigate to Settings.", "Tap Connections.", "Tap Wi-Fi option.", "Toggle on Wi-Fi scanning."], ["Open Settings.", "Tap Display.", "Go to Apps.", "Tap Storage."], [], ["Wait a while."]]
    assert apply(spark, steps, G.path, "array<string>") == [["Settings", "Connections", "Wi-Fi", "Wi-Fi scanning"], ["Apps", "Storage"], [], []]
    long = ["Open Settings.", "Tap Display.", "Tap Brightness.", "Go to Apps.", "Tap Storage."]
    assert apply(spark, [long, long[1:]], G.groups_by_screen, "array<string>") == [[long[:3], long[3:]], [long[1:]]]


def test_order(spark):
    assert apply(spark, [["auto", "manual", "critical"], ["manual", "auto"], []], gates.in_order, "array<string>") == [True, False, True]


def test_paraphrases(spark):
    rows = spark.createDataFrame([(k, " screen flickers after app install ", "flicker app install") for k in (3, 4, 3)] + [(5, None, None)], "seed long, t string, k string").coalesce(1)
    first, other, again, empty = [r.v for r in rows.select(P.paraphrases(F.col("t"), F.col("k"), F.col("seed")).alias("v")).collect()]
    assert len(first) == 10 and len(set(first)) == 10 and first[0] == "screen flickers after app install"
    assert first == again != other and empty[0] == "" and len(empty) == len(set(empty))
    words = spark.createDataFrame([(w, k) for w in ("abc", "abcd", "keyboard") for k in range(30)], "w string, k long")
    for r in words.select("w", P.misspelled(F.col("w"), F.col("k")).alias("m")).collect():
        letters = sorted(r.w)
        assert r.m == r.w if len(r.w) < 4 else r.m[0] == r.w[0] and (sorted(r.m) == letters and r.m != r.w or len(r.m) == len(r.w) - 1 and not set(r.m) - set(letters))


@pytest.mark.parametrize("text", ["", "ab", "Élan vital"])
def test_hashed_vector(text):
    v = U.hashed_vector(text)
    assert v.shape == (U.DIMENSIONS,) and (abs((v * v).sum() - 1) < 1e-5 or not v.any())
