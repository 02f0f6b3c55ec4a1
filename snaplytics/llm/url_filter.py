"""URL filter by a sorted digest array.

Entries are texts "host + path prefix" (``net/``, ``example.org/en/1``) or hosts alone
(``spam.example.com``); an entry fits its host, all subdomains, and paths that begin like its own. Blocked
labels (``casino-win``) are entries too and fit a host that has them between any two dots. The entries' 64-bit
xxHash values are sorted into arrays, one per range of digests, kept with the full texts. A
lookup writes the array of its range to a file, maps it into memory, finds all keys by one
vectorised binary search, and confirms every hit against the stored text, so digests that
collide change nothing.

Keys to look up are all domain suffixes of a host with the beginnings of the path that have
the length of some entry's path, and the host's labels. They are made from distinct hosts and path heads and are
themselves distinct, so a host with a third of all pages costs no more than any other. Both
the entries and the keys are dealt by digest into groups of bounded size; neither is ever
collected or broadcast whole.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplytics.llm.common import stored

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Words that blocked labels are made of, by default: a subject with a trade, or a bait with goods.
SUBJECTS = ("ad", "ads", "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "phishing", "pills", "poker", "porn",
            "sex", "slots", "spam", "viagra", "warez", "webcam", "xxx")
TRADES = ("bonus", "cash", "click", "clicks", "club", "deals", "farm", "girls", "live", "money", "now", "offers", "online", "shop", "spins",
          "store", "track", "tracker", "tracking", "tube", "video", "vip", "win", "wins", "x", "xxx", "zone")
BAITS = ("best", "buy", "cheap", "discount", "easy", "fast", "free", "hot", "instant", "lucky")
GOODS = ("bets", "betting", "casino", "drugs", "followers", "jackpot", "loans", "lotto", "meds", "pills", "poker", "porn", "sex", "slots",
         "spins", "viagra", "warez", "xxx")
KEYS_AT_ONCE = 100_000  # entries, or keys looked up, of one group
LISTED = "listed"  # kind of an entry that blocks without being a rule
LABEL_OF = "*.{}.*"  # entry of a label
ENTRIES = "entry string, path_length int, kind string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_entries(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [(host + path, len(path), verdict) for host, path, verdict in rules]
    return spark.createDataFrame(rows, ENTRIES)


def blocked_labels() -> list[str]:
    """The default labels, with and without a hyphen; none is taken from the pages judged."""
    pairs = [(a, b) for a in SUBJECTS for b in TRADES] + [(a, b) for a in BAITS for b in GOODS]
    return sorted({f"{a}{hyphen}{b}" for a, b in pairs if a != b for hyphen in ("-", "")})


def label_entries(spark: SparkSession, labels: Iterable[str] | None = None) -> DataFrame:
    """Entries that block every host with one of ``labels`` (in lower case) between any two dots."""
    rows = [(LABEL_OF.format(label), 0, LISTED) for label in (blocked_labels() if labels is None else labels)]
    return spark.createDataFrame(rows, ENTRIES)


def _digests(texts: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts), np.uint64, len(texts))


def _build(group: pa.Table) -> pa.Table:
    """The sorted digests of one range with texts and kinds in the same order."""
    texts, kinds = group["entry"].to_pylist(), group["kind"].to_pylist()
    digests = _digests(texts)
    order = np.argsort(digests, kind="stable")
    return pa.table(
        {
            "part": group["part"].slice(0, 1),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "entries": pa.array([[texts[i] for i in order]], pa.list_(pa.string())),
            "kinds": pa.array([[kinds[i] for i in order]], pa.list_(pa.string())),
        }
    )


def probe(digests: np.ndarray, entries: list[str], asked: list[str]) -> np.ndarray:
    """Place of every asked text in the array sorted by digest, -1 where it is not held."""
    own = _digests(asked)
    at = np.searchsorted(digests, own)
    out = np.full(len(asked), -1, np.int64)
    open_ = np.flatnonzero(at < len(digests))
    while len(open_):  # on equal digests, one round for each text that shares one
        open_ = open_[digests[at[open_]] == own[open_]]
        same = np.fromiter((entries[at[i]] == asked[i] for i in open_), bool, len(open_))
        out[open_[same]] = at[open_[same]]
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < len(digests)]
    return out


def _lookup(left: pa.Table, right: pa.Table) -> pa.Table:
    asked = left["entry"].to_pylist()
    places, kinds = np.full(len(asked), -1), []
    if asked and right.num_rows:
        index = right.slice(0, 1).to_pylist()[0]
        kinds = index["kinds"]
        with tempfile.TemporaryDirectory() as own:
            path = os.path.join(own, "digests")
            with open(path, "wb") as file:
                file.write(index["digests"])
            places = probe(np.memmap(path, np.uint64, "r"), index["entries"], asked)
    hit = np.flatnonzero(places >= 0)
    return pa.table({"entry": left["entry"].take(pa.array(hit)), "kind": pa.array([kinds[places[i]] for i in hit], pa.string())})


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("entry"), F.lit(parts)).cast("int")


def look_up(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, kind) for the distinct texts of ``keys`` that ``entries`` (distinct) hold."""
    parts = max(1, math.ceil(max(keys.count(), entries.count()) / KEYS_AT_ONCE))
    index = entries.withColumn("part", _part(parts)).groupBy("part").applyInArrow(
        _build, "part int, digests binary, entries array<string>, kinds array<string>"
    )
    asked = keys.withColumn("part", _part(parts)).groupBy("part")
    return asked.cogroup(index.groupBy("part")).applyInArrow(_lookup, "entry string, kind string")


def judge_urls(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, listed.

    The longest rule that fits decides, of equally long ones the last in order; without a rule, a page whose host is listed,
    or has a listed label, is blocked and any other allowed; ``listed`` is the longest, then last such entry. A null url, or one without ``://``, has an empty host and path and is
    allowed. Null ids and repeated rows are judged like others; an empty table gives no rows.
    Further columns are ignored. ``entries`` has entry, path_length and kind ("allow" or "block" for rules,
    "listed" for blocked hosts); a text that is there twice counts once, rules first.
    """
    rank = F.when(F.col("kind") == LISTED, 1).otherwise(0)
    entries = entries.groupBy("entry").agg(F.min_by("kind", rank).alias("kind"), F.max("path_length").alias("path_length"))
    entries = stored(entries, "entries")
    lengths = sorted(r[0] for r in entries.select("path_length").distinct().collect())  # no more than lengths of a path
    parsed = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = stored(parsed.withColumn("head", F.substring("path", 1, max(lengths, default=0))), "urls")
    heads = parsed.select("host", "head").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("head"))
    begun = F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda n: F.concat(s, F.substr("head", F.lit(1), n)))))
    own_labels = F.transform(labels, lambda label: F.format_string(LABEL_OF.replace("{}", "%s"), label))
    asked = heads.select("host", "head", F.explode(F.array_union(begun, own_labels)).alias("entry"))
    found = look_up(asked.select("entry").distinct(), entries.select("entry", "kind"))
    is_rule = F.col("kind") != LISTED
    fits = asked.join(found, "entry").groupBy("host", "head").agg(
        F.max(F.when(is_rule, F.struct(F.length("entry"), "entry", "kind"))).alias("best"),
        F.max(F.when(~is_rule, F.struct(F.length("entry"), "entry"))).alias("listed"),
    )
    method = F.when(F.col("listed").isNotNull(), "block").otherwise("allow")
    return parsed.join(fits, ["host", "head"], "left").select(
        "page_id", "host", "path", F.col("best.entry").alias("rule"), F.coalesce("best.kind", method).alias("verdict"), F.col("listed.entry").alias("listed")
    )
