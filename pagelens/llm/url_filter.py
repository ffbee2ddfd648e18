"""URL filter: allow and block rules, then gradient-boosted trees on lexical features.

Rules decide what they fit. Other URLs are judged by trees over features of the URL's text:
lengths, depth, shares of digits and of hyphens, entropy, parameters, and statistics of the
host's suffixes: how often URLs of other hosts with the same last three, two and one labels
are bad, smoothed. These are exact counts over all labelled URLs, added up by Spark per suffix
and fold of hosts; the fold of a host never describes it, in training or later.

Labels come from a table of hosts, if one is given. Otherwise a host is bad if a word of it is on a
short list, so that the trees can be no better than that list; generated URLs of both kinds then
stand in where a corpus has few. The trees are fitted to about ``TRAINING_URLS`` different
URLs, chosen by a hash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import narrow_batches, written

TRAINING_URLS = 40_000
GENERATED = 4_000
FOLDS = 5
# Labels of a host that a suffix has.
SUFFIXES = (3, 2, 1)
# A key is hot with more than a HOT-th of the rows, so fewer than HOT keys are; its rows are dealt over PLACES.
HOT, PLACES = 100, 64
TREES, DEPTH, BINS, RATE, RIDGE = 60, 3, 32, 0.2, 1.0

# (verdict, host, path); a longer rule goes before a shorter one, the first of equal ones before the others.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# Words of hosts that label a URL as bad.
BAD_WORDS = frozenset(
    "ads adult affiliate bet bets betting casino clickbait escort gambling loan loans lottery malware payday phishing pills "
    "poker porn sex slots spam viagra warez xxx".split()
)
# Plain and suspicious words for generated hosts.
PLAIN_WORDS = (
    "north", "river", "daily", "city", "open", "green", "museum", "garden", "school", "health", "travel", "music", "market",
    "science", "kitchen", "library", "sports", "weather", "nature", "history", "blog", "wiki", "docs", "forum",
)
LURES = ("free", "cheap", "win", "best", "online", "fast", "easy", "farm", "track", "deal", "bonus", "hot", "top", "click")
ENDINGS = ("com", "net", "org", "info", "biz", "de", "fr")

_WORDS = re.compile(r"[a-z0-9]+")
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), *_ASCII)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)
    for decision, own, start in reversed(ordered):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def split_url(url: str) -> tuple[str, str, str]:
    """Host, path and query of a URL, as in url_parts."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    query = rest[len(host) + len(path) :].partition("#")[0]
    return host.translate(str.maketrans(*_ASCII)), path, query


def label(host: str) -> int:
    """1 for a bad host: a word of the list in its name, or no host at all."""
    return int(not host or not BAD_WORDS.isdisjoint(_WORDS.findall(host)))


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def lexical(host: str, path: str, query: str) -> list[float]:
    url = host + path + query
    labels = host.split(".")
    name = max(labels, key=len)
    n = max(1, len(url))
    words = _WORDS.findall(host)
    return [
        len(url), len(host), len(path), len(query), path.count("/"), len(labels), sum(c.isdigit() for c in url) / n,
        sum(c.isdigit() for c in host) / max(1, len(host)), host.count("-"), entropy(host), entropy(path), query.count("=") + query.count("&"),
        len(name), max(map(len, words), default=0), len(words), sum(not c.isascii() for c in url) / n,
        sum(c in "aeiou" for c in host) / max(1, len(host)), sum(c in "%@_~" for c in url) / n, float(not host),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of DEPTH: a feature and a cut per inner node, a value per leaf."""

    cuts: list[np.ndarray]
    features: np.ndarray
    levels: np.ndarray
    leaves: np.ndarray
    shift: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1)
        out, rows = np.full(len(x), self.shift), np.arange(len(x))
        for feature, level, leaf in zip(self.features, self.levels, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, feature[node]] > level[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees by Newton boosting on the logistic loss, over quantile bins."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], axis=1)
    inner = 2**DEPTH - 1
    shift = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    margin = np.full(len(y), shift)
    features, levels, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = y - p, p * (1 - p)
        feature, level = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)  # no split: all to the left
        node = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            low, width = 2**depth - 1, 2**depth
            gain = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                place = (node - low) * BINS + binned[:, f]
                g = np.cumsum(np.bincount(place, slope, width * BINS).reshape(width, BINS), axis=1)
                h = np.cumsum(np.bincount(place, bend, width * BINS).reshape(width, BINS), axis=1)
                right_g, right_h = g[:, -1:] - g, h[:, -1:] - h
                gains = g**2 / (h + RIDGE) + right_g**2 / (right_h + RIDGE) - (g[:, -1] ** 2 / (h[:, -1] + RIDGE))[:, None]
                best = gains.argmax(axis=1)
                value = gains[np.arange(width), best]
                better = value > gain
                gain[better] = value[better]
                feature[low : low + width][better], level[low : low + width][better] = f, best[better]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > level[node])
        leaf = RATE * np.bincount(node - inner, slope, inner + 1) / (np.bincount(node - inner, bend, inner + 1) + RIDGE)
        margin += leaf[node - inner]
        features.append(feature)
        levels.append(level)
        leaves.append(leaf)
    return Trees(cuts, np.array(features), np.array(levels), np.array(leaves), shift)


def features(url: str, rates: tuple[float, ...]) -> list[float]:
    return [*lexical(*split_url(url)), *rates]


def blocked(trees: Trees, urls: list[str], rates: list[tuple[float, ...]]) -> list[bool]:
    rows = [features(u, r) for u, r in zip(urls, rates, strict=True)]
    return (trees.margin(np.array(rows)) >= 0).tolist() if rows else []


def generated(n: int, seed: int = 13) -> list[str]:
    """n URLs with bad hosts and n with others, in turn."""
    rng = np.random.default_rng(seed)

    def pick(options):
        return options[int(rng.integers(len(options)))]

    bad_words = sorted(BAD_WORDS)
    out = []
    for i in range(2 * n):
        if i % 2 == 0:
            parts = [pick(bad_words), pick(LURES)]
            name = pick(("-", "-", "")).join(parts if rng.random() < 0.5 else parts[::-1]) + pick(("", "", str(rng.integers(1, 999))))
        else:
            name = pick(("", "-")).join([pick(PLAIN_WORDS)] + [pick(PLAIN_WORDS)] * int(rng.integers(0, 2)))
        host = f"{pick(('', 'www.', 'm.', 'blog.'))}{name}.{pick(('', '', 'example.'))}{pick(ENDINGS)}"
        path = "".join(f"/{pick(PLAIN_WORDS)}" for _ in range(int(rng.integers(0, 3)))) + pick(("", "/", f"/{rng.integers(1, 9999)}.html"))
        out.append(f"{pick(('http', 'https'))}://{host}{path}{pick(('', '', '?page=2&ref=x', '#top', '?utm_source=feed'))}")
    return out


def listed_bad(host: Column) -> Column:
    """``label`` as a column."""
    words = F.array(*[F.lit(w) for w in sorted(BAD_WORDS)])
    return ((host == "") | F.arrays_overlap(F.split(host, "[^a-z0-9]+"), words)).cast("int")


def host_table(urls: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """host, n (its URLs) and bad (1, 0, or null if not labelled) of each host of ``urls(host)``."""
    hosts = urls.groupBy("host").agg(F.count("*").alias("n"))
    if labels is None:
        return hosts.withColumn("bad", listed_bad(F.col("host")))
    known = labels.groupBy(F.translate(F.col("host").cast("string"), *_ASCII).alias("host")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    return hosts.join(known, "host", "left")


def _suffixes(host: Column) -> Column:
    """Suffixes of a host, each with its number of labels before it."""
    return F.array(*[F.concat(F.lit(f"{k}:"), F.substring_index(host, ".", -k)) for k in SUFFIXES])


def _fold() -> Column:
    """URLs of a host are in one fold."""
    return F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(FOLDS)).cast("int")


def suffix_counts(hosts: DataFrame) -> DataFrame:
    """Hosts of each suffix, their labelled URLs and bad ones, the latter two also by fold as arrays."""
    labelled = F.when(F.col("bad").isNotNull(), F.col("n"))
    rows = hosts.select(_fold().alias("fold"), labelled.alias("n"), (F.col("n") * F.col("bad")).alias("n_bad"), F.explode(_suffixes(F.col("host"))).alias("suffix"))

    def of_folds(name: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(name))), F.lit(0)) for f in range(FOLDS)])

    return rows.groupBy("suffix").agg(
        F.count("*").alias("hosts"), F.sum("n").alias("seen"), F.sum("n_bad").alias("bad"), of_folds("n").alias("seen_in"), of_folds("n_bad").alias("bad_in")
    )


def hot_keys(table: DataFrame, key: str, weight: str) -> list[str]:
    """Keys of a table with one row per key that hold more than a HOT-th of all weight: fewer than HOT names."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    return [r[0] for r in table.filter(F.col(weight) > total / HOT).select(key).collect()]


def spread_join(rows: DataFrame, side: DataFrame, key: str, hot: list[str], dealt_by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with ``side``, which has one row per key: rows of a hot key are dealt over places, each with a copy of that row."""
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    place = F.when(is_hot, F.pmod(F.xxhash64(*dealt_by), F.lit(PLACES)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(PLACES - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("place", place).join(side.withColumn("place", F.explode(copies)), [key, "place"], how).drop("place")


def host_rates(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host and its rates (in the order of SUFFIXES), from the other folds, for distinct hosts.

    A hot suffix is one of very many hosts, as a country's or `com`.
    """
    keyed = hosts.select("host", _fold().alias("fold"), F.posexplode(_suffixes(F.col("host"))).alias("at", "suffix"))
    hot = hot_keys(counts, "suffix", "hosts")
    others = [F.coalesce(F.col(c) - F.get(f"{c}_in", "fold"), F.lit(0)) for c in ("bad", "seen")]
    rated = spread_join(keyed, counts, "suffix", hot, ["host"], "left").select("host", "at", ((others[0] + 0.5) / (others[1] + 5.0)).alias("rate"))
    by_length = [F.max(F.when(F.col("at") == i, F.col("rate"))) for i in range(len(SUFFIXES))]
    return rated.groupBy("host").agg(F.array(*by_length).alias("rates"))


def train(urls: DataFrame, hosts: DataFrame, counts: DataFrame, listed: bool = True, training_urls: int = TRAINING_URLS) -> Trees:
    """Trees for ``urls(url, host)``; with ``listed`` labels they also see generated URLs and some without a host.

    What reaches the driver is about ``training_urls`` URLs, however often one of them stands in the table.
    """
    different = urls.agg(F.approx_count_distinct("url", 0.01)).first()[0]
    share = min(1.0, training_urls / max(1, different))
    chosen = urls.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_003)) < int(share * 1_000_003)).distinct()
    sample = chosen.join(hosts.filter("bad IS NOT NULL").select("host", "bad"), "host")
    if listed:
        made = generated(GENERATED) + [""]
        extra = urls.sparkSession.createDataFrame(pa.table({"url": made, "host": [split_url(u)[0] for u in made]}))
        sample = sample.unionByName(extra.withColumn("bad", listed_bad(F.col("host"))))
    rated = sample.join(host_rates(sample.select("host").distinct(), counts), "host").select("url", "bad", "rates").toArrow().to_pylist()
    rows = sorted(((r["url"], r["bad"], tuple(r["rates"])) for r in rated))
    # Not one URL but many of a real table may lack a host.
    rows += [r for r in rows if r[0] == ""] * 50
    if not rows:
        raise ValueError("no URL of the table has a labelled host")
    return boosted(np.array([features(u, r) for u, _, r in rows]), np.array([bad for _, bad, _ in rows], dtype=float))


def judge_urls(pages: DataFrame, rules=RULES, trees: Trees | None = None, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    pages: page_id, url; other columns are not read. A null url, or one without ``://``, has
    empty host and path; no rule fits it, and the trees judge it as a URL without a host.
    Repeated rows give repeated rows, no rows none. labels(host, bad 0 or 1) replaces the word
    list; a host that it labels both ways is bad, hosts it does not name are only judged.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    host, path = url_parts(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})

    hosts = written(host_table(rows.select("host"), labels), "url-hosts")
    counts = written(suffix_counts(hosts), "url-suffixes")
    if trees is None:
        if not hosts.head(1):
            return rows.select("page_id", "host", "path", "rule", "verdict")
        trees = train(rows.select("url", "host"), hosts, counts, labels is None)
    sent = pages.sparkSession.sparkContext.broadcast(trees)

    def judge(batches):
        for batch in batches:
            rates = batch.column("rates").to_pylist()
            bad = blocked(sent.value, batch.column("url").to_pylist(), rates)
            verdicts = pa.array(["block" if b else "allow" for b in bad], pa.string())
            kept = [batch.column(n) for n in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*kept, verdicts], names=["page_id", "host", "path", "rule", "verdict"])

    # Every host of the table is among the rated ones.
    ruled = rows.filter("verdict IS NOT NULL").select("page_id", "host", "path", "rule", "verdict")
    rated = spread_join(rows.filter("verdict IS NULL"), host_rates(hosts, counts), "host", hot_keys(hosts, "host", "n"), ["page_id", "url"])
    judged = narrow_batches(rated).mapInArrow(judge, "page_id bigint, host string, path string, rule string, verdict string")
    return ruled.unionByName(judged)
