"""URL filter: rules first, then gradient-boosted trees on lexical features.

DataFrame functions only. Trees are grown level by level from histograms of
gradients (node, feature, bin) that the executors sum over the labelled URLs; the
driver sees those sums, whose number is bounded by nodes x features x bins, and
picks the splits. The model is then one expression, evaluated inside code
generation over every URL.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.llm.common import checkpointed

#: (rule, verdict); a rule is host/path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
TREES, DEPTH, RATE, LAMBDA, BINS = 12, 2, 0.5, 1.0, 64
#: At most so many labelled URLs train the trees, taken by the hash of the URL.
MAX_LABELLED = 50_000

#: Labelled names (1: block) for where a caller has no labels: how sites of either kind tend to be
#: called. They are taken from no table; both kinds have the same paths, so names alone tell them apart.
BLOCKED_NAMES = (
    "win-big-jackpot", "free-movies-4u", "best-loans-now", "hot-deals-24", "click-to-win", "buy-followers-fast", "replica-watches", "slots-bonus-777",
    "fast-cash-today", "meds-online-shop", "adult-cams-live", "crypto-double-1000", "seo-link-wheel", "lose-weight-quick", "poker777", "meds4u247",
    "xxx24x7", "bet365win88", "cheap-rx", "free-spins", "track-clicks", "popup-ads", "get-rich-9", "hot-singles",
)
ALLOWED_NAMES = (
    "library", "weather", "museum", "cityhall", "university", "gardening", "orchestra", "journal", "physics", "cathedral", "recipes", "history",
    "railways", "music", "archive", "council", "open-data", "e-learning", "mathnews", "route66", "botany", "harbour", "theatre", "cartography",
)
PATHS = ("/", "/articles/2021/introduction", "/index.php?id=7&view=full", "/docs/manual.pdf", "/p/8841", "/tag/music/?sort=new#list")
FEATURES = ("length", "host_length", "depth", "labels", "hyphens", "digits", "host_digits", "entropy", "host_entropy", "params", "suffix")


def default_labelled(spark: SparkSession) -> DataFrame:
    """The built-in labelled URLs: every name above under three suffixes and two paths each."""
    rows = []
    for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)):
        for k, name in enumerate(names):
            for j, suffix in enumerate(("com", "org", "net")):
                for i in range(2):
                    sub = ("www.", "", "news.", "my.")[(k + j + i) % 4]
                    rows.append((f"https://{sub}{name}.example.{suffix}{PATHS[(k + 2 * j + 3 * i) % len(PATHS)]}", label))
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.index("/")
        own, start = text[:at], text[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _entropy(text: Column) -> Column:
    """Bits of the character distribution of a text; 0 if empty."""
    n = F.length(text).cast("double")
    bits = F.aggregate(
        F.array_distinct(F.split(text, "")),
        F.lit(0.0),
        lambda acc, c: acc + F.when(c == "", F.lit(0.0)).otherwise(((F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n) * F.log2(n / F.greatest(F.lit(1), F.length(text) - F.length(F.replace(text, c, F.lit("")))))),
    )
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(F.concat(F.lit("."), host), r"\."), -1)


def with_features(urls: DataFrame, suffixes: dict[str, int], url_col: str = "url") -> DataFrame:
    """Add ``host``, ``path`` and one small whole number (0 to BINS - 1) for each feature, named ``f_<feature>``.

    ``suffixes``: the bin of each suffix seen in training; others are in the middle.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    out = urls.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    suffix = F.lit(BINS // 2)
    for s, b in sorted(suffixes.items()):
        suffix = F.when(suffix_of(host) == s, F.lit(b)).otherwise(suffix)
    share = lambda text: F.when(F.length(text) > 0, _count(text, "[0-9]") * 40 / F.length(text)).otherwise(0)
    raw = {
        "length": F.length(url) / 4,
        "host_length": F.length(host) / 2,
        "depth": _count(path, "/"),
        "labels": F.size(F.split(host, r"\.")),
        "hyphens": _count(host, "-"),
        "digits": share(url),
        "host_digits": share(host),
        "entropy": _entropy(url) * 8,
        "host_entropy": _entropy(host) * 8,
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "suffix": suffix,
    }
    return out.select("*", *[F.least(F.lit(BINS - 1), F.floor(raw[f]).cast("int")).alias(f"f_{f}") for f in FEATURES])


@dataclass(frozen=True)
class Boosted:
    """``trees``: each either a leaf's value or (feature, bin, left if at most, right)."""

    prior: float
    trees: tuple
    suffixes: dict[str, int]

    def margin(self) -> Column:
        """Log odds of "block" from the ``f_`` columns."""
        out = F.lit(self.prior)
        for tree in self.trees:
            out = out + _expression(tree)
        return out


def _expression(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, at, left, right = tree
    return F.when(F.col(f"f_{feature}") <= at, _expression(left)).otherwise(_expression(right))


def _leaf_number(tree, number: int = 1) -> Column:
    """Which open node a row is in, numbered as in a heap."""
    if not isinstance(tree, tuple):
        return F.lit(number)
    feature, at, left, right = tree
    return F.when(F.col(f"f_{feature}") <= at, _leaf_number(left, 2 * number)).otherwise(_leaf_number(right, 2 * number + 1))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", trees: int = TREES, depth: int = DEPTH, bound: int = MAX_LABELLED) -> Boosted:
    """Fit to labelled URLs (1: block, 0: allow; other labels and null URLs do not count).

    At most ``bound`` of them are used, those with the smallest hashes. Without
    any, the model is even odds; ties in gain go to the first feature and bin.
    """
    sample = labelled.where(F.col(label_col).isin(0, 1) & F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("y"))
    sample = checkpointed(sample.orderBy(F.xxhash64("url"), "url", "y").limit(bound))
    rates = sample.groupBy(suffix_of(host_of(F.col("url"))).alias("s")).agg(F.sum("y").alias("n1"), F.count("*").alias("n")).collect()  # no more than the sample has
    suffixes = {r["s"]: int((r["n1"] + 1) / (r["n"] + 2) * (BINS - 1)) for r in rates}
    n1, n = sum(r["n1"] for r in rates), sum(r["n"] for r in rates)
    prior = math.log((n1 + 1) / (n - n1 + 1))
    model = Boosted(prior, (), suffixes)
    if not n:
        return model
    known = checkpointed(with_features(sample, suffixes).select("y", *[f"f_{f}" for f in FEATURES]))
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin()))
        graded = known.select("*", (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"))
        tree: tuple | float | None = None
        for _level in range(depth):
            tree = _grow(graded, tree)
        model = Boosted(prior, (*model.trees, _close(tree)), suffixes)
    return model


def _grow(graded: DataFrame, tree):
    """Split every open node of the tree by the best of its histogram."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"f_{f}").alias("bin")) for k, f in enumerate(FEATURES)]))
    sums = graded.select(_leaf_number(tree).alias("node"), "g", "h", kinds.alias("x")).groupBy("node", "x.k", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    by: dict[int, dict[int, list]] = {}
    for r in sums.collect():
        by.setdefault(r["node"], {}).setdefault(r["k"], []).append((r["bin"], r["g"], r["h"]))
    return _split(tree, 1, by)


def _split(tree, number: int, by: dict):
    if isinstance(tree, tuple):
        feature, at, left, right = tree
        return feature, at, _split(left, 2 * number, by), _split(right, 2 * number + 1, by)
    if isinstance(tree, float) and number not in by:
        return tree
    best = None
    g_all = h_all = 0.0
    for k in sorted(by.get(number, {})):
        bins = sorted(by[number][k])
        g_all, h_all = sum(b[1] for b in bins), sum(b[2] for b in bins)
        g = h = 0.0
        for at, dg, dh in bins[:-1]:
            g, h = g + dg, h + dh
            gain = round(g * g / (h + LAMBDA) + (g_all - g) ** 2 / (h_all - h + LAMBDA) - g_all**2 / (h_all + LAMBDA), 9)
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = gain, k, at, RATE * g / (h + LAMBDA), RATE * (g_all - g) / (h_all - h + LAMBDA)
    if best is None:
        return RATE * g_all / (h_all + LAMBDA)
    return FEATURES[best[1]], best[2], round(best[3], 12), round(best[4], 12)


def _close(tree):
    return tree if tree is not None else 0.0


def filter_urls(urls: DataFrame, model: Boosted, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, probability of "block" for each row.

    Null URLs and those without ``://`` have empty host and path, fit no rule and
    are judged by the trees. Repeated rows and null ids are each returned; other
    columns are not looked at.
    """
    known = with_features(urls.select(F.col(id_col), F.col(url_col).alias("_url")), model.suffixes, "_url")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    p = 1 / (1 + F.exp(-model.margin()))
    return known.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(said, F.when(p > 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("probability"))
