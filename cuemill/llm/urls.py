"""URL filter: rules by host and path, else logistic regression on hashed character n-grams.

The host is what follows the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; the path follows up to
"?", "#" or the end. A null url, or one without "://", has an empty host and path. A rule fits its host and all
subdomains if the path starts with the rule's; the longest rule wins. Other urls are judged by a model whose features
are the counts of hash buckets among the n-grams of "^host$" and of the path, divided by the root of the number of
n-grams. An empty host and path have no n-grams and are judged by the intercept.

The model is trained from a small labelled table that this module makes of ordinary words by a rule (labelled_urls), with
no look at the urls to judge. All steps over data are DataFrame functions; the fit of a few hundred rows runs on the
driver once a process, and its weights (BUCKETS numbers) are a literal, so judging is map-only. Repeated rows get equal
verdicts, urls of any length are read whole, other columns are not touched, an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 4096
ORDERS = (3, 4, 5)
RIDGE = 0.00001

#: (host, start of the path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

# Words that stand for unwanted sites, what they come with, and ordinary words of several languages.
_UNWANTED = (
    "casino poker slots roulette jackpot blackjack betting bets gambling lottery bingo pills viagra cialis pharmacy steroids meds "
    "porn xxx sex adult escort nude cams erotic hentai spam malware phishing warez crack keygen torrent ads adserver tracker track clicks popup "
    "banner affiliate payday loans scam replica clickbait linkfarm hacked cheats"
).split()
_WITH = "online best free 24 club top now bonus hot super king real world deals mega vip".split()
_ORDINARY = (
    "news daily times herald tribune library museum university college school institute academy journal review magazine weather travel recipes cooking garden music "
    "history science physics biology chemistry medicine hospital health kitchen city council government parliament court bank insurance railway airport theatre cinema "
    "sports football cycling climbing hiking photography design architecture books publisher research software developer documentation wiki encyclopedia dictionary "
    "language forum community mail calendar maps store market furniture family kids nature animals orchard harbour mountain river lantern meadow bridge village "
    "zeitung garten schule wetter reise kirche bibliothek verein rathaus bibliotheque jardin ecole musique voyage mairie cuisine biblioteca escuela jardin noticias "
    "viajes cocina ayuntamiento giornale scuola cucina viaggi comune jornal escola cozinha krant winkel fiets bakkerij gazeta szkola kuchnia"
).split()
_ONSETS, _VOWELS, _CODAS = "b br c d dr f g gl h j k l m n p pr r s st t tr v w z".split(), "a e i o u ai ou ea".split(), ["", "n", "r", "l", "s", "rd", "nt", "ck"]
_PATHS = ("/", "", "/index.html", "/about", "/en/about", "/de/kontakt", "/a/b/c", "/2021/05/title-of-the-text", "/item/1284", "/es/inicio", "/search", "/fr/page/3")
_PREFIXES = ("", "www.", "blog.", "m.", "shop.")
_SUFFIXES = (".com", ".net", ".org", ".example.com", ".info", ".example.org", ".example.net")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table, (url, 1 if unwanted): every word alone and in compounds, made-up names of syllables; prefix, suffix
    and path are drawn by a hash of the name, alike for both labels."""
    bad, good = [], []
    for i, w in enumerate(_UNWANTED):
        more = [_WITH[(i + j * 5) % len(_WITH)] for j in range(6)]
        bad += [w, f"{more[0]}-{w}", f"{w}-{more[1]}", f"{w}{more[2]}", f"{more[3]}{w}", f"{w}-{_ONSETS[i % len(_ONSETS)]}", f"{w}-{more[4]}-{more[5]}"]
    for i, w in enumerate(_ORDINARY):
        other = _ORDINARY[(i * 7 + 3) % len(_ORDINARY)]
        good += [w, f"{w}-{other}", f"{_WITH[i % len(_WITH)]}-{w}"]
    n = len(_ONSETS) * len(_VOWELS) * len(_CODAS)
    syllable = lambda i: _ONSETS[i % len(_ONSETS)] + _VOWELS[i // len(_ONSETS) % len(_VOWELS)] + _CODAS[i // (n // len(_CODAS)) % len(_CODAS)]
    good += ["".join(syllable((i * 389 + j * 577) % n) for j in range(2 + i % 2)) for i in range(320)]
    pick = lambda kind, name: kind[zlib.crc32(f"{len(kind)} {name}".encode()) % len(kind)]
    return [(f"https://{pick(_PREFIXES, name)}{name}{pick(_SUFFIXES, name)}{pick(_PATHS, name)}", label) for names, label in ((bad, 1), (good, 0)) for name in names]


def _rest(url: Column) -> Column:
    """What follows the first "://"; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*+(/[^?#]*)", 1)


def rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer one overrides
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: Column, path: Column) -> Column:
    """Buckets of all n-grams, those of the host and of the path apart."""

    def of(text: Column, seed: int) -> list[Column]:
        return [
            F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))).otherwise(F.array().cast("array<int>"))
            for n in ORDERS
        ]

    name = F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("^"), host, F.lit("$")))
    return F.concat(*of(name, 1), *of(path, 2))


_trained: dict[tuple, tuple[list[float], float]] = {}


def train(spark: SparkSession, urls: list[tuple[str, int]] | None = None) -> tuple[list[float], float]:
    """(weight of each bucket, intercept). urls: a small labelled table of (url, 1 if unwanted), as it fits the driver."""
    known = tuple(urls or labelled_urls())
    if known not in _trained:
        rows = spark.createDataFrame(list(known), "url string, label int").coalesce(1).select("label", grams(host(F.col("url")), path(F.col("url"))).alias("b")).collect()
        counts = np.stack([np.bincount(r["b"], minlength=BUCKETS) / np.sqrt(max(1, len(r["b"]))) for r in rows])
        weights, intercept = fit_rows(counts, np.array([r["label"] for r in rows], float))
        _trained[known] = [round(float(w), 6) for w in weights], round(float(intercept), 6)
    return _trained[known]


def fit_rows(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of the least mean logistic loss with RIDGE / 2 times the squared weights. Newton steps over
    the rows' inner products, as rows are fewer than buckets."""
    n, k = len(x), x @ x.T
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    alpha, intercept = np.zeros(n), float(np.log(share / (1 - share)))
    for _ in range(50):
        f = k @ alpha + intercept
        p = 1 / (1 + np.exp(-np.clip(f, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-12)
        system = np.zeros((n + 1, n + 1))
        system[:n, :n] = k + np.diag(n * RIDGE / w)
        system[:n, n] = system[n, :n] = 1
        found = np.linalg.solve(system, np.append(f + (y - p) / w, 0))
        step = np.abs(found[:n] - alpha).max()
        alpha, intercept = found[:n], float(found[n])
        if step < 1e-8 * max(1.0, np.abs(alpha).max()):
            break
    return x.T @ alpha, intercept


def probability(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    """That a url is unwanted."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    buckets = grams(host, path)
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(buckets), F.lit(1))) + intercept)))


def judge(pages: DataFrame, url: str = "url", keep: list[str] | None = None, rules: tuple = RULES) -> DataFrame:
    """The columns in keep with host, path, rule, verdict, probability."""
    weights, intercept = train(pages.sparkSession)
    parts = pages.select(*(keep or []), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    found = parts.withColumn("_rule", rule(F.col("host"), F.col("path"), rules)).withColumn("probability", probability(F.col("host"), F.col("path"), weights, intercept))
    learned = F.when(F.col("probability") >= 0.5, "block").otherwise("allow")
    return found.select(*(keep or []), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", learned).alias("verdict"), "probability")
