"""URL filters: host and path rules, and logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, column, slices

BITS, ORDERS = 14, (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules: (action, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Labelled URLs for the default model: 1 is to be blocked.
LABELLED = [
    *[(u, 1) for u in (
        "http://ads-track.banner.example/en/1.html", "https://www.ads-track.example/en/77/", "http://m.ad-server.example/click?id=3", "http://track.pixel-ads.example/c/99", "http://spam-farm.example/en/286",
        "https://www.spam-farm.example/de/12.html", "http://blog.spam-links.example/fr/5/", "http://cheap-pills.example/buy/viagra", "https://online-pharmacy-cheap.example/order/pills", "http://casino-bonus.example/free-spins",
        "https://best-casino.example/slots/jackpot", "http://poker-win.example/bonus", "http://betting-odds-tips.example/vip", "http://xxx-cams.example/live", "https://adult-videos.example/porn/1",
        "http://free-download-crack.example/keygen", "http://warez-serials.example/crack/9", "http://payday-loan-fast.example/apply", "http://click-redirect.example/out?u=1", "http://malware-host.example/setup.exe",
        "http://phish-login.example/verify-account", "http://seo-link-farm.example/backlinks", "http://popup-ads.example/pop/1", "http://affiliate-track.example/aff/77", "http://replica-watches.example/sale",
        "http://clickbait-feed.example/you-wont-believe", "http://doubleclick-ads.example/adj/7", "http://adserver.track.example/ads/4", "http://spamdomain.example/en/7", "http://essay-writing-cheap.example/order")],
    *[(u, 0) for u in (
        "https://www.library.example/en/1.html", "http://m.museum.example/de/20/", "https://blog.gardening.example/fr/31", "https://news.city.example/es/200.html", "http://weather.region.example/en/today",
        "https://www.school.example/en/lessons/4", "https://docs.project.example/en/guide/", "http://history.archive.example/fr/1900", "https://recipes.kitchen.example/de/brot", "https://www.university.example/research/7",
        "http://blog.travel.example/es/888/", "https://wiki.science.example/en/physics", "https://m.health.example/en/advice", "http://music.band.example/fr/12", "https://www.hospital.example/de/kontakt",
        "https://forum.chess.example/en/5521", "http://maps.trail.example/en/77?page=2", "https://journal.math.example/en/3671", "https://www.theatre.example/fr/programme", "http://film.festival.example/es/2020",
        "https://blog.code.example/en/python", "https://www.farm.example/de/milch", "http://parish.village.example/en/notices", "https://radio.local.example/fr/direct", "https://www.novel.example/en/chapter/3",
        "http://birds.nature.example/en/222.html", "https://zoo.animals.example/de/affen", "https://data.statistics.example/en/table/5", "http://club.running.example/es/carrera", "https://law.review.example/en/44")],
]


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.char_length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.char_length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct (action, rule) of the longest rule that fits host and path, else null."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def hashed(host: str, path: str) -> np.ndarray:
    """Distinct feature indices: character n-grams of host and of path, kept apart."""
    found = []
    for salt, s in ((1, f".{host}."), (2, f"{path}.")):
        c = code_points(s).astype(np.uint64)
        h = np.full(len(c), salt, np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if n > len(c):
                break
            h = h[: len(c) - n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                found.append(((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), tail[:stop]


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        at = hashed(host, path)
        z = self.bias + float(self.weights[at].sum()) / max(len(at), 1) ** 0.5
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(labelled: list[tuple[str, int]] | None = None, *, epochs: int = 300, rate: float = 0.5, l2: float = 1e-3) -> UrlModel:
    """Logistic regression by full-batch gradient descent over a small table (url, label)."""
    rows = [(hashed(*split_url(u)), y) for u, y in (LABELLED if labelled is None else labelled)]
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(epochs if rows else 0):
        g, gb = l2 * w, 0.0
        for at, y in rows:
            s = max(len(at), 1) ** -0.5
            d = (1 / (1 + np.exp(-(b + w[at].sum() * s))) - y) / len(rows)
            g[at] += d * s * 4
            gb += d
        w, b = w - rate * 4 * g, b - rate * gb
    return UrlModel(w.astype(np.float32), b)


def judge_urls(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Per row: id, host, path, rule, score (probability of block by the model), verdict.

    The longest rule that fits decides (rule is null where none does); else the model blocks from
    ``threshold`` on.  Null urls and urls without :// have empty host and path, fit no rule and
    are judged by the model's bias.  Repeated rows and extra columns change nothing.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "path"):
            s = [model.score(h, p) for h, p in zip(column(b, "host").to_pylist(), column(b, "path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("id", "host", "path")), pa.array(s, pa.float64())], names=["id", "host", "path", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"id {kind}, host string, path string, score double").withColumn("r", best_rule(F.col("host"), F.col("path"), RULES if rules is None else rules))
    verdict = F.coalesce(F.col("r.action"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), "score", verdict.alias("verdict"))
