"""Operator 1, URL filters: host and path rules, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import map_arrow, mix

#: The contract's rules.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: The small labelled table: host and path of pages to allow and to block. Fixed values.
ALLOWED = """
library.example.edu/catalog/history encyclopedia.example.org/wiki/Astronomy docs.example.dev/guide/install
news.example.com/2021/05/climate-report museum.example.org/collections/maps journal.example.edu/articles/118
forum.example.net/threads/garden-soil weather.example.com/en/city/4411 school.example.edu/courses/algebra
city.example.gov/services/water-supply blog.example.com/en/2020/travel-notes books.example.net/en/reviews/203
science.example.org/papers/2017/enzymes health.example.gov/en/topics/nutrition tools.example.dev/reference/arrays
archive.example.org/de/texte/1848 cuisine.example.fr/fr/recettes/soupe maps.example.net/en/region/alps
parliament.example.gov/debates/1999/budget music.example.org/scores/bach-suite university.example.edu/research/physics
radio.example.net/programmes/evening www.example.com/en/about/history m.example.net/en/articles/5170
""".split()
BLOCKED = """
casino-bonus.example.biz/free-spins/win-now cheap-pills.example.info/buy/viagra-online xxx-cams.example.biz/live/hot-girls
bet-365-bonus.example.top/jackpot/slots?ref=aff replica-watches.example.shop/discount/rolex-90-off
loan-fast-cash.example.click/apply-now/no-credit-check free-download.example.xyz/crack/keygen-full-version
clickbait.example.top/you-wont-believe/shocking poker-online.example.bet/register/bonus-code
adult-dating.example.xxx/meet/singles-tonight pharma-discount.example.biz/order/cheap-cialis
win-iphone.example.click/claim-prize/winner torrent-movies.example.to/watch-free/full-hd
crypto-double.example.top/invest/guaranteed-profit escort-city.example.xxx/profiles/vip
spam-seo.example.info/buy-backlinks/cheap-traffic slots-casino.example.bet/spin-win/mega-jackpot
hot-deals.example.shop/cheap/replica-bags warez.example.to/serial/crack-download
nude-pics.example.xxx/gallery/free-sex miracle-diet.example.click/lose-weight-fast/pills
payday-loans.example.biz/instant-cash/apply porn-tube.example.xxx/videos/free gambling.example.bet/roulette/bonus
""".split()
BUCKETS = 1 << 15
GRAMS = (3, 4, 5)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end. Else both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.when(F.substring(path, 1, 1) == "/", path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule (ties: the first as text) that fits, as ``struct(rule, verdict)``, or null.

    A rule is ``host/path``; it fits its host and all subdomains where the path starts with ``/path``. Rules
    are code, a list of at most some hundreds: they compile to one ordered conditional without a join.
    """
    if len(rules) > 500:
        raise ValueError("more than 500 rules; split the list")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def gram_cells(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For all character n-grams of ``^host/$`` and ``^path$`` (host and path apart): the text's number and its hashed bucket.

    Grams are of bytes, hashed together for the whole batch; grams over a bound of a text fall away.
    """
    rows, cells = [], []
    for side, texts in ((1, [f"^{h}$" for h in hosts]), (2, [f"^{p}$" for p in paths])):
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(raw)), sizes)
        for n in GRAMS:
            m = len(data) - n + 1
            if m <= 0:
                continue
            h = np.full(m, side * 8 + n, np.uint64)
            for i in range(n):
                h = h * np.uint64(257) + data[i : i + m]
            inside = row[:m] == row[n - 1 :]
            rows.append(row[:m][inside])
            cells.append((mix(h[inside]) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows) if rows else np.empty(0, np.int64), np.concatenate(cells) if cells else np.empty(0, np.int64)


def _scores(hosts: list[str], paths: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    row, cell = gram_cells(hosts, paths)
    n = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
    return 1 / (1 + np.exp(-(np.bincount(row, weights[cell], minlength=len(hosts)) / np.sqrt(n) + bias)))


def train(labelled: Sequence[tuple[str, str, int]], turns: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights for (host, path, 1 to block or 0 to allow), by full-batch gradient descent; the table is small by contract (10,000 rows at most)."""
    if len(labelled) > 10_000:
        raise ValueError("the labelled table is larger than 10,000 rows")
    w, bias = np.zeros(BUCKETS), 0.0
    if not labelled:
        return w, bias
    hosts, paths, y = [x[0] for x in labelled], [x[1] for x in labelled], np.array([x[2] for x in labelled], float)
    row, cell = gram_cells(hosts, paths)
    each = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    for _ in range(turns):
        g = (_scores(hosts, paths, w, bias) - y) / len(y)
        w -= rate * 10 * (np.bincount(cell, (g * each)[row], minlength=BUCKETS) + decay * w / 10)
        bias -= rate * g.sum()
    return w, bias


def labelled_table() -> list[tuple[str, str, int]]:
    """The built-in table as (host, path, label)."""
    cut = lambda u: (u.partition("/")[0], "/" + u.partition("/")[2].partition("?")[0])
    return [(*cut(u), 0) for u in ALLOWED] + [(*cut(u), 1) for u in BLOCKED]


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, str, int]] | None = None) -> DataFrame:
    """``host, path, rule, verdict`` and ``block_score`` of every page's url, one row for each row of ``pages``.

    The verdict is the rule's where one fits, else block where the model's probability is above 0.5.
    No shuffle. A null url, or one without ``://``, has an empty host and path and gets the model's verdict on these.
    Null page_ids and repeated rows stay as they are; other columns are not read. An empty table gives no rows; urls of any length are read whole.
    """
    weights, bias = train(labelled_table() if labelled is None else labelled)
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    kind = cut.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                got = _scores(part.column("host").to_pylist(), part.column("path").to_pylist(), weights, bias)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], ["page_id", "host", "path", "block_score"])

    scored = map_arrow(cut, run, f"page_id {kind}, host string, path string, block_score double")
    found = scored.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    model = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", model).alias("verdict"), "block_score")
