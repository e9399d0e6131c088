"""URL filter: rules by host and path, and logistic regression on hashed character n-grams.

A rule names a host and the start of a path; it holds for the host and its
subdomains, and the longest rule that fits decides.  Other urls are judged by a
logistic regression whose features are the shares of hashed n-grams of host and
path.  Weights are whole numbers, so that sums are the same in any order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (3, 4, 5)  # characters of an n-gram
BUCKETS = 8192
BASE, FIRST = 257, {"host": 11, "path": 101}  # of the n-grams' polynomial, modulo PRIME
PRIME = 1_000_003
SCALE = 1_000_000  # a weight of 1 as a whole number
MOST_ROWS = 20_000  # labelled urls that are learned from, at most

# Fixed values of this filter's own example table.
BLOCKED_WORDS = ("casino", "poker", "jackpot", "viagra", "pills", "pharmacy-deals", "porn", "xxx", "escort", "spam", "spam-farm", "link-farm", "clickbait", "payday-loan", "replica-watches", "warez", "torrent", "cracked", "malware", "phishing", "free-iphone", "win-prize", "adserver", "bet-now", "lottery")
ALLOWED_WORDS = ("library", "museum", "school", "garden", "recipes", "history", "science", "journal", "weather", "sports", "news", "travel", "music", "docs", "forum", "health", "nature", "cinema", "market", "city", "farm", "theatre", "physics", "books", "review")
SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "ble", "tion", "sh", "wh", "ing")


@dataclass(frozen=True)
class Rule:
    """What happens to the urls of a host and its subdomains whose path starts so."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


#: The rules of the registered query.
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The index of the longest rule that fits (of equally long ones the one with the longer host, then the first); else null."""
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].text), -len(rules[k].host), k))
    out = F.coalesce(*[F.when(((host == rules[k].host) | host.endswith("." + rules[k].host)) & path.startswith(rules[k].path), F.lit(k)) for k in order]) if order else F.lit(None)
    return out.cast("int")


def example_urls() -> list[tuple[str, bool]]:
    """The default labelled table: (url, block), alike in all but the words of host and path."""
    rng = np.random.default_rng(3)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    out = []
    for block, words in ((True, BLOCKED_WORDS), (False, ALLOWED_WORDS), (False, SYLLABLES)):
        for word in words:
            for _ in range(4):
                more = "".join(pick(SYLLABLES) for _ in range(3))
                name = pick([word + more, f"{word}-{more}", f"{more}-{word}", word])
                host = pick(["", "www.", "m.", "blog."]) + name + ".example." + pick(["com", "org", "net"])
                tail = pick(["en", "de", "fr", "es"]) + "/" + (f"{word}/" if rng.random() < 0.4 else "") + str(int(rng.integers(1, 99_999))) + pick(["", "/", ".html"])
                out.append((f"http://{host}/{tail}", block))
    return out


def grams(texts: list[str], field: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of the texts, each with a mark at either end."""
    marked = ["^" + t + "$" for t in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    row = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters up to the text's end
    h = np.full(len(codes), FIRST[field], np.int64)
    rows, buckets = [], []
    for k in range(max(SIZES)):
        h = (h[: len(codes) - k] * BASE + codes[k:]) % PRIME
        if k + 1 in SIZES:
            whole = left[: len(h)] > k
            rows.append(row[: len(h)][whole])
            buckets.append(h[whole] % BUCKETS)
    return np.concatenate(rows), np.concatenate(buckets)


@dataclass(frozen=True)
class Model:
    """Whole-number weights by bucket, and the bias."""

    weights: np.ndarray
    bias: int

    def sums(self, hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of weights and number of n-grams of each url."""
        total, count = np.zeros(len(hosts), np.int64), np.zeros(len(hosts), np.int64)
        for field, texts in (("host", hosts), ("path", paths)):
            row, bucket = grams(texts, field)
            # whole numbers below 2**53 are exact as doubles
            total += np.bincount(row, self.weights[bucket].astype(float), len(hosts)).astype(np.int64)
            count += np.bincount(row, minlength=len(hosts))
        return total, count


def split_url(url: str) -> tuple[str, str]:
    """Host and path of a labelled url, as in ``host_and_path``."""
    rest = url.partition("://")[2]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def train(labelled: Sequence[tuple[str, bool]], rounds: int = 1500, rate: float = 1000.0, decay: float = 1e-6) -> Model:
    """Logistic regression by gradient descent on the shares of n-grams; ``block`` is the positive class.

    Both classes weigh the same, whatever their number of rows.
    """
    hosts, paths = zip(*[split_url(u) for u, _ in labelled], strict=True)
    x = np.zeros((len(hosts), BUCKETS))
    for field, texts in (("host", list(hosts)), ("path", list(paths))):
        np.add.at(x, grams(texts, field), 1.0)
    x /= x.sum(axis=1, keepdims=True)
    used = np.flatnonzero(x.any(axis=0))
    x, y = x[:, used], np.array([float(b) for _, b in labelled])
    each = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, bias = np.zeros(len(used)), 0.0
    for _ in range(rounds):
        off = (1 / (1 + np.exp(-(x @ w + bias))) - y) * each
        w -= rate * (x.T @ off + decay * w)
        bias -= 0.5 * float(off.sum())
    weights = np.zeros(BUCKETS, np.int64)
    weights[used] = np.round(w * SCALE).astype(np.int64)
    return Model(weights, round(bias * SCALE))


@lru_cache
def default_model() -> Model:
    """The model of the example table."""
    return train(example_urls())


def train_on(labelled: DataFrame, most: int = MOST_ROWS) -> Model:
    """A model from a table ``(url, block)``: of more than ``most`` rows those of least hash, a documented bound."""
    rows = labelled.where("url is not null and block is not null").orderBy(F.xxhash64("url"), "url", "block").limit(most)
    found = [(r["url"], bool(r["block"])) for r in rows.select("url", "block").collect()]
    if len({b for _, b in found}) < 2:
        raise ValueError("urls of both classes are needed")
    return train(found)


def judge(pages: DataFrame, model: Model | None = None, rules: Sequence[Rule] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict``; columns of these names are replaced.

    ``score`` is the model's probability of ``block``, given for every url;
    ``verdict`` is the rule's where one fits, else ``block`` from a probability
    over one half.  A null url, or one without ``://``, has an empty host and
    path and is judged like any other.  Every row stays; there is no shuffle.
    """
    model = model or default_model()
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    kept = [F.col(f"`{c}`") for c in names]
    host, path = host_and_path(F.col(f"`{url}`"))
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    listed, said = (F.array(*[F.lit(v) for v in values]).cast("array<string>") for values in ([r.text for r in rules], [r.verdict for r in rules]))
    at = fitting_rule(rules, F.col("host"), F.col("path"))
    ruled = parts.select(*kept, "host", "path", F.get(listed, at).alias("rule"), F.get(said, at).alias("verdict"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            total, count = model.sums(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist())
            margin = total + model.bias * count  # over zero: more likely block than not
            score = 1 / (1 + np.exp(-np.clip(margin / (np.maximum(count, 1) * SCALE), -500, 500)))
            own = ["block" if m > 0 else "allow" for m in margin.tolist()]
            final = [v or o for v, o in zip(batch.column(len(names) + 3).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) + 3], pa.array(score), pa.array(final, pa.string())], names=[*names, "host", "path", "rule", "score", "verdict"])

    schema = ruled.withColumn("score", F.lit(0.0)).select(*kept, "host", "path", "rule", "score", "verdict").schema
    for field in schema:
        field.nullable = True
    return ruled.mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def verdict_sql() -> str:
    """DuckDB SQL of ``report``, with the weights of the default model in it."""
    model = default_model()

    def total(field: str) -> str:
        text = f"('^' || {field} || '$')"
        out = []
        for size in SIZES:
            h = str(FIRST[field])
            for k in range(size):
                h = f"(({h} * {BASE} + unicode(substr({text}, CAST(i + {k} AS BIGINT), 1))) % {PRIME})"
            out.append(f"coalesce(list_sum(list_transform(range(1, length({text}) - {size} + 2), lambda i: w[1 + {h} % {BUCKETS}])), 0)")
        return " + ".join(out)

    count = " + ".join(f"greatest(length({field}) + 2 - {size} + 1, 0)" for field in FIRST for size in SIZES)
    rules = sorted(RULES, key=lambda r: -len(r.text))
    fits = [f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')" for r in rules]
    case = lambda of: "CASE " + " ".join(f"WHEN {f} THEN '{of(r)}'" for f, r in zip(fits, rules, strict=True)) + " END"
    return f"""WITH m AS (SELECT CAST({model.weights.tolist()} AS BIGINT[]) AS w),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
s AS (SELECT u.*, {total("host")} + {total("path")} + ({model.bias}) * ({count}) AS margin FROM u CROSS JOIN m)
SELECT page_id, host, path, {case(lambda r: r.text)} AS rule, coalesce({case(lambda r: r.verdict)}, CASE WHEN margin > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM s"""
