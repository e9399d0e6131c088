"""Personal data by candidates and boosted trees (DataFrame functions only).

Four fixed formats (e-mail, IPv4, payment card, international phone) are always
redacted.  High-recall generators propose further, overlapping spans; boosted
trees score each by its format and its context, and a calibrated threshold
selects those that are redacted too.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.llm.boosting import BoostedTrees, calibrated

#: The base kinds, in the order that ranks spans with one start.
BASE_KINDS = ("email", "ip", "card", "phone")

# The patterns match what the plain forms match.  Possessive repeats keep the
# matcher iterative on long runs, and a look-behind skips starts inside a run
# whose first character has already failed; \G admits the end of a match.
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


@dataclass(frozen=True)
class Generator:
    """A candidate pattern and the words that speak for it when they precede it."""

    kind: str
    pattern: str
    context: str


GENERATORS = (
    Generator("secret", r"(?<![A-Za-z0-9])[A-Za-z0-9+/_]{16,}+={0,2}", r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|access.?key|credential)[^\n]{0,6}$"),
    Generator("local_phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9])", r"(?i)(?:phone|tel|call|mobile|fax|contact)[^\n]{0,12}$"),
    Generator("masked_email", r"(?<![A-Za-z0-9._])[A-Za-z0-9._]{1,64}+ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z0-9-]++)++", r"(?i)(?:mail|contact|write|reach)[^\n]{0,12}$"),
    Generator("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"(?i)(?:ssn|social|national|identity|tax)[^\n]{0,20}$"),
)
BEFORE = 32  # characters of context in front of a candidate
FEATURES = ("length", "digits", "letters", "distinct", "separators", "context", "assigned", "quoted", "kind")


def features_of(kind: int, value: str, before: str) -> list[float]:
    """The features of one candidate in Python, for training; as in ``_features``."""
    return [
        float(len(value)),
        float(len(re.findall("[0-9]", value))),
        float(len(re.findall("[A-Za-z]", value))),
        float(len(set(value))),
        float(len(re.findall(r"[-. ()]", value))),
        float(bool(re.search(GENERATORS[kind].context, before))),
        float(bool(re.search(r"[:=] ?[\"']?$", before))),
        float(bool(re.search(r"[\"']$", before))),
        float(kind),
    ]


def _features(kind: Column, value: Column, before: Column) -> Column:
    count = lambda pattern: F.length(value) - F.length(F.regexp_replace(value, pattern, ""))
    context = F.lit(False)
    for k, g in enumerate(GENERATORS):
        context = context | ((kind == k) & before.rlike(g.context))
    made = [
        F.length(value),
        count("[0-9]"),
        count("[A-Za-z]"),
        F.size(F.array_distinct(F.split(value, ""))),
        count(r"[-. ()]"),
        context,
        before.rlike(r"[:=] ?[\"']?$"),
        before.rlike(r"[\"']$"),
        kind,
    ]
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(FEATURES, made, strict=True)])


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` generated candidates with labels: personal or not, by construction."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    digits, hexa, alnum = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    lower = alnum[:26]
    prose = lambda: " ".join(draw(lower, int(rng.integers(2, 9))) for _ in range(4))
    rows, labels = [], []
    for _ in range(n):
        kind, positive = int(rng.integers(4)), bool(rng.integers(2))
        if kind == 0:
            value = draw(pick([hexa, alnum]), int(rng.integers(16, 65))) if positive or rng.random() < 0.6 else draw(lower, int(rng.integers(16, 60)))
            key = pick(["token", "secret", "password", "api_key", "api-key", "access_key"])
            before = prose() + " " + (key + pick([" = ", "=", ": ", ":"]) + pick(['"', "'", ""]) if positive else pick(["commit ", "file ", "sha = ", "see ", "checksum: ", "", "http://x/"]))
            if not positive and rng.random() < 0.3:
                before = prose() + " " + key + " and "
                value = draw(lower, int(rng.integers(16, 30)))
        elif kind == 1:
            sep = pick("-. ")
            value = pick(["({}){}{}{}{}", "{}{}{}{}{}"]).format(draw(digits, 3), sep, draw(digits, 3), sep, draw(digits, 4))
            before = prose() + " " + (pick(["phone ", "tel: ", "call ", "mobile: ", "fax ", "contact us: "]) if positive else pick(["version ", "part no ", "sum ", "id ", "pages ", ""]))
        elif kind == 2:
            value = draw(lower, 5) + pick([" [at] ", "(at)", " (at) "]) + draw(lower, 6) + (pick([" [dot] ", "(dot)", "."]) + pick(["com", "org", "net"]))
            before = prose() + " " + (pick(["mail ", "contact ", "write to ", "", "reach me: "]) if positive else "")
            if not positive:
                value = draw(lower, 1) + "(at)" + draw(lower, 1) + "." + draw(lower, 1)
        else:
            value = f"{draw(digits, 3)}-{draw(digits, 2)}-{draw(digits, 4)}"
            before = prose() + " " + (pick(["ssn ", "SSN: ", "social security number ", "national id ", "tax id: "]) if positive else pick(["part ", "serial ", "score ", "", "lot "]))
        rows.append(features_of(kind, value, before[-BEFORE:]))
        labels.append(positive)
    return np.array(rows), np.array(labels, float)


@lru_cache
def model(train: int = 1500, held: int = 1000, seed: int = 11) -> BoostedTrees:
    """The trees, trained on generated candidates and calibrated on others."""
    return calibrated(*examples(train, seed), *examples(held, seed + 1))


#: Rows of an array that one step handles; arrays are cut into blocks, so that no step copies or compares more.
BLOCK = 256
#: Characters of a piece of text, so that a stretch is found without counting from the text's start.
PIECE = 4096


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")


def _in_blocks(rows: Column, made: Callable[[Column, Column], Column]) -> Column:
    """``made(block, number)`` of every block of an array."""
    return F.transform(F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>")), lambda b: made(F.slice(rows, b * BLOCK + 1, BLOCK), b))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, pattern: str) -> Column:
    """Matches of a pattern with code-point positions and the ``BEFORE`` characters in front: array<struct<start, end, value, before>>.

    The text between the matches (``split``) and the matches themselves
    alternate, so their lengths add up to the positions: first inside blocks of
    matches, then over the blocks.
    """
    both = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")), lambda x: x["value"].isNotNull())
    tail = lambda c: F.substring(c, -BEFORE, BEFORE)
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")

    def found(pairs: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["value"])
            lead = F.concat(acc["tail"], x["gap"])
            row = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), tail(lead).alias("before"))
            return F.struct(end.alias("at"), tail(F.concat(lead, x["value"])).alias("tail"), F.concat(acc["out"], F.array(row)).alias("out"))

        def block(part: Column, b: Column) -> Column:
            # as many matches as characters of context hold these, as no match is empty
            lead = F.when(b > 0, F.slice(pairs, F.greatest(b * BLOCK - BEFORE + 1, F.lit(1)), BEFORE)).otherwise(F.slice(pairs, 1, 0))
            before = tail(F.array_join(F.transform(lead, lambda x: F.concat(x["gap"], x["value"])), ""))
            return F.aggregate(part, F.struct(F.lit(0).cast("bigint").alias("at"), before.alias("tail"), none.alias("out")), step)

        def placed(blocks: Column) -> Column:
            sums = F.aggregate(blocks, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
            moved = lambda at: F.transform(blocks, lambda x, b: F.transform(x["out"], lambda s: F.struct((s["start"] + F.get(at, b)).alias("start"), (s["end"] + F.get(at, b)).alias("end"), s["value"].alias("value"), s["before"].alias("before"))))
            return F.flatten(_bound(sums, moved))

        return _bound(_in_blocks(pairs, block), placed)

    return F.when(text.rlike(pattern), _bound(both, found)).otherwise(_no_spans())


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.when(d.cast("int") > 4, 1).otherwise(0))),
        F.lit(0),
        lambda acc, d: acc + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    pattern = BASE_PATTERNS[kind]
    spans = F.filter(find_all(text, pattern), lambda s: _valid(kind, s["value"]))
    guard = {"email": text.contains("@"), "phone": text.contains("+"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")}.get(kind)
    return spans if guard is None else F.when(guard, spans).otherwise(_no_spans())


def _labelled(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _proposed(text: Column, k: int) -> Column:
    def candidate(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"), s["value"].alias("value"), s["before"].alias("before"))

    needs = {"local_phone": text.rlike(r"[0-9]{3}[-. ][0-9]{4}"), "masked_email": text.contains("(") | text.contains("["), "national_id": text.contains("-")}
    kind = GENERATORS[k].kind
    found = find_all(text, GENERATORS[k].pattern)
    return F.transform(F.when(needs[kind], found).otherwise(_no_spans()) if kind in needs else found, candidate)


def _overlapping(rows: Column, c: Column, also: Callable[[Column], Column] | None = None) -> Column:
    """Whether a row of blocks (``_bounded``) overlaps span ``c`` (and holds ``also``)."""

    def hit(d: Column) -> Column:
        meets = (d["start"] < c["end"]) & (c["start"] < d["end"])
        return meets if also is None else meets & also(d)

    return F.exists(rows, lambda b: (b["lo"] < c["end"]) & (c["start"] < b["hi"]) & F.exists(b["rows"], hit))


def _bounded(rows: Column) -> Column:
    """Blocks of an array sorted by start, with the bounds of their spans."""
    return _in_blocks(rows, lambda part, b: F.struct(part.alias("rows"), F.get(part, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(part, lambda d: d["end"])).alias("hi")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def other_negatives(n: int, seed: int) -> np.ndarray:
    """``n`` candidates that are not personal, from other templates than ``examples``: digests, identifiers, numbers of things."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for _ in range(n):
        kind = int(rng.integers(4))
        if kind == 0:
            value = pick([draw("0123456789abcdef", pick([32, 40, 64])), "/".join(draw(lower, int(rng.integers(4, 9))) for _ in range(4)), draw(lower, 6) + draw(lower, 7).title() + draw(lower, 8).title(), "_".join(draw(lower, 6) for _ in range(3))])
            before = pick(["index ", "blob ", "etag of the page ", "path ", "call ", "import ", "parent ", "see also "])
        elif kind == 1:
            value, before = f"{draw(digits, 3)}{pick('-. ')}{draw(digits, 3)}{pick('-. ')}{draw(digits, 4)}", pick(["invoice ", "order ", "ref ", "item ", "in total ", "between ", "catalogue "])
        elif kind == 2:
            value, before = draw(lower, 1) + pick(["(at)", "[at]"]) + draw(lower, 1) + "." + draw(lower, 1), pick(["", "matrix ", "f"])
        else:
            value, before = f"{draw(digits, 3)}-{draw(digits, 2)}-{draw(digits, 4)}", pick(["batch ", "range ", "chapter ", "isbn ", "bus ", "model "])
        rows.append(features_of(kind, value, (f"{draw(lower, 5)} {draw(lower, 7)} " + before)[-BEFORE:]))
    return np.array(rows)


@lru_cache
def thresholds(trees: BoostedTrees, held: int = 1000, seed: int = 12, precision: float = 0.98) -> tuple[float, ...]:
    """Per kind the margin from which on held-out candidates are personal with this precision.

    The held-out rows are those of ``examples`` by another seed, and half as many
    negatives from other templates; a kind that never gets there is not selected.
    """
    x, y = examples(held, seed)
    more = other_negatives(held // 2, seed + 1)
    x, y = np.concatenate([x, more]), np.concatenate([y, np.zeros(len(more))])
    margins, kinds = trees.margin(x), x[:, FEATURES.index("kind")]
    out = []
    for k in range(len(GENERATORS)):
        values, order = margins[kinds == k], np.argsort(-margins[kinds == k], kind="stable")
        exact = np.cumsum(y[kinds == k][order]) / np.arange(1, len(order) + 1)
        last = np.append(values[order][1:] < values[order][:-1], True)  # equal margins are selected together
        good = np.flatnonzero(last & (exact >= precision))
        if not len(good):
            out.append(float("inf"))
            continue
        edge = good[-1]  # between the last selected margin and the next one
        out.append(float(values[order[edge : edge + 2]].mean()))
    return tuple(out)


def find_spans(docs: DataFrame, trees: BoostedTrees | None = None) -> DataFrame:
    """Add ``base`` and ``spans`` (arrays of start, rank, end, kind) to ``docs``.

    Positions are code points, ends exclusive.  ``base`` holds the fixed
    formats; ``spans`` adds selected candidates that overlap no base span and
    no better candidate.  A null text has no spans.  There is no shuffle.
    """
    trees = trees or model()
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_t", text)
    out = out.select("*", *[_labelled(_base(F.col("_t"), k), k, i).alias(f"_{k}") for i, k in enumerate(BASE_KINDS)])
    out = out.withColumn("base", F.sort_array(F.concat(*[F.col(f"_{k}") for k in BASE_KINDS])))
    out = out.withColumn("_cands", F.concat(*[_proposed(F.col("_t"), k) for k in range(len(GENERATORS))]))
    out = out.withColumn(
        "_cands",
        F.transform("_cands", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), _features(c["kind"], c["value"], c["before"]).alias("f"))),
    )
    names = F.array(*[F.lit(g.kind) for g in GENERATORS])
    least = F.array(*[F.lit(t) for t in thresholds(trees)])
    out = out.withColumn(
        "_cands",
        F.filter(
            F.transform(
                "_cands",
                lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), trees.column([c["f"][n] for n in FEATURES]).alias("margin")),
            ),
            lambda c: c["margin"] >= F.get(least, c["kind"]),
        ),
    )

    def free(bases: Column) -> Column:
        return F.filter("_cands", lambda c: ~_overlapping(bases, c))

    def best(rows: Column) -> Column:
        def better(c: Column) -> Callable[[Column], Column]:
            return lambda d: (d["margin"] > c["margin"]) | ((d["margin"] == c["margin"]) & ((d["start"] < c["start"]) | ((d["start"] == c["start"]) & (d["kind"] < c["kind"]))))

        return F.filter("_free", lambda c: ~_overlapping(rows, c, better(c)))

    out = out.withColumn("_free", F.when(F.size("_cands") > 0, F.sort_array(_bound(_bounded(F.col("base")), free))).otherwise(F.col("_cands")))
    best = _bound(_bounded(F.col("_free")), best)
    added = F.transform(best, lambda c: F.struct(c["start"].alias("start"), (c["kind"] + len(BASE_KINDS)).alias("rank"), c["end"].alias("end"), F.get(names, c["kind"]).alias("kind")))
    out = out.withColumn("spans", F.when(F.size("_free") > 0, F.sort_array(F.concat("base", added))).otherwise(F.col("base")))
    return out.drop("_t", "_cands", "_free", *[f"_{k}" for k in BASE_KINDS])


def redact(docs: DataFrame, trees: BoostedTrees | None = None, mask: str = "[{}]") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; other columns stay.

    Of overlapping spans the one that starts first is replaced, and the rest
    of the others is taken out with it.  A null text stays null.
    """
    left, right = mask.split("{}")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # keeps clashing names apart
    found = find_spans(docs.select(row, "text"), trees)

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def built(parts: Column) -> Column:
        def stretch(start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            whole = F.array_join(F.slice(parts, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(whole, (start % PIECE).cast("int") + 1, (end - start).cast("int"))).otherwise("")

        def step(acc: Column, s: Column) -> Column:
            masked = F.concat(stretch(acc["at"], s["start"]), F.lit(left), s["kind"], F.lit(right))
            shown = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(masked))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), shown.alias("out"))

        def joined(blocks: Column) -> Column:
            def block(part: Column, b: Column) -> Column:
                at = F.coalesce(F.array_max(F.transform(F.slice(blocks, F.lit(1), b), lambda x: x["hi"])), F.lit(0).cast("bigint"))
                return F.aggregate(part["rows"], F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])

            last = F.array_max(F.transform(blocks, lambda x: x["hi"]))
            return F.concat(F.array_join(F.flatten(F.transform(blocks, block)), ""), stretch(last, F.length("text").cast("bigint")))

        return _bound(_bounded(F.col("spans")), joined)

    built = _bound(pieces, built)
    text = F.when(F.size("spans") > 0, built).otherwise(F.col("text")).alias("text")
    return found.select(*[text if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans, and all spans as text."""
    found = find_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
