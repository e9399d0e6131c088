"""URL filter, runs and whitening against plain versions, with awkward rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from isoreach.llm import pii, registry, runs, url_filter, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PERIODIC = "doc_id long, text string, lang string, runs int, _t long"


def plain_runs(x, exponent, least):
    """All runs by comparing the sequence with itself at every distance."""
    found = {}
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(exponent * q, least):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in found.items())


@pytest.mark.parametrize("exponent,least", [(2, 2), (3, 4), (4, 6)])
def test_runs_of_all_kinds(exponent, least):
    rng = random.Random(exponent)
    for _ in range(800):
        n = rng.randint(0, 70)
        x = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            a, b = sorted(rng.randrange(n + 1) for _ in range(2))
            p = rng.randint(1, 12)
            for i in range(a + p, b):
                x[i] = x[i - p]
        got = [(s, q, e) for s, e, q in runs.find_runs(np.array(x, np.int64), exponent, least).tolist()]
        assert got == plain_runs(x, exponent, least), x


def test_runs_copied_into_later_blocks():
    inner = [7, 1, 1, 1, 1, 1, 1, 8, 2, 3, 2, 3, 2, 3, 2, 3, 9]
    x = [*inner, 20, *inner, 21, *inner, 22]  # the second and third copy are blocks
    got = [(s, q, e) for s, e, q in runs.find_runs(np.array(x), 4, 6).tolist()]
    assert got == plain_runs(x, 4, 6) and len(got) == 6


def test_long_runs_stay_cheap():
    for x in (np.zeros(300_000, np.int64), np.arange(300_000) % 70_000):
        found = runs.find_runs(x, 4, 6).tolist()
        assert found == [[0, 300_000, 1 if not x.any() else 70_000]]


def test_run_report(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n ", "one", "a " * 5, "a " * 6, "a b " * 4, "x " * 5000 + "y", "der der\u00a0der"]
    texts += [" ".join(rng.choice("ab cd e f") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts += [("p q r s t " * 9 + "z\n") * 3, "u v w " * 4 + "u"]
    rows = [(k, t, None, 1, 2) for k, t in enumerate(texts)] + [(5, texts[5], None, 1, 2), (None, "a " * 9, None, 0, 0), (10**12, "m n " * 30, "x", 0, 0)]
    docs = spark.createDataFrame(rows, PERIODIC).repartition(3)

    def want(doc_id, text):
        w = WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w, 4, 6)
        gone = {i for s, q, e in found for i in range(s + q, e)}
        best = min(found, key=lambda r: (-(r[2] - r[0]) / r[1], r[0], r[1]), default=None)
        lines = "".join(f"{s},{e - s},{q}\n" for s, q, e in found)
        four = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return (doc_id, len(found), *four, digest(lines), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))

    got = sorted(map(str, (tuple(r)[:8] for r in runs.report(docs).collect())))
    assert got == sorted(str(want(i, t)) for i, t, *_ in rows)
    assert runs.report(docs.limit(0)).count() == 0
    plain = {r["doc_id"]: r for r in runs.periodic_runs(docs, 2, 4).collect()}
    assert plain[5]["collapsed"] == "a" and plain[6]["runs"][0]["period"] == 2 and plain[0]["runs"] == []


URLS = [None, "", "no scheme", "http://", "http://a.org", "http://a.org/", "HTTP://WWW.Example.ORG/es/1", "http://example.org/en/12?x=/es/", "http://notexample.org/en/1", "https://com/fr/2", "https://x.y.com/de/#q", "https://x.com/d", "ftp://u:p@host.net:81/a?b#c", "http://casino-poker.example.net/en/1", "http://museum.example.net/en/1", "http://\u00fc\u4e2d\U0001f600.net/\u00e9", "a://b://c/d", "http://é.ORG?x", "http://x.net/" + "ab/" * 40_000]


def test_url_report_and_sql(spark):
    rows = [(k, u, "h", "p", 5) for k, u in enumerate(URLS)] + [(3, URLS[3], "h", "p", 5), (None, URLS[13], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, _url int").repartition(2)
    got = [tuple(r) for r in url_filter.report(pages).collect()]

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()

    by_id = {r[0]: r for r in got}
    assert len(got) == len(rows) and all(by_id[k][1:3] == split(u) for k, u in enumerate(URLS))
    ruled = {k: by_id[k][3:] for k in range(len(URLS)) if by_id[k][3]}
    assert ruled == {5: ("org/", "allow"), 6: ("example.org/es/", "block"), 7: ("example.org/en/1", "block"), 8: ("org/", "allow"), 9: ("com/fr/", "allow"), 10: ("com/de/", "block")}
    assert by_id[13][4] == "block" and by_id[14][4] == "allow"
    con = duckdb.connect()  # its substrings take the square of a url's length
    got = [r for r in got if r[0] is None or r[0] < len(URLS) - 1]
    con.register("pages", pages.where(f"page_id is null or page_id < {len(URLS) - 1}").select("page_id", "url").toPandas().astype(object).where(lambda d: d.notna(), None))
    con.execute("CREATE TABLE p AS SELECT CAST(page_id AS BIGINT) AS page_id, CAST(url AS VARCHAR) AS url FROM pages")
    told = con.sql(url_filter.verdict_sql().replace("FROM pages", "FROM p")).fetchall()
    assert sorted(map(str, told)) == sorted(map(str, got))
    assert url_filter.report(pages.limit(0)).count() == 0
    kept = url_filter.judge(pages)
    assert set(kept.columns) == {"page_id", "url", "host", "path", "verdict", "rule", "score", "_url"} and {r["_url"] for r in kept.collect()} == {5, None}


def test_url_model_on_held_out_urls(spark):
    urls = url_filter.example_urls()
    rng = random.Random(4)
    fresh = [(f"https://{rng.choice(['', 'www.'])}{w}{rng.choice(['', '-', 'x'])}{rng.choice(url_filter.SYLLABLES)}.example.net/en/{rng.randrange(9999)}", block) for block, words in ((True, url_filter.BLOCKED_WORDS), (False, url_filter.ALLOWED_WORDS)) for w in words for _ in range(6)]
    model = url_filter.default_model()
    for table, least in ((urls, 0.97), (fresh, 0.88)):
        hosts, paths = map(list, zip(*[url_filter.split_url(u) for u, _ in table], strict=True))
        total, count = model.sums(hosts, paths)
        assert np.mean((total + model.bias * count > 0) == np.array([b for _, b in table])) >= least
    again = url_filter.train_on(spark.createDataFrame(urls + [(None, True), ("http://x.net/", None)], "url string, block boolean"))
    assert again.weights.any()
    with pytest.raises(ValueError):
        url_filter.train_on(spark.createDataFrame([("http://x.net/", True)], "url string, block boolean"))


def test_whitening_report(spark):
    rng = np.random.default_rng(2)
    good = (rng.standard_normal((400, 40)) * np.linspace(3, 0.2, 40)).astype(np.float32)
    good[100:200] = good[100]  # a heavy tie
    rows = [(k, [float(c) for c in v], 1.0) for k, v in enumerate(good)]
    bad = [None, [], [1.0] * 39 + [None], [1.0] * 39 + [math.nan], [1.0] * 39 + [math.inf]]
    rows += [(1000 + k, v, None) for k, v in enumerate(bad)] + [(1100, [1.0, 2.0], 0.0), (None, rows[3][1], 0.0), (3, rows[3][1], 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened double").repartition(3)
    got = whitening.report(table).toPandas()
    x = np.floor(64 * np.concatenate([good, good[[3, 3]]]).astype(float)) + 1_000_000
    n = len(x)
    assert len(got) == n * 32 and (got.n == n).all()
    c = x - x.mean(axis=0)
    values, directions = np.linalg.eigh(c.T @ c / n)
    values, directions = values[::-1], directions[:, ::-1]
    want = (c @ directions)[:, :32] / np.sqrt(values[:32])
    mine = got[got.vec_id.notna() & (got.vec_id != 3)].sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(-1, 32)
    rest = np.delete(want[:400], 3, axis=0)
    assert np.abs(mine * np.sign((mine * rest).sum(axis=0)) - rest).max() < 1e-8
    shares = got[got.vec_id == 7].sort_values("component").explained.to_numpy()
    assert np.allclose(shares, values[:32] / values.sum(), rtol=1e-9)
    exact = {k: sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], x.sum(axis=0), strict=True)) for k in (0, 150, 399)}
    assert all((got[got.vec_id == k].deviation == v).all() for k, v in exact.items())
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_few_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.report(spark.createDataFrame([], kind)).count() == 0
    assert whitening.report(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    assert whitening.report(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    two = whitening.report(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])], kind)).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    model, held = whitening.fit(spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [2.0, 2.5], "b"), (3, [2.0, 9.0], "c")], "vec_id long, embedding array<double>, name string"), 1)
    assert len(model.values) == 1 and set(whitening.whiten(model, held).columns) == {"vec_id", "embedding", "name", "whitened", "deviation"}


def test_lanczos_restarts_and_breaks_down():
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.standard_normal((200, 200)))
    for values in (np.linspace(1, 100, 200), np.repeat([5.0, 3.0, 0.0, 0.0], 50), np.r_[np.zeros(197), 4.0, 4.0, 9.0], 1.2 ** np.arange(200.0)):
        a = (q * values) @ q.T
        for block in (2, 5, None):
            if block and len(set(values.tolist())) < 10:
                continue  # equal values need a block as wide
            found, u, products = whitening.lanczos(lambda b: a @ b, 200, 6, block, 1e-11)  # noqa: B023
            assert np.allclose(found, np.sort(values)[::-1][:6], atol=1e-8 * values.max()), (block, products)
            assert np.abs(a @ u - u * found).max() < 1e-8 * values.max() and np.allclose(u.T @ u, np.eye(6), atol=1e-10)


def test_deviations_beyond_64_bits():
    x = np.array([[1_000_000, 2_000_000], [1_000_064, 2_000_000]])
    n, sums = 10**15, np.array([10**15 * 1_000_001, 10**15 * 2_000_000])
    assert whitening.deviations(x, n, sums) == [None, None]
    small = whitening.deviations(x, 2, np.array([2_000_064, 4_000_000]))
    assert small == [64**2, 64**2]


def test_registered():
    assert {"op11_url_filter", "op12_periodic_runs", "op13_embedding_whitening"} <= set(registry.queries())
    assert "op11_url_filter" in registry.oracle_sql()


def test_added_spans_against_brute_force(spark):
    """All spans of long texts, across blocks of matches, and the text without them."""
    rng = random.Random(21)

    def piece(i):
        return rng.choice([f"user{i}.x@mail{i}.example.com", f"token = {rng.getrandbits(128):032x}", f"ssn {rng.randrange(100, 999)}-12-{rng.randrange(1000, 9999)}", "call 555-123-4567", "wörds \U0001f600", "10.2.3.4", "+1 (555) 010-9999", "mail a.b(at)c-1.de", "password: 'abcdefghijklmnopqrst/uv'", "\n"])

    texts = [None, "", *[rng.choice([" ", "", "; "]).join(piece(i) for i in range(n)) for n in (1, 5, 255, 256, 257, 900, 3000) for _ in range(2)]]
    trees = pii.model()
    least = pii.thresholds(trees)
    valid = {
        "email": lambda v: True,
        "ip": lambda v: all(int(x) < 256 for x in v.split(".")),
        "card": lambda v: 12 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and sum(int(c) if k % 2 == 0 else int(c) * 2 % 10 + (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0,
        "phone": lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def spans(text):
        base = [(m.start(), k, m.end(), kind) for k, kind in enumerate(pii.BASE_KINDS) for m in re.finditer(plain[kind], text) if valid[kind](m.group())]
        found = []
        for k, g in enumerate(pii.GENERATORS):
            for m in re.finditer(g.pattern, text):
                margin = float(trees.margin(np.array([pii.features_of(k, m.group(), text[max(0, m.start() - pii.BEFORE) : m.start()])]))[0])
                if margin >= least[k] and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                    found.append((m.start(), m.end(), k, margin))
        rank = lambda c: (-c[3], c[0], c[2])
        kept = [c for c in found if not any(c[0] < d[1] and d[0] < c[1] and rank(d) < rank(c) for d in found)]
        return sorted(base + [(s, k + 4, e, pii.GENERATORS[k].kind) for s, e, k, _ in kept])

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for k, text in enumerate(texts):
        want = spans(text or "")
        assert got[k] == ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in want)
        out, at = [], 0
        for s, _, e, kind in want:
            if s >= at:
                out.append((text or "")[at:s] + f"[{kind}]")
            at = max(at, e)
        assert masked[k] == (None if text is None else "".join(out) + text[at:])


def test_thresholds_on_other_negatives():
    trees = pii.model()
    least = np.array(pii.thresholds(trees))
    kind = pii.FEATURES.index("kind")
    for rows, most in ((pii.other_negatives(800, 77), 0.02),):
        assert (trees.margin(rows) >= least[rows[:, kind].astype(int)]).mean() <= most
    x, y = pii.examples(1000, 78)
    chosen = trees.margin(x) >= least[x[:, kind].astype(int)]
    assert np.isfinite(least).all() and chosen[y > 0].mean() >= 0.9 and y[chosen].mean() >= 0.97
