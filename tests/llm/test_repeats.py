"""The search for repeated windows handles many texts at once."""

import random

import numpy as np
import pyarrow as pa

from isoreach.llm import repeats, sketch, substring_dedup, suffix_dedup, textrows

ODD = ["", None, "a", " a ", "end", "start", "a\x00 a", "x\x1cy\x85z\xa0é", "\t\n\x0b\x0c\r ", "w" * 64, "w" * 65, "w" * 200, "ends ", " starts", "", "0" * 8, "0" * 9, "0" * 8 + "1"]


class Captured:
    """Stands for a table and gives the function that is to run over its batches."""

    def where(self, *_):
        return self

    select = where

    def mapInArrow(self, run, _):
        return run


def batch_of(texts):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "fp", "text"])


def test_work_follows_words_not_documents(spark, monkeypatch):
    """A fixed number of calls for a batch of short texts, whose words are all different."""
    rng, calls = random.Random(4), []
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(400)]

    class Counted(textrows.Rolling):
        def __init__(self, *a):
            calls.append("rolling")
            super().__init__(*a)

    digest = textrows.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(repeats, "Rolling", Counted)
    monkeypatch.setattr(sketch, "Rolling", Counted, raising=False)
    monkeypatch.setattr(textrows.xxhash, "xxh3_64_intdigest", lambda x: (calls.append("word"), digest(x))[1])
    batch = batch_of(texts)
    for run, rows in ((repeats.segments(Captured(), substring_dedup.WHAT), batch), (sketch.partial_sketches(Captured(), substring_dedup.WHAT, 16), batch.select(["text"]))):
        assert sum(b.num_rows for b in run(iter([rows])))
    assert len(calls) < 40


def test_texts_laid_flat_as_each_alone(spark):
    rng = random.Random(5)
    vocabulary = [f"{'é' * rng.randrange(9)}{i}{'z' * rng.choice([0, 5, 12, 70])}" for i in range(30)]
    prose = lambda n: rng.choice(["", " "]) + " ".join(rng.choice(vocabulary) for _ in range(n)) + rng.choice(["", "\n"])
    texts = [x for k in (0, 49, 50, 51, 400, 20, 90) for x in (prose(k), *rng.sample(ODD, 4), "b" * 399, "c" * 400)] + [prose(40_000), prose(60)]
    for what in (substring_dedup.WHAT, suffix_dedup.WHAT):
        run = repeats.segments(Captured(), what)
        rows = lambda batches: [tuple(r.values()) for b in run(iter(batches)) for r in b.to_pylist()]
        whole = batch_of(texts)
        assert rows([whole]) == rows([whole.slice(i, 1) for i in range(len(texts))]) != []
        for _, first, last, length in {(r[0], r[2], r[3], len(words(texts[r[0]]) if what.by_words else (texts[r[0]] or "").encode())) for r in rows([whole])}:
            assert 0 <= first <= last <= length - what.window


def words(text):
    return (text or "").encode().split()


def test_words_of_flat_texts():
    texts = ODD * 2
    raw, cuts = textrows.flat(pa.array(["left out", *texts]).slice(1))
    starts, ends, counts = textrows.words_of(raw, cuts)
    found = [raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert [found[a:b] for a, b in zip(counts[:-1], counts[1:], strict=True)] == [words(x) for x in texts]
    hashes = textrows.hashes_of_words(raw, starts, ends).tolist()
    assert len(set(hashes)) == len(set(found)) == len(set(zip(found, hashes, strict=True)))


def test_empty_batches():
    raw, cuts = textrows.flat(pa.array([], pa.string()))
    assert len(raw) == 0 and cuts.tolist() == [0] and list(textrows.together(iter([batch_of([])]), "text", 9)) == []
    sizes = [(b.num_rows, len(r), len(c)) for b, r, c in textrows.together(iter([batch_of(["aa", None, "b" * 20, "", "c"])]), "text", 9)]
    assert sizes == [(2, 2, 3), (1, 20, 2), (2, 1, 3)] and np.all(textrows.ranges(np.array([3, 9]), np.array([2, 1])) == [3, 4, 9])
