"""Token ids of whole texts with a public byte-level vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

END_ID = 0
VOCABULARY = "byte_bpe_50k.json"


def default_vocabulary() -> str:
    """Path of the byte-level vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Encodes texts; equal to encoding each whole text at once by ``tokenizers``.

    The vocabulary's word splitter never joins characters across a single
    space: a space goes with what follows it.  So a text without double spaces
    is the sum of its space-led words.  Words repeat, and their ids are kept
    (up to ``limit`` words of at most ``longest`` characters); new words of a
    batch are encoded in one call, with the same vocabulary in its rank form,
    and told apart by the byte lengths of their tokens.  Texts with the
    special token are encoded whole by ``tokenizers``.
    """

    def __init__(self, path: str, limit: int = 250_000, longest: int = 48):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        import public_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.ranked = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.limit, self.longest = limit, longest
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """Ids of a whole text, without the kept words."""
        if any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranked.encode_to_numpy(text).astype("<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: encoded in a row, each after its space."""
        parts = [(" " + w).encode() for w in words]
        ids = self.ranked.encode_to_numpy(b"".join(parts).decode()).astype("<u4")
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(p) for p in parts])) + 1
        blob, start = ids.tobytes(), 0
        for word, end in zip(words, ends.tolist(), strict=True):
            self.words[word] = blob[4 * start : 4 * end]
            start = end

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none for null."""
        split = [None if t is None or "  " in t or "<|" in t else t.split(" ") for t in texts]
        new = list(set().union(*(words[1:] for words in split if words)).difference(self.words))
        short, before = [w for w in new if len(w) <= self.longest], len(self.words)
        self._learn(short)
        once = {w: self.ranked.encode_to_numpy(" " + w).astype("<u4").tobytes() for w in new if len(w) > self.longest}
        kept, out = self.words, []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self.whole(text) if text else b"")
                continue
            head = self.whole(words[0]) if words[0] else b""
            rest = map(kept.__getitem__, words[1:]) if not once else (kept[w] if w in kept else once[w] for w in words[1:])
            out.append(head + b"".join(rest))
        if len(kept) > self.limit:
            for w in short[max(0, self.limit - before) :]:
                del kept[w]
        return out


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies, inverted.

    Printable bytes stand for themselves; the others follow from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator, path: str) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids and the end id) of each row of Arrow batches (doc_id, text)."""
    own, end = encoder(path), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = part.column(1).to_pylist()
            for doc_id, ids in zip(part.column(0).to_pylist(), own.encode_batch(texts), strict=True):
                yield doc_id, ids + end
