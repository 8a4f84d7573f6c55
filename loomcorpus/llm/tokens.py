"""Token ids of whole texts, with a bounded cache of their pieces."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of one worker's cache; it is emptied when full.
CACHE = 400_000
#: Marks that end a word and form one token run of their own.
_MARKS = ".,;:!?|#*$%&"


@lru_cache(1)
def _encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The pre-tokenizer parts a text before a single space between two other characters (the space
    goes with what follows) and around a single line end, so a text splits into pieces there: a
    piece that starts with a line end follows one, any other follows a space. A piece of letters
    and final marks parts once more between the two. An empty piece, or one with white space at an
    end, shows that this doesn't hold; texts with such pieces are encoded whole.
    """

    def __init__(self, path: str):
        self.path = path
        self.pieces: dict[str, bytes | None] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.line = len(self._ids(["\n"])[0])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in _encoder(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Put the ids of new pieces into the cache."""
        whole, head, tail = self.pieces, [], []
        for p in new:
            word = p[1:] if p[:1] == "\n" else p
            if not word or word != word.strip() or "<|" in word:
                whole[p] = None
                continue
            letters = word.rstrip(_MARKS)
            if len(letters) == len(word) or not letters.isalpha():
                letters = word
            head.append(p[:1] + letters if p is not word else " " + letters)
            tail.append(word[len(letters) :])
        parts = self.parts
        missing = list({x for x in (*head, *tail) if x not in parts})
        # parts are encoded between line ends, which part texts and have one id of their own
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            ids = self._ids(["\n".join(["", *(x.lstrip("\n") for x in some), ""])])[0]
            line = ids[:1].tobytes()
            ends = np.flatnonzero(ids == ids[0]) * 4
            body = ids.tobytes()
            parts.update((x, line + body[a + 4 : z] if x[0] == "\n" else body[a + 4 : z]) for x, a, z in zip(some, ends.tolist(), ends[1:].tolist()))
        whole.update(zip([p for p in new if p not in whole], [parts[x] + parts[y] for x, y in zip(head, tail)]))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a column of texts in one array, and where each text's start and end there; a
        null text has none."""
        if len(self.pieces) > CACHE or len(self.parts) > CACHE:
            self.pieces.clear()
            self.parts = {"": b""}
        texts = pc.fill_null(column.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # the first piece of a text follows nothing, so it is made one that follows a line end
        lines = pc.binary_join_element_wise(pa.scalar("\n"), pc.replace_substring(texts, "\n", " \n"), "")
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        of, codes = split.offsets.to_numpy(), coded.indices.to_numpy()
        names = coded.dictionary.to_pylist()
        pieces = self.pieces
        self._learn([p for p in names if p not in pieces])
        own = [pieces[p] for p in names]
        pool = np.frombuffer(b"".join(x for x in own if x), "<u4")
        sizes = np.array([len(x) // 4 if x else 0 for x in own])
        n = sizes[codes]
        past = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[codes] - past[:-1], n) + np.arange(past[-1])]
        start, end = past[of[:-1]] + self.line, past[of[1:]]
        unlike = np.array([x is None for x in own])[codes]
        whole = np.flatnonzero(np.add.reduceat(unlike, of[:-1], dtype=np.int64))
        if len(whole):
            extra = self._ids(texts.take(pa.array(whole)).to_pylist())
            end[whole] = len(ids) + np.cumsum([len(x) for x in extra])
            start[whole] = end[whole] - [len(x) for x in extra]
            ids = np.concatenate([ids, *extra])
        return ids, start, end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes."""
        ids, start, end = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(start, end)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, so its cache outlives a task."""
    return Encoder(path)
