"""Token ids of whole texts by a ready-made tokenizer file, cached by word."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept by one worker; later ones, which are rare, are encoded batch by batch.
CACHE_WORDS = 700_000
SPACE, FEED = 32, 10
#: Bytes of ASCII letters and digits.
PLAIN = np.zeros(256, bool)
PLAIN[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True


def utf8(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts as a column, its bytes end to end, and the edges of each text in them."""
    column = pa.array(texts, pa.large_string())
    edges = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    return column, np.frombuffer(column.buffers()[2] or b"", np.uint8), edges


def even(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of each text whether all its white space is single spaces and line feeds between words (other characters next to such ones in the tables count as white, too)."""
    out = np.diff(edges) > 0
    white = (data == SPACE) | (data == FEED)
    out[out] = ~(white[edges[:-1][out]] | white[edges[1:][out] - 1])
    bad = (data < SPACE) & (data != FEED)
    bad[1:] |= white[1:] & white[:-1]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    one, two, three = data[lead], data[np.minimum(lead + 1, len(data) - 1)], data[np.minimum(lead + 2, len(data) - 1)]
    wide = (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
    wide |= (one == 0xE1) & ((two == 0x9A) | (two == 0xA0)) & ((three == 0x80) | (three == 0x8E))
    wide |= (one == 0xE2) & ((two == 0x80) & (three <= 0xAF) & ((three <= 0x8F) | (three >= 0xA8)) | (two == 0x81) & (three == 0x9F))
    wide |= (one == 0xE3) & (two == 0x80) & (three == 0x80)
    for at in (np.flatnonzero(bad), lead[wide]):
        out[np.searchsorted(edges, at, "right") - 1] = False
    return out


def cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of even texts: texts, spaces, line feeds, what follows a line feed, and a mark between a letter or digit and white space."""
    cut = (data == SPACE) | (data == FEED)
    mark = np.flatnonzero(((data == 44) | (data == 46))[:-1] & cut[1:])
    cut[1:] |= data[:-1] == FEED
    cut[edges[:-1][np.diff(edges) > 0]] = True
    mark = mark[mark > 1]
    before = data[mark - 1]
    # letters of two bytes from the first table after ASCII, but for the signs of multiplication and division
    letter = PLAIN[before] | ((data[mark - 2] == 0xC3) & (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7))
    cut[mark[letter]] = True
    return np.flatnonzero(cut)


class Encoder:
    """``encode(texts)`` gives each text's ids as uint32, equal to encoding the whole text.

    The byte-level pre-tokenizer always cuts before a space that stands between two other
    characters, around a single line feed and between a letter or digit and a mark, so the
    ids of a text are those of such pieces.  New pieces are encoded by the library many at
    a time: joined to one text, in which a piece begins where an id's bytes begin with a
    space or, for pieces without one, after each line feed put between them.  Texts with
    other white space, or with the name of an added token in them, go to the library whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([self.tokenizer.id_to_token(i).startswith("Ġ") for i in range(size)])
        self.line_feed = np.array([self.tokenizer.id_to_token(i) == "Ċ" for i in range(size)])
        #: Pieces, and where their ids stand in ``ids``.
        self.names = pa.array(["\n"], pa.large_string())
        self.start = np.zeros(1, np.int64)
        self.count = np.ones(1, np.int32)
        self.ids = np.flatnonzero(self.line_feed).astype(np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(self, words: list[str], between: str, heads: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new words end to end, first places and counts; each is encoded after ``between``, heads marks the ids that begin one, of which the first ``drop`` are not its own."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        ids = np.concatenate(self.whole(["".join(between + w for w in words[i : i + 2000]) for i in range(0, len(words), 2000)]))
        head = np.flatnonzero(heads[ids])
        if len(head) != len(words):
            raise ValueError("the tokenizer does not cut where words are joined")
        return ids, head + drop, (np.diff(np.append(head, len(ids))) - drop).astype(np.int32)

    def encode_new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = words.to_pylist()
        spaced = np.array([w[0] == " " for w in names])
        start, count = np.zeros(len(names), np.int64), np.zeros(len(names), np.int32)
        a, start[spaced], count[spaced] = self.of_words([w for w in names if w[0] == " "], "", self.spaced, 0)
        b, start[~spaced], count[~spaced] = self.of_words([w for w in names if w[0] != " "], "\n", self.line_feed, 1)
        start[~spaced] += len(a)
        return np.concatenate((a, b)), start, count

    def looked_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first place of each piece in them, count of each piece)."""
        found = pc.index_in(pieces, value_set=self.names)
        start, count, ids = self.start, self.count, self.ids
        at = found.fill_null(0).to_numpy(zero_copy_only=False)
        if found.null_count:
            new = found.is_null()
            fresh = pieces.filter(new).dictionary_encode()
            more, first, size = self.encode_new(fresh.dictionary)
            start, count, ids = np.concatenate((start, first + len(ids))), np.concatenate((count, size)), np.concatenate((ids, more))
            at = at.copy()
            at[new.to_numpy(zero_copy_only=False)] = len(self.start) + np.asarray(fresh.indices)
            if len(start) <= self.cache_words:
                self.names = pa.concat_arrays([self.names, fresh.dictionary])
                self.start, self.count, self.ids = start, count, ids
        return ids, start[at], count[at]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        column, data, edges = utf8(texts)
        ok = even(data, edges)
        for name in self.added:
            if any(name in t for t in texts):
                ok &= np.array([name not in t for t in texts])
        odd = np.flatnonzero(~ok).tolist()
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        if len(odd) == len(texts):
            return out
        if odd:
            column, data, edges = utf8([texts[i] for i in np.flatnonzero(ok).tolist()])
        first = cuts(data, edges)
        pieces = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data)).astype(np.int64)), column.buffers()[2])
        ids, start, count = self.looked_up(pieces)
        ends = np.cumsum(count, dtype=np.int64)
        flat = ids[np.repeat(start - ends + count, count) + np.arange(ends[-1])]
        cut = np.concatenate(([0], ends))[np.searchsorted(first, edges)].tolist()
        for k, i in enumerate(np.flatnonzero(ok).tolist()):
            out[i] = flat[cut[k] : cut[k + 1]]
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One for each worker process, file and size, so that words stay cached from task to task."""
    key = (path, cache_words)
    if key not in _encoders:
        _encoders[key] = Encoder(path, cache_words)
    return _encoders[key]


def batches(texts: list[str | None], chars: int = 10 << 20) -> list[slice]:
    """Consecutive texts of about so many characters."""
    edges, held = [0], 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            edges.append(i + 1)
            held = 0
    if edges[-1] != len(texts):
        edges.append(len(texts))
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
