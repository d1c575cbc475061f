"""Encoding with a public tokenizer, for operators that need every token id.

The vocabulary drops white space, and its pre-tokenizer never lets a token reach over white
space or from an ASCII letter to a full stop or comma or back. Texts are cut there into
*pieces*, each with the white space before it; the ids of a text are those of its pieces, one
after the other. Arrow numbers the distinct pieces of a batch, the worker remembers the ids
of those it has met, and the library is asked for the rest only.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat_bytes

#: Kinds of bytes: 1 letter, 2 full stop or comma, 3 white space, 0 any other.
KIND = np.zeros(256, np.uint8)
KIND[65:91] = KIND[97:123] = 1
KIND[list(b".,")] = 2
KIND[list(b" \t\n\r\x0b\x0c")] = 3
LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
STOPPED = LATIN.replace("$", "[.,]$")
SLICE = 17_000_000  # bytes of text encoded at a time
GATHER = 400_000  # pieces whose ids are put together at a time

#: What stands for each byte of a word in byte-level vocabularies: itself where it can be seen, else a letter.
BYTE_LEVEL = np.arange(256, dtype="<u4")
BYTE_LEVEL[[*range(127, 161), 173]] = 256 + 33 + np.arange(35)

_encoders: dict[str, "WordEncoder"] = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts. At most about ``cache_words`` pieces are remembered, as Arrow strings;
    beyond that the half that was asked for least is forgotten."""

    def __init__(self, path: str, cache_words: int = 600_000):
        from tokenizers import Tokenizer

        self.limit = cache_words
        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = self._drops_spaces()
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([""])
        self.start, self.size, self.asked = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _drops_spaces(self) -> bool:
        """Whether this vocabulary drops white space, as encoding by pieces needs, and takes a
        word of lower-case Latin letters for one pre-token, by its bytes."""
        parts = ["A", " b", "\tc", " 'd", "\n e", ",", "f", " g", "..", "\r\n"]
        if self._library(["".join(parts)])[0] != sum(self._library(parts), []):
            return False
        words = ["one", "twofold", "thréeføldlyàÿ"]
        ids = self._library([" ".join(words), ".", words[2] + "."])
        return ids[0] == self._pretokens(pa.array(words))[0] and ids[2] == self._pretokens(pa.array(words[2:]))[0] + ids[1]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretokens(self, words: pa.Array, stops: list[list[int]] | None = None) -> tuple[list[int], list[int]]:
        """Ids end to end, and how many each word has, of the library's model on single
        pre-tokens: nothing of lower-case Latin words is normalised or cut, so they can go
        without the steps before it. ``stops``: ids to add to each word."""
        if not len(words):
            return [], []
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ").cast(pa.binary())[0].as_py()
        text = BYTE_LEVEL[np.frombuffer(text, np.uint8)].tobytes().decode("utf-32-le")
        ids, sizes, tokenize = [], [], self.tokenizer.model.tokenize
        for k, word in enumerate(text.split(" ")):
            found = [t.id for t in tokenize(word)]
            if stops:
                found += stops[k]
            ids += found
            sizes.append(len(found))
        return ids, sizes

    def _learn(self, words: pa.Array) -> pa.Array:
        """Ask the library for new pieces; returns them in the order of their numbers."""
        easy, stopped = pc.match_substring_regex(words, LATIN), pc.match_substring_regex(words, STOPPED)
        plain, ended, rest = words.filter(easy), words.filter(stopped), words.filter(pc.invert(pc.or_(easy, stopped)))
        ids, sizes = self._pretokens(plain)
        stops = {x: self._library([x])[0] for x in ".,"}
        last = [stops[x] for x in pc.utf8_slice_codeunits(ended, -1).to_pylist()]
        more, n = self._pretokens(pc.utf8_lower(pc.utf8_slice_codeunits(ended, 0, -1)), last)
        ids += more
        sizes += n
        for at in range(0, len(rest), 20_000):
            found = self._library([x.decode(errors="replace") for x in rest.slice(at, 20_000).cast(pa.binary()).to_pylist()])
            ids += chain.from_iterable(found)
            sizes += map(len, found)
        words = pa.concat_arrays([plain, ended, rest])
        self._remember(words, np.array(ids, np.uint32), np.array(sizes, np.int64))
        return words

    def _remember(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(words) != len(sizes):
            raise ValueError(f"{len(sizes)} word ends for {len(words)} words")
        self.words = pa.concat_arrays([self.words, words])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size, self.asked = np.concatenate([self.size, sizes]), np.concatenate([self.asked, np.zeros(len(words), np.int64)])
        self.ids = np.concatenate([self.ids, ids])

    def _make_room(self) -> None:
        k = np.argsort(-self.asked[1:], kind="stable")[: self.limit // 2] + 1
        words, start, n, ids, asked = self.words.take(pa.array(k)), self.start[k], self.size[k], self.ids, self.asked[k]
        self.forget()
        self._remember(words, ids[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())], n)
        self.asked[1:] = asked // 2

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column end to end (uint32) and the n + 1 places where texts
        begin and end; null counts as empty."""
        raw, ends = flat_bytes(column)
        ids, sizes, at, n = [], [], 0, len(ends) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
            found, size = self._some(raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
            ids.append(found)
            sizes.append(size)
            at = to
        sizes = np.concatenate([np.zeros(1, np.int64), *sizes])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.cumsum(sizes)

    def _some(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of some texts."""
        if not self.by_pieces:
            data = raw.tobytes()
            found = self._library([data[a:b].decode(errors="replace") for a, b in zip(ends, ends[1:])])
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        kind = KIND[raw]
        begins = np.zeros(len(raw), bool)
        before, here = kind[:-1], kind[1:]
        # Into white space; or between a letter (1) and a full stop (2).
        begins[1:] = ((here == 3) & (before != 3)) | ((here ^ before == 3) & (here > 0) & (before > 0))
        begins[ends[:-1][np.diff(ends) > 0]] = True
        cuts = np.append(np.flatnonzero(begins), len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = pieces.dictionary_encode()
        words = pc.ascii_trim_whitespace(coded.dictionary)
        # What could compose, or be a special token, is left for the library to lower-case.
        words = pc.if_else(pc.match_substring_regex(words, LATIN), pc.utf8_lower(words), words)
        words = pc.if_else(pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|"))), pc.ascii_lower(words), words)
        number = pc.index_in(words, value_set=self.words)
        if number.null_count:
            new = words.filter(pc.is_null(number)).unique()
            if len(self.words) + len(new) > self.limit:
                self._make_room()
                number = pc.index_in(words, value_set=self.words)
                new = words.filter(pc.is_null(number)).unique()
            fresh, base = pc.is_null(number), len(self.words)
            number = number.fill_null(0).to_numpy().copy()
            number[fresh.to_numpy(zero_copy_only=False)] = base + pc.index_in(words.filter(fresh), value_set=self._learn(new)).to_numpy()
        else:
            number = number.to_numpy()
        which, total, ids = number[coded.indices.to_numpy()], [np.zeros(1, np.int64)], [np.zeros(0, np.uint32)]
        self.asked += np.bincount(which, minlength=len(self.asked))
        for at in range(0, len(which), GATHER):
            some = which[at : at + GATHER]
            size = self.size[some]
            upto = np.cumsum(size)
            where = np.repeat(self.start[some] - (upto - size), size)
            where += np.arange(len(where))
            ids.append(self.ids[where])
            total.append(upto + total[-1][-1])
        cut = np.concatenate(total)[np.searchsorted(cuts, ends)]
        return np.concatenate(ids), np.diff(cut)


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process for the vocabulary file at ``path``."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def drop_encoders() -> None:
    """Forget all encoders of this worker, as a task does when it ends: the worker lives on, and
    other operators' tasks need the memory."""
    _encoders.clear()
