"""Token ids by the tokenizers library, with a cache of what stands between blanks.

The vocabulary is byte-level and its pattern joins a space to the word after it and nothing to what stands
before; a line feed before a word is a token of its own. So a text can be cut before every space and line feed
that another sign follows, each part encoded alone, and the ids joined, with the same result as for the whole
text. Parts repeat, so most come from a cache. The cache is bounded in bytes, in two halves: when the one that parts
were last met in is full, it becomes the other, and what was in that goes. Long parts, as in texts without blanks, are never kept.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space beside white space, at an end or of another kind: such a text is cut by search, others by splitting.
_WIDE = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \\n][ \\n]|[ \\n]\\z"
_CUT = re.compile(r" (?=\S)|(?=\n\S)")
#: A word of Latin letters, which is one piece of the vocabulary's pattern, and signs after it, which are one.
_WORD = "^\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+\\z"
_SIGNS_AFTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of parts and their ids that a cache may hold, and what an entry takes beside them in Python.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 150
#: Bytes of text that are encoded at once: parts and ids of so many are held beside the cache.
TEXT_BYTES = 3 << 20
#: Parts that go to the model at once, whose answer takes some hundred bytes an id.
PARTS = 1 << 16
#: Characters of the longest part that is kept.
LONGEST_KEPT = 64


def _byte_signs() -> dict[int, int]:
    """The sign that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printed]
    return {b: b for b in printed} | {b: 256 + i for i, b in enumerate(others)}


#: The sign of each byte, but for the line feed that parts words.
_SIGNS = np.array([10 if b == 10 else sign for b, sign in sorted(_byte_signs().items())], "<u4")
#: The id that ends each document.
END_ID = 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_lengths(tokenizer) -> np.ndarray:
    """Bytes of text that each id stands for; every sign of a byte-level token is one byte."""
    special = {i: token.content for i, token in tokenizer.get_added_tokens_decoder().items()}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    lengths = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        lengths[i] = len(special[i].encode()) if i in special else len(token)
    return lengths


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, vocabulary: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._lengths = _byte_lengths(self._tokenizer)
        # the same model, held once, fed with words in the model's spelling of bytes
        self._words = Tokenizer(self._tokenizer.model)
        self._words.pre_tokenizer = CharDelimiterSplit("\n")
        self._feed = self._whole(["\n"])[0]
        self._tails: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {"": b""}
        self._earlier: dict[str, bytes] = {}
        self._held, self._room = 0, cache_bytes
        self.vocabulary_size = len(self._lengths)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _pieces(self, tokenizer, text: str, sizes: np.ndarray) -> pa.Array:
        """The ids of the text, cut where so many bytes of text end."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends, edges = np.cumsum(self._lengths[ids]), np.cumsum(sizes)
        cuts = np.searchsorted(ends, edges) + 1
        if not len(ids) or ends[-1] != edges[-1] or not np.array_equal(ends[cuts - 1], edges):
            raise ValueError("the vocabulary isn't byte-level: ids don't add up to the text")
        stops = pa.array(4 * np.concatenate([[0], cuts]), pa.int32())
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, stops.buffers()[1], pa.py_buffer(ids.tobytes())])

    def _learned(self, parts: pa.Array) -> pa.Array:
        """The ids of parts, each after a space or with the line feed that it begins with.

        A Latin word with or without signs after it is one or two pieces of the pattern: words go to the model
        without the pattern's search, and the ids of signs stand ready once they were met.
        """
        if len(parts) > PARTS:
            return pa.concat_arrays([self._learned(parts.slice(i, PARTS)) for i in range(0, len(parts), PARTS)])
        stems = pc.utf8_rtrim(parts, _SIGNS_AFTER)
        simple = pc.match_substring_regex(stems, _WORD)
        feeds = pc.starts_with(parts, "\n")
        spaced = pc.if_else(feeds, parts, pc.binary_join_element_wise(" ", parts, ""))
        out = []
        rest = spaced.filter(pc.invert(simple))
        if len(rest):
            out.append(self._pieces(self._tokenizer, "".join(_listed(rest)), pc.binary_length(rest).to_numpy()))
        if len(rest) < len(parts):
            own, stems, feeds = parts.filter(simple), stems.filter(simple), feeds.filter(simple)
            coded = pc.if_else(feeds, stems, pc.binary_join_element_wise(" ", stems, "")).dictionary_encode()
            words = pc.utf8_ltrim(coded.dictionary, "\n")
            spelt = _SIGNS[np.frombuffer("\n".join(_listed(words)).encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = self._pieces(self._words, spelt, pc.binary_length(words).to_numpy()).take(coded.indices)
            ids = pc.binary_join_element_wise(pc.if_else(feeds, self._feed, b""), ids, b"")
            marked = pc.not_equal(pc.binary_length(own), pc.binary_length(stems))
            if pc.any(marked).as_py():
                places = pc.utf8_length(stems.filter(marked)).to_numpy().tolist()
                tails = [p[k:] for p, k in zip(_listed(own.filter(marked)), places)]
                ids = pc.replace_with_mask(ids, marked, pc.binary_join_element_wise(ids.filter(marked), self._signs(tails), b""))
            out.append(ids)
        at = np.argsort(np.concatenate([np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (pc.invert(simple), simple)]))
        return pa.concat_arrays(out).take(pa.array(at))

    def _signs(self, tails: list[str]) -> pa.Array:
        """The ids of signs that stand after words."""
        new = list({*tails}.difference(self._tails))
        if new:
            if len(self._tails) + len(new) > 1 << 16:
                self._tails, new = {}, list({*tails})
            self._tails.update(zip(new, self._whole(new)))
        return pa.array([self._tails[x] for x in tails], pa.binary())

    def _found(self, parts: pa.Array) -> pa.Array:
        """The ids of different parts, from the cache or else the model."""
        ids = pa.array(list(map(self._parts.get, _listed(parts))), pa.binary())
        if not ids.null_count:
            return ids
        away = ids.is_null()
        parts = parts.filter(away)
        others = pa.array(list(map(self._earlier.get, _listed(parts))), pa.binary())
        if others.null_count:
            new = others.is_null()
            others = pc.replace_with_mask(others, new, self._learned(parts.filter(new)))
        self._keep(parts, others)
        return pc.replace_with_mask(ids, away, others)

    def _keep(self, parts: pa.Array, ids: pa.Array) -> None:
        short = pc.less_equal(pc.utf8_length(parts), LONGEST_KEPT)
        parts, ids = parts.filter(short), ids.filter(short)
        texts, values = (pc.sum(pc.binary_length(x)).as_py() or 0 for x in (parts, ids))
        size = texts + values + ENTRY_BYTES * len(parts)
        if self._held + size > self._room // 2:
            self._earlier, self._parts, self._held = self._parts, {"": b""}, 0
        if size <= self._room // 2:
            self._held += size
            self._parts.update(zip(_listed(parts), _listed(ids)))

    def _divided(self, texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """The parts of each text, and the order in which the texts are told."""
        wide = pc.match_substring_regex(texts, _WIDE).to_numpy(zero_copy_only=False)
        order = np.argsort(wide, kind="stable")
        plain = texts.take(pa.array(order[: len(wide) - int(wide.sum())]))
        parts = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        if wide.any():
            others = [_CUT.split(x) for x in texts.filter(pa.array(wide)).to_pylist()]
            parts = pa.concat_arrays([parts, pa.array(others, parts.type)])
        return order, parts

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text (null: of an empty one), without an end id."""
        texts = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        out = [b""] * len(texts)
        special = np.zeros(len(texts), bool)
        for token in self._special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if special.any():  # text of a special token: no cut is safe there
            for i, ids in zip(np.flatnonzero(special), self._whole(texts.filter(pa.array(special)).to_pylist())):
                out[i] = ids
        plain = np.flatnonzero(~special)
        if not len(plain):
            return out
        order, parts = self._divided(texts.take(pa.array(plain)))
        edges = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        every = parts.flatten()
        # a text's first part has no blank before it
        firsts = self._whole(every.take(pa.array(edges[:-1])).to_pylist())
        first = np.zeros(len(every), bool)
        first[edges[:-1]] = True
        coded = pc.if_else(pa.array(first), "", every).dictionary_encode()
        names = coded.dictionary
        table = pa.concat_arrays([self._found(names), pa.array(firsts, pa.binary())])
        numbers = coded.indices.to_numpy().copy()
        numbers[edges[:-1]] = len(names) + np.arange(len(firsts))
        stops, flat = table.take(pa.array(numbers)).buffers()[1:]
        stops = np.frombuffer(stops, np.int32)[edges].tolist()
        for i, a, b in zip(plain[order].tolist(), stops[:-1], stops[1:]):
            out[i] = flat[a:b].to_pybytes()
        return out


def _listed(values: pa.Array) -> list:
    """As to_pylist, without a scalar for each value."""
    return values.to_numpy(zero_copy_only=False).tolist()


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder a Python worker, kept over its tasks."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
