"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once.

Vocabularies of this kind never join characters across white space, so a text is
the sequence of its words, and a batch of texts needs each distinct word once. Words of
plain Latin letters skip the library's normaliser (for these it only lower-cases) and
reach its model split into the pre-tokens that the vocabulary file defines, whose ids a
worker keeps; any other word, such as one with combining marks or the text of a special
token, is given to the library as it is.
"""

from __future__ import annotations

import json
import string
from functools import cache

#: A character for which normalising may be more than lower-casing.
_ODD = r"[^\x21-\x7e\x{a1}-\x{12f}\x{131}-\x{17f}]"


class Generations:
    """A dictionary of two generations: bounded, and what is in use stays."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that are unknown; all others are in ``new`` afterwards."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        lacking, old = keys.difference(self.new), self.old
        kept = {k: old[k] for k in lacking if k in old}
        self.new.update(kept)
        return lacking.difference(kept)


def strings(words) -> list[str]:
    """An Arrow array of texts without line feeds as a list; faster than item by item."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(words):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, pa.scalar("\n", words.type))[0].as_py().split("\n")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; ``most_words`` bounds the memory."""

    def __init__(self, path: str, most_words: int = 120_000):
        import numpy as np
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces = regex.compile(pattern)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [i for t, i in self.whole.get_vocab().items() if t.endswith(spec["model"]["end_of_word_suffix"])]
        self.ends = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        self.ends[ends] = True
        self.parts = Generations(most_words)

    def _parts(self, new: list[str]) -> list[bytes]:
        """Ids of lower-case pre-tokens; the last id of each, and no other, ends a word."""
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(new), 4_000):
            ids = np.array(self.bare.encode_batch_fast([" ".join(new[at : at + 4_000])], add_special_tokens=False)[0].ids, dtype="<u4")
            data, cuts = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            out += [data[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]
        return out

    def _vocabulary(self, words) -> list[bytes]:
        """The ids of distinct words, an Arrow array."""
        import numpy as np
        import pyarrow.compute as pc

        own = pc.match_substring_regex(words, _ODD)
        for s in self.special:
            own = pc.or_(own, pc.match_substring(words, s))
        core = pc.utf8_rtrim(words, characters=string.punctuation)
        simple = pc.and_not(pc.utf8_is_alpha(core), own).to_numpy(zero_copy_only=False)
        tailed = pc.not_equal(pc.binary_length(core), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        texts, cores = strings(words), strings(pc.utf8_lower(core))
        # the pre-tokens of each word: a core of letters and perhaps marks after it, or what the pattern says
        tails = {i: texts[i][len(cores[i]) :] for i in np.flatnonzero(simple & tailed).tolist()}
        whole = np.flatnonzero(own.to_numpy(zero_copy_only=False)).tolist()
        rest = np.setdiff1d(np.flatnonzero(~simple), whole).tolist()
        split = {i: self.pieces.findall(texts[i].lower()) for i in rest}
        letters = [cores[i] for i in np.flatnonzero(simple).tolist()]
        missing = list(self.parts.missing(set(letters).union(tails.values(), *split.values())))
        self.parts.new.update(zip(missing, self._parts(missing), strict=True))
        known = self.parts.new
        out, find = list(map(known.get, cores)), known.__getitem__
        for i, t in tails.items():
            out[i] += known[t]
        for i, ps in split.items():
            out[i] = b"".join(map(find, ps))
        if whole:
            encoded = self.whole.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
            for i, e in zip(whole, encoded, strict=True):
                out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def encode(self, texts):
        """The ids of an Arrow array of texts (null: empty) as one array, and the bounds of each text in it."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        ids = self._vocabulary(coded.dictionary)
        place = coded.indices.to_numpy()
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(length) - length
        each = length.take(place)
        ends = np.concatenate([[0], np.cumsum(each)])
        kind = np.int32 if max(len(flat), ends[-1]) < 1 << 31 else np.int64
        at = np.repeat((start.take(place) - ends[:-1]).astype(kind), each)
        at += np.arange(len(at), dtype=kind)
        offsets = words.offsets.to_numpy()
        return flat.take(at), ends[offsets - offsets[0]]

    def encode_all(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow array as little-endian unsigned 32-bit bytes."""
        ids, bounds = self.encode(texts)
        data, bounds = ids.tobytes(), (4 * bounds).tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def in_batches(texts, most_bytes: int = 8_000_000):
    """Slices of an Arrow array of about ``most_bytes``, so that memory stays bounded."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + most_bytes, side="right")))
        yield start, stop
        start = stop
