"""Token ids of whole texts, with a per-process memory of the pieces already encoded.

Both vocabularies split a text before they merge, so a text that is cut where the splitting always cuts has the ids of
its pieces, one after the other. Arrow cuts the texts of a batch and numbers the distinct pieces; prose repeats its
words, so few pieces are left to encode, and the ids of all texts are gathered by offsets. Texts in which the cut isn't
certain are encoded whole.
"""

from __future__ import annotations

import os
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.llm.shared import fresh

#: Pieces remembered by one Python worker (about 15 MB). Beyond that, pieces are encoded again where they come up.
REMEMBERED = 300_000
_LETTER = "[A-Za-zªµºÀ-ÖØ-öø-ÿ]"
#: A letter that lowering leaves one letter, and a full stop or comma after it, which always begins a new piece.
_STOPPED = f"{_LETTER}[.,]$"
#: Pieces that the vocabulary neither lowers nor splits further: the merges are asked for directly.
_WORD = {"space": "^[a-zªµºß-öø-ÿ]+$", "before": f"^ ?{_LETTER}+$"}
#: Two white-space characters in a row, one at either end, or one that is neither a space nor a line feed.
_SPACE = "\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x{85}\\p{Z}"
_UNSURE = f"[{_SPACE}][{_SPACE}]|^[{_SPACE}]|[{_SPACE}]$|[\\t\\x0B\\f\\r\\x1C-\\x1F\\x{{85}}\\p{{Zl}}\\p{{Zp}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]|\\x00"


class PieceEncoder:
    """arrays(texts) -> for each text its ids, the same as encoding it whole.

    cut is "space" for vocabularies in lower case that drop white space (pieces never hold any) or "before" for
    byte-level ones, where a single space belongs to the word after it. A special token's string in a text gives that
    token, as the library has it by default, unless special_as_text is set.
    """

    def __init__(self, path: str, cut: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.splitter = Tokenizer.from_file(path) if special_as_text else self.tokenizer
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.cut = cut
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.between_id, between = next(iter(added.items()))
        self.between = between.content
        self.known = pa.array([], pa.large_string())
        self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all their ids): one call for many pieces, with a special token between them."""
        found = np.array(self.splitter.encode_batch_fast([self.between.join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        marks = found == self.between_id
        return np.diff(np.nonzero(marks)[0], prepend=-1, append=len(found)) - 1, found[~marks]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        merge = self.splitter.model.tokenize
        found = [[t.id for t in merge(x)] for x in self.bytes.pre_tokenize_str("\n".join(words))[0][0].split("Ċ")]
        return np.array(list(map(len, found)), np.int64), np.array(list(chain.from_iterable(found)), "<u4")

    def each(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lengths, ids, places = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        plain = pc.match_substring_regex(pieces, _WORD[self.cut]).to_numpy(zero_copy_only=False)
        for encode, chosen in ((self._merged, plain), (self._joined, ~plain)):
            at = np.nonzero(chosen)[0]
            for k in range(0, len(at), 20_000):
                n, found = encode(pieces.take(pa.array(at[k : k + 20_000])).to_numpy(zero_copy_only=False).tolist())
                lengths.append(n)
                ids.append(found)
            places.append(at)
        lengths, order = np.concatenate(lengths), np.argsort(np.concatenate(places))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return lengths[order], _gathered(np.concatenate(ids), starts[order], lengths[order])

    def _cut_surely(self, texts: pa.Array) -> np.ndarray:
        """Which texts may be cut."""
        unsure = pc.match_substring_regex(texts, "\\x00") if self.cut == "space" else pc.match_substring_regex(texts, _UNSURE)
        for token in self.special:
            unsure = pc.or_(unsure, pc.match_substring(texts, token))
        return ~unsure.to_numpy(zero_copy_only=False)

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        if self.cut == "space":
            # letter by letter in this range, like the vocabulary's own lowering
            lowered = pc.if_else(pc.match_substring_regex(texts, "[^\\x{00}-\\x{FF}]"), texts, pc.utf8_lower(texts))
            return pc.split_pattern(pc.replace_substring(lowered, "\n", " "), " ")
        # a line feed between two words is a piece of its own, a space goes with what follows it
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
        return pc.split_pattern(marked, "\0")

    def _fresh(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pieces to ids; a word with a stop on it is encoded as the two."""
        stopped = pc.match_substring_regex(new, _STOPPED)
        ends = np.concatenate([[0], np.cumsum(1 + stopped.to_numpy(zero_copy_only=False))])
        word = pc.if_else(stopped, pc.utf8_slice_codeunits(new, 0, -1), new)
        numbered = pa.concat_arrays([word, pc.utf8_slice_codeunits(new.filter(stopped), -1)]).dictionary_encode()
        of_part, part_ids = self.each(numbered.dictionary)
        part = np.zeros(ends[-1], np.int64)
        at = numbered.indices.to_numpy()
        part[ends[:-1]] = at[: len(new)]
        part[ends[1:][np.diff(ends) == 2] - 1] = at[len(new) :]
        starts = np.concatenate([[0], np.cumsum(of_part)[:-1]])
        return np.add.reduceat(of_part[part], ends[:-1]), _gathered(part_ids, starts[part], of_part[part])

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each distinct piece, all their ids one after the other)."""
        found = pc.index_in(pieces, value_set=self.known)
        slots = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = slots < 0
        lengths, ids = self.lengths, self.ids
        if missing.any():
            new = pieces.filter(pa.array(missing))
            more, more_ids = self._fresh(new)
            slots[missing] = len(lengths) + np.arange(len(new))
            lengths, ids = np.concatenate([lengths, more]), np.concatenate([ids, more_ids])
            keep = min(len(new), REMEMBERED - len(self.known))
            if keep > 0 and pc.max(pc.binary_length(new)).as_py() < 1_000:
                self.known = pa.concat_arrays([self.known, new.slice(0, keep)])
                self.lengths = lengths[: len(self.known)]
                self.ids = ids[: int(self.lengths.sum())]
        starts = np.concatenate([[0], np.cumsum(lengths)])[slots]
        return lengths[slots], _gathered(ids, starts, lengths[slots])

    def arrays(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none), as little-endian unsigned 32-bit integers."""
        texts = fresh(texts)
        out: list = [None] * len(texts)
        sure = self._cut_surely(texts)
        rows = np.nonzero(~sure)[0]
        for i, ids in zip(rows, self.whole([texts[int(i)].as_py() for i in rows])):
            out[i] = ids
        rows = np.nonzero(sure)[0]
        if len(rows):
            cut = self._pieces(texts.filter(pa.array(sure)))
            offsets = cut.offsets.to_numpy()
            numbered = cut.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
            at = numbered.indices.to_numpy()
            lengths, ids = self._encoded(numbered.dictionary)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            flat = _gathered(ids, starts[at], lengths[at])
            ends = np.concatenate([[0], np.cumsum(lengths[at])])[offsets - offsets[0]]
            for i, a, b in zip(rows, ends[:-1], ends[1:]):
                out[i] = flat[a:b]
        return out


def _gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches ids[start : start + length] one after the other."""
    ends = np.cumsum(lengths)
    return ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


@cache
def encoder(path: str, cut: str, special_as_text: bool = False) -> PieceEncoder:
    return PieceEncoder(path, cut, special_as_text)


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
