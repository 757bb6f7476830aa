"""Token ids of whole texts by the tokenizers library, with a bounded cache of pre-tokens.

Texts of plain Latin letters are cut at white space, where the tokenizer's pre-tokens always end, and the
words of some megabytes of text are numbered together. Each distinct word is cut into pre-tokens once,
by a pattern equal to the tokenizer's, and each new pre-token goes to the tokenizer's BPE model. Any
other text goes to the tokenizer whole. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import array
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters on which Python and the tokenizers library agree about letters, digits, white space and case.
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e¡§«°·»¿À-ÖØ-öø-įı-ɏ–—‘’“”…€]")
_TAILS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Stands between words that are cut together; no plain text holds it.
_CUT = "\x01"
_LETTER, _OTHER = r"[^\W\d_]", rf"(?:[^\w\s{_CUT}]|_)"
#: Pre-tokens of each kind of vocabulary: lower-cased words and marks, or pieces with their leading space.
_PIECES = {
    "word": re.compile(rf"{_CUT}|{_TAILS}|{_LETTER}+|\d|{_OTHER}+"),
    "byte": re.compile(rf"{_CUT}|{_TAILS}| ?{_LETTER}+| ?\d+| ?{_OTHER}+|\s"),
}


#: White space that byte-level pre-tokens do not take character by character: more than two characters, or two at the end.
_LONG_RUN = re.compile(r"\s\s(?:\s|\Z)")
#: Characters of text whose words are numbered together.
AT_ONCE = 3 << 20


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in prints}
    rest = (b for b in range(256) if b not in letters)
    letters.update({b: chr(0x100 + i) for i, b in enumerate(rest)})
    return [letters[b] for b in range(256)]


class _Cache(dict):
    def __init__(self, ids, most: int):
        super().__init__()
        self.ids, self.most = ids, most

    def __missing__(self, piece: str) -> bytes:
        out = self.ids(piece)
        if len(self) < self.most and len(piece) <= 64:
            self[piece] = out
        return out


class Encoder:
    """Texts to little-endian unsigned 32-bit ids. kind: 'word' (lower case) or 'byte' (byte level)."""

    def __init__(self, path: str, kind: str, cache: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lower, self.pieces, model, letters = kind == "word", _PIECES[kind], self.tokenizer.model, _byte_letters()

        def ids(piece: str) -> bytes:
            if piece.isascii() and piece.isprintable():
                shown = piece.replace(" ", letters[0x20])
            else:
                shown = "".join([letters[b] for b in piece.encode()])
            return array.array("I", [t.id for t in model.tokenize(shown)]).tobytes()

        self.cache = _Cache(ids, cache)
        self.cache[_CUT] = b""

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _some(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and how many each has."""
        odd: dict[int, np.ndarray] = {}
        plain = []
        for i, t in enumerate(texts):
            if not t:
                plain.append("")
            elif _PLAIN.search(t) or (not self.lower and _LONG_RUN.search(t)):
                odd[i] = np.frombuffer(self.whole(t), dtype=np.uint32)
                plain.append("")
            else:
                plain.append(t.lower() if self.lower else t.replace("\n", _CUT + "\n").replace(" ", _CUT + " "))
        lists = pa.array(plain, pa.large_string())
        lists = pc.ascii_split_whitespace(lists) if self.lower else pc.split_pattern(lists, _CUT)
        coded = lists.flatten().dictionary_encode()
        found = list(map(self.cache.__getitem__, self.pieces.findall(_CUT.join(coded.dictionary.to_pylist()))))
        of_piece = np.array([len(x) // 4 for x in found] + [0], dtype=np.int64)
        size = np.diff(np.cumsum(of_piece)[of_piece == 0], prepend=0)[: len(coded.dictionary)]
        number = coded.indices.to_numpy()
        sizes, ends = size[number], np.append(0, np.cumsum(size[number]))
        begins = (np.cumsum(size) - size)[number] - ends[:-1]
        ids = np.frombuffer(b"".join(found), dtype=np.uint32)[np.repeat(begins, sizes) + np.arange(ends[-1])]
        ends = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        counts = np.diff(ends)
        if odd:
            parts = [odd.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)
        return ids, counts

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and how many each has; empty for a null text."""
        parts, at = [], 0
        while at < len(texts):
            some, n = at, 0
            while at < len(texts) and n < AT_ONCE:
                n += len(texts[at] or "")
                at += 1
            parts.append(self._some(texts[some:at]))
        if not parts:
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def with_end(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As many(), each text's ids followed by end_id; the second is where each begins and the last ends."""
        ids, counts = self.many(texts)
        return np.insert(ids, np.cumsum(counts), end_id), np.append(0, np.cumsum(counts + 1))

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0].tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def few_at_once(batch: pa.RecordBatch, most: int = 4 << 20):
    """The doc_ids and texts of a batch, about so many bytes of text at once, so that no step holds more than that and one text."""
    texts = batch["text"]
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))) if len(texts) else np.empty(0)
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0.0
        upto = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch["doc_id"].slice(at, upto - at), texts.slice(at, upto - at).to_pylist()
        at = upto
