"""Token ids of whole texts in tasks, through the tokenizers library, with a bounded memory of pieces already seen.

Byte-level BPE first cuts a text into pieces by a fixed pattern. Texts are cut at places where that pattern always cuts,
whatever else a text holds (``split``), so that an element has the same ids wherever it occurs. Equal elements of a slice
of texts are looked up once, by an Arrow dictionary; one not seen before is cut into its pieces, and a piece not seen
before goes to the library's BPE model. Elements that begin or end with white space, and so could be cut otherwise
elsewhere, are not used that way: their texts go to the library whole, as do texts with a special token in them, and all
texts if the tokenizer is of another make.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

TOKENIZER = "byte_bpe_50k.json"
#: Elements, and pieces of elements, in a generation of what each Python worker remembers, about 200 bytes each.
MOST_WORDS = 200_000

_state: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class _Memory:
    """A bounded memory in two generations: a full young one replaces the old; what is used of the old moves to the young."""

    def __init__(self):
        self.young: dict[str, bytes | bool] = {}
        self.old: dict[str, bytes | bool] = {}

    def put(self, key: str, ids: bytes | bool) -> None:
        if len(self.young) >= MOST_WORDS:
            self.old, self.young = self.young, {}
        self.young[key] = ids


#: What a byte is to ``split``: 1 white space, 2 an ASCII letter or digit, 4 a mark that often ends a word, 8 other ASCII; the bytes of other characters have none.
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = 8
_KIND[[*range(9, 14), *range(28, 33)]] = 1
_KIND[[b for b in range(128) if chr(b).isalnum()]] = 2
_KIND[[ord(c) for c in ".,;:!?"]] = 4


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(elements, each text's first element and the end): texts cut only where the library's pattern cuts them too.

    That is before a space that stands between two characters that are not white space, around such a line feed, and
    between an ASCII letter or digit and a mark.
    """
    column = pa.array(texts, pa.large_string())
    starts = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1] if texts else np.zeros(1, np.int64)
    data = column.buffers()[2] or pa.py_buffer(b"")
    raw = np.frombuffer(data, np.uint8)[: starts[-1]]
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 2:
        kind = _KIND[raw]
        filled = kind != 1
        inside = filled[:-2] & filled[2:]
        cut[1:-2] = inside & (raw[1:-1] == 32)
        line = inside & (raw[1:-1] == 10) & (kind[:-2] != 0) & (kind[2:] != 0)
        cut[1:-2] |= line
        cut[2:-1] |= line
        cut[1:-1] |= (kind[:-1] == 2) & (kind[1:] == 4)
    cut[starts] = True
    offsets = np.flatnonzero(cut) if len(raw) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), data]), np.searchsorted(offsets, starts)


class _Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        self.special = [a.content for a in t.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.letters = _letters()
        self.inner = {b: c for b, c in self.letters.items() if b != 10}
        made = t.pre_tokenizer
        self.known_make = isinstance(t.model, models.BPE) and isinstance(made, pre_tokenizers.ByteLevel) and made.use_regex and not made.add_prefix_space and t.normalizer is None
        self.model = t.model
        self.words, self.parts = _Memory(), _Memory()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def cut(self, text: str) -> bytes:
        """Ids of a text by pieces."""
        return b"".join([self.part(p) for p in self.pattern.findall(text)])

    def model_ids(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [x.id for x in self.model.tokenize(mapped)]).tobytes()

    def part(self, piece: str) -> bytes:
        memory = self.parts
        if piece in memory.young:
            return memory.young[piece]
        ids = memory.old.get(piece) or self.model_ids(piece)
        if len(piece) < 64:
            memory.put(piece, ids)
        return ids

    def alone(self, w: str) -> bytes | bool:
        """Ids of an element of several pieces, or False if it begins or ends with white space that another place could cut otherwise."""
        core = w[1:] if w[0] == " " else w
        return self.cut(w) if w == "\n" or core and not core[0].isspace() and not core[-1].isspace() else False

    def single(self, elements: list[str]) -> list[bytes]:
        """Ids of elements that are one piece each, mapped to the vocabulary's characters at once."""
        if not elements:
            return []
        mapped, tokenize = "\n".join(elements).encode().decode("latin-1").translate(self.inner).split("\n"), self.model.tokenize
        return [array("I", [x.id for x in tokenize(m)]).tobytes() for m in mapped]

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text, None for those that the library has to take whole. Equal elements are looked up once.

        What is found out about an element is remembered if it occurs again in these texts: of a large corpus most occur
        once, and would drive out those that return.
        """
        plain = [i for i, t in enumerate(texts) if self.known_make and not any(s in t for s in self.special)]
        elements, spans = split([texts[i] for i in plain])
        coded = elements.dictionary_encode()
        young, old, words = self.words.young, self.words.old, coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        again = (np.bincount(coded.indices.to_numpy(), minlength=len(words)) > 1).tolist()
        ids, new = list(map(young.get, words)), []
        for k in [k for k, x in enumerate(ids) if x is None]:
            w = words[k]
            ids[k] = x = old.get(w)
            if x is None:
                if w.isalpha() or w[0] == " " and w[1:].isalpha():
                    new.append(k)
                    continue
                ids[k] = x = self.alone(w)
            if again[k] and len(w) < 64:
                self.words.put(w, x)
        for k, x in zip(new, self.single([words[k] for k in new])):
            ids[k] = x
            if again[k] and len(words[k]) < 64:
                self.words.put(words[k], x)
        at = coded.indices.to_numpy()
        laid = pa.array([x or b"" for x in ids], pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(laid.buffers()[1], np.int64)[: len(laid) + 1] if len(laid) else np.zeros(1, np.int64)
        data = memoryview(laid.buffers()[2] or b"")
        odd = np.fromiter((x is False for x in ids), bool, len(ids))
        bad = np.concatenate([[0], np.cumsum(odd[at])])
        out: list[bytes | None] = [None] * len(texts)
        for i, a, b in zip(plain, spans[:-1].tolist(), spans[1:].tolist()):
            if bad[a] == bad[b]:
                out[i] = bytes(data[ends[a] : ends[b]])
        return out


def encode(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    if _state.get("path") != path:
        _state.clear()
        _state.update(path=path, encoder=_Encoder(path))
    encoder = _state["encoder"]
    out = encoder.encode(texts)
    left = [i for i, ids in enumerate(out) if ids is None]
    for i, ids in zip(left, encoder.whole([texts[i] for i in left])):
        out[i] = ids
    return out


def pieces(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """Slices of a batch that hold about ``most`` characters each, one text at least."""
    out, start, held = [], 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            out.append((start, i))
            start, held = i, 0
        held += n
    return [*out, (start, len(lengths))] if len(lengths) else []


def encoded(batch_texts, path: str, most: int = 1 << 22):
    """(first row, ids of each text) for slices of an Arrow column of texts; null as empty."""
    texts = [t or "" for t in batch_texts.to_pylist()]
    for a, b in pieces([len(t) for t in texts], most):
        yield a, encode(texts[a:b], path)
        pa.default_memory_pool().release_unused()
