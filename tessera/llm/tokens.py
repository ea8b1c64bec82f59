"""Token ids of whole texts, by the tokenizers library.

A byte-level vocabulary with its usual pattern (no prefix space, no normaliser)
falls into words that do not depend on what is around them, so texts are cut at
such borders, found for a whole block of texts at once from the classes of their
bytes. Arrow's dictionary encoding reduces the block to its distinct cuts; a cut
that is one word of plain letters, digits or marks goes through the library's
model, any other through the whole library, and both are remembered for the next
block, within a bound in bytes.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from tessera.llm.common import pieces, tidy, utf8

#: Bytes of cuts and ids that a worker remembers, over both generations, and
#: what an entry takes besides (two objects and a place in a table).
REMEMBERED, ENTRY = 128 << 20, 180
#: Bytes of text that are cut at a time; a longer text is alone.
BLOCK = 4 << 20
#: Letters and marks that are such in every version of Unicode.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", "!-&(-/:-@[-`{-~"
PLAIN = re.compile(f" ?(?:[{LETTERS}]+|[{MARKS}]+|[0-9]+)|\n")
# Classes of bytes: what may stand on both sides of a border.
OTHER, LETTER, DIGIT, MARK, QUOTE, SPACE, BLANK = range(7)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x21:0x7F] = MARK
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
CLASS[0x30:0x3A] = DIGIT
CLASS[0x27] = QUOTE  # may begin a contraction with the letters after it
CLASS[0x20] = SPACE
CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BLANK
#: First bytes of characters that are not white space in any version.
VISIBLE = np.zeros(256, bool)
VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF0), *range(0xF0, 0xF5)]] = True
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def byte_letters() -> dict[int, str]:
    """The visible character by which a byte-level vocabulary writes each byte:
    its own if visible in Latin-1, else the next unused one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def borders(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The starts of all cuts of texts laid end to end, and the end of the last.

    A border stands before every space that a visible character follows; between
    letters, digits and marks; and between one white-space character and what is
    visible. None stands next to a character of another script, after an
    apostrophe, or between several white-space characters and what follows.
    """
    n = len(data)
    at = np.zeros(n + 1, bool)
    at[offs] = True
    if n < 2:
        return np.flatnonzero(at)
    kind = CLASS[data]
    # Letters of two bytes, from U+00C0 to U+023F but for two signs.
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    follow = data[lead + 1]
    lead = lead[(data[lead] != 0xC3) | ((follow != 0x97) & (follow != 0xB7))]
    kind[lead] = LETTER
    kind[lead + 1] = LETTER
    left, right = kind[:-1], kind[1:]
    word = (kind >= LETTER) & (kind <= MARK)
    cut = (left != right) & word[:-1] & (right != OTHER) & ~((left == MARK) & (right == QUOTE))
    alone = np.flatnonzero(kind == BLANK)
    before = kind[alone - 1]
    alone = alone[((before >= LETTER) & (before <= QUOTE)) | at[alone]]
    alone = alone[alone < n - 1]
    after = kind[alone + 1]
    cut[alone[(after >= LETTER) & (after <= QUOTE)]] = True
    gap = np.flatnonzero(right[:-1] == SPACE)  # the space is at gap + 1
    cut[gap[VISIBLE[data[gap + 2]] & ~at[gap + 2]]] = True
    at[1:n] |= cut
    return np.flatnonzero(at)


class Encoder:
    """Encodes texts as little-endian ids (dtype).

    A text that holds an added token of the vocabulary goes through the library
    whole, as do all texts of a vocabulary of any other kind.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.cuts = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.letters = byte_letters()
        self.cells = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        #: What this generation of blocks used, the one before, and bytes held.
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, keys: list[bytes]) -> list[bytes]:
        """The ids of each cut; those not yet known are learned."""
        if self.held > REMEMBERED // 2:
            self.known, self.old, self.held = {}, self.known, 0
        known, old = self.known, self.old
        out = [*map(known.get, keys)]
        new, odd = [], []
        for i in [i for i, x in enumerate(out) if x is None]:
            x = out[i] = old.get(keys[i])
            if x is not None:
                known[keys[i]] = x
                self.held += len(keys[i]) + len(x) + ENTRY
            else:
                (odd if b"\0" in keys[i] else new).append(i)
        if new:
            raw = b"\0".join([keys[i] for i in new])
            cells, tokenize, plain = self.cells, self.model.tokenize, PLAIN.fullmatch
            shown = raw.decode("latin-1").translate(self.letters).split(self.letters[0])
            for i, w, s in zip(new, raw.decode().split("\0"), shown, strict=True):
                if plain(w):
                    out[i] = b"".join([cells[t.id] for t in tokenize(s)])
                else:
                    odd.append(i)
        for i, x in zip(odd, self._whole([keys[i].decode() for i in odd]), strict=True):
            out[i] = x
        for i in (*new, *odd):
            if len(keys[i]) < 256:  # a longer run of another script hardly comes again
                known[keys[i]] = out[i]
                self.held += len(keys[i]) + len(out[i]) + ENTRY
        return out

    def rest(self) -> None:
        """At the end of a task: only the younger generation stays."""
        self.old = {}
        tidy()

    def _block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(offs), np.int64)
        at = borders(data, offs)
        cuts = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self._ids(cuts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary())
        size = np.diff(np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)).astype(np.int64)
        ends = np.zeros(len(at), np.int64)
        np.cumsum(size[cuts.indices.to_numpy()], out=ends[1:])
        raw = np.frombuffer(ids.take(cuts.indices).buffers()[2], np.uint8, int(ends[-1])) if ends[-1] else np.zeros(0, np.uint8)
        return raw.view(self.dtype), ends[np.searchsorted(at, offs)] // self.dtype.itemsize

    def blocks(self, column: pa.Array):
        """Of a string column (null: empty), in order: the ids of some texts, laid
        end to end, and where each begins, with the end of the last."""
        data, offs = utf8(column)
        for a, b in pieces(offs, BLOCK, 4096):
            part, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            raw = part.tobytes() if self.added or not self.cuts else b""
            if self.cuts and not any(x in raw for x in self.added):
                yield self._block(np.ascontiguousarray(part), at)
                continue
            each = [raw[s:t] for s, t in zip(at[:-1], at[1:], strict=True)]
            whole = [not self.cuts or any(x in t for x in self.added) for t in each]
            made = iter(self._whole([t.decode() for t, w in zip(each, whole, strict=True) if w]))
            ids = [np.frombuffer(next(made), self.dtype) if w else self._block(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t, w in zip(each, whole, strict=True)]
            yield np.concatenate(ids), np.cumsum([0, *map(len, ids)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        out = []
        for ids, at in self.blocks(pa.array(texts, pa.string())):
            out += [ids[s:t].tobytes() for s, t in zip(at[:-1], at[1:], strict=True)]
        return out
