"""Token ids from a public tokenizer file, with a bounded memory of pieces already encoded.

The tokenizers library encodes a text piece by piece: neither kind of file below has
a token across the cuts made here, so the ids of a text are those of its pieces in
order. Pieces repeat, so each worker asks the library for a piece only once. A plain word with
marks behind it is two pre-tokens under the rules of both files, so it goes to the library's model
without the steps before it, which cost more than the model. A text that
holds the string of an added token, in any case, is encoded whole by the library's own call.
"""

import json
import os
import re
import struct
from itertools import islice

# Pieces remembered by a worker (27 MB measured, which it holds as long as it lives, whatever runs in it next). Beyond
# that the first half stays: pieces met early are the frequent ones.
KEEP = 300_000
LONG = 256  # longer pieces are not remembered

_SPACED = re.compile(rb"[ \n]*[^ \n]+|[ \n]+")
# One space or newline at most, letters that no normaliser rule but lower case changes, marks other than the apostrophe.
_WORD = re.compile(r"([ \n]?)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")
# Rules under which the letters (with the space before them), a newline and the marks of _WORD are pre-tokens.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORD_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_STEPS = [{"type": "Split", "pattern": {"Regex": _WORD_RULE}, "behavior": "Removed", "invert": True}, _BYTES | {"use_regex": False}]
_WORD_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PLAIN = [
    (None, _BYTES | {"use_regex": True}),
    ({"type": "Sequence", "normalizers": _WORD_NORMAL}, {"type": "Sequence", "pretokenizers": _WORD_STEPS}),
]
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
# The letter that stands for each byte in a byte-level vocabulary, and those for _WORD's letters beyond ASCII.
_LETTER = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_SPELT = {c: chr(c).encode().decode("latin-1").translate(_LETTER) for c in range(0xC0, 0x100)}
_LEAD = {"": "", " ": _LETTER[32]}
_NEWLINE = _LETTER[10]
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, as the library's call with its defaults gives them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # In any case of letters, as a normaliser may change it.
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        # White space is dropped, and no normaliser rule joins what it parts.
        self.drops_space = self.library.normalizer is not None and not self.library.encode("a \n b", add_special_tokens=False).ids[2:]
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.model = self.library.model
        steps = [json.loads(x.__getstate__()) if x is not None else None for x in (self.library.normalizer, self.library.pre_tokenizer)]
        self.plain = tuple(steps) in _PLAIN and not self.model.dropout

    def _direct(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_token(self, text: str, lead: str = "") -> bytes:
        tokens = self.model.tokenize(lead + (text if text.isascii() else text.translate(_SPELT)))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _word(self, lead: str, letters: str, marks: str) -> bytes:
        stem = (lead + letters).encode()
        ids = self.known.get(stem)
        if ids is None:
            if self.drops_space:
                ids = self._pre_token(letters.lower())
            elif lead == "\n":
                ids = self._pre_token("", _NEWLINE) + self._pre_token(letters)
            else:
                ids = self._pre_token(letters, _LEAD[lead])
            self.known[stem] = ids
        if marks:
            if marks not in self.marks:
                self.marks[marks] = self._pre_token(marks)
            ids += self.marks[marks]
        return ids

    def _learn(self, pieces: set[bytes]) -> dict[bytes, bytes | None]:
        """Ids of pieces that are not remembered yet; None where a piece's end may hang on what follows."""
        if len(self.known) + 2 * len(pieces) > KEEP:
            self.known = dict(islice(self.known.items(), KEEP // 2))
            self.marks.clear()
        new, todo = {}, []
        for piece in pieces:
            word = _WORD.fullmatch(piece.decode()) if self.plain and len(piece) <= LONG else None
            if word:
                new[piece] = self._word(*word.groups())
            # A cut is sure only after a character that is no white space at all.
            elif not self.drops_space and piece.strip(b" \n") and piece.decode()[-1].isspace():
                new[piece] = None
            else:
                todo.append(piece)
        new.update(zip(todo, self._direct([p.decode() for p in todo])))
        self.known.update((p, x) for p, x in new.items() if x is not None and len(p) <= LONG)
        return new

    def encode(self, text: str) -> bytes:
        lowered = text.lower()
        if any(token in lowered for token in self.added):
            return self._direct([text])[0]
        raw = text.encode()
        pieces = raw.split() if self.drops_space else _SPACED.findall(raw)
        ids = list(map(self.known.get, pieces))
        if None in ids:
            new = self._learn({p for p, x in zip(pieces, ids) if x is None})
            if None in new.values():
                return self._direct([text])[0]
            ids = [new[p] if x is None else x for p, x in zip(pieces, ids)]
        return b"".join(ids)
