"""Exact token ids from the tokenizers library, each distinct word encoded once per worker.

Both public vocabularies used here cut a text into pre-tokens before any merge.  A text
is therefore cut where no pre-token crosses, distinct parts go through
``Tokenizer.encode_batch_fast`` and the ids are joined.

"byte": a pre-token holds a blank only at its start or consists of blanks, so a text is
cut before each blank and line end that follows no other blank, and between a letter and
a stop before a blank.  The cuts of a batch are made on its bytes at once and its parts
numbered by Arrow.  "word": a run of letters never shares a pre-token with what follows
it, so a text is cut at its letter runs.

Texts where a cut could fall inside a pre-token (several blanks in a row; for "word" an
apostrophe or characters that are not composed; an added token such as an end mark) are
encoded whole.
"""

from __future__ import annotations

import functools
import os
import re
import string
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

CACHE_PARTS = 600_000  # parts whose ids a worker remembers
_BLANK, _LETTER, _STOP = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)  # of a byte
for _k, _bytes in ((_BLANK, b" \n"), (_LETTER, string.ascii_letters.encode()), (_STOP, b".,;:!?")):
    _CLASS[list(_bytes)] = _k
_BLANK_END = np.zeros((256, 256), bool)  # last two bytes that any kind of blank may have
for _c in filter(str.isspace, map(chr, range(0x3001))):
    _BLANK_END[_c.encode()[-2] if len(_c.encode()) > 1 else slice(None), _c.encode()[-1]] = True


def _unknown(text: str) -> bool:
    """Has it characters that Python's tables do not know?  Newer tables may call them letters."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


class Encoder:
    """``kind`` is "byte" (a word holds its leading blank) or "word" (blanks vanish, case is folded).

    As the library does it, the name of a special token in a text becomes that token's id.
    With ``special_as_text`` it is encoded like other text, so that no text forges a control id.
    """

    def __init__(self, path: str, kind: str, special_as_text: bool = False, cache_parts: int = CACHE_PARTS):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.cache_parts = kind, cache_parts
        # Words and the gaps between them (word).  A gap of a single blank has no ids and is passed over.
        self.parts = re.compile(r"[^\W\d_]+|[\W\d_]{2,}|[\d_]|[^\w ]").findall
        self.cache: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}  # parts of the time before, not met since
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)  # opens a part (byte) or ends a word (word)
        for piece, i in vocab.items():
            self.edge[i] = piece.startswith(("Ġ", "Ċ")) if kind == "byte" else piece.endswith("</w>")

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _plain(self, text: str) -> bool:
        if any(t in text for t in self.added):
            return False
        if self.kind == "byte":
            return not (text[:1].isspace() or "  " in text or "\n\n" in text)
        if "'" in text or _unknown(text):
            return False
        return text.isascii() or ("Σ" not in text and unicodedata.is_normalized("NFC", text))

    def _learn(self, parts: list[str]) -> None:
        """Encode new parts.  Most are encoded many to a string and cut at their edge ids."""
        joined, single = [], []
        for p in parts:
            plain = p[0] in " \n" and not p[-1].isspace() if self.kind == "byte" else p.isalpha()
            (joined if plain else single).append(p)
        blocks = [joined[at:at + 512] for at in range(0, len(joined), 512)]
        between = "" if self.kind == "byte" else " "
        found = self.tokenizer.encode_batch_fast([between.join(b) for b in blocks], add_special_tokens=False)
        for block, e in zip(blocks, found):
            ids = np.array(e.ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            cuts = np.append(edges, len(ids)) if self.kind == "byte" else np.append(0, edges + 1)
            if len(edges) == len(block) and cuts[0] == 0 and cuts[-1] == len(ids):
                raw, cuts = ids.tobytes(), (cuts * 4).tolist()
                self.cache.update(zip(block, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                single.extend(block)
        for p, ids in zip(single, self._whole(single)):
            # \w also takes numerals that are neither letters nor decimal digits: no cut beside them (word)
            odd = self.kind == "word" and any(c.isalnum() and not (c.isalpha() or c.isdecimal()) for c in p)
            self.cache[p] = None if odd else ids

    def _turn(self) -> None:
        """A full half of the cache replaces the other, so that frequent parts stay."""
        if len(self.cache) > self.cache_parts // 2:
            self.cache, self.older = {}, self.cache

    def _know(self, met: set[str]) -> None:
        """Have all these parts in the cache."""
        self._turn()
        new = met.difference(self.cache)
        fresh = new.difference(self.older)
        for p in new - fresh:
            self.cache[p] = self.older.pop(p)
        self._learn(list(fresh))

    def _ids(self, met: list[str]) -> list[bytes]:
        """Ids of distinct parts (byte)."""
        self._turn()
        found = list(map(self.cache.get, met))
        holes = [k for k, ids in enumerate(found) if ids is None]
        new = [met[k] for k in holes]
        old = list(map(self.older.pop, new, repeat(None)))
        self.cache.update((p, ids) for p, ids in zip(new, old) if ids is not None)
        self._learn([p for p, ids in zip(new, old) if ids is None])
        for k, ids in zip(holes, map(self.cache.__getitem__, new)):
            found[k] = ids
        return found

    def _cut_words(self, texts: list[str]) -> list[bytes | None]:
        """Ids of plain texts; None for a text that has to be encoded whole."""
        cut, met = [], set()
        for text in texts:
            parts = self.parts(text.lower())
            met.update(parts)
            cut.append(parts)
        self._know(met)
        get = self.cache.__getitem__
        out: list[bytes | None] = []
        for parts in cut:
            try:
                out.append(b"".join(map(get, parts)))
            except TypeError:  # a part with no cut beside it
                out.append(None)
        return out

    def _cut_bytes(self, texts: list[str]) -> list[bytes | None]:
        """As :meth:`_cut_words`.  A line end in front of each text, whose id is dropped, opens its first part."""
        raw = [t.encode() for t in texts]
        data = b"\n" + b"\n".join(raw) + b"\n"
        chars = np.frombuffer(data, np.uint8)
        of = _CLASS[chars]
        cut = of == _BLANK
        cut[1:-1] |= (of[:-2] == _LETTER) & (of[1:-1] == _STOP) & cut[2:]
        cuts = np.flatnonzero(cut)
        tops = np.searchsorted(cuts, np.cumsum([0, *[len(r) + 1 for r in raw]]))  # first part of each text
        parts = pa.Array.from_buffers(
            pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        met, number = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        ids = pa.array(self._ids(met), pa.large_binary()).take(parts.indices)
        _, starts, body = ids.buffers()
        spans = np.frombuffer(starts, np.int64)[tops].tolist()
        body = memoryview(body)
        out: list[bytes | None] = [bytes(body[a + 4:b]) for a, b in zip(spans, spans[1:])]
        # A part that ends in a blank shares it with the part behind it: no cut there.
        ends = _BLANK_END[chars[cuts[1:] - 2], chars[cuts[1:] - 1]]
        ends[tops[1:] - 1] = False
        odd = [k for k in np.unique(number[ends]).tolist() if met[k][-1].isspace()]
        ends &= np.isin(number, odd)
        for k in np.unique(np.searchsorted(tops, np.flatnonzero(ends), "right") - 1).tolist():
            out[k] = None
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        plain = [k for k, text in enumerate(texts) if self._plain(text)]
        if plain:
            cut = self._cut_bytes if self.kind == "byte" else self._cut_words
            for k, ids in zip(plain, cut([texts[k] for k in plain])):
                out[k] = ids
        whole = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(whole, self._whole([texts[k] for k in whole])):
            out[k] = ids
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str, kind: str, special_as_text: bool = False, cache_parts: int = CACHE_PARTS) -> Encoder:
    """One encoder per worker process, so that its cache outlives a batch.

    One thread: Spark runs a task on each core already.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, kind, special_as_text, cache_parts)
