"""Byte-pair encoding of public vocabularies without running merges.

An encoder takes the longest token at each place (found by an Aho-Corasick automaton over the
vocabulary) and steps back to the next shorter token whenever a pair of neighbours could not stand
side by side in a merged text. Whether it could is a property of the pair alone, kept in a table.
The result is the exact merge result, in time linear in the text. Decoding copies bytes by an
offset table. Counting walks all tokens that end at each place, which gives the exact count of
every prefix.
"""

from __future__ import annotations

import json
import re
from array import array

import ahocorasick
import numpy as np
import regex

#: Fixed value: the pattern of the public byte-level vocabularies that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text in which a blank is no safe place to cut: white space before it, and after it or at the end.
_UNSAFE = re.compile(r"\s \s|\s $")
_BLANK, _BLANKS = regex.compile(r"\s"), regex.compile(r"\s+")
#: Chunks in one generation of a worker's memory; two generations take about 200 MB.
REMEMBERED = 500_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the files of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letter):
        letter[b] = chr(256 + n)
    return [letter[b] for b in range(256)]


class Codec:
    """Encoder, decoder and prefix counter for one byte-level BPE file (.json of the tokenizers format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.token[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, i in self.special.items():
            self.token[i] = s.encode()
        ident = {t: i for i, t in enumerate(self.token) if i not in self.special.values()}
        # rank of a token: when its merge is made; bytes come first
        self.pair: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(size)]
        self.rank = [-1] * size
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = (vocab[x] for x in (m if isinstance(m, list) else m.split(" ")))
            whole = ident[self.token[left] + self.token[right]]
            self.pair[left, right] = whole
            if self.rank[whole] < 0:
                self.rank[whole], self.halves[whole] = r, (left, right)
        self.find = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        for t, i in ident.items():
            if t:
                self.find.add_word(t.decode("latin-1"), i)
        self.find.make_automaton()
        # the longest token that is a proper prefix of a token: the next choice when stepping back
        self.shorter = [-1] * size
        for t, i in ident.items():
            for n in range(len(t) - 1, 0, -1):
                if (j := ident.get(t[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.sizes_list = [len(t) for t in self.token]
        self.sizes = np.array([len(t) for t in self.token], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.sizes)])
        self.pool = np.frombuffer(b"".join(self.token), np.uint8)
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN)
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    # -- pairs ------------------------------------------------------------------------------

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can be neighbours in a merged text."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[left, right] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        """Undo the later of the two tokens' merges again and again; a merge across the border that would come first rules the pair out."""
        rank, pair, halves = self.rank, self.pair, self.halves
        bound = len(rank) + len(pair)
        while True:
            across = pair.get((left, right))
            if across is not None and rank[across] < bound:
                return False
            # merges of equal rank go from left to right, so the left token's comes first
            if rank[left] > rank[right]:
                bound = rank[left]
                left = halves[left][1]
            elif rank[right] >= 0:
                bound = rank[right] + 1
                right = halves[right][0]
            else:
                return True

    # -- one piece --------------------------------------------------------------------------

    def encode_piece(self, piece: bytes) -> list[int]:
        """Exact tokens of one piece between cuts."""
        text, n = piece.decode("latin-1"), len(piece)
        # one run of the automaton: longest matches from left to right, right as they are in most pieces
        out = [t for _, t in self.find.iter_long(text)]
        fits, sound = self.fits, 1
        for pair in zip(out, out[1:], strict=False):
            known = fits.get(pair)
            if not (self.compatible(*pair) if known is None else known):
                break
            sound += 1
        if sound >= len(out):
            return out
        size, shorter, token = self.sizes_list, self.shorter, self.token
        step = out[sound]  # does not fit behind out[sound - 1]: from here on with steps back
        del out[sound:]
        at, dead = sum(size[t] for t in out), bytearray(n + 1)  # dead: no encoding goes on from here
        while at < n:
            end = at + len(token[step])
            if not dead[end] and (not out or self.compatible(out[-1], step)):
                out.append(step)
                at = end
                if at < n:
                    step = self._first(text, at)
                continue
            step = shorter[step]
            while step < 0:
                dead[at] = 1
                if not out:
                    raise ValueError("a byte has no token")
                last = out.pop()
                at -= size[last]
                step = shorter[last]
        return out

    def _first(self, text: str, at: int) -> int:
        """The longest token at a place: the automaton's leftmost longest match, which starts there as every byte is a token."""
        return next(self.find.iter_long(text, at))[1]

    def prefix_counts(self, piece: bytes) -> array:
        """Tokens of every prefix: entry i is the exact count for the first i bytes.

        Of the tokens that end at i, one fits behind the last token of its start; so each place needs
        one earlier entry, and no prefix is encoded again.
        """
        n = len(piece)
        count, last = array("i", bytes(4 * (n + 1))), [-1] * (n + 1)
        size, fits, compatible = self.sizes_list, self.fits, self.compatible
        for end, t in self.find.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size[t]
            if start:
                before = last[start]
                if before < 0:
                    continue
                known = fits.get((before, t))
                if not (compatible(before, t) if known is None else known):
                    continue
            last[end], count[end] = t, count[start] + 1
        return count

    # -- texts ------------------------------------------------------------------------------

    def parts(self, text: str) -> list[tuple[str, int]]:
        """The text between special strings (id -1), and these."""
        if self.apart is None or not self.apart.search(text):
            return [(text, -1)]
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += [(text[at : m.start()], -1), (m[0], self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], -1)]

    def chunks(self, text: str) -> list[str]:
        """The text in chunks that end where pieces end, so that a chunk's tokens depend on the chunk alone."""
        if not text:
            return []
        if _UNSAFE.search(text):
            return self.split.findall(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        place = np.arange(int(ends[-1])) + np.repeat(self.offset[ids] - ends + n, n)
        return self.pool[place].tobytes().decode("utf-8", "replace")


class _Memory(dict):
    """Results by chunk. A full generation becomes the old one, from which chunks in use come back."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def turn(self) -> None:
        if len(self) > REMEMBERED:
            self.old = self.copy()
            self.clear()

    def __missing__(self, chunk: str):
        got = self.old.get(chunk)
        if got is None:
            pieces = self.codec.pieces(chunk)
            got = self.join([self[p] for p in pieces]) if len(pieces) > 1 else self.piece(chunk)
        self[chunk] = got
        return got


class Encoder(_Memory):
    """Ids of chunks as little-endian bytes."""

    join = staticmethod(b"".join)

    def piece(self, piece: str) -> bytes:
        return array("I", self.codec.encode_piece(piece.encode())).tobytes()

    def __call__(self, text: str) -> bytes:
        self.turn()
        whole = []
        for part, special in self.codec.parts(text):
            if special >= 0:
                whole.append(special.to_bytes(4, "little"))
            else:
                whole += map(self.__getitem__, self.codec.chunks(part))
        return b"".join(whole)


class Counter(_Memory):
    """Token counts of chunks by prefix tables; and answers about prefixes of whole texts."""

    join = staticmethod(sum)

    def table(self, piece: str) -> array:
        return self.codec.prefix_counts(piece.encode())

    def piece(self, piece: str) -> int:
        return self.table(piece)[-1]

    def __call__(self, text: str) -> int:
        self.turn()
        return sum(1 if special >= 0 else sum(map(self.__getitem__, self.codec.chunks(part))) for part, special in self.codec.parts(text))

    def prefix_table(self, text: str) -> list[int]:
        """Tokens of text[:i] for every i up to the length, as encoding that prefix alone would give.

        A prefix ends within one piece: its count is that of the pieces before it and the piece's
        own table. White space before the end is one piece, as nothing follows it; a contraction that
        is cut short is split as the pattern splits it.
        """
        out, base, open_ = [0], 0, ""
        for part, special in self.codec.parts(text):
            if special < 0:
                open_ = part
                out += [base + c for c in self._plain_table(part)[1:]]
            else:  # cut short, the special string is ordinary text after what stands before it
                out += [base + c for c in self._plain_table(open_ + part)[len(open_) + 1 : -1]]
                base, open_ = base + self._plain_table(open_)[-1] + 1, ""
                out.append(base)
        return out

    def _plain_table(self, text: str) -> list[int]:
        out, base, at, run = [0], 0, 0, 0  # run: where the white space that ends at this place began
        blank, size = None, 0  # the table of that whole run of white space, and the bytes of it so far
        for p in self.codec.pieces(text):
            table, n = self.table(p), 0
            for i, c in enumerate(p, 1):
                n += len(c.encode())
                if _BLANK.match(c):
                    if blank is None:
                        blank, size = self.table(_BLANKS.match(text, run)[0]), 0
                    size += len(c.encode())
                    out.append(out[run] + blank[size])
                    continue
                run, blank = at + i, None
                out.append(base + (sum(self[q] for q in self.codec.pieces(p[:i])) if p[0] == "'" else table[n]))
            base += table[-1]
            at += len(p)
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most `budget` tokens."""
        table = self.prefix_table(text)
        return text[: max(i for i, c in enumerate(table) if c <= budget)]
