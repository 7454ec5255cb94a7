"""Byte-level BPE by prefix dynamic programming.

A BPE encoding is valid exactly when every two neighbouring tokens are: merging
their bytes alone gives the two back. So each prefix of a byte string has one
valid encoding, and it is enough to store its last token: among the tokens that
end a prefix only one fits the stored last token of what stands before it.
The table grows by exact appends, and after an edit only the entries from the
edit on are made again, until they agree with the old ones.

Defined cases: null text counts as empty; an empty text has no tokens and the
hash of no bytes; texts are encoded whole in time linear in their length;
repeated rows are encoded each; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts

CACHE = 300_000
RARE_SPACE = re.compile("[\t\r\v\f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 bytes and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Remembered:
    """A bounded memo: what was not asked for during the last CACHE new entries is forgotten."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def __call__(self, key: str) -> bytes:
        if (v := self.young.get(key)) is None:
            if (v := self.old.get(key)) is None:
                v = self.make(key)
            if len(key) < 64:
                if len(self.young) >= CACHE:
                    self.young, self.old = {}, self.young
                self.young[key] = v
        return v

    def all(self, keys: list[str]) -> list[bytes]:
        found = list(map(self.young.get, keys))
        if None in found:
            found = [self(k) if v is None else v for k, v in zip(keys, found, strict=True)]
        return found


class PrefixTable:
    """The unique last token of each prefix of a byte string."""

    def __init__(self, codec: "Codec", data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", [None]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Lengthen the string; what stood before stays as it is."""
        begin = len(self.data)
        self.data += data
        self.last += [None] * len(data)
        for i in range(begin + 1, len(self.data) + 1):
            self.last[i] = self.codec.last_token(self.data, i, self.last)

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Replace bytes start to end by data; returns how many entries were made again."""
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        n = len(self.data)
        self.last = old[: start + 1] + [None] * (n - start)
        same = made = 0
        for i in range(start + 1, n + 1):
            self.last[i] = self.codec.last_token(self.data, i, self.last)
            made += 1
            j = i - shift
            same = same + 1 if j > end and old[j] == self.last[i] else 0
            if same >= self.codec.longest:  # no later entry can see further back
                self.last[i + 1 :] = old[j + 1 :]
                break
        return made

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(t := self.last[i])
            i -= len(self.codec.bytes_of[t])
        return out[::-1]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.endings = dict.fromkeys((b[i:] for b in ranks for i in range(1, len(b))), -1) | ranks  # -1: only the end of tokens
        self.split: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        white = r"\p{White_Space}"  # \s as the library that the ranks were made for has it
        self.pattern = regex.compile(pattern.replace(r"[^\s", rf"[^{white}").replace(r"\S", rf"[^{white}]").replace(r"\s", f"[{white}]"))
        self.uneven = regex.compile(rf" [{white}]|[{white}] | \Z")
        self.pieces = Remembered(self._piece)
        self.after_space = Remembered(self._after_space)

    def merged(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """Plain merging, lowest rank first, of ranks less than below; for a token's bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _alone(self, t: int) -> bool:
        if (ok := self.whole.get(t)) is None:
            b = self.bytes_of[t]
            ok = self.whole[t] = self.merged(b) == [b]
        return ok

    def _halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge made t; None for a single byte."""
        if (found := self.split.get(t, 0)) == 0:
            b = self.bytes_of[t]
            parts = self.merged(b, below=t)
            found = self.split[t] = None if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[b[len(parts[0]) :]])
        return found

    def _fit(self, t: int, u: int) -> bool:
        """Whether t and u stay apart: undo their merges, latest first; the two tokens that
        touch must never have been able to merge before the merge that was undone last."""
        if len(self.fits) >= 4 * CACHE:
            self.fits.clear()
        key, ok, before = t << 20 | u, self._alone(t) and self._alone(u), 1 << 60
        a, b = t, u
        while ok:
            if self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60) < before:
                ok = False
                break
            ha, hb = self._halves(a), self._halves(b)
            if ha is None and hb is None:
                break
            if hb is None or (ha is not None and a > b):
                before, a = a, ha[1]  # of equal merges the left one comes first
            else:
                before, b = b + 1, hb[0]
        self.fits[key] = ok
        return ok

    def last_token(self, data: bytes, i: int, last: list) -> int:
        """The token that ends the valid encoding of data[:i], given those of all shorter prefixes."""
        find, fits = self.endings.get, self.fits
        for start in range(i - 1, -1, -1):
            t = find(data[start:i])
            if t is None:
                break
            if t >= 0:
                if not start:
                    if self._alone(t):
                        return t
                elif (ok := fits.get(last[start] << 20 | t)) or (ok is None and self._fit(last[start], t)):
                    return t
        raise ValueError(f"no token ends the prefix of {i} bytes")

    def piece(self, data: bytes) -> list[int]:
        t = self.ranks.get(data)
        return [t] if t is not None else PrefixTable(self, data).tokens()

    def _piece(self, text: str) -> bytes:
        return array("I", self.piece(text.encode("utf-8"))).tobytes()

    def _direct(self, text: str) -> bytes:
        return b"".join(map(self.pieces, self.pattern.findall(text)))

    def _after_space(self, text: str) -> bytes:
        if text.isalpha():
            return self.pieces(" " + text)
        if text[-1:] in (",", ".") and text[:-1].isalpha():
            return self.pieces(" " + text[:-1]) + self.pieces(text[-1])
        return self._direct(" " + text)

    def encode(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers in the machine's order (little-endian on all supported ones).

        A lone space before a word always begins a new piece, so what lies
        between such spaces is encoded by itself and remembered; texts with
        other runs of white space go through the pattern whole.
        """
        if "  " in text or " \n" in text or "\n " in text or text.endswith(" ") or (RARE_SPACE.search(text) and self.uneven.search(text)):
            return self._direct(text)
        head, *rest = text.split(" ")
        return self._direct(head) + b"".join(self.after_space.all(rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


_codecs: dict[tuple[str, str], Codec] = {}


def codec_for(path: str, pattern: str) -> Codec:
    """One codec in each Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, hash of ids and of the decoded bytes (with_ids: also the ids) of each row of docs; no shuffle.

    path: a vocabulary file that every executor has, such as an installed package's.
    """

    def run(batches):
        c = codec_for(path, pattern)
        for b in batches:
            ids = [c.encode(t) for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array([list(array("I", x)) for x in ids], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return texts(docs).mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))
