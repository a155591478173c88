"""Byte-level BPE encoding by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end the prefix's
encoding. The encoder stores that last token per prefix: a token ``t`` ending
at byte ``i`` is the last one if the token before it (the stored last token of
the prefix it leaves) and ``t`` may stand side by side. Two tokens may stand
side by side if no merge across their border comes first in merge order. An automaton over the tokens gives those that end at each byte.
Stored last tokens make appends exact (only the new bytes are worked on) and
let an edit keep everything before it, and everything behind it from where a
longest token's length of last tokens agrees with the old ones.

``TextPrefixes`` holds them for each pre-token of a whole text, which can be appended
to and edited; ``encode_documents`` encodes whole columns and remembers pieces.

Null texts count as empty: no ids, the digest of no bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, only, rows_batch, table, texts_of

#: Distinct pieces and pairs of tokens that a worker remembers, in two generations: when the
#: younger is half of them, it becomes the older, from which what is met again comes back.
CACHED_PIECES, CACHED_PAIRS = 500_000, 300_000
#: Longer pieces are not remembered, which bounds that memory in bytes.
LONGEST_REMEMBERED = 64
DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_file(name: str = DEFAULT_RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PrefixEncoder:
    """Encoder of single pieces over one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._parts: dict[bytes, tuple[bytes, bytes] | None | bool] = {}
        self._right: dict[bytes, list] = {}
        self._left: dict[bytes, list] = {}
        self._beside: dict[tuple[bytes, bytes], bool] = {}
        self._beside_older: dict[tuple[bytes, bytes], bool] = {}
        self._ends = ahocorasick.Automaton()
        for b in ranks:
            if self.parts(b) is not False:
                self._ends.add_word(b.decode("latin-1"), (b, len(b)))
        self._ends.make_automaton()

    @classmethod
    def from_file(cls, path: str) -> PrefixEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(r) for a, r in map(bytes.split, f)})

    def parts(self, token: bytes):
        """The two tokens whose merge makes ``token``; None for a byte; False where merging never makes it."""
        found = self._parts.get(token, 0)
        if found == 0:
            if len(token) == 1:
                found = None
            else:
                at = [token[i : i + 1] for i in range(len(token))]
                own = self.ranks[token]
                while len(at) > 2:
                    best, where = own, -1
                    for i in range(len(at) - 1):
                        r = self.ranks.get(at[i] + at[i + 1], own)
                        if r < best:
                            best, where = r, i
                    if where < 0:
                        break
                    at[where : where + 2] = [at[where] + at[where + 1]]
                found = (at[0], at[1]) if len(at) == 2 else False
            self._parts[token] = found
        return found

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The tokens at one border of ``token`` while it is built, with the rank of the merge that ends each."""
        memory = self._left if side == 0 else self._right
        found = memory.get(token)
        if found is None:
            found, now, until = [], token, float("inf")
            while now:
                found.append((now, until))
                p = self.parts(now)
                until, now = self.ranks[now], p[side] if p else None
            memory[token] = found
        return found

    def beside(self, a: bytes, b: bytes) -> bool:
        """Whether encoding ``a + b`` gives ``a`` and ``b``."""
        key = (a, b)
        found = self._beside.get(key)
        if found is None:
            found = self._beside_older.get(key)
        if found is None:
            found = True
            ranks = self.ranks
            for x, x_until in self._spine(a, 1):
                for y, y_until in self._spine(b, 0):
                    r = ranks.get(x + y)
                    # equal ranks: the leftmost merge goes first, so x's own merge wins a tie and y's loses it
                    if r is not None and r < x_until and r <= y_until:
                        found = False
                        break
                if not found:
                    break
        if len(self._beside) >= CACHED_PAIRS // 2:
            self._beside_older = dict(self._beside)
            self._beside.clear()
        self._beside[key] = found
        return found

    def extend(self, data: bytes, last: list[bytes], start: int = 0) -> list[bytes]:
        """Last tokens of all prefixes of ``data``; ``last[:start]`` is taken as it stands."""
        del last[start:]
        memory, beside, push = self._beside, self.beside, last.append
        from_ = max(0, start - self.longest)  # a token that ends behind start begins here or later
        done = start
        for end, (t, length) in self._ends.iter(data[from_:].decode("latin-1")):
            end += from_
            if end < done:
                continue
            if end > done:
                break
            if length > end:
                push(t)
                done += 1
                continue
            before = last[end - length]
            ok = memory.get((before, t))
            if ok or ok is None and beside(before, t):
                push(t)
                done += 1
        if done < len(data):
            raise ValueError(f"no valid token ends at byte {done + 1}")
        return last

    def unroll(self, last: list[bytes]) -> list[int]:
        ids, i = [], len(last)
        while i:
            t = last[i - 1]
            ids.append(self.ranks[t])
            i -= len(t)
        ids.reverse()
        return ids

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token."""
        r = self.ranks.get(piece)
        return [r] if r is not None else self.unroll(self.extend(piece, []))


class Prefixes:
    """The encoding of one piece that can be appended to and edited; ``worked`` counts the prefixes found anew."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data = encoder, data
        self.last = encoder.extend(data, [])
        self.worked = len(data)

    def append(self, more: bytes) -> None:
        self.edit(len(self.data), len(self.data), more)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes start to end: last tokens before ``start`` stay, as do those after the place where they agree again."""
        old, longest = self.last, self.encoder.longest
        self.data = self.data[:start] + new + self.data[end:]
        border, shift = start + len(new), start + len(new) - end
        last, at = old[:start], border
        while True:
            self.encoder.extend(self.data[:at], last, len(last))
            # where a longest token's length of last tokens behind the edit agrees, all later ones do
            if at - border >= longest and last[at - longest :] == old[at - shift - longest : at - shift]:
                last += old[at - shift :]
                break
            if at == len(self.data):
                break
            at = min(len(self.data), at + longest)
        self.worked += at - start
        self.last = last

    def ids(self) -> list[int]:
        r = self.encoder.ranks.get(self.data)
        return [r] if r is not None else self.unrolled()

    def unrolled(self) -> list[int]:
        return self.encoder.unroll(self.last)


def safe_start(text: str, start: int) -> int:
    """A position so far before an edit at ``start`` that no pre-token ending there can change.

    Back over white space, over the last visible run and over four
    characters more: a choice looks past its own end by no more than
    a run of white space or a contraction of three characters.
    """
    p = start
    while p and text[p - 1].isspace():
        p -= 1
    while p and not text[p - 1].isspace():
        p -= 1
    while p and text[p - 1].isspace():
        p -= 1
    return max(0, p - 4)


#: A pre-token that ends so many characters before the end of what is known of a text stands whatever follows.
LOOKAHEAD = 2


def resplit(texts: list[str], sizes: Sequence[int], first: int, begin: int, start: int, end: int, new: str, pattern) -> tuple[int, int, list[str]]:
    """What an edit of characters start to end does to a text held in consecutive stretches that end with pre-tokens.

    ``first`` is the stretch that holds ``start`` and ``begin`` where it begins; ``sizes`` are the stretches' lengths.
    Returns the first stretch that is replaced, the one behind the last, and the new pre-tokens.
    """
    held = texts[first][: start - begin]
    step = 1
    while not (p := safe_start(held, start - begin)) and first:
        back = max(0, first - step)
        held = "".join(texts[back:first]) + held
        begin -= sum(sizes[back:first])
        first, step = back, step * 2
    while first < len(texts) - 1 and sizes[first] <= p:  # the stretch that holds this position
        p -= sizes[first]
        held, begin = held[sizes[first] :], begin + sizes[first]
        first += 1
    behind, known = first, begin
    while behind < len(texts) and (known < end or behind == first):
        known += sizes[behind]
        behind += 1
    old = "".join(texts[first:behind])
    changed = old[: start - begin] + new + old[end - begin :]
    more = 1
    while True:
        reach = min(len(texts), behind + more)
        text = changed + "".join(texts[behind:reach])
        border, at, pieces = len(changed), behind, []
        for m in pattern.finditer(text):
            pieces.append(m.group())
            e = m.end()
            while border < e and at < reach:
                border += sizes[at]
                at += 1
            if e == border and (reach == len(texts) or e + LOOKAHEAD <= len(text)):
                return first, at, pieces
        if reach == len(texts):
            return first, reach, pieces
        more *= 2


class TextPrefixes:
    """The last tokens of each pre-token of a whole text, which can be appended to and edited."""

    def __init__(self, encoder: PrefixEncoder, pattern, text: str = ""):
        self.encoder, self.pattern = encoder, pattern
        self.pieces = pattern.findall(text)
        self.prefixes = [Prefixes(encoder, p.encode("utf-8", "surrogatepass")) for p in self.pieces]

    def append(self, text: str) -> None:
        n = sum(map(len, self.pieces))
        self.edit(n, n, text)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end (clamped to the text). Pre-tokens that stay keep their last tokens; the changed ones go on from theirs."""
        sizes = list(map(len, self.pieces))
        n = sum(sizes)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        if not self.pieces:
            self.__init__(self.encoder, self.pattern, new)
            return
        first = begin = 0
        while first < len(sizes) - 1 and begin + sizes[first] <= start:
            begin += sizes[first]
            first += 1
        first, behind, pieces = resplit(self.pieces, sizes, first, begin, start, end, new, self.pattern)
        old, made = self.prefixes[first:behind], []
        stay = 0
        while stay < min(len(old), len(pieces)) and self.pieces[first + stay] == pieces[stay]:
            stay += 1
        tail = 0
        while tail < min(len(old), len(pieces)) - stay and self.pieces[behind - 1 - tail] == pieces[-1 - tail]:
            tail += 1
        for k in range(stay, len(pieces) - tail):
            data = pieces[k].encode("utf-8", "surrogatepass")
            if k < len(old) - tail:  # goes on from the old pre-token in its place
                p = old[k]
                same = next((i for i, (a, b) in enumerate(zip(p.data, data)) if a != b), min(len(p.data), len(data)))  # noqa: B905
                most = min(len(p.data), len(data)) - same
                back = next((i for i in range(most) if p.data[-1 - i] != data[-1 - i]), most)
                p.edit(same, len(p.data) - back, data[same : len(data) - back])
            else:
                p = Prefixes(self.encoder, data)
            made.append(p)
        self.prefixes[first:behind] = old[:stay] + made + old[len(old) - tail :]
        self.pieces[first:behind] = pieces

    def ids(self) -> list[int]:
        return [i for p in self.prefixes for i in p.ids()]


class PieceMemory(dict):
    """What ``of`` makes of a piece's ids, filled on demand and bounded."""

    most = CACHED_PIECES

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def of(self, ids: list[int]):
        raise NotImplementedError

    def __missing__(self, piece: str):
        found = self.older.get(piece)
        if found is None:
            found = self.of(self.encoder.encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) > LONGEST_REMEMBERED:
            return found
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class PieceIds(PieceMemory):
    """Piece to its ids as little-endian unsigned 32-bit integers."""

    def of(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> tuple[PrefixEncoder, PieceIds]:
    encoder = PrefixEncoder.from_file(path)
    return encoder, PieceIds(encoder)


@lru_cache(maxsize=4)
def compiled(pattern: str):
    return regex.compile(pattern)


def encode_text(text: str, pieces: PieceIds, pattern) -> bytes:
    return b"".join(map(pieces.__getitem__, pattern.findall(text)))


def decode_ids(ids: bytes, encoder: PrefixEncoder) -> bytes:
    return b"".join(map(encoder.bytes_of.__getitem__, memoryview(ids).cast("I")))


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", ranks_file: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, ids_sha256, decoded_sha256, and the ids (binary) where kept.

    No shuffle; a worker holds one batch of texts and a bounded memory of pieces.
    Nulls encode as empty texts, repeated rows give repeated rows, an empty table gives none.
    """
    path, pat = ranks_file or tokenizer_file(), pattern or piece_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = worker_encoder(path)
        find = compiled(pat)
        for batch in batches:
            keys, n, digest, decoded, kept = batch.column(0), [], [], [], []
            for t in texts_of(batch.column(1)):
                ids = encode_text(t.as_py(), pieces, find)
                n.append(len(ids) // 4)
                digest.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(ids, encoder)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            out = rows_batch(["n_tokens", "ids_sha256", "decoded_sha256"], [n, digest, decoded], [pa.int64(), pa.string(), pa.string()])
            columns, names = [keys, *out.columns], [key, *out.schema.names]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(only(docs, key, text), run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)
