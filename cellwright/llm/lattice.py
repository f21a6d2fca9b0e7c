"""SentencePiece encoding and decoding over a lattice of pieces.

A text gets a leading word mark, spaces become word marks, and the result is cut where no piece reaches across:
before a word mark that follows another character, and between two characters that no piece holds side by side.
For the distinct words so found, every substring of bounded length is looked up in the piece table; the matches, by
word, are the edges of its lattice. A fold over them gives the path: the highest sum of scores from left to right for a
unigram model (Viterbi), and for a byte-pair model, whose scores are ranks and not probabilities, the merges in the
order of their scores, since the highest sum is a different segmentation there. Characters without a piece become bytes.

The piece table has a fixed size and goes to every task; words are looked up where the text is, so nothing is shuffled.
The distinct words of BYTES of text are folded together, in rounds that join one pair of neighbours in each. A null text has no pieces. Ids outside the table are an error;
bytes that are no UTF-8 decode to U+FFFD, each by itself.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cellwright.llm.tables import column, own_columns

MARK = "▁"
ROWS = 256  # handled at a time
BYTES = 4 << 20  # of texts that are cut into words together
TOGETHER = 64  # characters; longer parts of words are folded one by one
NO_EDGE = 1 << 30
SHORT = 256  # up to this length a list is faster than a heap
_NONE = float("-inf")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """The piece table: id and score of each ordinary piece, ids of the bytes, and how to print every id."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    shown: list[str | int]
    merges: bool
    longest: int
    pairs: frozenset[str] = frozenset()

    @cached_property
    def symbols(self) -> dict[str, int]:
        """A number for each piece, and for each character that occurs in one."""
        return {x: k for k, x in enumerate(dict.fromkeys(chain(self.ids, *self.ids)))}

    @cached_property
    def of_code(self) -> np.ndarray:
        """The symbol of each code point; those of no piece share a number that joins with nothing."""
        out = np.full(0x110000, len(self.symbols), np.int64)
        for x, k in self.symbols.items():
            if len(x) == 1:
                out[ord(x)] = k
        return out

    @cached_property
    def held(self) -> np.ndarray:
        """The pairs of neighbouring code points that some piece holds."""
        return np.sort(np.array([ord(x[0]) << 32 | ord(x[1]) for x in self.pairs], np.int64))

    @cached_property
    def joins(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The edges between neighbours: the two symbols as a key, in order; the place of the edge by its score; the symbol it makes. The last key is of no pair."""
        number = self.symbols
        place = {x: k for k, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = sorted(
            (number[x[:k]] * (len(number) + 1) + number[x[k:]], place[score], number[x])
            for x, score in self.scores.items() for k in range(1, len(x)) if x[:k] in number and x[k:] in number)
        keys, places, made = np.array([*found, ((len(number) + 1) ** 2, NO_EDGE, 0)], np.int64).T.copy()
        return keys, places, made

    @cached_property
    def spellings(self) -> list[list[int]]:
        return [self.spelled(x) for x in self.symbols]

    def fold(self, word: str) -> list[int]:
        return merged(word, self) if self.merges else best_path(word, self)

    def edges_between(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the edge between neighbours, NO_EDGE without one, and the symbol it makes."""
        keys, places, made = self.joins
        wanted = left * (len(self.symbols) + 1) + right
        at = found_in(keys, wanted)
        return np.where(at < 0, NO_EDGE, places[at]), made[at]

    def join_all(self, symbols: np.ndarray, last: np.ndarray, put: np.ndarray, out: np.ndarray) -> None:
        """As `joined`, for many parts in rounds of one join each. `last` marks where parts end; out[put] gets the symbols that are left, -1 where one went into its neighbour."""
        edge, made = self.edges_between(symbols[:-1], symbols[1:])
        edge, made = np.append(edge, NO_EDGE), np.append(made, 0)
        edge[last] = NO_EDGE
        while len(symbols):
            heads = np.flatnonzero(np.append(True, last[:-1]))
            best = np.minimum.reduceat(edge << 32 | np.arange(len(edge)), heads)
            live = best >> 32 != NO_EDGE
            at = best[live] & 0xFFFFFFFF
            symbols[at], last[at] = made[at], last[at + 1]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            out[put[gone]] = -1
            going = np.repeat(live, np.diff(np.append(heads, len(symbols))))
            out[put[~going]] = symbols[~going]
            keep = going & ~gone
            at = np.cumsum(keep)[at] - 1
            symbols, last, put, edge, made = symbols[keep], last[keep], put[keep], edge[keep], made[keep]
            edge[at] = NO_EDGE
            before = at[at > 0] - 1
            again = np.concatenate((at[~last[at]], before[~last[before]]))
            edge[again], made[again] = self.edges_between(symbols[again], symbols[again + 1])

    def fold_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, which have blanks for word marks, one after the other, and how many each has."""
        text = b"".join(words.to_pylist()).decode().replace(" ", MARK)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = pc.utf8_length(words.cast(pa.large_string())).to_numpy()
        heads = np.cumsum(lengths) - lengths
        begins = np.append(True, found_in(self.held, codes[:-1] << 32 | codes[1:]) < 0)[:len(codes)]
        begins[heads] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(codes)))
        symbols, spelled = self.of_code[codes], list(self.spellings)
        out, alone = symbols.copy(), (size > 1) & ((size > TOGETHER) | (not self.merges))
        several = np.repeat((size > 1) & ~alone, size)
        put = np.flatnonzero(several)
        self.join_all(symbols[put], np.append(begins[1:], True)[:len(codes)][put], put, out)
        out[np.repeat(alone, size)] = -1
        known: dict[str, int] = {}

        def number(part: str, ids: Callable[[str], list[int]]) -> int:
            if part not in known:
                known[part] = len(spelled)
                spelled.append(ids(part))
            return known[part]

        for a in np.flatnonzero(out == len(self.symbols)).tolist():
            out[a] = number(text[a], self.spelled)
        for a, n in zip(start[alone].tolist(), size[alone].tolist(), strict=True):
            out[a] = number(text[a:a + n], self.fold)
        left = out >= 0
        ids, counts = laid_out(spelled, out[left])
        ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(left)))[np.append(heads, len(codes))]]
        return ids, np.diff(ends)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; every distinct word of theirs is folded once."""
        words, first = cut(texts)
        coded = words.dictionary_encode()
        folded = [self.fold_all(coded.dictionary.slice(at, n)) for at, n in bounded(coded.dictionary)]
        table = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in folded)])
        sizes = np.concatenate([np.zeros(0, np.int64), *(sizes for _, sizes in folded)])
        of = coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[of])))
        return pa.ListArray.from_arrays(pa.array(ends[first], pa.int32()), pa.array(gathered(table, sizes, of), pa.int32()))

    def decode_all(self, encoded: pa.ListArray) -> list[str]:
        """As `decode`, for many lists of ids."""
        ids = encoded.values
        shown = self.raw.take(ids)
        ends = np.frombuffer(shown.buffers()[1], np.int64, len(ids) + 1)[encoded.offsets.to_numpy()].tolist()
        data, out = memoryview(shown.buffers()[2] or b""), []
        for row, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            try:
                out.append(self.unmarked(str(data[a:b], "utf-8")))
            except UnicodeDecodeError:
                out.append(self.decode(encoded[row].as_py()))
        return out

    @cached_property
    def raw(self) -> pa.Array:
        """The bytes that every id stands for, a blank instead of the word mark."""
        return pa.array([bytes([x]) if isinstance(x, int) else x.replace(MARK, " ").encode() for x in self.shown], pa.large_binary())

    def spelled(self, part: str) -> list[int]:
        """The piece, or the bytes of a character without one."""
        found = self.ids.get(part)
        return [found] if found is not None else [self.byte_ids[b] for b in part.encode()]

    def decode(self, ids: list[int]) -> str:
        shown = list(map(self.shown.__getitem__, ids))
        try:
            return self.unmarked("".join(shown))
        except TypeError:  # bytes beyond ASCII among the pieces
            pass
        out, raw = [], bytearray()
        for i in ids:
            shown = self.shown[i]
            if isinstance(shown, int):
                raw.append(shown)
                continue
            out.append(_lenient(raw))
            raw = bytearray()
            out.append(shown)
        out.append(_lenient(raw))
        return self.unmarked("".join(out))

    @staticmethod
    def unmarked(text: str) -> str:
        text = text.replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other and with blanks for word marks, and where those of each text begin and the last end."""
    parts = [b" " + t.replace(MARK, " ").encode() if t else b"" for t in texts.to_pylist()]
    data, ends = b"".join(parts), np.concatenate(([0], np.cumsum([*map(len, parts)], dtype=np.int64)))
    blank = np.frombuffer(data, np.uint8) == ord(" ")
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[ends[:-1][np.diff(ends) > 0]] = True
    at = np.append(np.flatnonzero(begins), len(data))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]), np.searchsorted(at, ends)


def bounded(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and length of runs of BYTES, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right")))
        yield at, to - at
        at = to


def found_in(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key stands among the ordered ones, -1 without."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


def gathered(table: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The rows `of` a table of rows of these sizes, one after the other."""
    counts = sizes[of]
    ends = np.cumsum(counts)
    return table[np.repeat((np.cumsum(sizes) - sizes)[of] - ends + counts, counts) + np.arange(counts.sum())]


def laid_out(lists: list[list[int]], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return gathered(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes, of), sizes[of]


def _lenient(raw: bytes) -> str:
    try:
        return bytes(raw).decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for width in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[at:at + width]).decode())
                    at += width
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids: dict[str, int] = {}
    scores: dict[str, float] = {}
    byte_ids, shown = [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:-1], 16)
            byte_ids[value] = i
            shown.append(value if value > 127 else chr(value))  # an ASCII byte is its character wherever it stands
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            shown.append(" ⁇ " if model.is_unknown(i) else "")
        else:
            ids[piece], scores[piece] = i, model.get_score(i)
            shown.append(piece)
    return table(ids, scores, byte_ids, shown)


def table(ids: dict[str, int], scores: dict[str, float], byte_ids: list[int], shown: list[str | int]) -> Pieces:
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a piece reaches from one word into the next")
    ranked = all(s == int(s) and s <= 0 for s in scores.values())
    pairs = frozenset(p[k:k + 2] for p in ids for k in range(len(p) - 1))
    return Pieces(ids, scores, byte_ids, shown, ranked, max(map(len, ids), default=1), pairs)


def edges(word: str, p: Pieces) -> dict[tuple[int, int], float]:
    """The lattice of a word: substrings of bounded length that are pieces, with their scores."""
    found = {}
    for start in range(len(word)):
        for end in range(start + 1, min(len(word), start + p.longest) + 1):
            score = p.scores.get(word[start:end])
            if score is not None:
                found[start, end] = score
    return found


def joined(word: str, p: Pieces) -> list[int]:
    """As `merged`, for short words: the fold over a plain list of neighbours."""
    score, parts = p.scores.get, list(word)
    edge = [score(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while edge and (best := max(edge)) != _NONE:
        at = edge.index(best)
        parts[at] += parts.pop(at + 1)
        del edge[at]
        if at < len(edge):
            edge[at] = score(parts[at] + parts[at + 1], _NONE)
        if at:
            edge[at - 1] = score(parts[at - 1] + parts[at], _NONE)
    return [i for part in parts for i in p.spelled(part)]


def merged(word: str, p: Pieces) -> list[int]:
    """Joins neighbours along the edges, the best edge first and the leftmost of equals, until none is left."""
    n, scores = len(word), p.scores
    if n <= SHORT:
        return joined(word, p)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(-s, k, k + 2) for k in range(n - 1) if (s := scores.get(word[k:k + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, start, end = heapq.heappop(waiting)
        middle = after[start]
        if middle <= start or middle >= n or after[middle] != end:
            continue
        after[start], after[middle] = end, -1
        if end < n:
            before[end] = start
            if (s := scores.get(word[start:after[end]])) is not None:
                heapq.heappush(waiting, (-s, start, after[end]))
        if start > 0 and (s := scores.get(word[before[start]:end])) is not None:
            heapq.heappush(waiting, (-s, before[start], end))
    out, at = [], 0
    while at < n:
        out += p.spelled(word[at:after[at]])
        at = after[at]
    return out


def best_path(word: str, p: Pieces) -> list[int]:
    """The path of the highest score; of equals the one whose last piece is longest. A character without a piece costs ten more than the worst."""
    lattice, worst = edges(word, p), min(p.scores.values(), default=0.0) - 10
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        ways = [(best[start][0] + lattice[start, end], -start) for start in range(max(0, end - p.longest), end) if (start, end) in lattice]
        if (end - 1, end) not in lattice:
            ways.append((best[end - 1][0] + worst, -(end - 1)))
        score, start = max(ways)
        best.append((score, -start))
    cuts, end = [], len(word)
    while end:
        cuts.append((best[end][1], end))
        end = best[end][1]
    return [i for a, b in reversed(cuts) for i in p.spelled(word[a:b])]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of each whole text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for at, n in bounded(column(batch, "text")):
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), p.encode_all(column(part, "text"))], ["doc_id", "ids"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the text they spell."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [p.decode(ids or []) for ids in column(part, "ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return own_columns(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def summary(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, the number of pieces, their ids, and the digest of the text that the ids decode to; encoded and decoded in one pass."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for at, n in bounded(column(batch, "text")):
                part = batch.slice(at, n)
                ids = p.encode_all(column(part, "text"))
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in p.decode_all(ids)]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pc.list_value_length(ids).cast(pa.int64()), ids, pa.array(digests, pa.string())],
                    ["doc_id", "n_pieces", "ids", "decoded_sha256"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string")
