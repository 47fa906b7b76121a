"""SentencePiece encoding and decoding with a forward pass shared by common prefixes.

Distinct marked words (a word with the space marks before it) are sorted, which puts them in the order of a depth-first walk
through their trie; the forward state at each character stays on a stack, so a word starts where it leaves the one before.

For a unigram model the state is the best score and the last piece that reaches it (Viterbi). A merge model's segmentation is not
that of the best score, so there the state of a prefix is the last token of its own segmentation: the one token
that ends there and that, next to the last token of the prefix before it, comes out of merging their two texts unchanged.
A segmentation's beginning is itself the segmentation of that beginning, so one token is enough to go on from.
The pieces that end at a character are those of its node: the longest end of the prefix that begins a piece.

No piece of the supported models has a space mark after another character, so words never merge with each other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import Remembered, with_columns

MARK = "▁"
#: Bytes of words whose ids a worker remembers.
REMEMBERED = 90 << 20
#: Pairs of tokens whose verdict a worker remembers.
PAIRS = 500_000
#: Ways from a node to the next, besides those of the pieces, that a worker remembers.
WAYS = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


class _Found(dict):
    """Values by key, found on first use; beyond ``most`` it starts anew, which changes no result."""

    def __init__(self, find: Callable, most: int):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.find(key)
        return value


class _Node(dict):
    """The beginning of some piece; its items are the nodes by the next character. ``shorter`` is the node of its longest proper end
    that also begins a piece, ``ends`` the pieces (length, id) that it ends with, longest first. ``left`` counts down the further ways
    that all nodes together may remember."""

    __slots__ = ("ends", "left", "shorter")

    def after(self, char: str) -> _Node:
        node = self
        while char not in node and node.shorter is not None:
            node = node.shorter
        return node.get(char, node)

    def __missing__(self, char: str) -> _Node:
        node = self.after(char)
        if self.shorter is not None and self.left[0] > 0:
            self.left[0] -= 1
            self[char] = node
        return node


def _nodes(pieces: dict[str, int]) -> _Node:
    """The root of the nodes of ``pieces``."""
    left = [WAYS]

    def made(shorter: _Node | None) -> _Node:
        node = _Node()
        node.shorter, node.ends, node.left = shorter, (), left
        return node

    root = made(None)
    for piece, k in pieces.items():
        node = root
        for char in piece:
            node = node[char] if char in node else node.setdefault(char, made(root))
        node.ends = ((len(piece), k),)
    ahead = deque([root])
    while ahead:
        node = ahead.popleft()
        for char, below in node.items():
            below.shorter = root if node is root else node.shorter.after(char)
            below.ends += below.shorter.ends
            ahead.append(below)
    return root


class PieceModel:
    """Pieces, scores and types of a model file, and its segmentation.

    Types are those of the file format: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""

    def __init__(self, pieces: list[tuple[str, float, int]], merges: bool, prefix: bool = True, identity: bool = True, keep_spaces: bool = True):
        self.pieces, self.merges, self.prefix = pieces, merges, prefix
        if not identity or not keep_spaces:
            raise ValueError("only models that leave texts as they are, but for the space mark, are supported")
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4)}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark inside, so words are not independent")
        #: The score of a character without a piece, as the file format's library sets it.
        self.lowest = min((s for _, s, kind in pieces if kind == 1), default=0.0) - 10.0
        #: What every text's first word begins with; the keys of remembered words are without it.
        self.lead = MARK if prefix else ""
        self._root: _Node | None = None
        #: Characters of pieces that are no piece themselves, by a number beyond the ids: a merge model joins them like pieces.
        self._parts = dict(enumerate(sorted({c for p in self.ids for c in p} - self.ids.keys()), len(pieces))) if merges else {}
        self._shift = (len(pieces) + len(self._parts)).bit_length()
        self._fits = _Found(self._next_to, PAIRS)
        self._bytes = _Found(self._ids_of, PAIRS)
        self.known = Remembered(REMEMBERED)
        said = {6: lambda p: bytes([int(p[3:5], 16)]), 2: lambda p: " ⁇ ".encode(), 3: lambda p: b""}
        self.said = [said.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, _, kind in pieces]

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            data = f.read()
        pieces, merges, prefix, identity, keep = [], False, True, True, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]), own.get(3, 1)))
            elif number == 2:
                merges = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                own = dict(_fields(value))
                identity, prefix, keep = not own.get(2), bool(own.get(3, 1)), not own.get(4, 1)
        return cls(pieces, merges, prefix, identity, keep)

    # -- the parts of a text ------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """The marked words of a text, runs of marks with what follows up to the next mark, each without the ``lead`` at its front."""
        if not text:
            return []
        if self.prefix and "  " not in text and text[0] != " " and MARK not in text:
            return text.split(" ")
        out = (self.lead + text.replace(" ", MARK)).split(MARK)
        words, marks = ([out[0]] if out[0] else []), 0
        for w in out[1:]:
            marks += 1
            if w:
                words.append(MARK * marks + w)
                marks = 0
        return [w[len(self.lead) :] for w in words + ([MARK * marks] if marks else [])]

    def single(self, char: str) -> list[int]:
        """The ids of one character: its piece, its bytes, or unknown."""
        if char in self.ids:
            return [self.ids[char]]
        if self.bytes:
            return [self.bytes[b] for b in char.encode()]
        return [self.unknown]

    def _ids_of(self, k: int) -> bytes:
        """The ids of a state's token: its own, or those of a character without a piece."""
        char = chr(~k) if k < 0 else self._parts.get(k)
        return np.array([k] if char is None else self.single(char), "<i4").tobytes()

    # -- merge models ---------------------------------------------------------------------------
    def _merged(self, text: str) -> list[tuple[float, str, str]]:
        """Merging by the best score, leftmost first: before each merge its score, the first part and the last, then those of the end."""
        score, parts, steps = self._scores.get, list(text), []
        none = -np.inf
        ranks = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := max(ranks)) > none:
            steps.append((best, parts[0], parts[-1]))
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = score(parts[at] + parts[at + 1], none)
        return [*steps, (none, parts[0], parts[-1])]

    def _prepare(self) -> None:
        """The nodes of the pieces; of a merge model's, those that merging makes of their own text, with the steps it takes."""
        self._scores = {p: self.pieces[k][1] for p, k in self.ids.items()}
        whole = self.ids
        if self.merges:
            parts = self.ids | {c: k for k, c in self._parts.items()}
            self._steps = {k: steps for p, k in parts.items() if (steps := self._merged(p))[-1][1] == p}
            whole = {p: k for p, k in parts.items() if k in self._steps}
        self._root = _nodes(whole)

    def _next_to(self, pair: int) -> bool:
        """Whether merging the text of both tokens gives the two: each text takes its own steps, the better score first, then the
        left one, and the parts that meet are never merged in between."""
        left, right = self._steps[pair >> self._shift], self._steps[pair & (1 << self._shift) - 1]
        score, none, i, j = self._scores.get, -np.inf, 0, 0
        while True:
            (a, _, last), (b, first, _) = left[i], right[j]
            s = score(last + first, none)
            if s > a and s >= b:
                return False
            if a == b == none:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    # -- the walk ---------------------------------------------------------------------------------
    def segment_sorted(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each of the sorted distinct ``words`` (after the lead), sharing the states of common prefixes."""
        if self._root is None:
            self._prepare()
        # after the first i characters: the node, the last token's length and id (negative: a character without a piece), and the score
        nodes, size, last, score = [self._root], [0], [-1], [0.0]
        step, before, base, ids = self._merge_states if self.merges else self._best_states, "", len(self.lead), self._bytes
        step(self.lead, 0, nodes, size, last, score)
        for word in words:
            same = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                same += 1
            step(word[same:], base + same, nodes, size, last, score)
            out, end = [], base + len(word)
            while end:
                out.append(ids[last[end]])
                end -= size[end]
            yield b"".join(out[::-1])
            before = word

    def _merge_states(self, chars: str, end: int, nodes: list[_Node], size: list[int], last: list[int], score: list[float]) -> None:
        """The states after each of ``chars``, which follow the first ``end`` characters."""
        fits, shift, node = self._fits, self._shift, nodes[end]
        del nodes[end + 1 :], size[end + 1 :], last[end + 1 :]
        for char in chars:
            end += 1
            node = node[char]
            for n, k in node.ends:
                left = last[end - n]
                if left < 0 or n == 1 or fits[left << shift | k]:
                    break
            else:
                n, k = 1, ~ord(char)
            nodes.append(node)
            size.append(n)
            last.append(k)

    def _best_states(self, chars: str, end: int, nodes: list[_Node], size: list[int], last: list[int], score: list[float]) -> None:
        node = nodes[end]
        del nodes[end + 1 :], size[end + 1 :], last[end + 1 :], score[end + 1 :]
        for char in chars:
            end += 1
            node = node[char]
            best = (score[end - 1] + self.lowest, 1, ~ord(char))
            for n, k in node.ends:
                if (s := score[end - n] + self.pieces[k][1]) > best[0] or best[2] < 0 and n == 1:
                    best = (s, n, k)
            nodes.append(node)
            score.append(best[0])
            size.append(best[1])
            last.append(best[2])

    # -- texts -----------------------------------------------------------------------------------
    def learn(self, words: set[str]) -> None:
        """Segments those of the distinct words that are not remembered, in one walk."""
        self.known.room()
        new = sorted(words.difference(self.known))
        for word, ids in zip(new, self.segment_sorted(new), strict=True):
            self.known.keep(word, ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<i4") for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined, bytes as UTF-8, marks as spaces, without the mark put in front."""
        text = b"".join(map(self.said.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel.load(path)
    return _models[path]


def sentencepiece_encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``ids`` (array of int), and the text read back from them if ``decoded`` names a column.

    Defined cases: a text is read whole, however long, and a run without spaces is one word of it; a null text has null ids, an empty one none; characters without a piece become byte pieces; a space mark in the
    text is read as a space, as the model's own library does; repeated rows give equal ids; an empty table gives an empty table; an
    input column named as ``ids`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        own = piece_model(model)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            out: list[np.ndarray | None] = []
            for at in range(0, len(texts), 1000):
                part = texts[at : at + 1000]
                coded = own.encode([t or "" for t in part])
                out += [c if t is not None else None for t, c in zip(part, coded, strict=True)]
            del texts
            back = {} if decoded is None else {decoded: pa.array([None if o is None else own.decode(o) for o in out], pa.string())}
            flat = np.concatenate([o for o in out if o is not None] or [np.zeros(0, np.int32)])
            sizes = np.array([0 if o is None else len(o) for o in out], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            none = pa.array([o is None for o in out] or [], pa.bool_())
            del out
            yield {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=none if len(none) else None)} | back

    return with_columns(docs, run, f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else ""))


def sentencepiece_decode(coded: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``coded`` plus ``text``, the text of the ids (null for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        own = piece_model(model)
        for batch in batches:
            lists = batch.column(ids)
            flat, ends, none = lists.values.to_numpy(), lists.offsets.to_numpy(), lists.is_null().to_pylist()
            yield {text: pa.array([None if gone else own.decode(flat[a:b]) for gone, a, b in zip(none, ends, ends[1:], strict=False)], pa.string())}

    return with_columns(coded, run, f"`{text}` string")
