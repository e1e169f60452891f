"""SentencePiece encoding and decoding by a prefix table.

A text in which every space is U+2581 splits into units before a run of U+2581 (no vocabulary piece continues past
the end of a unit, so no merge crosses it), and units split at characters that no piece holds. For a unit, the table stores for each prefix
the last token of its encoding: it is the one token that ends there (an automaton over the vocabulary finds all of them)
and whose pair with the last token of the prefix before it encodes as just these two. Going back from the end recovers the ids.
Units that a batch of texts brings for the first time are encoded in sorted order, so that the rows of a prefix they share are worked out once.
Whether a pair is compatible comes from replaying the merges that make each piece; it is remembered for every pair met.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_rows

#: Units of a generation that a worker remembers, and pairs; two generations of units are kept, all pairs are forgotten beyond.
MEMORY, PAIRS = 400_000, 500_000
#: Moves of the automaton that a worker remembers. Units of texts that are encoded together, about.
MOVES, TOGETHER = 500_000, 400_000
SPACE = "▁"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + n]
            at += n


class _State(dict):
    """A state of the automaton that finds all pieces ending at each character: for each character met, the state that it leads to.

    A state is the longest end of what was read that begins a piece; .longest is the longest piece that ends it, of which PieceModel.shorter leads to the rest.
    Moves are worked out when first met, and remembered up to MOVES of them.
    """

    __slots__ = ("text", "longest", "shared")

    @classmethod
    def root(cls, model: PieceModel) -> _State:
        shared = {"ids": model.ids, "prefixes": {p[:k] for p in model.ids for k in range(1, len(p) + 1)}, "states": {}, "moves": 0}
        root = cls()
        root.text, root.longest, root.shared = "", -1, shared
        return root

    def __missing__(self, c: str) -> _State:
        shared = self.shared
        text = self.text + c
        while text not in shared["prefixes"]:
            text = text[1:]
        found = shared["states"].get(text)
        if found is None:
            found = shared["states"][text] = _State()
            found.text, found.shared = text, shared
            found.longest = next(shared["ids"][text[k:]] for k in range(len(text)) if text[k:] in shared["ids"])
        if shared["moves"] < MOVES:
            shared["moves"] += 1
            self[c] = found
        return found


class PieceModel:
    """A BPE vocabulary with byte fallback: pieces, scores, and which ids are ordinary pieces."""

    def __init__(self, pieces: list[str], scores: list[float], ordinary: list[bool], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.ids = {p: i for i, p in enumerate(pieces) if ordinary[i]}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece continues past a word; units would not be independent")
        self.known = {c for p in self.ids for c in p if c in self.ids}
        self.spaced, self.numbers = [p.replace(SPACE, " ") for p in pieces], [str(i) for i in range(len(pieces))]
        self.lengths = [len(p) for p in pieces]
        self.shorter = {i: next((self.ids[p[k:]] for k in range(1, len(p)) if p[k:] in self.ids), -1) for p, i in self.ids.items()}
        self.automaton = _State.root(self)
        self.start = len(pieces)  # stands for "no token before"
        self.byte_of = {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self._steps: dict[int, tuple | None] = {}
        self._pairs: dict[int, bool] = {}
        self.memory = _Memory(self)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """The model of a file. Raises ValueError where the file asks for what this encoder doesn't do: other algorithms than BPE with byte fallback, a normaliser, no space in front, user-defined or unused pieces."""
        with open(path, "rb") as f:
            found = list(_fields(f.read()))
        trainer, normalizer = ({k: v for part, v in found if part == which for k, v in _fields(v)} for which in (2, 3))
        listed = [dict(_fields(v)) for part, v in found if part == 1]
        kinds = [p.get(3, 1) for p in listed]
        wrong = {
            "not BPE": trainer.get(3, 1) != 2, "no byte fallback": not trainer.get(35), "space as suffix": trainer.get(24),
            "a normaliser": normalizer.get(2) or normalizer.get(6), "no space in front": not normalizer.get(3, 1),
            "extra spaces go": normalizer.get(4, 1), "spaces not escaped": not normalizer.get(5, 1), "user-defined pieces": 4 in kinds, "unused pieces": 5 in kinds,
        }
        if any(wrong.values()):
            raise ValueError(f"{path}: " + ", ".join(k for k, v in wrong.items() if v))
        names = [p[1].decode() for p in listed]
        at = {n: i for i, n in enumerate(names)}
        scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in listed]
        return cls(names, scores, [k == 1 for k in kinds], [at[f"<0x{b:02X}>"] for b in range(256)])

    def whole(self, i: int) -> bool:
        """Whether the piece encodes as itself."""
        return self.steps(i) is not None

    def steps(self, i: int) -> tuple[list[float], list[str], list[str]] | None:
        """The merges that make the piece from its characters, in order: scores, and the leftmost and rightmost part before each and at the end. None if plain merging doesn't make it."""
        if i not in self._steps:
            parts, score = list(self.pieces[i]), self.scores
            scores, left, right = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                found = [(s, -k) for k in range(len(parts) - 1) if (s := score.get(parts[k] + parts[k + 1])) is not None]
                if not found:
                    break
                s, k = max(found)
                parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
                scores.append(s)
                left.append(parts[0])
                right.append(parts[-1])
            self._steps[i] = (scores, left, right) if len(parts) == 1 else None
        return self._steps[i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two pieces, joined, encode as these two (and, where the first is the start, whether the second encodes as itself): replay the merges of both, best first, and see that none across the border comes first."""
        if (found := self._pairs.get(key := a << 32 | b)) is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self.whole(b) if a == self.start else self._apart(self.steps(a), self.steps(b))
        return found

    def _apart(self, a, b) -> bool:
        if a is None or b is None:
            return False
        (sa, _, ends), (sb, starts, _) = a, b
        i = j = 0
        none = float("-inf")
        while True:
            across = self.scores.get(ends[i] + starts[j])
            na, nb = sa[i] if i < len(sa) else none, sb[j] if j < len(sb) else none
            if across is not None and across > na and across >= nb:  # of equals, the leftmost goes first
                return False
            if i == len(sa) and j == len(sb):
                return True
            if na >= nb and i < len(sa):
                i += 1
            else:
                j += 1

    def encode_runs(self, runs: list[str]) -> Iterator[list[int]]:
        """Ids of each of sorted runs of known characters.

        last is the prefix table: for each prefix of the run, the id of its last token. Runs are sorted, so that a run keeps what it shares with the one before.
        """
        known, lengths, shorter = self._pairs.get, self.lengths, self.shorter
        last, states, previous = [self.start], [self.automaton], ""
        for run in runs:
            same = 0
            for a, b in zip(run, previous, strict=False):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], states[same + 1 :]
            state, previous = states[same], run
            for end in range(same + 1, len(run) + 1):
                state = state[run[end - 1]]
                i = state.longest
                while True:  # all pieces that end here, longest first, up to the one that fits
                    before = last[end - lengths[i]]
                    fits = known(before << 32 | i)
                    if fits is None:
                        fits = self.compatible(before, i)
                    if fits:
                        break
                    i = shorter[i]
                last.append(i)
                states.append(state)
            out, at = [], len(run)
            while at:  # ids are recovered from the end backwards
                out.append(i := last[at])
                at -= lengths[i]
            out.reverse()
            yield out

    def encode_units(self, units: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Units with their ids, in any order; characters that no piece holds become bytes."""
        known, plain, odd = self.known, [], {}
        for u in units:
            if known.issuperset(u):
                plain.append(u)
            else:
                odd[u] = ["".join(group) for _, group in itertools.groupby(u, known.__contains__)]
        plain.sort()
        yield from zip(plain, self.encode_runs(plain), strict=True)
        parts = sorted({p for parts in odd.values() for p in parts if p[0] in known})
        found = dict(zip(parts, self.encode_runs(parts), strict=True))
        for u, parts in odd.items():
            yield u, [i for p in parts for i in (found[p] if p[0] in known else [self.byte_ids[b] for b in p.encode()])]

    def decode_ids(self, ids: list[int]) -> str:
        """Pieces joined, runs of bytes as UTF-8 (what isn't becomes U+FFFD), U+2581 as a space. The first space of a text stays."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.spaced[i] for i in ids])
        out, run = [], b""
        for i in ids:
            if i in self.byte_of:
                run += self.byte_of[i]
            else:
                if run:
                    out.append(run.decode(errors="replace"))
                    run = b""
                out.append(self.spaced[i])
        return "".join(out) + run.decode(errors="replace")

    def units(self, text: str) -> list[str]:
        """The text's units."""
        if not text:
            return []
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " " or " \n" in text or "\n " in text or "\n" in self.known:
            return _UNITS.findall(SPACE + text.replace(" ", SPACE))
        keys: list[str] = []  # a line break is a unit of its own, as no piece holds it
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                keys.append("\n")
                if words[0]:
                    keys.append(words[0])
                keys += [SPACE + w for w in words[1:]]
            elif line:
                keys += [SPACE + w for w in words]
            else:
                keys.append(SPACE)
        return keys

    def encode_texts(self, texts: Iterable[str]) -> Iterator[tuple[str, str]]:
        """For each text: its ids joined by commas, and the text that these ids decode to, without the space that encoding puts in front."""
        held, n = [], 0
        for text in texts:
            held.append(self.units(text))
            n += len(held[-1])
            if n >= TOGETHER:
                yield from self.memory.texts(held)
                held, n = [], 0
        yield from self.memory.texts(held)


class _Memory(dict):
    """For each unit: its ids joined by commas, and what they decode to. Units met for the first time are encoded together.

    Short units are remembered in two generations: when the young one is full, it takes the place of the old one, and what is met again moves back.
    """

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model, self.old = model, {}

    def texts(self, held: list[list[str]]) -> Iterator[tuple[str, str]]:
        if len(self) > MEMORY:
            self.old = dict(self)
            self.clear()
        new = set().union(*held).difference(self)
        for u in new & self.old.keys():
            self[u] = self.old[u]
        for u, ids in self.model.encode_units(new.difference(self.old)):
            self[u] = ",".join([self.model.numbers[i] for i in ids]), self.model.decode_ids(ids)
        for units in held:
            cells = list(map(self.__getitem__, units))
            yield ",".join([c[0] for c in cells]), "".join([c[1] for c in cells])[1:]
        for u in new:
            if len(u) > 64:
                del self[u]


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a file, loaded once in a worker."""
    if path not in _models:
        _models[path] = PieceModel.load(path)
    return _models[path]


def piece_digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode each text of docs(doc_id, text), then decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    path: a SentencePiece model file that every executor has. Null and empty texts have no ids and decode to nothing.
    Repeated rows stay repeated. An empty table gives an empty result. Other columns are ignored. Nothing is shuffled.
    """

    def rows(b):
        m = model(path)
        n, ids_sha, decoded = [], [], []
        for ids, text in m.encode_texts([t or "" for t in b.column(1).to_pylist()]):
            n.append(ids.count(",") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            decoded.append(hashlib.sha256(text.encode()).hexdigest())
        return {"doc_id": b.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded}

    return by_rows(docs.select("doc_id", "text"), rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, an array of piece ids, for each row of docs(doc_id, text)."""

    def rows(b):
        m = model(path)
        ids = [list(map(int, x.split(","))) if x else [] for x, _ in m.encode_texts([t or "" for t in b.column(1).to_pylist()])]
        return {"doc_id": b.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}

    return by_rows(docs.select("doc_id", "text"), rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_column(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text for each row of ids(doc_id, ids). Null and empty arrays give an empty text."""

    def rows(b):
        m = model(path)
        return {"doc_id": b.column(0), "text": [m.decode_ids(x)[1:] if x else "" for x in b.column(1).to_pylist()]}

    return by_rows(ids.select("doc_id", "ids"), rows, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string")
