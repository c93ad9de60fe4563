"""Token counts by a compiled finite-state transducer.

A piece vocabulary with byte fallback encodes a text by merging neighbouring symbols, best piece
first. The encoding of a prefix ends in exactly one piece, and a piece u may follow the encoding of
q exactly if merging (last piece of q) + u by itself gives those two pieces back. So a scan from
left to right needs to remember only, for each earlier position from which a piece may still reach
past the present one, the last piece there and how many pieces more or fewer it had. That is a
finite state; each transition (state, character) is annotated with the change in the number of
tokens. Transitions are compiled when first met and stay compiled in the Python worker.

A space after another character leads to the start state whatever the state before, so texts are
cut there: the state map of such a piece of text, a word, is constant, and its count is kept once it
has been composed. Words that aren't known yet step through the transducer side by side as numpy
vectors. A word longer than LONG_WORD (text without spaces) is cut into chunks of one size. A chunk's
state map takes each state that may enter it (those that runs begun at each of several places before
the chunk lead to) to a state and a number of tokens; maps are composed by a parallel scan (pointer
doubling). Where a state leaves a chunk that the next map doesn't have, the map gets it, and the scan
is repeated, so that the count is exact for any text.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, read_table, slices, span_hashes

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a word that is stepped as a whole, and in a chunk of a longer one.
LONG_WORD, CHUNK_CHARS = 96, 384
#: How far before a chunk the runs begin that guess the states that enter it.
WARM = range(17, 33)
#: Characters whose words are looked up and stepped side by side.
BLOCK_CHARS = 1_000_000
#: Compiled transitions kept by a worker; beyond that it starts again from none. Words whose counts
#: are kept; beyond that, those not met lately are forgotten. Results stay the same.
MAX_TRANSITIONS, MAX_WORDS = 1_200_000, 2_000_000


class CountingTransducer:
    """(state, code point) -> (state, change in tokens), compiled on demand from a vocabulary."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.prefixes = {p[:n] for p in pieces for n in range(1, len(p))}
        self.follows: dict[tuple[str, str], bool] = {}
        self.histories: dict[str, list[tuple[str, str, float]] | None] = {}
        self.words = WordCounts()
        self.reset()

    def reset(self) -> None:
        #: A state: earlier positions as (text since then, last piece there, tokens there minus tokens here).
        self.states: list[tuple] = [(("", "", 0),)]
        self.known: dict[tuple, int] = {self.states[0]: 0}
        self.bits = 16
        self.table = np.full((1 << self.bits, 2), -1, np.int64)
        self.filled = 0

    def history(self, piece: str) -> list[tuple[str, str, float]] | None:
        """How merging a piece by itself goes, best neighbours first, leftmost of equals: its first and
        last symbol and the score of the next merge, before each merge and at the end. None if
        something else comes out."""
        if piece not in self.histories:
            parts, steps = list(piece), []
            while True:
                best = max(((self.pieces.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(-np.inf, 0))
                steps.append((parts[0], parts[-1], best[0]))
                if best[0] == -np.inf:
                    break
                i = -best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.histories[piece] = steps if len(parts) == 1 else None
        return self.histories[piece]

    def may_follow(self, last: str, piece: str) -> bool:
        """Whether merging last + piece gives these two: both are merged as if alone, the better merge
        first, unless a merge across the border is better than both at some time."""
        key = (last, piece)
        if key not in self.follows:
            if len(self.follows) > MAX_TRANSITIONS:
                self.follows.clear()
            self.follows[key] = self._stay_apart(last, piece)
        return self.follows[key]

    def _stay_apart(self, last: str, piece: str) -> bool:
        right = self.history(piece)
        left = self.history(last) if last else [("", "", -np.inf)]
        if right is None or left is None:
            return False
        i = j = 0
        while True:
            (_, a, next_a), (b, _, next_b) = left[i], right[j]
            across = self.pieces.get(a + b, -np.inf) if a else -np.inf
            if across > next_a and across >= next_b:
                return False
            if next_a == next_b == -np.inf:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1

    def step(self, state: int, char: str) -> tuple[int, int]:
        alive = self.states[state]
        if char == SPACE and alive[0][0] and not alive[0][0].startswith(SPACE * len(alive[0][0])):
            alive = self.states[0]  # no piece has a space after other characters: words are separate
        if char not in self.pieces:  # byte fallback: a token for each byte, and no merge across it
            return 0, len(char.encode("utf-8", "surrogatepass"))
        found = next((since + char, n) for since, last, n in alive if since + char in self.pieces and self.may_follow(last, since + char))
        change = found[1] + 1
        after = [(sys.intern(since + char), last, n - change) for since, last, n in alive if since + char in self.prefixes]
        after = tuple([*after, ("", sys.intern(found[0]), 0)])
        number = self.known.get(after)
        if number is None:
            number = self.known[after] = len(self.states)
            self.states.append(after)
        return number, change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if (self.filled + len(keys)) * 3 > len(self.table):
            old = self.table[self.table[:, 0] >= 0]
            while (self.filled + len(keys)) * 3 > 1 << self.bits:
                self.bits += 1
            self.table = np.full((1 << self.bits, 2), -1, np.int64)
            keys, values, self.filled = np.concatenate([old[:, 0], keys]), np.concatenate([old[:, 1], values]), 0
        mask = len(self.table) - 1
        for k, s, v in zip(keys.tolist(), self._slots(keys).tolist(), values.tolist()):
            while self.table[s, 0] >= 0:
                s = (s + 1) & mask
            self.table[s] = k, v
        self.filled += len(keys)

    def step_all(self, states: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of many runs: their next states and changes in tokens."""
        keys = (states << 21) | chars
        slots, mask = self._slots(keys), len(self.table) - 1
        got = self.table[slots]
        found = got[:, 0] == keys
        if not found.all():
            todo = np.flatnonzero(~found)
            while len(todo):
                probe = self.table[slots[todo]]
                hit, gone = probe[:, 0] == keys[todo], probe[:, 0] < 0
                got[todo[hit]] = probe[hit]
                if gone.any():
                    new = np.unique(keys[todo[gone]])
                    made = [self.step(k >> 21, chr(k & 0x1FFFFF)) for k in new.tolist()]
                    values = np.array([(s << 8) | (d + 128) for s, d in made], np.int64)
                    self._put(new, values)
                    at = todo[gone]
                    got[at, 1] = values[np.searchsorted(new, keys[at])]
                    slots, mask = self._slots(keys), len(self.table) - 1
                    todo = todo[~hit & ~gone]
                else:
                    todo = todo[~hit]
                    slots[todo] = (slots[todo] + 1) & mask
        return got[:, 1] >> 8, (got[:, 1] & 255) - 128

    def run(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps codes[start : start + size] from a state each, side by side: states and tokens."""
        order = np.argsort(-size, kind="stable")
        start, state = start[order], state[order].astype(np.int64)
        longest = int(size.max(initial=0))
        alive = np.searchsorted(-size[order], -np.arange(longest), side="left")  # runs longer than i
        tokens = np.zeros(len(start), np.int64)
        for i in range(longest):
            n = alive[i]
            state[:n], change = self.step_all(state[:n], codes[start[:n] + i])
            tokens[:n] += change
        out = np.empty((2, len(start)), np.int64)
        out[:, order] = state, tokens
        return out[0], out[1]

    def composed(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of long words, by composing the state maps of their chunks."""
        per = -(-size // CHUNK_CHARS)
        word = np.repeat(np.arange(len(size)), per)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(per) - per, per)
        begin = start[word] + nth * CHUNK_CHARS
        length = np.minimum(size[word] - nth * CHUNK_CHARS, CHUNK_CHARS)
        # Which states may enter a chunk: 0 at a word's first; else where runs from places before it lead.
        later = np.flatnonzero(nth > 0)
        chunk = np.repeat(later, len(WARM))
        back = np.tile(np.array(WARM, np.int64), len(later))
        guess, _ = self.run(codes, begin[chunk] - back, back, np.zeros(len(chunk), np.int64))
        first = np.flatnonzero(nth == 0)
        todo = np.unique(np.stack([np.concatenate([first, chunk]), np.concatenate([np.zeros(len(first), np.int64), guess])], 1), axis=0)
        nodes, made = np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)  # (chunk, state in), (state out, tokens)
        while len(todo):
            done = np.stack(self.run(codes, begin[todo[:, 0]], length[todo[:, 0]], todo[:, 1]), 1)
            nodes, made = np.concatenate([nodes, todo]), np.concatenate([made, done])
            order = np.lexsort((nodes[:, 1], nodes[:, 0]))
            nodes, made = nodes[order], made[order]
            goes_on = np.flatnonzero(np.append(nth[1:] > 0, False)[nodes[:, 0]])  # not the last chunk of a word
            wanted = np.stack([nodes[goes_on, 0] + 1, made[goes_on, 0]], 1)
            place, asked = _places(nodes, wanted)
            todo = np.unique(wanted[~asked], axis=0)
        # The scan: each node points to the one that its state goes into; the length of a pointer doubles.
        total = np.append(made[:, 1], 0)
        to = np.full(len(nodes) + 1, len(nodes))
        to[goes_on] = place
        while (to != len(nodes)).any():
            total, to = total + total[to], to[to]
        return total[_places(nodes, np.stack([first, np.zeros(len(first), np.int64)], 1))[0]]

    def count(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; codes holds their code points one after the other."""
        n = len(codes)
        if not n:
            return np.zeros(len(offsets) - 1, np.int64)
        space = codes == ord(SPACE)
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, n))
        tokens = np.empty(len(start), np.int64)
        block = (np.cumsum(size) - size) // BLOCK_CHARS
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(start)]
        for a, b in zip(edges, edges[1:]):
            tokens[a:b] = self._block(codes[start[a] : start[b - 1] + size[b - 1]], start[a:b] - start[a], size[a:b])
        sums = np.concatenate([[0], np.cumsum(tokens)])
        at = np.searchsorted(start, offsets)
        return sums[at[1:]] - sums[at[:-1]]

    def _block(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.filled > MAX_TRANSITIONS:
            self.reset()
        tokens = np.empty(len(start), np.int64)
        long = size > LONG_WORD
        if long.any():
            tokens[long] = self.composed(codes, start[long], size[long])
        start, size = start[~long], size[~long]
        mixed = codes.astype(np.uint64)
        one = span_hashes(mixed, start, start + size)
        two = span_hashes(mix64(mixed), start, start + size)
        _, some, which = np.unique(one, return_index=True, return_inverse=True)
        one_word = two == two[some][which]  # two words with one hash: never seen, but they are told apart
        known, counts = self.words.find(one[some], two[some])
        new = some[~known]
        counts[~known] = self.run(codes, start[new], size[new], np.zeros(len(new), np.int64))[1]
        self.words.add(one[new], two[new], counts[~known])
        got = counts[which]
        if not one_word.all():
            odd = np.flatnonzero(~one_word)
            got[odd] = self.run(codes, start[odd], size[odd], np.zeros(len(odd), np.int64))[1]
        tokens[~long] = got
        return tokens


def _places(nodes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in nodes (sorted rows of two numbers) the wanted rows are, and whether they are there."""
    both = lambda x: (x[:, 0].astype(np.int64) << 31) | x[:, 1]
    keys, want = both(nodes), both(wanted)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return at, keys[at] == want


class WordCounts:
    """Tokens of words by two 64-bit hashes."""

    def __init__(self):
        self.one, self.two, self.n, self.met = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool)

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are known, and their counts."""
        if not len(self.one):
            return np.zeros(len(one), bool), np.zeros(len(one), np.int64)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        known = (self.one[at] == one) & (self.two[at] == two)
        self.met[at[known]] = True
        return known, self.n[at].astype(np.int64)

    def add(self, one: np.ndarray, two: np.ndarray, n: np.ndarray) -> None:
        if len(self.one) + len(one) > MAX_WORDS:
            keep = self.met if self.met.sum() < MAX_WORDS // 2 else np.zeros(len(self.met), bool)
            self.one, self.two, self.n = self.one[keep], self.two[keep], self.n[keep]
            self.met = np.zeros(len(self.one), bool)
        at = np.searchsorted(self.one, one)
        fresh = np.ones(len(one), bool)
        if len(self.one):
            fresh = self.one[np.minimum(at, len(self.one) - 1)] != one
        at = at[fresh]
        self.one, self.two = np.insert(self.one, at, one[fresh]), np.insert(self.two, at, two[fresh])
        self.n, self.met = np.insert(self.n, at, n[fresh]), np.insert(self.met, at, True)


_COMPILED: dict[str, CountingTransducer] = {}


def transducer(path: str) -> CountingTransducer:
    """The transducer of a vocabulary file; kept by the Python worker from task to task."""
    if path not in _COMPILED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if bad := [p for p in pieces if SPACE in p.lstrip(SPACE)]:
            raise ValueError(f"pieces with a space inside aren't supported: {bad[:3]}")
        _COMPILED[path] = CountingTransducer(pieces)
    return _COMPILED[path]


def count_texts(machine: CountingTransducer, texts: list[str]) -> np.ndarray:
    """Tokens of each text as the vocabulary's library counts them: a space goes before each text
    that isn't empty, and a space is a piece's character."""
    ready = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    codes = np.frombuffer("".join(ready).encode("utf-32-le"), np.uint32).astype(np.int64)
    offsets = np.zeros(len(ready) + 1, np.int64)
    np.cumsum([len(t) for t in ready], out=offsets[1:])
    return machine.count(codes, offsets)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """n_bytes, n_tokens and over_limit of each whole text; no shuffle, one row for each row of docs.

    model_path: a piece vocabulary with byte fallback (default: the public piece_bpe_32k.model, looked
    up on each executor). Null and empty texts have no bytes and no tokens. Repeated rows and null
    ids come back as they are. Other columns of docs are left out. Texts of any length are counted
    whole, in chunks.
    """

    def run(batches):
        import public_tokenizers

        machine = transducer(model_path or public_tokenizers.path(MODEL))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                counts = count_texts(machine, pc.fill_null(texts, "").to_pylist())
                size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), size, pa.array(counts), pa.array(counts > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return bounded_batches(source).mapInArrow(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
