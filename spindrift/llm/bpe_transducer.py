"""Byte-pair encoding compiled, state by state, into a deterministic transducer.

A correct BPE result has two properties: every part of a correct token sequence
is itself correct, and a sequence is correct exactly when each adjacent pair of
tokens is.  The encoding of a prefix is therefore fixed by its last token
and by the encoding of what stands before that token.  A state keeps, for each start
position from which some vocabulary entry could still grow, the last token
before that position and the token count relative to now.  Only finitely many such states
exist; they are made when first met and kept.  A transition
carries the change of the token count and the last token at the new position.

The last byte of a word is a symbol of its own (byte + 256), because the
vocabulary marks word ends.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import regex

CHUNK_CHARS = 1 << 15
MEMO_WORDS = 300_000
MEMO_CHARS = 64
#: Compiled states, and pairs of tokens whose fit is known, at most; beyond, both are forgotten and made anew.
MAX_STATES, MAX_PAIRS = 300_000, 300_000


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return out | {chr(256 + n): b for n, b in enumerate(rest)}


class Transducer:
    """Counts and ids of words for a BPE vocabulary with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix, byte_of = model["end_of_word_suffix"], _byte_of_char()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}

        def parts(token: str) -> tuple[bytes, bool]:
            final = token.endswith(suffix) and token != suffix
            return bytes(byte_of[c] for c in (token[: -len(suffix)] if final else token)), final

        self.text: dict[int, tuple[bytes, bool]] = {i: parts(t) for t, i in vocab.items() if t not in self.special}
        self.id_of = {v: k for k, v in self.text.items()}
        self.inner = {b: i for (b, final), i in self.id_of.items() if not final}
        self.closing = {b: i for (b, final), i in self.id_of.items() if final}
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.prefixes = {b[:n] for b, _ in self.text.values() for n in range(1, len(b) + 1)}
        self.made_of = {}
        for (a, b), (rank, whole) in self.merge.items():
            self.made_of.setdefault(whole, (a, b, rank))
        # at most two entries, and one, for each token of the vocabulary
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.alone: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the compiled states and the pairs; they are made anew on demand."""
        self.pairs: dict[tuple[int, int], bool] = {}
        start = (b"", ((0, -1, 0),))
        self.states, self.number, self.moves = [start], {start: 0}, [{}]

    def merged(self, symbols: list[int]) -> list[int]:
        """Plain BPE by repeated lowest-rank merge."""
        merge = self.merge
        while len(symbols) > 1:
            best = min((merge[p] + (n,) for n, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merge), default=None)
            if best is None:
                break
            symbols[best[2] : best[2] + 2] = [best[1]]
        return symbols

    def spelled(self, token: int) -> list[int]:
        text, final = self.text[token]
        return [self.id_of[text[n : n + 1], final and n == len(text) - 1] for n in range(len(text))]

    def stands_alone(self, token: int) -> bool:
        if (known := self.alone.get(token)) is None:
            known = self.alone[token] = self.merged(self.spelled(token)) == [token]
        return known

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one side of a token while it is being merged, each with the rank at which it goes into a larger one."""
        if (known := self.edges.get((token, side))) is None:
            known, at, until = [], token, float("inf")
            while True:
                known.append((at, until))
                if (made := self.made_of.get(at)) is None:
                    break
                at, until = made[side], made[2]
            self.edges[token, side] = known
        return known

    def fit(self, left: int, right: int) -> bool:
        """May right follow left?  Not if some merge across the border comes first.

        Of equal merges the leftmost comes first.
        """
        if (known := self.pairs.get((left, right))) is None:
            merge, known = self.merge, True
            for a, until_a in self.edge(left, 1):
                for b, until_b in self.edge(right, 0):
                    if (m := merge.get((a, b))) is not None and m[0] < until_a and m[0] <= until_b:
                        known = False
            self.pairs[left, right] = known
        return known

    def compile(self, state: int, symbol: int) -> tuple[int, int, int, int]:
        """The transition (next state, change of count, last token, its length).

        Where states or pairs have reached their bound all are forgotten but this state; the next state's number is one of those made since.
        """
        if len(self.states) >= MAX_STATES or len(self.pairs) >= MAX_PAIRS:
            here = self.states[state]
            self.reset()
            if (state := self.number.setdefault(here, 1)) == 1:
                self.states.append(here)
                self.moves.append({})
        seen, starts = self.states[state]
        final = symbol > 255
        seen += bytes((symbol & 255,))
        tokens, size = self.closing if final else self.inner, len(seen) - 1
        for back, last, count in starts:  # longest start first
            token = tokens.get(seen[size - back :])
            if token is not None and self.stands_alone(token) and (last < 0 or self.fit(last, token)):
                break
        else:
            raise ValueError(f"no token for byte {symbol & 255}")
        change = count + 1
        if final:
            move = (0, change, token, back + 1)
        else:
            kept = [(b + 1, t, c - change) for b, t, c in starts if seen[size - b :] in self.prefixes]
            key = (seen[size + 1 - kept[0][0] :] if kept else b"", (*kept, (0, token, 0)))
            if (target := self.number.get(key)) is None:
                target = self.number[key] = len(self.states)
                self.states.append(key)
                self.moves.append({})
            move = (target, change, token, back + 1)
        self.moves[state][symbol] = move
        return move

    def count(self, word: bytes) -> int:
        moves, state, total = self.moves, 0, 0
        for byte in word[:-1]:
            if (move := moves[state].get(byte)) is None:
                move = self.compile(state, byte)
                moves = self.moves
            state = move[0]
            total += move[1]
        symbol = word[-1] + 256
        return total + (moves[state].get(symbol) or self.compile(state, symbol))[1]

    def ids(self, word: bytes) -> list[int]:
        moves, state, path = self.moves, 0, []
        for byte in word[:-1]:
            if (move := moves[state].get(byte)) is None:
                move = self.compile(state, byte)
                moves = self.moves
            state = move[0]
            path.append(move)
        symbol = word[-1] + 256
        path.append(moves[state].get(symbol) or self.compile(state, symbol))
        out, at = [], len(path)
        while at:
            _, _, token, length = path[at - 1]
            out.append(token)
            at -= length
        out.reverse()
        return out


UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SPACE = regex.compile(r"\p{White_Space}")
#: What str.split() takes for white space although it has not that property.
SEPARATORS = regex.compile("[\x1c-\x1f]")
WIDE = regex.compile(r"\p{White_Space}+")


def normal(text: str) -> str:
    """NFC and lower case letter by letter (a capital sigma never becomes a final one)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


class Counts(dict):
    """Token counts of stretches without white space; a missing unit is run through the transducer.

    At most two generations of MEMO_WORDS entries are kept; what is used again
    moves from the old one into the new one.
    """

    def __init__(self, path: str):
        super().__init__()
        self.old: dict = {}
        self.open(path)

    def open(self, path: str) -> None:
        self.machine = machine(path)

    def __missing__(self, stretch: str):
        if (value := self.old.get(stretch)) is None:
            units = UNIT.findall(stretch)
            value = self.unit(units[0]) if len(units) == 1 else self.joined([self[u] for u in units])
        if len(stretch) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.old = dict(self)
                self.clear()
            self[stretch] = value
        return value

    def unit(self, unit: str) -> int:
        return self.machine.count(unit.encode())

    joined = staticmethod(sum)


class Codes(Counts):
    """Token ids of stretches, as the tokenizer library gives them, as little-endian unsigned 32-bit bytes."""

    def open(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in _byte_of_char().items()}

    def unit(self, unit: str) -> bytes:
        spelled = unit.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    joined = staticmethod(b"".join)


@lru_cache(maxsize=4)
def machine(path: str) -> Transducer:
    return Transducer(path)


@lru_cache(maxsize=4)
def counts(path: str) -> Counts:
    return Counts(path)


@lru_cache(maxsize=4)
def codes(path: str) -> Codes:
    return Codes(path)


@lru_cache(maxsize=4)
def special_pattern(path: str) -> regex.Pattern:
    return regex.compile("|".join(regex.escape(s) for s in sorted(machine(path).special, key=len, reverse=True)) or r"(?!)")


def stretches(text: str) -> list[str]:
    """The parts between white space."""
    return [x for x in WIDE.split(text) if x] if SEPARATORS.search(text) else text.split()


# A chunk's state map tells, for the state in which the chunk is entered, its tokens and the state in which it is
# left.  White space puts the scanner and the transducer into their start state whatever came before, so the map of a
# chunk that holds some is constant behind the first white space: (head, tokens, tail), with tokens
# counting what lies between the first and the last white space.  What stands before that is not tabled for each
# of the states: it is kept as text, and run when composition tells the state.  A chunk without
# white space is (text,): it only lengthens what is open.


def chunk_map(text: str, memo: Counts) -> tuple:
    parts = stretches(text)
    if not parts:
        return ("", 0, "") if text else ("",)
    opens, closes = not SPACE.match(text[0]), not SPACE.match(text[-1])
    if len(parts) == 1 and opens and closes:
        return (text,)
    head = parts.pop(0) if opens else ""
    tail = parts.pop() if closes else ""
    return head, sum(map(memo.__getitem__, parts)), tail


def compose(a: tuple, b: tuple, memo: Counts) -> tuple:
    """The map of a followed by b; associative."""
    if len(a) == 1:
        return (a[0] + b[0], *b[1:])
    if len(b) == 1:
        return a[0], a[1], a[2] + b[0]
    return a[0], a[1] + b[1] + memo[a[2] + b[0]], b[2]


def scan(maps: list[tuple], memo: Counts) -> tuple:
    """Composes neighbours pairwise, level by level (the up-sweep of a prefix scan)."""
    while len(maps) > 1:
        maps = [compose(*maps[n : n + 2], memo) if n + 1 < len(maps) else maps[n] for n in range(0, len(maps), 2)]
    return maps[0]


def tokens_between(text: str, memo: Counts, chunk_chars: int = CHUNK_CHARS) -> int:
    """Tokens of a text without special strings."""
    text = normal(text)
    whole = scan([chunk_map(text[n : n + chunk_chars], memo) for n in range(0, len(text), chunk_chars)] or [("",)], memo)
    ends = whole if len(whole) == 1 else (whole[0], whole[2])
    return sum(map(memo.__getitem__, ends)) + (whole[1] if len(whole) > 1 else 0)


def token_count(text: str | None, path: str, chunk_chars: int = CHUNK_CHARS) -> int:
    """Tokens of a whole text; a special string in it is one token."""
    if not text:
        return 0
    memo, special = counts(path), special_pattern(path)
    if "<|" not in text or not special.search(text):
        return tokens_between(text, memo, chunk_chars)
    pieces = special.split(text)
    return len(pieces) - 1 + sum(tokens_between(p, memo, chunk_chars) for p in pieces)
