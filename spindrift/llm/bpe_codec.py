"""Byte-pair encoding by speculation: longest matches are proposed, every adjacent pair is checked, few words are merged.

A token sequence is the correct one for a word exactly when each token encodes its own text and each adjacent pair
encodes the text of both.  So greedy longest matches are proposed for all new words of a buffer at once; both conditions are
tested as array operations over the distinct tokens and pairs; only words with a failing test go through the exact
merge.  Results of short stretches (what stands between white space) are kept in two bounded generations.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import bpe_transducer, textscan

#: Characters that are buffered before their new words are encoded together, and of a piece of a long text.
BUFFER_CHARS = 1 << 20
#: Stretches kept, of this many characters at most; longer ones are encoded each time.
MEMO_STRETCHES, MEMO_CHARS = 100_000, 64
NEVER = 1 << 30
#: Symbols of a word beyond which the exact merge keeps a heap instead of taking part in rounds over all words.
LONG = 64
FINAL = 256


def in_order(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and the word of each, by word; the order within a word stays."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tokens, word = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(word, kind="stable")
    return tokens[order], word[order]


class Codec:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, path: str):
        spec = bpe_transducer.machine(path)
        self.merge, self.spelled, self.special = spec.merge, spec.spelled, spec.special
        letters = {b: c for c, b in bpe_transducer._byte_of_char().items()}
        n = max(max(spec.text), max(self.special.values(), default=0)) + 1
        self.n, self.strings = n, np.full(n, "", object)
        for token, (text, final) in spec.text.items():
            self.strings[token] = text.decode("latin-1").translate(letters) + ("</w>" if final else "")
        for text, token in self.special.items():
            self.strings[token] = text
        self.string_sizes = np.fromiter(map(len, self.strings), np.int64, n)
        pairs = sorted((a * n + b, rank) for (a, b), (rank, _) in self.merge.items())
        self.pair_keys, self.pair_ranks = np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        self.pair_makes = np.array([self.merge[divmod(p, n)][1] for p, _ in pairs], np.int64)
        # how each token is made: its halves and the rank of that merge
        self.half, self.rank = np.full((2, n), -1, np.int64), np.full(n, NEVER, np.int64)
        for whole, (a, b, rank) in spec.made_of.items():
            self.half[0, whole], self.half[1, whole], self.rank[whole] = a, b, rank
        self._trie(spec.text)
        self.first = np.array([spec.id_of[bytes((b,)), final] for final in (False, True) for b in range(256)], np.int64)
        self.alone = np.full(n, -1, np.int8)
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        self.old: tuple[dict, dict] = ({}, {})

    def _trie(self, texts: dict[int, tuple[bytes, bool]]) -> None:
        edges: dict[int, int] = {}
        token_at = [-1]
        for token, (text, final) in texts.items():
            node = 0
            for k, byte in enumerate(text):
                key = node * 512 + byte + (FINAL if final and k == len(text) - 1 else 0)
                if (node := edges.setdefault(key, len(token_at))) == len(token_at):
                    token_at.append(-1)
            token_at[node] = token
        keys = np.array(sorted(edges), np.int64)
        self.edge_keys, self.edge_to = keys, np.array([edges[k] for k in keys.tolist()], np.int64)
        self.token_at = np.array(token_at, np.int64)
        # the first two steps are looked up without a search: node after one symbol, and after two
        self.one = np.zeros(512, np.int64)
        self.one[keys[keys < 512]] = self.edge_to[keys < 512]
        symbol_of = np.full(len(token_at), -1, np.int64)
        symbol_of[self.one[self.one > 0]] = np.flatnonzero(self.one)
        second = symbol_of[keys // 512] >= 0
        self.two = np.zeros(512 * 512, np.int64)
        self.two[symbol_of[keys[second] // 512] * 512 + keys[second] % 512] = self.edge_to[second]

    def longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each place, and its length; a last symbol of a word has no continuation."""
        n = len(symbols)
        node = self.one[symbols]
        token, length = self.token_at[node], np.where(self.token_at[node] >= 0, 1, 0)
        at = np.flatnonzero(symbols[:-1] < FINAL)
        node, depth = self.two[symbols[at] * 512 + symbols[at + 1]], 2
        at, node = at[node > 0], node[node > 0]
        while len(at):
            whole = self.token_at[node] >= 0
            token[at[whole]], length[at[whole]] = self.token_at[node[whole]], depth
            more = (at + depth < n) & (symbols[at + depth - 1] < FINAL)
            at, node = at[more], node[more]
            keys = node * 512 + symbols[at + depth]
            slot = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            on = self.edge_keys[slot] == keys
            at, node, depth = at[on], self.edge_to[slot[on]], depth + 1
        return token, length

    def propose(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the greedy longest matches of all words, and the word of each."""
        token, length = self.longest(symbols)
        taken, at = np.zeros(len(symbols), bool), starts
        while len(at):
            taken[at] = True
            at = at + length[at]
            at = at[symbols[at - 1] < FINAL]
        place = np.flatnonzero(taken)
        return token[place], np.searchsorted(starts, place, "right") - 1

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of left and right comes before those that make either; of equal ones the leftmost comes first."""
        good = np.ones(len(left), bool)
        row, a, until_a = np.arange(len(left)), left, np.full(len(left), NEVER)
        while len(row):
            inner, x, b, until_x, until_b = row, a, right[row], until_a, np.full(len(row), NEVER)
            while len(inner):
                rank, _ = self.pair_ranks_of(x, b)
                good[inner[(rank < until_x) & (rank <= until_b) & (rank < NEVER)]] = False
                until_b, b = self.rank[b], self.half[0, b]
                on = (b >= 0) & good[inner]
                inner, x, b, until_x, until_b = inner[on], x[on], b[on], until_x[on], until_b[on]
            until_a, a = self.rank[a], self.half[1, a]
            on = (a >= 0) & good[row]
            row, a, until_a = row[on], a[on], until_a[on]
        return good

    def encodes_itself(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token's own text encodes to it alone; worked out once for a token."""
        new = np.unique(tokens[self.alone[tokens] < 0])
        found, of = self.merged_all([self.spelled(t) for t in new.tolist()])
        self.alone[new] = np.bincount(of, minlength=len(new)) == 1
        self.alone[new[of[found != new[of]]]] = 0
        return self.alone[tokens] == 1

    def pair_ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merge of each pair; NEVER where there is none."""
        keys = left * self.n + right
        slot = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[slot] == keys, self.pair_ranks[slot], NEVER), self.pair_makes[slot]

    def merged_all(self, words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The exact merge of many words: all tokens in order, and the word of each.

        In each round every word that still has a merge takes its first pair of lowest rank; long words are merged by themselves.
        """
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        sizes = np.fromiter((len(words[k]) for k in short), np.int64, len(short))
        tokens = np.fromiter((t for k in short for t in words[k]), np.int64, int(sizes.sum()))
        word = np.repeat(np.array(short, np.int64), sizes)
        out = [(found, np.full(len(found), k)) for k, w in enumerate(words) if len(w) > LONG and len(found := np.array(self.merged(w), np.int64))]
        while len(tokens):
            rank, makes = np.full(len(tokens), NEVER, np.int64), np.zeros(len(tokens), np.int64)
            beside = word[1:] == word[:-1]
            rank[:-1], makes[:-1] = self.pair_ranks_of(tokens[:-1], tokens[1:])
            rank[:-1][~beside] = NEVER
            starts = np.flatnonzero(np.concatenate(([True], ~beside)))
            lengths = np.diff(starts, append=len(tokens))
            least = np.minimum.reduceat(rank * len(tokens) + np.arange(len(tokens)), starts)
            done = least >= NEVER * len(tokens)
            whole = np.repeat(done, lengths)
            out.append((tokens[whole], word[whole]))
            place = least[~done] % len(tokens)
            tokens[place] = makes[place]
            whole[place + 1] = True
            tokens, word = tokens[~whole], word[~whole]
        return in_order(out)

    def merged(self, tokens: list[int]) -> list[int]:
        """The exact merge: the pair of lowest rank first, of equal ones the leftmost; n log n for n symbols."""
        merge, n = self.merge, len(tokens)
        tokens, after, before = list(tokens), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(merge[p][0], k) for k, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in merge]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if tokens[k] < 0 or (to := after[k]) < 0 or (found := merge.get((tokens[k], tokens[to]))) is None or found[0] != rank:
                continue
            tokens[k], tokens[to], after[k] = found[1], -1, after[to]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and (right := after[left]) >= 0 and (found := merge.get((tokens[left], tokens[right]))) is not None:
                    heapq.heappush(heap, (found[0], left))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Token ids of all words (none empty) in order, the word of each, and how many words took the exact merge."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        symbols[ends - 1] += FINAL
        tokens, word = self.propose(symbols, ends - sizes)
        bad = np.zeros(len(words), bool)
        bad[word[~self.encodes_itself(tokens)]] = True
        beside = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(tokens[beside] * self.n + tokens[beside + 1], return_inverse=True)
        bad[word[beside[~self.compatible(pairs // self.n, pairs % self.n)[which]]]] = True
        failing, good = np.flatnonzero(bad), ~bad[word]
        exact, of = self.merged_all([self.first[symbols[ends[k] - sizes[k] : ends[k]]].tolist() for k in failing.tolist()])
        return *in_order([(tokens[good], word[good]), (exact, failing[of])]), len(failing)

    def learn(self, stretches: Iterable[str]) -> None:
        """Makes ids and texts of these stretches known."""
        if len(self.ids) >= MEMO_STRETCHES:
            self.old, self.ids, self.texts = (self.ids, self.texts), {}, {}
        ids, texts, (old_ids, old_texts) = self.ids, self.texts, self.old
        new = []
        for stretch in stretches:
            if stretch not in ids:
                if stretch in old_ids:
                    ids[stretch], texts[stretch] = old_ids[stretch], old_texts[stretch]
                else:
                    new.append(stretch)
        if not new:
            return
        units = list(map(bpe_transducer.UNIT.findall, new))
        tokens, word, _ = self.encode_words([u.encode() for u in chain.from_iterable(units)])
        # the tokens of a stretch lie together, so its ids and its text are cut from those of all
        last = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        at = np.searchsorted(word, np.concatenate(([0], last)))
        raw, whole = tokens.astype("<u4").tobytes(), self.decode(tokens)
        in_text = np.concatenate(([0], np.cumsum(self.string_sizes[tokens] + 1)))[at].tolist()
        in_ids = (4 * at).tolist()
        ids.update(zip(new, [raw[i:j] for i, j in pairwise(in_ids)], strict=True))
        texts.update(zip(new, [whole[i : j - 1] for i, j in pairwise(in_text)], strict=True))

    def forget_long(self) -> None:
        for stretch in [s for s in self.ids if len(s) > MEMO_CHARS]:
            del self.ids[stretch], self.texts[stretch]

    def decode(self, tokens: np.ndarray) -> str:
        """The library's text of ids for a vocabulary without a decoder: the tokens' own strings between spaces."""
        return " ".join(self.strings[tokens].tolist())


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def pieces(text: str, most: int = BUFFER_CHARS) -> Iterator[str]:
    """A normal text in parts of about most characters, cut at white space only."""
    start = 0
    while len(text) - start > most:
        if (cut := bpe_transducer.WIDE.search(text, start + most)) is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def parts(text: str, path: str) -> Iterator[str | list[str]]:
    """Special strings of a text, and lists of the stretches between them, in order."""
    special = bpe_transducer.special_pattern(path)
    found = special.findall(text) if "<|" in text else []
    for k, between in enumerate(special.split(text) if found else [text]):
        for piece in pieces(bpe_transducer.normal(between)):
            if stretches := bpe_transducer.stretches(piece):
                yield stretches
        if k < len(found):
            yield found[k]


class Digest:
    """Running count and hashes of one text's ids and of the text that they decode to."""

    def __init__(self):
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: bytes, text: str) -> None:
        self.text.update((" " if self.n else "").encode() + text.encode())
        self.ids.update(ids)
        self.n += len(ids) // 4


def digests(texts: list[str], path: str) -> list[Digest]:
    own, out = codec(path), [Digest() for _ in texts]
    held: list[tuple[Digest, str | list[str]]] = []
    chars = 0

    def flush() -> None:
        new = {s for _, part in held if isinstance(part, list) for s in part}
        own.learn(new)
        for digest, part in held:
            if isinstance(part, str):
                digest.add(int(own.special[part]).to_bytes(4, "little"), part)
            else:
                digest.add(b"".join(map(own.ids.__getitem__, part)), " ".join(map(own.texts.__getitem__, part)))
        own.forget_long()
        held.clear()

    for digest, text in zip(out, texts, strict=True):
        for part in parts(text, path):
            held.append((digest, part))
            chars += sum(map(len, part))
            if chars >= BUFFER_CHARS:
                flush()
                chars = 0
    flush()
    return out


def encode(text: str, path: str) -> list[int]:
    """Token ids of one text."""
    own, out = codec(path), []
    for part in parts(text, path):
        if isinstance(part, str):
            out.append(own.special[part])
        else:
            own.learn(dict.fromkeys(part))
            out += np.frombuffer(b"".join(map(own.ids.__getitem__, part)), "<u4").tolist()
    own.forget_long()
    return out


def decode(ids: Iterable[int], path: str) -> str:
    """The text of ids, special tokens included; ids that the vocabulary lacks are left out."""
    own = codec(path)
    return own.decode(np.array([i for i in ids if 0 <= i < own.n and own.strings[i]], np.int64))


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; one narrow pass, no shuffle.

    A null or empty text has no tokens: both hashes are those of no bytes.  Repeated rows are encoded each; a null doc_id
    stays null; an empty table gives no rows.  Texts of any length are read whole, in pieces cut at white space; a stretch
    without white space is one piece.  Columns other than doc_id and text are not read.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        for batch in batches:
            for start, end in textscan.blocks(batch["text"]):
                part = batch.slice(start, end - start)
                found = digests(part["text"].to_pylist(), path)
                columns = [pa.array([d.n for d in found], pa.int64()), pa.array([d.ids.hexdigest() for d in found]), pa.array([d.text.hexdigest() for d in found])]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], names=names)

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
