"""Secret scan: patterns find candidates, a random forest removes the false ones.

The forest is trained on labelled findings: a table (text, start, length, path, secret)
that the caller may give; else findings made from all documents.  Into each of them credentials drawn by rule from their
formats, and what is commonly mistaken for them, are planted between its own words, under its own path; and candidates
that documents hold already are taken as false where neither their name nor their form tells of a secret.  The dictionary
is counted over all words of all documents, and the letter transitions over the dictionary.  What is learned from stays in
the tasks: the forest grows from sums over it, level by level.
"""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import storage
from spindrift.llm.forest import ONE, Forest, coarse, edges_of
from spindrift.llm.textscan import mix

SECRET_SCORE = 0.5
#: Findings drawn by rule: at least so many, and at least so many in each document.
FINDINGS, EACH = 6000, 2
#: A word of the dictionary stands in so many documents, and in so large a part of all: so it does not grow with their number.
LEAST_DOCS, LEAST_SHARE = 3, 0.0015
#: What features see around a candidate is shorter than this.
CONTEXT = 256
#: What learned rows are: candidates of the documents that are taken as false, findings that are false, secrets.
OWN, FALSE, SECRET = 0, 1, 2
MASK = "[SECRET]"

#: Formats of issued credentials (fixed values).
ISSUED = (
    r"(?:AKIA|ASIA|AGPA|AIDA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}"
    r"|AIza[\w-]{35}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}"
)
KEY_BLOCK = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----[\s\S]{0,8192}?(?:-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)"
CANDIDATE = re.compile(
    rf"(?P<block>{KEY_BLOCK})|(?<![A-Za-z0-9])(?P<issued>{ISSUED})"
    r"|(?P<name>[A-Za-z_][\w.-]{2,40})[\"']?[ \t]*(?::=|=>|[:=])[ \t]*[\"']?(?P<assigned>[^\s\"'<>,;(){}\[\]]{6,256})"
    r"|(?<![\w+/=.-])(?P<bare>(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,512})(?![\w+/=-])"
)
#: What lies beyond the bounds in CANDIDATE: the rest of an assigned value, longer runs, and key blocks to their END line, the next BEGIN or the text's end.
BOUND = 256
#: Where CANDIDATE can match at all: at a name whose separator has a value behind it, at a key block, and within runs of DENSE
#: characters (one byte a code point; those beyond ASCII count as such) as long as the shortest issued credential, at what STARTS finds.
SEPARATOR = re.compile(r"[:=]")
HAS_VALUE = re.compile(r"(?::=|=>|[:=])[ \t]*+[\"']?[^\s\"'<>,;(){}\[\]]{6}")
NAME_REVERSED = re.compile(r"[\w.-]{3,41}+")
DENSE = bytes(97 if b > 127 or chr(b).isalnum() or chr(b) in "+/_=.-?" else 32 for b in range(256))
DENSE_RUN = b"a" * 15
STARTS = re.compile(r"(?<![A-Za-z0-9])(?=A[KSI]IA|AGPA|AIDA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[_-]|AIza|eyJ|npm_|SG\.)|(?<![\w+/=.-])(?=[A-Za-z0-9+/_=-]{20})")
BEGINS = re.compile(r"(?=-----BEGIN )")
REST = re.compile(r"[^\s\"'<>,;(){}\[\]]*+")
LONG = re.compile(r"(?<![\w+/=.-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{513,}+(?![\w+/=-])")
KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_STOP = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----|(?=-----BEGIN )|\Z")
#: What a secret name is set to: its separator, the name before that, and the value to its quote or, without quotes, to white space.
SETS = re.compile(r"[:=]>?[ \t]{0,40}(?P<quote>\\?(?:\"\"\"|\'\'\'|[\"'`]))?")
NAME_BEFORE = re.compile(r"([A-Za-z_][\w.-]{2,40})\\?[\"'`]?[ \t]{0,20}:?\Z")
NAME_REACH, CALL_REACH = 64, 256
CLOSED = {
    **{q: re.compile(rf"(?P<value>(?:[^\\\n{q}]|\\[^\n])*+){q}") for q in "\"'`"},
    **{"\\" + q: re.compile(rf"(?P<value>[^\n]*?)\\{q}") for q in "\"'`"},
    **{q * 3: re.compile(rf"(?s)(?P<value>(?:[^\\]|\\.)*?){q * 3}") for q in "\"'"},
    **{"\\" + q * 3: re.compile(rf"(?s)(?P<value>.*?)\\{q}") for q in "\"'"},
}
UNQUOTED = re.compile(r"[^\s\"'`<>]*+")
NEXT_PAIR = re.compile(r"[,;&][\w.-]+[=:]")
EXPRESSION = re.compile(r"[A-Za-z_$][\w.:$>-]*[(\[{]")
#: Names of what is secret, and words that tell of what is not (fixed values), for folded() text.
SECRET_NAME = re.compile(r"pass(?:word|wd|phrase)?$|pwd|secret(?!ar)|token(?!i[sz])|credential|api[_.-]?key|access[_.-]?key|private[_.-]?key|auth(?!or(?!i[sz]))|bearer|signing[_.-]?key")
HARMLESS_NAME = re.compile(r"commit|sha\d*|md5|hash|digest|checksum|etag|uuid|guid|version|build|revision|^ids?$|[_-]id$|integrity|nonce|url|path|file|href|src|class|type|name|title|date|time|size|color")
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|change.?me|your|xxx|\*\*\*|\.\.\.|todo|fixme|redacted|insert|replace|none|null|true|false|required|optional|<|\$\{|%s|env\.|process\.|getenv|config\.")
#: Words that sentences about secrets hold, and passphrases seldom (fixed values).
SENTENCE = re.compile(r"\b(?:a|an|and|are|at|be|been|by|can|cannot|could|enter|for|forgot|has|have|here|in|incorrect|invalid|is|it|least|may|missing|must|need|new|no|not|of|on|or|please|reset|should|than|that|the|this|to|type|use|was|when|will|with|wrong|you)\b", re.I)
TEST_PATH = re.compile(r"test|spec|example|sample|fixture|doc|readme|mock|demo")
#: Words of code and settings, which the dictionary holds in any case (fixed values).
COMMON = frozenset(
    "access account admin api app auth base build cache case class client code config count data date default directory docs example field file format get group hash home host http https "
    "id image index info input item key lib library line link list local log main map max min name node null number object option output page part password path port post private "
    "program project public query read request response result return root run script secret server service session set size source src start state status string system table temp test text "
    "time title token type url usr user value var version view web width with word work write the and for you not this that from have".split()
)
SORTED_COMMON = sorted(COMMON)
WORD = re.compile(r"[A-Za-z]{3,}")
NAMES = ("length", "classes", "changes", "change_rate", "entropy", "transition", "coverage", "digits", "upper", "hex", "repeats", "dots", "slashes", "placeholder", "secret_name", "harmless_name", "assigned", "issued", "block", "words_secret", "words_harmless", "test_path", "file_like", "digits_only", "spaces", "sentence")
#: What splits() tells of a node, and rows to learn from: a seed, the features of its candidates one after another, and the group of each.
SPLIT = ("slot", "cut", "n", "p", "left_n", "left_p")
LEARNED = "seed long, learned array<float>, groups array<int>"


class Lexicon:
    """A dictionary and the log probabilities of letter pairs in its words."""

    def __init__(self, words: frozenset[str] = frozenset()):
        self.words = COMMON | words
        counts = np.full((27, 27), 0.3)
        for word in self.words:
            letters = [0, *(ord(c) - 96 if "a" <= c <= "z" else 0 for c in word), 0]
            np.add.at(counts, (letters[:-1], letters[1:]), 1)
        self.pairs = np.log(counts / counts.sum(1, keepdims=True)).tolist()


def least_docs(docs: int) -> int:
    """How many of so many documents hold each word of the dictionary."""
    return max(LEAST_DOCS, math.ceil(LEAST_SHARE * docs))


def lexicon(texts: list[str]) -> Lexicon:
    """The dictionary of texts at hand."""
    times = Counter(w for t in texts for w in {x.lower() for x in WORD.findall(t)})
    return Lexicon(frozenset(w for w, n in times.items() if n >= least_docs(len(texts))))


def counted_lexicon(texts: DataFrame) -> tuple[Lexicon, int]:
    """The dictionary of a table's column text, from the whole of each, and how many texts there are that hold more than white space."""
    texts = texts.where(F.col("text").rlike(r"\S"))
    docs = texts.count()
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({WORD.pattern})")), F.lower))
    often = texts.select(F.explode(words).alias("word")).groupBy("word").count().where(F.col("count") >= least_docs(docs))
    return Lexicon(frozenset(often.toArrow()["word"].to_pylist())), docs


def kind_of(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


KINDS = bytes(kind_of(chr(b)) for b in range(128)) + bytes(128)
HEX = frozenset(string.hexdigits)
HUMP = re.compile(r"([a-z])([A-Z])")
FILE_LIKE = re.compile(r"\.[a-z]{2,4}$|^https?:|^www\.|@")
#: Letters beyond ASCII that a search which ignores case takes for ASCII ones.
ODD = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def folded(text: str) -> str:
    """The text, as long as before, in which lower-case ASCII patterns find what they find in the text when case is ignored."""
    return text.lower() if text.isascii() else text.translate(ODD).lower()


def covered_by(value: str, known: Lexicon) -> int:
    """How many characters of a value lie in words of the dictionary."""
    return sum(len(w) for w in WORD.findall(HUMP.sub(r"\1 \2", value)) if w.lower() in known.words)


def features(value: str, kind: str, name: str, before: str, after: str, path: str, known: Lexicon) -> list[float]:
    """NAMES: length, transitions between characters, dictionary coverage, path, and neighbouring words."""
    size = len(value)
    kinds = value.encode().translate(KINDS) if value.isascii() else bytes(map(kind_of, value))
    changes = sum(map(ne, kinds, kinds[1:]))
    counts = Counter(value)
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
    letters = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in value.lower()]
    pairs = [known.pairs[a][b] for a, b in pairwise(letters) if a and b]
    low_name, low_before, near = folded(name), folded(before), folded(f"{before} {after}")
    return [
        size, len(set(kinds)), changes, changes / max(1, size - 1), entropy, sum(pairs) / len(pairs) if pairs else -6.0, covered_by(value, known) / size,
        kinds.count(2) / size, kinds.count(1) / size, sum(n for c, n in counts.items() if c in HEX) / size, max(counts.values()) / size,
        value.count("."), value.count("/"), bool(PLACEHOLDER.search(folded(value))), bool(SECRET_NAME.search(low_name)), bool(HARMLESS_NAME.search(low_name)), kind == "assigned", kind == "issued", kind == "block",
        len(SECRET_NAME.findall(low_before)), len(HARMLESS_NAME.findall(near)) + len(PLACEHOLDER.findall(near)), bool(TEST_PATH.search(folded(path))), bool(FILE_LIKE.search(value)), value.isdigit(),
        value.count(" "), len(SENTENCE.findall(value)) if " " in value else 0,
    ]


def unquoted_end(text: str, start: int) -> int:
    """Where a value without quotes ends: before white space, quotes or a further pair, less the punctuation around it; a call or subscript ends at its bracket."""
    end = UNQUOTED.match(text, start).end()
    if pair := NEXT_PAIR.search(text, start, end):
        end = pair.start()
    value = text[start:end]
    many = {c: value.count(c) for c in "()[]{}"}
    while end > start and text[end - 1] in ".!?,;)]}":
        if (last := text[end - 1]) in ")]}":
            if many[last] <= many["([{"[")]}".index(last)]]:
                break
            many[last] -= 1
        end -= 1
    called = EXPRESSION.match(text, start, end)
    if called:
        opened = text[called.end() - 1]
        closed = ")]}"["([{".index(opened)]
        # a call whose arguments go on behind white space is closed on its line, or its bracket is the line's last
        rest = text[end : end + CALL_REACH].partition("\n")[0]
        if text[end - 1] in ")]}" or many[opened] > many[closed] and (text[end - 1] == opened or closed in rest):
            return called.end() - 1
    return end


def named_values(text: str) -> dict[int, tuple[int, str, int]]:
    """What secret names are set to: by the value's start its end, the name and where that begins."""
    out, skip = {}, 0
    for m in SETS.finditer(text):
        if m.start() < skip:
            continue
        low = max(0, m.start() - NAME_REACH)
        name = NAME_BEFORE.search(text[low : m.start()])
        if not name or not SECRET_NAME.search(folded(name[1])):
            continue
        start, quote = m.end(), m["quote"]
        closed = CLOSED[quote].match(text, start) if quote else None
        if closed:
            end = closed.end("value")
        else:
            skip = end = unquoted_end(text, start)
        out[start] = (end, name[1], low + name.start(1))
    return out


def dense_runs(text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of the runs that may hold an issued credential or a value without a name."""
    flat = text.encode("latin-1", "replace").translate(DENSE)
    end, at = 0, flat.find(DENSE_RUN)
    while at >= 0:
        end = flat.find(b" ", at)
        yield at, end if end >= 0 else len(flat)
        at = flat.find(DENSE_RUN, end) if end >= 0 else -1


def matches(text: str, runs: list[tuple[int, int]]) -> Iterator[re.Match]:
    """What CANDIDATE.finditer(text) gives, tried only where a match can start."""
    at, behind = [], 0
    for m in SEPARATOR.finditer(text) if ":" in text or "=" in text else ():
        if HAS_VALUE.match(text, m.start()):
            before = text[behind : m.start()].rstrip(" \t")
            end = behind + len(before) - before.endswith(("\"", "'"))
            if name := NAME_REVERSED.match(text[max(behind, end - 41) : end][::-1]):
                at += range(end - name.end(), end - 2)
        behind = m.end()
    for start, end in runs:
        at += (m.start() for m in STARTS.finditer(text, start, end))
    if "-----BEGIN " in text:
        at += (m.start() for m in BEGINS.finditer(text))
    end = 0
    for start in sorted(at):
        if start >= end and (m := CANDIDATE.match(text, start)):
            yield m
            end = m.end()


def candidates(text: str) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, kind, name, words before, words after) of what may be a secret; one may lie within another.

    What a secret name is set to counts whole: to its closing quote on the line (three quotes: in the text), else to white space, quotes,
    < or > or a further pair, less the punctuation behind it; of a call or subscript the name alone.
    """
    out, run_end = [], 0
    begins, ends = [], []  # of assignments

    def add(begin: int, start: int, end: int, kind: str, name: str) -> None:
        if end - start >= 6:
            out.append((start, end, kind, name, " ".join(text[max(0, begin - 60) : begin].split()[-4:]), " ".join(text[end : end + 40].split()[:3])))

    runs = [*dense_runs(text)]
    named = named_values(text) if ":" in text or "=" in text else {}
    for start, (end, name, begin) in named.items():
        add(begin, start, end, "assigned", name)
    for m in matches(text, runs):
        kind = m.lastgroup if m.lastgroup != "name" else "assigned"
        start, end = m.span(kind)
        if start in named and kind != "block":
            begins.append(m.start())
            ends.append(named[start][0])
            if kind == "assigned":
                continue
        if kind == "assigned" and end - start == BOUND:
            # the search goes on within the run, since a value that is no secret may hold one
            run_end = end = run_end if run_end > end else REST.match(text, end).end()
        if kind == "assigned":
            begins.append(m.start())
            ends.append(end)
        while end > start and text[end - 1] in ".!?":
            end -= 1
        if kind == "assigned" and text[start : min(end, start + BOUND)].isalpha() and text[start:end].isalpha() and text[start:end].islower() and not SECRET_NAME.search(folded(m["name"])):
            continue
        add(m.start(), start, end, kind, m["name"] or "")
    for m in LONG.finditer(text) if any(end - start > 512 for start, end in runs) else ():
        k = bisect_right(begins, m.start()) - 1
        if k < 0 or ends[k] <= m.start():
            add(m.start(), m.start(), m.end(), "bare", "")
    if "-----BEGIN " in text:
        known = {start for start, _, kind, *_ in out if kind == "block"}
        for m in KEY_BEGIN.finditer(text):
            if m.start() not in known:
                add(m.start(), m.start(), KEY_STOP.search(text, m.end()).end(), "block", "")
    return out


def labelled_findings(sample: list[tuple[str, str]] | None = None, count: int = FINDINGS, seed: int = 1) -> list[tuple[str, int, int, str, int]]:
    """(text, start, length, path, secret): drawn by rule, half of them secret, and planted between words of the sample (text, path)."""
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    low, word_letters = "0123456789abcdef", string.ascii_letters + string.digits
    common = SORTED_COMMON
    sampled = [(t.split(), p) for t, p in sample or [] if t.strip()]
    paths = ("src/main", "config/app", "docs/readme", "tests/fixtures", "src3", "web", "deploy/env", "data/part")
    case = lambda s: rng.choice((s, s, s.upper()))

    def prose(n: int, words: list[str]) -> str:
        if words and rng.random() < 0.8:
            at = rng.randrange(max(1, len(words) - n))
            return " ".join(words[at : at + n])
        return " ".join(pick("etaoinshrdlu", rng.randint(2, 9)) if rng.random() < 0.5 else rng.choice(common) for _ in range(n))

    def random_value() -> str:
        return rng.choice(
            (
                lambda: pick(low, rng.choice((16, 18, 20, 24, 32, 40, 48, 64))), lambda: pick(word_letters, rng.randint(16, 48)), lambda: pick(word_letters + "+/", rng.randint(20, 60)) + "=" * rng.randint(0, 2),
                lambda: pick(word_letters + "!@#$%^&*", rng.randint(8, 20)), lambda: pick(string.ascii_lowercase, rng.randint(3, 7)) + pick(string.digits, rng.randint(2, 5)) + rng.choice("!@#$%"),
            )
        )()

    def secret() -> tuple[str, str]:
        roll = rng.random()
        if roll < 0.3:
            return "", rng.choice(
                (
                    lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(word_letters, 36), lambda: "sk_live_" + pick(word_letters, 24), lambda: "AIza" + pick(word_letters, 35),
                    lambda: f"eyJ{pick(word_letters, 20)}.eyJ{pick(word_letters, 40)}.{pick(word_letters, 30)}", lambda: "glpat-" + pick(word_letters, 20), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(word_letters, 24),
                )
            )()
        if roll < 0.33:
            return "", f"-----BEGIN RSA PRIVATE KEY-----\n{pick(word_letters + '+/', 120)}\n-----END RSA PRIVATE KEY-----"
        if roll < 0.42:
            words = rng.choice((" ", " ", " ", "-", "_")).join(rng.choice(common) if rng.random() < 0.6 else pick("etaoinshrdlu", rng.randint(3, 8)) for _ in range(rng.randint(4, 6)))
            value = rng.choice((pick(word_letters + string.punctuation.translate({ord(c): None for c in "\"'`\\"}), rng.randint(8, 24)),) * 2 + (words + rng.choice(("", f" {rng.randint(1, 99)}", "!")),))
            return case(rng.choice(("password", "db_password", "passphrase", "secret", "pwd"))) + rng.choice(("=\"", " = \"", ": '", "\": \"", " => '")), value
        if roll < 0.48:
            return case(rng.choice(("password", "passwd", "pwd", "db_password", "admin_password"))) + rng.choice(("=", " = ", ": ", "=\"")), pick(string.ascii_lowercase, rng.randint(8, 14))
        name = rng.choice(("password", "passwd", "pwd", "token", "secret", "api_key", "apiKey", "access_key", "auth_token", "client_secret", "db_password", "private_key", "credential", "AWS_SECRET_ACCESS_KEY"))
        return case(name) + rng.choice(("=", " = ", ": ", "=\"", " = \"", ": '", "\": \"")), random_value()

    def harmless() -> tuple[str, str]:
        secret_name = rng.choice(("password", "token", "secret", "api_key", "auth"))
        plain_name = rng.choice(("commit", "sha256", "md5", "checksum", "etag", "id", "uuid", "version", "url", "path", "file", "hash", "revision", "build", "integrity", "user_id"))
        join = rng.choice(("=", " = ", ": ", "=\"", ": '"))
        uuid = lambda: "-".join(pick(low, n) for n in (8, 4, 4, 4, 12))
        path = "/".join(rng.choices(common, k=rng.randint(3, 6)))
        sentence = lambda: " ".join(rng.choice(("please", "enter", "the", "your", "must", "be", "is", "of", "at", "least", "not", "for", "to", "invalid", "a", "new", rng.choice(common), rng.choice(common), secret_name)) for _ in range(rng.randint(3, 9))).capitalize()
        return rng.choice(
            (
                lambda: (secret_name + rng.choice(("=\"", " = \"", ": '", "\": \"")), sentence() + rng.choice(("", ".", ":", "!"))),
                lambda: (secret_name + rng.choice(("=", " = ")), rng.choice(common) + rng.choice("._") + rng.choice(common) + rng.choice((f"({rng.choice(common)})", f"[{rng.choice(common)}]", "()"))),
                lambda: (secret_name + rng.choice(("_", "")) + rng.choice(("type", "name", "field", "url", "path")) + join, rng.choice(common) + rng.choice(("", "_" + rng.choice(common), " " + rng.choice(common)))),
                lambda: (secret_name + join, rng.choice(("your_" + secret_name + "_here", "changeme", "example123", "xxxxxxxxxxxx", "${" + secret_name.upper() + "}", "********", "placeholder", "dummy-" + secret_name, "process.env." + secret_name.upper(), "required", "optional", "undefined", "os.getenv", "config.token"))),
                lambda: (secret_name + join, rng.choice(common) + rng.choice(("_", ".", "")) + rng.choice(common) + rng.choice(("", "_" + rng.choice(common)))),
                lambda: (plain_name + join, rng.choice((pick(low, rng.choice((16, 32, 40, 64))), uuid(), pick(string.digits, rng.randint(6, 16)), path, f"{rng.choice(common)}-{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}"))),
                lambda: (rng.choice(("commit ", "at ", "digest sha256-", "")), rng.choice((pick(low, 40), uuid(), pick(string.digits, rng.choice((20, 22, 24)))))),
                lambda: ("", path + "/" + rng.choice(common) + str(rng.randint(1, 99))),
                lambda: ("", rng.choice(common).title().join(rng.choice(common).title() for _ in range(5)) + str(rng.randint(1, 9))),
                lambda: ("", "-".join(rng.choice(common) for _ in range(5)) + "-" + str(rng.randint(1, 2030))),
                lambda: (rng.choice(("width", "title", "name", "type", "time", "see", "note")) + join, rng.choice((prose(1, []) + "sss", f"{rng.randint(0, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", path, "https://" + rng.choice(common) + ".example.com/" + path))),
            )
        )()

    out = []
    for n in range(count):
        head, value = (secret if n % 2 else harmless)()
        words, path = rng.choice(sampled) if sampled else ([], "")
        left = prose(rng.randint(0, 5), words)[-CONTEXT:]
        begin = (left + " " if left else "") + head
        tail = head[-1] + rng.choice((" ", "\n", ", ", "; ", "} ")) if head.endswith(("\"", "'")) else rng.choice((" ", "\" ", "\n", "' ", ". ", "!! "))
        out.append((begin + value + tail + prose(rng.randint(0, 4), words)[:CONTEXT], len(begin), len(value), path if path and rng.random() < 0.5 else rng.choice(paths), n % 2))
    return out


def harmless(value: str, kind: str, name: str, before: str, known: Lexicon) -> bool:
    """Whether a candidate that a document holds is taken as false: of no issued form and no secret name, and without a word of one before it, it is words, numbers or repeats few characters."""
    if kind not in ("bare", "assigned") or SECRET_NAME.search(folded(name)) or SECRET_NAME.search(folded(before)):
        return False
    letters = sum(c.isalpha() for c in value)
    return 2 * covered_by(value, known) >= letters > 0 or not letters or 4 * len(set(value)) <= len(value)


def examples(findings: list[tuple[str, int, int, str, int]], known: Lexicon) -> tuple[list[list[float]], list[int]]:
    """Features, and FALSE or SECRET, of the candidates that overlap each finding."""
    x, groups = [], []
    found: dict[str, list] = {}
    for text, start, length, path, secret in findings:
        if text not in found:
            found[text] = candidates(text)
        for a, b, kind, name, before, after in found[text]:
            if a < start + length and b > start:
                x.append(features(text[a:b], kind, name, before, after, path, known))
                groups.append(SECRET if secret else FALSE)
    return x, groups


def own_examples(text: str, path: str, found: list, seed: int, each: int, known: Lexicon) -> tuple[list[list[float]], list[int]]:
    """What a document with these candidates gives to learn from: findings planted between its words, and its candidates that are taken as false."""
    x, groups = examples(labelled_findings([(text, path)], each, seed), known) if text.strip() else ([], [])
    for a, b, kind, name, before, after in found:
        if harmless(text[a:b], kind, name, before, known):
            x.append(features(text[a:b], kind, name, before, after, path, known))
            groups.append(OWN)
    return x, groups


def group_weights(counts: list[int]) -> np.ndarray:
    """The weight of a row by its group: own candidates together weigh at most half as much as all findings."""
    own, planted = counts[OWN], counts[FALSE] + counts[SECRET]
    return np.array([max(1, min(ONE, ONE * planted // (2 * own))) if own and planted else ONE, ONE, ONE], np.int64)


def planted_each(docs: int) -> int:
    return max(EACH, 2 * math.ceil(FINDINGS / (2 * max(1, docs))))


def drawn_only(known: Lexicon) -> Forest:
    """The forest where there is nothing to learn from but the rules."""
    x, groups = examples(labelled_findings(), known)
    return Forest().fit(np.array(x, np.float32), np.array(groups) == SECRET)


def trained_on(sample: list[tuple[str, str]]) -> tuple[Forest, Lexicon]:
    """Forest and lexicon from documents (text, path) at hand."""
    sample = [(t, p) for t, p in sample if t.strip()]
    known = lexicon([t for t, _ in sample])
    x, groups = [], []
    for text, path in sample:
        more, of = own_examples(text, path or "", candidates(text), zlib.crc32(text.encode("utf-8", "surrogatepass")), planted_each(len(sample)), known)
        x += more
        groups += of
    if not x:
        return drawn_only(known), known
    weights = group_weights(np.bincount(groups, minlength=3).tolist())
    return Forest().fit(np.array(x, np.float32), np.array(groups) == SECRET, weights[groups]), known


def apart(secrets: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Secrets in text order; those that overlap are one, from the first one's start to the last end."""
    out: list[tuple[int, int, str, float]] = []
    for a, b, kind, score in sorted(secrets, key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2], max(score, out[-1][3]))
        else:
            out.append((a, b, kind, score))
    return out


def scan(texts: list, paths: list, model: tuple[Forest, Lexicon]) -> list[list[tuple[int, int, str, float]]]:
    """For each text its secrets: (start, end, kind, score)."""
    found = [candidates(t) if t else [] for t in texts]
    forest, known = model
    return judged([[c[:3] for c in cs] for cs in found], candidate_features(texts, paths, found, known), forest)


def candidate_features(texts: list, paths: list, found: list[list], known: Lexicon) -> np.ndarray:
    rows = [features(t[a:b], kind, name, before, after, p or "", known) for t, p, cs in zip(texts, paths, found, strict=True) for a, b, kind, name, before, after in cs]
    return np.array(rows, np.float32).reshape(-1, len(NAMES))


def judged(found: list[list[tuple[int, int, str]]], x: np.ndarray, forest: Forest) -> list[list[tuple[int, int, str, float]]]:
    """For each text the candidates that the forest takes for secrets."""
    scores = iter(forest.probability(x).tolist() if len(x) else [])
    return [apart([(a, b, kind, s) for (a, b, kind), s in zip(cs, scores, strict=False) if s >= SECRET_SCORE]) if cs else [] for cs in found]


def _pieces(batches, rows: int = 512):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _read(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, groups and seeds of the rows to learn from that a piece of an Arrow batch holds."""
    x = part["learned"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    groups, sizes = part["groups"].flatten().to_numpy(zero_copy_only=False), part["groups"].value_lengths().to_numpy(zero_copy_only=False)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    seeds = np.repeat(part["seed"].to_numpy(zero_copy_only=False).view(np.uint64), sizes)
    return x, groups, mix(seeds + (np.arange(len(x)) - first).astype(np.uint64))


def grown(rows: DataFrame) -> Forest | None:
    """The forest from all rows to learn from (seed, learned, groups), which stay in the tasks; None where there are none.

    A task sends its sums over each open node's bins, which do not grow with the rows; a node's sums meet in one task.
    """
    spark, rows = rows.sparkSession, rows.select("seed", "learned", "groups").where(F.size("groups") > 0)

    def values(batches):
        for part in _pieces(batches, 2048):
            x, groups, _ = _read(part)
            near = coarse(x)
            for k in range(len(NAMES)):
                for g in np.unique(groups):
                    value, n = np.unique(near[groups == g, k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, np.int32)), pa.array(np.full(len(value), g, np.int32)), pa.array(value), pa.array(n)], names=["feature", "group", "value", "n"])

    table = rows.mapInArrow(values, "feature int, group int, value float, n long").groupBy("feature", "group", "value").agg(F.sum("n").alias("n")).toArrow()
    if not table.num_rows:
        return None
    feature, group, value, n = (table[c].to_numpy() for c in ("feature", "group", "value", "n"))
    weights = group_weights([int(n[(feature == 0) & (group == g)].sum()) for g in range(3)])
    forest = Forest()
    edges = [edges_of(value[feature == k], (n * weights[group])[feature == k], forest.bins) for k in range(len(NAMES))]

    def splits_of(opened):
        shared = spark.sparkContext.broadcast((forest, opened, weights))
        some = opened[2].shape[1]

        def sums(batches):
            forest, opened, weights = shared.value
            n = p = None
            for part in _pieces(batches, 2048):
                x, groups, seeds = _read(part)
                more = forest.sums(forest.codes(x), groups == SECRET, weights[groups], seeds, opened)
                n, p = more if n is None else (n + more[0], p + more[1])
            if n is not None:
                cells = np.flatnonzero(n)
                node, cell = np.divmod(cells, some * forest.bins)
                yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(n.ravel()[cells]), pa.array(p.ravel()[cells])], names=["node", "cell", "n", "p"])

        def best(batches):
            forest = shared.value[0]
            n, p = (np.zeros((len(opened[0]), some * forest.bins), np.int64) for _ in range(2))
            for batch in batches:
                at = batch["node"].to_numpy(), batch["cell"].to_numpy()
                np.add.at(n, at, batch["n"].to_numpy())
                np.add.at(p, at, batch["p"].to_numpy())
            nodes = np.flatnonzero(n.any(1))
            if len(nodes):
                shape = (len(nodes), some, forest.bins)
                found = forest.splits(n[nodes].reshape(shape), p[nodes].reshape(shape))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), *map(pa.array, found.T.astype(np.int64))], names=["node", *SPLIT])

        of = rows.mapInArrow(sums, "node int, cell int, n long, p long").repartition("node").mapInArrow(best, "node long, " + ", ".join(f"{c} long" for c in SPLIT)).toArrow()
        shared.destroy()
        out = np.zeros((len(opened[0]), len(SPLIT)), np.int64)
        out[:, 0] = -1
        out[of["node"].to_numpy()] = np.stack([of[c].to_numpy() for c in SPLIT], 1)
        return out

    return forest.grow(edges, splits_of)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))


def _learn_from_findings(findings: DataFrame, known) -> DataFrame:
    """Of each labelled finding the rows to learn from."""

    def run(batches):
        for part in _pieces(batches):
            made = [examples([tuple(row)], known.value) for row in zip(*(part[c].to_pylist() for c in ("text", "start", "length", "path", "secret")), strict=True)]
            yield pa.RecordBatch.from_arrays([part["seed"], _lists([[v for row in x for v in row] for x, _ in made], pa.float32()), _lists([g for _, g in made], pa.int32())], names=["seed", "learned", "groups"])

    rows = findings.select("text", F.col("start").cast("long"), F.col("length").cast("long"), "path", F.col("secret").cast("int").alias("secret")).dropna()
    return rows.select("*", F.xxhash64("text", "start", "length").alias("seed")).mapInArrow(run, LEARNED)


def _learn_from_documents(documents: DataFrame, known, docs: int, spans: bool) -> DataFrame:
    """Of each document the rows to learn from; with spans also its candidates and their features, which the scan then need not find again."""
    each = planted_each(docs)

    def run(batches):
        for part in _pieces(batches):
            texts, paths = [t or "" for t in part["text"].to_pylist()], [p or "" for p in part["source"].to_pylist()]
            found = [candidates(t) if t else [] for t in texts]
            made = [own_examples(t, p, cs, seed, each, known.value) for t, p, cs, seed in zip(texts, paths, found, part["seed"].to_pylist(), strict=True)]
            columns = [part["seed"], _lists([[v for row in x for v in row] for x, _ in made], pa.float32()), _lists([g for _, g in made], pa.int32())]
            names = ["seed", "learned", "groups"]
            if spans:
                rows = iter(candidate_features(texts, paths, found, known.value).tolist())
                columns += [part["doc_id"], *(_lists([[c[k] for c in cs] for cs in found], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))), _lists([[v for _ in cs for v in next(rows)] for cs in found], pa.float32())]
                names += ["doc_id", "starts", "ends", "kinds", "found"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = _texts(documents).select("*", F.xxhash64("doc_id", "text").alias("seed"))
    return rows.mapInArrow(run, LEARNED + (", doc_id long, starts array<long>, ends array<long>, kinds array<string>, found array<float>" if spans else ""))


def _learned(documents: DataFrame, findings: DataFrame | None, spans: bool) -> tuple:
    """The model, broadcast, and the kept candidates of the documents if they are asked for and learned from."""
    context = documents.sparkSession.sparkContext
    words, docs = counted_lexicon(_texts(documents))
    known = context.broadcast(words)
    rows = storage.keep(_learn_from_documents(documents, known, docs, spans) if findings is None else _learn_from_findings(findings, known), "secrets")
    forest = grown(rows)
    if not spans or findings is not None:
        storage.discard(rows)
        rows = None
    return context.broadcast((forest or drawn_only(words), words)), rows


def find_secrets(documents: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, start, length (code points), kind, score: one row for each secret in each document row.

    Null and empty texts hold none.  Repeated rows are reported each; a null doc_id stays null; a null
    source tells nothing; an empty table gives no rows.  Columns other than doc_id, text and source are not
    read.  All documents, or all labelled findings given, are learned from.
    """
    shared, kept = _learned(documents, findings, True)
    names = ["doc_id", "start", "length", "kind", "score"]

    def told(doc_id, found):
        rows = [(n, a, b - a, kind, s) for n, secrets in enumerate(found) for a, b, kind, s in secrets]
        if rows:
            at, *rest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(at)), pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.int64()), pa.array(rest[2]), pa.array(rest[3])], names=names)

    def run(batches):
        for part in _pieces(batches):
            yield from told(part["doc_id"], scan(part["text"].to_pylist(), part["source"].to_pylist(), shared.value))

    def judge(batches):
        for part in _pieces(batches):
            spans = [[*zip(*three, strict=True)] for three in zip(*(part[c].to_pylist() for c in ("starts", "ends", "kinds")), strict=True)]
            x = part["found"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield from told(part["doc_id"], judged(spans, x, shared.value[0]))

    schema = "doc_id long, start long, length long, kind string, score double"
    if kept is None:
        return _texts(documents).mapInArrow(run, schema)
    return kept.select("doc_id", "starts", "ends", "kinds", "found").where(F.size("starts") > 0).mapInArrow(judge, schema)


def redact(documents: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """The documents with each secret replaced by MASK and n_chars, where there is such a column, renewed; rows, other columns and their order stay."""
    shared, _ = _learned(documents, findings, False)

    def run(batches):
        for part in _pieces(batches):
            texts = part["text"].to_pylist()
            found = scan(texts, part["source"].to_pylist(), shared.value)
            sizes = part["n_chars"].to_pylist() if "n_chars" in part.schema.names else [None] * len(texts)
            for n, secrets in enumerate(found):
                for a, b, *_ in reversed(secrets):
                    texts[n] = texts[n][:a] + MASK + texts[n][b:]
                if secrets:
                    sizes[n] = len(texts[n])
            renewed = {c: pa.array(values, part.schema.field(c).type) for c, values in (("text", texts), ("n_chars", sizes)) if c in part.schema.names}
            yield pa.RecordBatch.from_arrays([renewed.get(f.name, part.column(k)) for k, f in enumerate(part.schema)], schema=part.schema)

    return documents.mapInArrow(run, documents.schema)
