"""Personal data: exact patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole candidate segments of up to MOST_TOKENS tokens by features of the segment, and
a dynamic programme over the tokens chooses boundaries and kinds together. It learns from a bounded
sample of documents in which the patterns mark the segments. Each marked piece is also learned from with
a segment respelled in ways that no pattern takes, and with something harmless (a date, a version, an
amount) in its place, so that the field goes beyond the patterns that teach it.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import hash_sample, small_batches

Example = tuple[str, list[tuple[int, int]], set[tuple[int, int, int]]]
KINDS = ("email", "ip", "card", "phone", "secret")
#: Tokens of a segment, characters of a token that is not split at punctuation, documents to learn from, and rounds.
MOST_TOKENS, MOST_LETTERS, SAMPLE_DOCS, EPOCHS, RATE = 7, 120, 12_000, 4, 0.2
#: Pieces of islands that the field learns from, taken in turns from all sampled texts.
SAMPLE_ISLANDS = 3000
#: Tokens of a piece of an island to learn from.
PIECE = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NUMERIC_RUN = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Only for learning: shapes of secrets.
SECRET = re.compile(r"(?:AKIA[0-9A-Z]{16}|(?:password|passwd|secret|token|api_key)\s?=\s?\"?[0-9A-Za-z]{8,64}\"?)")
#: An @ and a spelled-out one take the next token with them.
HINT = re.compile(r"[0-9]|(?:@|[(\[{<]\x20?(?:at|AT|dot|DOT)\x20?[)\]}>])(?:\x20\S)?")
#: What else an island starts at, and the words, lower-cased, of which such a place holds one.
KEYWORD = re.compile(r"(?i:password|passwd|secret|token|api[_-]?key)[\"']?\s?[=:]\s?[\"']?\S?|AKIA[0-9A-Z]{16}")
WORDS = ("password", "passwd", "secret", "token", "api", "akia")
UNSPACED, PART = re.compile(r"\S+"), re.compile(r"[A-Za-z0-9._%+@=-]+")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, searched from each @ so that long runs of letters cost no more than their length."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in NUMERIC_RUN.finditer(text):
        if run.group().count(".") >= 3:
            for m in IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                    yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(number := digits(m.group())) <= 19 and luhn(number):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits(m.group())) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns, by start and kind."""
    return sorted(((s, e, k) for k, find in enumerate((emails, addresses, cards, phones)) for s, e in find(text)), key=lambda x: (x[0], x[2]))


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The tokens of a run without white space: the run itself, or what punctuation leaves of a long one."""
    return [(start, end)] if end - start <= MOST_LETTERS else [m.span() for m in PART.finditer(text, start, end)]


def hints(text: str) -> Iterator[tuple[int, int]]:
    """Places of digits, @ and secret keywords (these up to the first character of their value), by start."""
    low, found = text.lower(), (m.span() for m in HINT.finditer(text))
    return heapq.merge(found, (m.span() for m in KEYWORD.finditer(text))) if any(w in low for w in WORDS) else found


def islands(text: str) -> Iterator[list[tuple[int, int]]]:
    """Whole runs of neighbouring tokens (start, end) with a hint, and up to two tokens of the same line before each; no two share a token."""
    done, run = 0, []
    for start, high in hints(text):
        if high <= done:
            continue
        start = max(start, done)
        while start > done and not text[start - 1].isspace():
            start -= 1
        while high < len(text) and not text[high].isspace():
            high += 1
        found = [x for m in UNSPACED.finditer(text, start, high) for x in parts(text, *m.span())]
        if not (run and found and start - run[-1][1] <= 1):
            found = widened(text, start, done) + found
        done = high
        for token in found:
            gap = text[run[-1][1] : token[0]] if run and token[0] - run[-1][1] <= 3 else None
            if gap is None or len(gap) > 1 and any(c.isspace() for c in gap):
                if run:
                    yield run
                run = []
            run.append(token)
    if run:
        yield run


def widened(text: str, start: int, free: int) -> list[tuple[int, int]]:
    """Up to two tokens of the same line before start, none of them before free."""
    tokens: list[tuple[int, int]] = []
    while len(tokens) < 2 and start - 1 > free and text[start - 1] == " ":
        end = start = start - 1
        while start > free and not text[start - 1].isspace():
            start -= 1
        if start == end:
            break
        tokens = parts(text, start, end) + tokens
    return tokens[-2:]


def pieces(text: str) -> Iterator[list[tuple[int, int]]]:
    """Islands to learn from: long ones in pieces, each after the last tokens of the one before."""
    for tokens in islands(text):
        for i in range(0, len(tokens), PIECE):
            yield tokens[max(0, i - MOST_TOKENS + 1) : i + PIECE]


def bounds(text: str, start: int, end: int) -> tuple[int, int]:
    """A segment without punctuation at its ends, but for a plus before it."""
    while start < end and not (text[start].isalnum() or text[start] == "+"):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


NUMBERS, MARKS, VALUE = re.compile("[0-9]+"), re.compile("[A-Za-z0-9]+"), re.compile("[A-Za-z0-9+/_-]+")
SAID = re.compile(r"(?i)[(\[{<]\x20?(?:at|dot)\x20?[)\]}>]")
NAMED = re.compile(r"(?i)pass|pwd|secret|token|key|auth|bearer|credential")
#: Brackets and quotes of all kinds are one to the features.
ALIKE = str.maketrans("[{<]}>'`", '((()))""')
SHAPES = ((re.compile("[A-Z]+"), "A"), (re.compile("[a-z]+"), "a"), (re.compile("[0-9]+"), "9"), (re.compile(r"\s+"), " "))


def segment_features(piece: str, tokens: int, before: str) -> list[str]:
    """Features of a whole segment."""
    number = digits(piece)
    piece = piece.translate(ALIKE)
    shape = piece
    for pattern, name in SHAPES:
        shape = pattern.sub(name, shape)
    n = len(number)
    groups = "-".join(str(min(5, len(g))) for g in NUMBERS.findall(piece)[:6])
    marks = "".join(sorted(set(MARKS.sub("", piece))))[:6]
    found = ["bias", f"groups{groups}", f"marks{marks}", f"digits{min(n, 20)}marks{marks}", f"tokens{tokens}", f"shape{shape[:24]}", f"digits{min(n, 20)}", f"length{min(12, len(piece) // 4)}", f"first{piece[:1] if not piece[:1].isalnum() else 'x'}", f"dots{min(4, piece.count('.'))}", f"before{before[-12:].lower()}"]
    if "@" in piece:
        found.append("at")
    if piece.startswith("+"):
        found.append("plus")
    if 14 <= n <= 19:
        found.append(f"luhn{luhn(number)}")
    if "=" in piece:
        found.append("equals")
    if n and re.fullmatch(r"[0-9a-f]{12,}|[0-9A-Z]{16,}", piece.rpartition("=")[2].strip(" \"")):
        found.append("key")
    if not n and "@" not in piece and not SAID.search(piece):
        found.append("plain")
    found.append(f"density{int(5 * n / max(1, len(piece)))}")
    if SAID.search(piece):
        found += [f"said{min(3, len(SAID.findall(piece)))}", f"said:tokens{tokens}"]
    named = NAMED.search(piece)
    if named:
        value = max(len(x) for x in VALUE.findall(piece[named.end() :]) or [""])
        found += ["named", f"named:at{min(2, named.start())}", f"named:value{min(8, value // 4)}", f"named:digits{n > 0}:tokens{tokens}"]
    long = max(map(len, VALUE.findall(piece)), default=0)
    found.append(f"long{min(8, long // 6)}:{n > 2}")
    return found


class Field:
    """Weights of features for each kind; tokens outside of segments score 0."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        self.weights = weights or {}

    def ending(self, text: str, tokens: list[tuple[int, int]], j: int) -> Iterator[tuple[int, int, int, int, list[str]]]:
        """(first token, last token, start, end, features) of the candidates of an island that end with token j."""
        first = j
        while first > max(0, j - MOST_TOKENS + 1) and "\n" not in text[tokens[first - 1][0] : tokens[first][0]]:
            first -= 1
        for i in range(first, j + 1):
            start, end = bounds(text, tokens[i][0], tokens[j][1])
            if end - start >= 5:
                yield i, j, start, end, segment_features(text[start:end], j - i + 1, text[slice(*tokens[i - 1])] if i else "")

    def segments(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, int, list[str]]]:
        """All candidates of an island by first and last token."""
        return sorted((s for j in range(len(tokens)) for s in self.ending(text, tokens, j)), key=lambda s: s[:2])

    def score(self, features: list[str]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                total += w
        return total

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, kind) of the best segmentation."""
        top, back = [0.0] + [0.0] * len(tokens), [None] * (len(tokens) + 1)
        for j in range(len(tokens)):
            top[j + 1] = top[j]
            for i, _, start, end, features in self.ending(text, tokens, j):
                score = self.score(features)
                k = int(score.argmax())
                if top[i] + score[k] > top[j + 1]:
                    top[j + 1], back[j + 1] = top[i] + score[k], (i, start, end, k)
        out, j = [], len(tokens)
        while j:
            if back[j] is None:
                j -= 1
            else:
                j, *found = back[j]
                out.append(tuple(found))
        return out[::-1]

    def learn(self, examples: list[Example], epochs: int, rate: float, order: np.random.Generator) -> None:
        """Climb the log-likelihood of the marked segmentations, one example (text, tokens, marks) after another, by forward and backward sums over all segmentations."""
        names: dict[str, int] = {}
        ready = []
        for text, tokens, gold in examples:
            segments = self.segments(text, tokens)
            if segments:
                ids = np.array([names.setdefault(f, len(names)) for s in segments for f in s[4]])
                sizes = np.array([len(s[4]) for s in segments])
                marks = np.array([[(s[2], s[3], k) in gold for k in range(len(KINDS))] for s in segments], float)
                ready.append((len(tokens), [s[0] for s in segments], [s[1] for s in segments], ids, sizes, np.cumsum(sizes) - sizes, marks))
        weights = np.zeros((len(names), len(KINDS)))
        for f, w in self.weights.items():
            if f in names:
                weights[names[f]] = w
        for epoch in range(epochs):
            for x in order.permutation(len(ready)):
                n, first, last, ids, sizes, begin, marks = ready[x]
                scores = np.add.reduceat(weights[ids], begin, axis=0)
                step = marks - expected(n, first, last, scores)
                np.add.at(weights, ids, rate / (1 + epoch) * np.repeat(step, sizes, axis=0))
        self.weights.update({f: weights[i] for f, i in names.items()})


def expected(n: int, first: list[int], last: list[int], scores: np.ndarray) -> np.ndarray:
    """The probability of every segment (its first and last of n tokens) with each kind, over all segmentations."""
    top = scores.max(axis=1)
    merged = (top + np.log(np.exp(scores - top[:, None]).sum(axis=1))).tolist()
    by_end: list[list[int]] = [[] for _ in range(n)]
    by_start: list[list[int]] = [[] for _ in range(n)]
    for x, (i, j) in enumerate(zip(first, last)):
        by_end[j].append(x)
        by_start[i].append(x)
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(n):
        ahead[j + 1] = summed([ahead[j], *(ahead[first[x]] + merged[x] for x in by_end[j])])
    for i in range(n - 1, -1, -1):
        behind[i] = summed([behind[i + 1], *(behind[last[x] + 1] + merged[x] for x in by_start[i])])
    around = np.array([ahead[i] + behind[j + 1] - ahead[n] for i, j in zip(first, last)])
    return np.exp(np.minimum(0, scores + around[:, None]))


def summed(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def marked(text: str) -> set[tuple[int, int, int]]:
    """What the patterns, and those of secrets, mark for learning."""
    return set(base_spans(text)) | {(*bounds(text, *m.span()), len(KINDS) - 1) for m in SECRET.finditer(text)}


def respelled(piece: str, kind: int, random: np.random.Generator) -> str:
    """A span of a kind in a spelling that the patterns don't take."""
    pick = lambda *x: x[int(random.integers(len(x)))]
    if kind == 0:
        local, _, domain = piece.partition("@")
        at = pick(" (at) ", " [at] ", "(at)", " @ ", "[at]", " {at} ")
        return local + at + domain.replace(".", pick(".", ".", " (dot) ", "[dot]", " [dot] "))
    if kind == 1:
        return piece.replace(".", pick(" . ", "[.]", "(.)", "-", " [dot] ", "[dot]"))
    number = digits(piece)
    if kind == 2:
        return pick(".", "/", "_", "  ", ".", " - ").join(number[i : i + 4] for i in range(0, len(number), 4))
    if kind == 3:
        number = number[-10:] if pick(True, True, False) else number
        head, a, b = number[:-7], number[-7:-4], number[-4:]
        mark = pick(" ", "-", ".", "/")
        return pick(f"({head}) {a}{mark}{b}", f"{head}{mark}{a}{mark}{b}", f"00{head}{mark}{a}{mark}{b}", f"tel:{head}{mark}{a}{mark}{b}", f"{head}{mark}{a}{b}")
    value = max(VALUE.findall(piece), key=len)
    if pick(True, False):
        letters = pick("abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
        value = "".join(letters[i] for i in random.integers(len(letters), size=int(random.integers(8, 41))))
    quote = pick("", "", '"', "'")
    return pick("pwd", "auth_token", "client_secret", "private_key", "api key", "bearer", "access-key", "passphrase", "credential") + pick(": ", " : ", "=", " => ", ":", " is ", " ") + quote + value + quote


def harmless(random: np.random.Generator) -> str:
    """A date, time, version, amount, range or another number that is nobody's."""
    n = lambda low, high: int(random.integers(low, high))
    return (
        f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 32):02}", f"{n(1, 32)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", f"v{n(0, 20)}.{n(0, 30)}.{n(0, 99)}", f"{n(1, 999)},{n(0, 999):03}.{n(0, 99):02}",
        f"{n(1, 900)}-{n(1, 900)}", f"{n(0, 100)} % of {n(0, 10**6)}", f"{n(0, 10**9)}", f"{n(1900, 2100)} and {n(1900, 2100)}", f"{n(1, 99)} x {n(1, 99)} x {n(1, 99)}", f"chapter {n(1, 99)}.{n(1, 99)}", f"the key {n(1, 99)} to room {n(1, 999)}", f"{n(1, 9)} 000 {n(100, 999)}", f"@ {n(1, 99)} each",
    )[n(0, 14)]


def taught(text: str, tokens: list[tuple[int, int]], gold: set[tuple[int, int, int]], random: np.random.Generator) -> Iterator[Example]:
    """The examples of a piece: itself and, if something is marked, it with one mark respelled twice, and with something harmless instead."""
    yield text, tokens, gold
    if not gold:
        return
    s, e, k = sorted(gold)[int(random.integers(len(gold)))]
    for new, kind in ((respelled(text[s:e], k, random), k), (respelled(text[s:e], k, random), k), (harmless(random), None)):
        changed, step = text[:s] + new + text[e:], len(new) - (e - s)
        marks = {(a + step * (a >= e), b + step * (a >= e), c) for a, b, c in gold if b <= s or a >= e}
        if kind is not None:
            marks.add((*bounds(changed, s, s + len(new)), kind))
        for found in islands(changed):
            low, high = found[0][0], found[-1][1]
            yield changed[low:high], [(a - low, b - low) for a, b in found], {(a - low, b - low, c) for a, b, c in marks if low <= a and b <= high}


def sample_pieces(docs: DataFrame, most: int, seed: int) -> DataFrame:
    """(turn, draw, text, tokens, gold) of pieces of islands of docs' texts, cut on the executors; turn counts a text's pieces in random order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                order = np.random.default_rng([seed, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))])
                found, gold = list(pieces(text)), marked(text)
                rows = []
                for turn, i in enumerate(order.permutation(len(found))[:most]):
                    low, high = found[i][0][0], found[i][-1][1]
                    tokens = [x - low for t in found[i] for x in t]
                    rows.append((turn, float(order.random()), text[low:high], tokens, [x for s, e, k in sorted(gold) if low <= s and e <= high for x in (s - low, e - low, k)]))
                kinds = (pa.int32(), pa.float64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], ["turn", "draw", "text", "tokens", "gold"])

    return docs.select("text").mapInArrow(run, "turn int, draw double, text string, tokens array<int>, gold array<int>")


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 9) -> Field:
    """A field learned from about sample_docs documents, chosen by the hash of doc_id and text.

    Of their islands at most SAMPLE_ISLANDS pieces of some tokens reach the driver: of every text a random
    one, then of every text another, and so on.
    """
    small_batches(docs.sparkSession)
    chosen = hash_sample(docs.select("doc_id", "text"), sample_docs, "doc_id", "text", seed=seed).where(F.col("text").rlike(r"(?i)[0-9@]|password|passwd|secret|token|api[_-]?key|akia|[(\[{<] ?(?:at|dot) ?[)\]}>]"))
    rows = sample_pieces(chosen, SAMPLE_ISLANDS, seed).orderBy("turn", "draw", "text").limit(SAMPLE_ISLANDS).collect()
    field, order = Field(), np.random.default_rng(seed)
    pairs = lambda x, n: [tuple(x[i : i + n]) for i in range(0, len(x), n)]
    examples = [x for r in rows for x in taught(r.text, pairs(r.tokens, 2), set(pairs(r.gold, 3)), order)]
    field.learn(examples, EPOCHS, RATE, order)
    return field


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' spans, and these with the field's spans that overlap none of them."""
    base = base_spans(text)
    taken = sorted((s, e) for s, e, _ in base)
    starts = np.array([s for s, _ in taken])
    reach = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else starts
    more = []
    for tokens in islands(text):
        for s, e, k in field.best(text, tokens):
            at = int(np.searchsorted(starts, e))
            if not at or reach[at - 1] <= s:
                more.append((s, e, k))
    return base, sorted({*base, *more}, key=lambda x: (x[0], x[2], x[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_pii(docs: DataFrame, field: Field) -> DataFrame:
    """Personal data of every whole text.

    docs needs doc_id and text; other columns are unread. Returns one row per input row: doc_id, n_email,
    n_ip, n_card, n_phone (pattern matches), base_sha256 (of these as kind:start:end, comma-joined), spans
    (these and the field's, as the same kind of string), n_spans (their number) and masked (the text with
    [KIND] for each span that no earlier one overlaps). Offsets are code points. A null or empty text has no
    spans; rows that repeat are alike; an empty table gives none. Of segmentations with equal scores the
    one is taken that leaves the last token outside or, else, has the longest last segment; of equal kinds
    the first.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field.weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(shared.value)
        for batch in batches:
            counts, digests, spans, sizes, masks = [], [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base, found = all_spans(text, model)
                counts.append([sum(1 for b in base if b[2] == k) for k in range(4)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
                sizes.append(len(found))
                out, at = [], 0
                for s, e, k in found:
                    if s >= at:
                        out += [text[at:s], f"[{KINDS[k].upper()}]"]
                        at = e
                masks.append("".join([*out, text[at:]]))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(sizes, pa.int64()), pa.array(masks, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "masked"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, masked string")
