"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens as begin, inside or outside of a secret."""

from __future__ import annotations

import bisect
import itertools
import math
import random
import re
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import discard, materialize, prepare
from runlens.llm.shingles import mix

#: Kinds in their order, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
KINDS = [k for k, *_ in BASE] + ["crf"]
_PATTERNS = {k: (re.compile(p, re.ASCII | (re.IGNORECASE if k == "assign" else 0)), group, least) for k, p, group, least in BASE}
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_DIGITS = b"0123456789"
#: Tokens of a text, and the ends of its lines.
_TOKEN = re.compile(r"[A-Za-z0-9_+/=.-]+|[^\sA-Za-z0-9_+/=.-]|\n")
BEGIN, INSIDE, OUTSIDE = range(3)
FEATURES = 4096
#: A token's neighbours that are features of it, and the tokens of a line that the field is fitted to at once, at most.
_NEAR = (-3, -2, -1, 1)
LENGTH = 16
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[A-Za-z0-9_+/=.-]+")

Span = tuple[int, int, str]


def base_spans(text: str, raw: bytes, value: bool = False) -> list[Span]:
    """(start, end, kind) of the fixed patterns, or of their secrets alone (value); raw is the text's UTF-8, in which a quick search tells what can't match."""
    found = []
    low = raw.lower()
    for kind, (pattern, group, least) in _PATTERNS.items():
        if kind == "assign" and not any(w in low for w in _WORDS) or kind == "access" and b"AKIA" not in raw or kind == "hex" and b"\x01" * 32 not in raw.translate(_HEX):
            continue
        found += [(m.start(group if value else 0), m.end(group if value else 0), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: By character: digit, capital, small letter, anything else; and whether it is a hexadecimal digit.
_CLASS = np.array([0 if chr(c) in "0123456789" else 1 if chr(c) in string.ascii_uppercase else 2 if chr(c) in string.ascii_lowercase else 3 for c in range(129)], np.int64)
_HEXES = np.array([chr(c) in "0123456789abcdefABCDEF" for c in range(129)])


def _numbers(kind: int, values: np.ndarray) -> np.ndarray:
    """Features of a kind, by hashed value, below FEATURES."""
    return (mix(values.astype(np.uint64) + np.uint64((kind + 1) << 40)) >> np.uint64(20)).astype(np.int64) % FEATURES


def token_features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each token the features of its shape (length, shares and kinds of characters, entropy, outline), and those that it gives to tokens near it, by _NEAR."""
    codes = np.frombuffer("".join(tokens).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    n = np.array([len(t) for t in tokens], np.int64)
    begins = np.cumsum(n) - n
    of, at = np.repeat(np.arange(len(n)), n), np.arange(len(codes)) - np.repeat(begins, n)
    kinds = _CLASS[np.minimum(codes, 128)]
    total = lambda x: np.add.reduceat(x, begins)
    digits, upper, lower, signs = (total((kinds == k).astype(np.int64)) for k in range(4))
    pairs = np.sort(of << 21 | codes)
    runs = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    sizes = np.diff(np.append(runs, len(pairs)))
    entropy = np.log2(n) - np.bincount(pairs[runs] >> 21, sizes * np.log2(sizes), len(n)) / n
    hexes = total(_HEXES[np.minimum(codes, 128)].astype(np.int64)) == n
    signed = np.where(kinds < 3, kinds, codes + 10)
    turns = np.concatenate(([True], signed[1:] != signed[:-1])) | (at == 0)
    rank = np.cumsum(turns)
    rank -= np.repeat(rank[begins], n)
    spread = lambda x, place: mix((x * 64 + place).astype(np.uint64))
    outline = total(np.where(turns & (rank < 8), spread(signed, rank), np.uint64(0)))
    small = np.where(kinds == 1, codes + 32, codes)
    told = total(np.where(at < 12, spread(small, at), np.uint64(0)))
    told[((n >= 8) & (digits > 0)) | (codes[begins] == 10)] = 0  # tokens of 8 characters or more with a digit are rarely words: as neighbours all are one feature
    mixed = (upper > 0) * 8 + (lower > 0) * 4 + (digits > 0) * 2 + (signs > 0)
    shape = [np.minimum(n // 8, 8), 4 * digits // n, mixed, (entropy + 1e-9).astype(np.int64), hexes * 8 + np.minimum(n // 16, 4), outline, (digits == n) * 16 + np.minimum(n // 4, 8)]
    return np.stack([_numbers(k, v) for k, v in enumerate(shape)], axis=1), np.stack([_numbers(20 + j, told) for j in range(len(_NEAR))], axis=1)


def _file(raw: bytes) -> list[int]:
    """Features of a text: its share of digits, of signs, its length; and one that is always there."""
    n = max(1, len(raw))
    digits, signs = n - len(raw.translate(None, _DIGITS)), n - len(raw.translate(None, b"=:{}();<>$#\"'"))
    return [zlib.crc32(f.encode()) % FEATURES for f in (f"filedigits{min(9, int(math.log2(1 + 1000 * digits / n)))}", f"filesigns{min(9, int(math.log2(1 + 1000 * signs / n)))}", f"filelen{int(math.log10(n))}", "any")]


Known = tuple[dict[str, int], np.ndarray, np.ndarray]


def known(tokens: Iterable[str]) -> Known:
    """token_features of all unlike tokens at once, and where each token's are; those of a line's end among them."""
    unlike = list(dict.fromkeys(("\n", *tokens)))
    return dict(zip(unlike, range(len(unlike)), strict=True)), *token_features(unlike)


def line_features(tokens: list[str], file: list[int], told: Known | None = None) -> list[list[int]]:
    """The features of each token of a line."""
    numbers, own, near = told or known(tokens)
    at = np.array([numbers[t] for t in tokens] + [0])  # 0 is the line's end
    place = np.arange(len(tokens))
    beside = [near[at[np.where((place + d >= 0) & (place + d < len(tokens)), place + d, len(tokens))], j] for j, d in enumerate(_NEAR)]
    return np.concatenate((own[at[:-1]], np.stack(beside, axis=1), np.tile(np.array(file, np.int64), (len(tokens), 1))), axis=1).tolist()


class Field:
    """Weights of features by tag, and of tags by the tag before. A line has an outside tag at both its ends; inside never follows outside."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray) -> None:
        self.emission, self.transition = emission, transition

    def decode(self, features: list[list[int]]) -> list[int]:
        """The most likely tags (Viterbi); ties go to the first of begin, inside, outside."""
        return self.best(np.array([self.emission[f].sum(axis=0) for f in features]))

    def best(self, local: np.ndarray) -> list[int]:
        """The same from each token's sums of weights by tag."""
        scores, back = self.transition[OUTSIDE], []
        for i, own in enumerate(local):
            if i:
                ways = scores[:, None] + self.transition
                back.append(ways.argmax(axis=0))
                scores = ways.max(axis=0)
            scores = scores + own
        tags = [int((scores + self.transition[:, OUTSIDE]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def open_places(self, local: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where a tag other than outside can be best at all; ends marks the ends of lines among the tokens.

        A stretch of begin and inside tags is in the best tags only if it scores no less than outside tags in its
        place. Each token's part in that is bounded, with the dearest step to it and from it; a token that is in no
        stretch whose bounds sum to 0 or more is outside. So the stretches left can be decoded each alone.
        """
        stay = self.transition[OUTSIDE, OUTSIDE]
        steps = self.transition[:, :OUTSIDE].max(axis=0) - stay + np.maximum(0, self.transition[:OUTSIDE, OUTSIDE] - stay)
        gain = (local[:, :OUTSIDE] + steps).max(axis=1) - local[:, OUTSIDE]
        gain[ends] = -1e4
        upto = np.concatenate(([0.0], np.cumsum(gain)))
        before = upto[:-1] - np.minimum.accumulate(upto)[:-1]
        after = np.maximum.accumulate(upto[::-1])[::-1][1:] - upto[1:]
        return np.flatnonzero((before + gain + after >= -1e-4) & ~ends)


class Tagger:
    """Tags of all tokens of texts by a field. Sums of weights are remembered for up to `words` unlike tokens."""

    def __init__(self, field: Field, words: int = 200_000) -> None:
        self.field, self.words = field, words
        self.numbers: dict[str, int] = {}
        self.sums = np.zeros((1024, 1 + len(_NEAR), 3))

    def _numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self.numbers) > self.words:
            self.numbers = {}
        numbers = self.numbers
        new = [t for t in dict.fromkeys(("\n", *tokens)) if t not in numbers]
        if new:
            first = len(numbers)
            numbers.update(zip(new, range(first, first + len(new)), strict=True))
            while first + len(new) > len(self.sums):
                self.sums = np.concatenate((self.sums, np.zeros_like(self.sums)))
            own, near = token_features(new)
            self.sums[first : first + len(new), 0] = sum(self.field.emission[own[:, k]] for k in range(own.shape[1]))
            self.sums[first : first + len(new), 1:] = self.field.emission[near]
        return np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))

    def local(self, tokens: list[str], files: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's sums of weights by tag (those of its text, files, among them), and which tokens are ends of lines."""
        numbers = self._numbers(tokens)
        line_end = self.numbers["\n"]
        ends = numbers == line_end
        line = np.cumsum(ends) - ends
        out = self.sums[numbers, 0] + files
        for j, d in enumerate(_NEAR, 1):
            near = np.full(len(numbers), line_end)
            here, there = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
            near[here] = np.where(line[here] == line[there], numbers[there], line_end)
            out += self.sums[near, j]
        return out, ends

    def spans(self, texts: list[str], raws: list[bytes]) -> list[list[Span]]:
        out: list[list[Span]] = [[] for _ in texts]
        begin = 0
        while begin < len(texts):
            tokens, starts, end = [], [], begin
            while end < len(texts) and len(tokens) < 100_000:
                starts.append(len(tokens))
                tokens += _TOKEN.findall(texts[end])
                tokens.append("\n")
                end += 1
            sizes = np.diff([*starts, len(tokens)])
            files = np.array([self.field.emission[_file(raw)].sum(axis=0) for raw in raws[begin:end]])
            local, ends = self.local(tokens, np.repeat(files, sizes, axis=0))
            places = self.field.open_places(local, ends)
            held, where = -1, []
            for stretch in np.split(places, np.flatnonzero(np.diff(places) != 1) + 1):
                if not len(stretch):
                    continue
                tags = self.field.best(local[stretch])
                if all(t == OUTSIDE for t in tags):
                    continue
                text = int(np.searchsorted(starts, stretch[0], "right")) - 1
                if text != held:
                    held, where = text, [m.span() for m in _TOKEN.finditer(texts[begin + text])]
                own = out[begin + text]
                for at, tag in zip(stretch - starts[text], tags, strict=True):
                    if tag == BEGIN:
                        own.append((*where[at], "crf"))
                    elif tag == INSIDE:
                        own[-1] = (own[-1][0], where[at][1], "crf")
            begin = end
        return out


def fit(runs: list[list[list[int]]], tags: list[list[int]], steps: int = 80, rate: float = 0.3, decay: float = 0.01) -> Field:
    """The field of the highest likelihood less decay * squared weights / 2, by gradient steps over all runs at once (forward and backward sums)."""
    forbidden = np.zeros((3, 3))
    forbidden[OUTSIDE, INSIDE] = -1e4
    emission, transition = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    if not runs:
        emission[:, OUTSIDE] = 1
        return Field(emission, forbidden)
    size, wide = len(runs), max(map(len, runs))
    y, there = np.full((size, wide), OUTSIDE), np.zeros((size, wide), bool)
    for i, (run, own) in enumerate(zip(runs, tags, strict=True)):
        there[i, : len(run)] = True
        y[i, : len(run)] = own
    x = np.array([f for run in runs for f in run])  # of all tokens; they have the same number of features
    deep = x.shape[1]
    total = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
    closed = np.where(np.arange(3) == OUTSIDE, 0.0, -1e4)
    before = np.concatenate((np.full((size, 1), OUTSIDE), y), axis=1)
    after = np.concatenate((y, np.full((size, 1), OUTSIDE)), axis=1)
    seen = np.concatenate((np.ones((size, 1), bool), there), axis=1)
    target = np.zeros((3, 3))
    np.add.at(target, (before[seen], after[seen]), 1)
    speed_e, speed_t = np.zeros_like(emission), np.zeros_like(transition)
    flat = x.ravel()
    for _ in range(steps):
        local = np.where(there[:, :, None], 0, closed) + np.zeros((size, wide, 3))
        weights = emission.astype(np.float32)
        local[there] = sum(weights[x[:, k]] for k in range(deep))
        moves = transition + forbidden
        ahead = [moves[OUTSIDE] + local[:, 0]]
        for t in range(1, wide):
            step = np.where((there[:, t] | there[:, t - 1])[:, None, None], moves, 0)
            ahead.append(total(ahead[-1][:, :, None] + step, 1) + local[:, t])
        behind = [np.where(there[:, -1, None], moves[:, OUTSIDE], 0.0)]
        for t in range(wide - 1, 0, -1):
            step = np.where((there[:, t] | there[:, t - 1])[:, None, None], moves, 0)
            behind.append(total(step + (local[:, t] + behind[-1])[:, None, :], 2))
        behind = behind[::-1]
        whole = total(ahead[-1] + behind[-1], 1)
        missed, grad_t = np.zeros((size, wide, 3)), np.zeros((3, 3))
        for t in range(wide):
            odds = np.exp(ahead[t] + behind[t] - whole[:, None]) * there[:, t, None]
            hit = (np.arange(3) == y[:, t, None]) * there[:, t, None]
            missed[:, t] = hit - odds
            if t == 0:
                grad_t[OUTSIDE] -= odds.sum(axis=0)
            else:
                step = np.where((there[:, t] | there[:, t - 1])[:, None, None], moves, 0)
                pair = np.exp(ahead[t - 1][:, :, None] + step + (local[:, t] + behind[t])[:, None, :] - whole[:, None, None])
                grad_t -= (pair * (there[:, t] | there[:, t - 1])[:, None, None]).sum(axis=0)
        last = there[:, -1]
        grad_t[:, OUTSIDE] -= (np.exp(ahead[-1] + behind[-1] - whole[:, None]) * last[:, None]).sum(axis=0)
        told = missed[there]
        grad_e = np.stack([np.bincount(flat, np.repeat(told[:, tag], deep), FEATURES) for tag in range(3)], axis=1)
        for weight, speed, grad in ((emission, speed_e, grad_e / size), (transition, speed_t, (grad_t + target) / size)):
            grad = grad - decay * weight / size
            speed *= 0.9
            speed += 0.1 * grad**2
            weight += rate * grad / (np.sqrt(speed) + 1e-3)
    return Field(emission, transition + forbidden)


def _tags(places: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """Begin for the first token that meets a span, inside for further ones of the same span; spans that meet count as one."""
    joined: list[list[int]] = []
    for start, end, _ in sorted(spans):
        if joined and start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    out, at, last = [], 0, -1
    for start, end in places:
        while at < len(joined) and joined[at][1] <= start:
            at += 1
        hit = at < len(joined) and joined[at][0] < end
        out.append(OUTSIDE if not hit else INSIDE if at == last else BEGIN)
        last = at if hit else -1
    return out


def pieces(line: str, spans: list[Span], at: int = 0) -> list[tuple[list[str], list[int], int, int]]:
    """A line's tokens and tags, and from where to where at most LENGTH of them are a piece; spans count from the text's begin, the line begins `at`.

    Pieces are cut before a secret rather than in it.
    """
    found = [(at + m.start(), at + m.end(), m[0]) for m in _TOKEN.finditer(line)]
    tokens, tags = [t for _, _, t in found], [OUTSIDE] * len(found)
    if spans:
        tags = _tags([(a, b) for a, b, _ in found], spans)
    begin, out = 0, []
    while begin < len(tokens):
        end = cut = min(begin + LENGTH, len(tokens))
        while begin < cut < len(tokens) and tags[cut] == INSIDE:
            cut -= 1
        end = cut if cut > begin else end
        out.append((tokens, tags, begin, end))
        begin = end
    return out


def piece(tokens: list[str], tags: list[int], begin: int, end: int, file: list[int], told: Known | None = None) -> tuple[list[list[int]], list[int]]:
    """Features and tags of a piece; inside at its begin, from a secret longer than a piece, is begin."""
    low = max(0, begin - 3)
    features = line_features(tokens[low : end + 1], file, told)[begin - low : end - low]
    return features, [BEGIN if i == 0 and t == INSIDE else t for i, t in enumerate(tags[begin:end])]


def made_lines(n: int = 300, seed: int = 7) -> Iterator[tuple[str, list[Span]]]:
    """Lines by rule: random keys in contexts that the fixed patterns don't know, and numbers, addresses and dates that are no secrets."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    letters = string.ascii_letters + string.digits
    for i in range(n):
        key = "".join(rng.choices(letters, k=rng.randrange(20, 44))) + digits(2)
        before = rng.choice(["key: ", "auth = ", 'passphrase = "', "Bearer ", "credentials: ", "private key ", "signature=", "client_id: "])
        plain = rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", digits(16), ".".join(str(rng.randrange(256)) for _ in range(4)), f"user{digits(3)}@mail{digits(1)}.example.com", f"20{digits(2)}-0{rng.randrange(1, 10)}-1{digits(1)}", f"version-{digits(1)}.{digits(2)}.{digits(1)}", f"report_{digits(4)}.pdf", f"http://www.example.org/page{digits(5)}.html"])
        word = rng.choice(["call", "see", "from", "the", "on", "to"])
        yield f"{word} {before}{key}", [(len(word) + 1 + len(before), len(word) + 1 + len(before) + len(key), "crf")]
        yield f"{word} {plain} {rng.choice(['and', 'or', 'then'])}", []
        parts = ["".join(rng.choices(string.ascii_letters, k=rng.randrange(20, 44))), "".join(rng.choices(letters, k=5)) + digits(2), "".join(rng.choices(letters, k=16)) + ":" + "".join(rng.choices(letters, k=16))]
        yield f"{word} {before}{parts[i % 3]}", [(len(word) + 1 + len(before), len(word) + 1 + len(before) + len(parts[i % 3]), "crf")]


def learn(docs: DataFrame, runs: int = 1000, longest: int = 4096) -> Field:
    """A field fitted to what the fixed patterns tag, and to made_lines.

    The sample it is fitted to: of the lines of all documents of at most `longest` bytes, up to `runs` with a secret, as many without one but with a
    long token that has a digit, and as many others, those of the least hashes; of each line a piece of at most LENGTH
    tokens (that with the first secret, else one by the hash), with features from the whole line. A task tells no more
    than that, so the driver gets three times `runs` lines. Scanning isn't bounded so: it takes all tokens of all lines.
    Repeated lines count once; null and empty texts have none.
    """
    prepare(docs.sparkSession)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[int, tuple]] = [{}, {}, {}]
        most = [1 << 32] * 3
        for batch in batches:
            for text in batch.column(0).to_pylist():
                raw = text.encode()
                spans, file, at, reached = base_spans(text, raw, value=True), None, 0, 0
                digits = bool(_DIGIT.search(text))
                for line in raw.split(b"\n"):
                    turn, kind = zlib.crc32(line), 2
                    if spans:
                        begin, at = at, at + len(line.decode()) + 1
                        while reached < len(spans) and spans[reached][1] <= begin:
                            reached += 1
                        kind = 0 if reached < len(spans) and spans[reached][0] < at - 1 else 2
                    if kind and turn >= most[2] and not (digits and turn < most[1]) or len(line) > longest:
                        continue
                    shown = line.decode()
                    if kind and digits and any(len(t) >= 8 and _DIGIT.search(t) for t in _WORD.findall(shown)):
                        kind = 1
                    if turn >= most[kind] or turn in held[kind] or not shown.strip():
                        continue
                    own = [(max(a, begin) - begin, min(b, at - 1) - begin) for a, b, _ in spans[reached:] if a < at - 1] if kind == 0 else []
                    file = file or _file(raw)
                    held[kind][turn] = (shown, [{"start": a, "end": b} for a, b in own], file)
                    if len(held[kind]) >= 2 * runs:
                        held[kind] = dict(sorted(held[kind].items())[:runs])
                        most[kind] = max(held[kind]) + 1
        rows = [(kind, turn, *held[kind][turn]) for kind in range(3) for turn in sorted(held[kind])[:runs]]
        for i in range(0, len(rows), 1000):
            columns = zip(*rows[i : i + 1000], strict=True)
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "turn", "line", "spans", "file"])

    every = docs.where("text IS NOT NULL").select(F.col("text").cast("string")).mapInArrow(sample, "kind int, turn long, line string, spans array<struct<start:long,end:long>>, file array<int>")
    written = materialize(every, "secret-lines")
    first = Window.partitionBy("kind", "turn").orderBy("line", "file")
    once = written.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    once = materialize(once.select("kind", "turn", F.shiftright("turn", 20).alias("part"), "line", "spans", "file"), "secret-lines-once")
    counts = {(r["kind"], r["part"]): r["n"] for r in once.groupBy("kind", "part").agg(F.count("*").alias("n")).collect()}
    taken = []
    for k in range(3):
        upto = itertools.accumulate(counts.get((k, part), 0) for part in range(1 << 12))
        cut = next((part for part, n in enumerate(upto) if n >= runs), 1 << 12)  # beyond it no line can be among the first, so none is sent
        taken += once.where((F.col("kind") == k) & (F.col("part") <= cut)).orderBy("turn").limit(runs).collect()
    shown = [(r["line"], [(s["start"], s["end"], "") for s in r["spans"]], r["file"], r["turn"]) for r in taken]
    discard(written, once)
    chosen = []
    for line, spans, file, turn in shown:
        cuts = pieces(line, spans)
        if cuts:
            chosen.append((next((c for c in cuts if any(t != OUTSIDE for t in c[1][c[2] : c[3]])), cuts[turn % len(cuts)]), file))
    chosen += [(cut, _file(line.encode())) for line, spans in made_lines() for cut in pieces(line, spans)]
    told = known(t for (tokens, *_), _ in chosen for t in tokens)
    xs, ys = zip(*(piece(*cut, file, told) for cut, file in chosen), strict=True)
    return fit(list(xs), list(ys))


def apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that meet none of base, which is in order of starts."""
    starts, reach = [b[0] for b in base], list(itertools.accumulate((b[1] for b in base), max))
    return [s for s in spans if not (i := bisect.bisect_left(starts, s[1])) or reach[i - 1] <= s[0]]


def scan_secrets(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans) for each row of docs: spans of (kind, start, end) in code points, by start and then kind.

    Kinds assign, access and hex are the fixed patterns' matches, each found from left to right without overlaps of
    its own kind, those with too short a secret dropped after matching; crf are spans of the field that meet none of
    them. Spans of one start are in the order of KINDS. Null text counts as empty and has no span; repeated rows give a
    row each; an empty table gives an empty one; other columns are left out.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            out = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            raws = [t.encode() for t in texts]
            for text, raw, tagged in zip(texts, raws, tagger.spans(texts, raws), strict=True):
                base = base_spans(text, raw)
                own = apart(tagged, base)
                out.append([{"kind": k, "start": a, "end": b} for a, b, k in sorted(base + own, key=lambda s: (s[0], KINDS.index(s[2])))])
            spans = pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, spans: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the text inside spans (doc_id, spans; one row for each doc_id) replaced by mark; overlapping spans become one mark."""
    told = spans.where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"))
    whole = docs.join(told, docs["doc_id"] == told["_id"], "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda a, s: F.substr(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(F.struct(F.concat(a["out"], piece(a, s), F.lit(mark)).alias("out"), s["end"].alias("at")))
    done = F.aggregate("_spans", start, step, lambda a: F.concat(a["out"], F.substr(F.col("text"), (a["at"] + 1).cast("int"))))
    return whole.select(*[F.when(F.col("_spans").isNull(), docs["text"]).otherwise(done).alias("text") if c == "text" else docs[c] for c in docs.columns])
