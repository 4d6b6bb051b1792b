"""Secret scan: three fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags every word of a text as secret begin, inside or outside from its shape, its neighbours, the nearest hint
(password, bearer, key ...) among the REACH words before and features of the whole text, decoded by Viterbi over all words.
Features are codes counted in numpy over groups of texts, and scores are sums of table rows. Where a bound over all paths
proves that the best one is outside, the chain falls apart, so Viterbi runs in Python only between such words; the result
is that of the whole chain (see settled).

It is trained on made-up lines (a fixed random seed) and on a sample of at most SAMPLE documents of the corpus (those of at
most LONGEST characters with the smallest hashes of their doc_id, so a repeated run learns the same), labelled by the fixed
patterns with their keywords hidden half of the time: from it come the words within MARGIN of a labelled secret and at most
QUIET stretches of QUIET_WORDS words without one, drawn from all places of the sample.

Edge cases: a null text counts as empty and has no spans; overlapping kinds all stay; a field's span that touches a
fixed one is not repeated; repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import null_safe_texts, release, small, table

SAMPLE = 2_000
#: Documents with more characters are scanned but not learnt from, so the sample has a bound in characters too.
LONGEST = 20_000
#: Stretches without a secret that are learnt from, their words, and the words learnt from on both sides of a secret.
QUIET, QUIET_WORDS, MARGIN = 1_500, 20, 8
REACH = 6
#: Characters of text whose words are coded at a time; a longer word is not cut.
PIECE = 1 << 18
#: Far above the rounding of a sum of scores, far below what one feature adds.
SLACK = 1e-6
EPOCHS = 6
SEED = 11
MASK = "[SECRET]"

# The patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "crf")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
OUT, BEGIN, INSIDE = 0, 1, 2
HINTS = ("passphrase", "password", "passwd", "secret", "token", "key", "credential", "auth", "bearer", "private", "pwd", "login", "access")
HINT = re.compile("|".join(HINTS), re.I | re.A)
GAP = re.compile(r"[\x20\x09-\x0D]")
#: Features of a word alone and how many values each has, then those of its place among the others.
SHAPE = {"len": 17, "digits": 5, "upper": 5, "mixed": 4, "changes": 7, "distinct": 9, "hex": 4, "plain": 2, "sep": 2, "at": 2, "url": 2, "assigned": 2, "hinted": 4, "number": 2, "consonants": 7, "vowels": 18, "letters": 18}
SIDES = ("<", "<<", ">")
PLACES, LENGTHS = 2 * REACH + 1, 9
#: The side code of no word at all.
NOTHING = 4
DIGIT, UPPER, LOWER, LETTER, HEXED, PLAIN, SEPARATOR, NUMERIC, CONSONANT, VOWEL, EDGE, LOOSE, ODD, SPACE = (1 << k for k in range(14))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@lru_cache(1)
def classes() -> np.ndarray:
    """The classes of every code point."""
    out = np.zeros(0x110000, np.uint16)
    for code in range(0x110000):
        if (c := chr(code)).isalnum():
            out[code] = DIGIT * c.isdigit() | UPPER * c.isupper() | LOWER * c.islower() | LETTER * c.isalpha()
    for kind, chars in ((HEXED, "0123456789abcdefABCDEF"), (NUMERIC, "0123456789.,:/+-"), (SEPARATOR, "-/."), (EDGE, ".,;:!?()[]{}\"'"), (LOOSE, ".,;!?()[]{}\"'"), (ODD, "0123456789=:_+/@"), (SPACE, " \t\n\x0b\x0c\r"), (CONSONANT, "bcdfghjklmnpqrstvwxz"), (VOWEL, "aeiouy")):
        out[list(map(ord, chars + chars.upper() if kind >= CONSONANT else chars))] |= kind
    out[[c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_.=-"]] |= PLAIN
    return out


class Words:
    """Starts, ends and feature codes of the words of a text, which may be several that gaps divide."""

    def __init__(self, text: str):
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = classes()[chars]
        gap = kind & SPACE != 0
        edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
        self.start, self.end = start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        flag = lambda bits: kind & bits != 0

        def counter(marks):
            total = np.zeros(len(marks) + 1, np.int32)
            np.cumsum(marks, out=total[1:])
            return lambda a, b: total[b] - total[a]

        def trimmed(bits):
            """The words less such characters at both ends; empty ones end where they start."""
            other = np.flatnonzero(~flag(bits | SPACE))
            a, b = np.searchsorted(other, start), np.searchsorted(other, end)
            some, other = a < b, np.append(other, 0)
            return np.where(some, other[a], start), np.where(some, other[b - 1] + 1, start)

        a, b = trimmed(EDGE)  # the core: [a, b)
        cuts = (chars == 58) | (chars == 61)
        place = np.append(np.flatnonzero(cuts), 0)
        before = np.searchsorted(place[:-1], b) - 1
        after = np.where((before >= 0) & (place[before] >= a), place[before] + 1, a)  # behind the last : or =, less quotes
        bare = np.append(np.flatnonzero((chars != 34) & (chars != 39)), len(chars))
        v = bare[np.searchsorted(bare[:-1], after)]
        v = np.where(v < b, v, a)  # the value: [v, b)
        n, m = b - v, b - a
        least = lambda x: np.maximum(x, 1)
        digits, upper, lower = (counter(flag(k))(v, b) for k in (DIGIT, UPPER, LOWER))
        turn = np.zeros(len(chars), bool)
        turn[1:] = (kind[1:] ^ kind[:-1]) & (DIGIT | UPPER) != 0
        changes = np.where(n > 0, counter(turn)(np.minimum(v + 1, b), b), 0)
        spans = np.stack((v, b), 1).ravel()
        low = np.append(chars & 127, 0).astype(np.uint64)
        bit = np.uint64(1) << (low & np.uint64(63))
        some = lambda x: np.bitwise_or.reduceat(x, spans)[::2] if len(spans) else np.empty(0, np.uint64)
        distinct = np.where(n > 0, sum(np.bitwise_count(some(np.where(half, bit, np.uint64(0)))).astype(np.int64) for half in (low < 64, low >= 64)), 0)
        whole = lambda k, x, y: (counter(~flag(k))(x, y) == 0) & (y > x)
        url = np.zeros(len(chars), bool)
        url[:-2] = (chars[:-2] == 58) & (chars[1:-1] == 47) & (chars[2:] == 47)
        at = np.arange(1, len(chars) + 1)
        run = np.append(at - np.maximum.accumulate(np.where(flag(CONSONANT), 0, at)), 0)
        runs = np.maximum.reduceat(run, np.stack((start, end), 1).ravel())[::2] if len(start) else np.empty(0, np.int64)
        self.hint = np.zeros(len(start), np.int64)  # 0: none, 1: a hint, 2: a passphrase, which may be several words
        for found in HINT.finditer(text):
            i = int(np.searchsorted(start, found.start(), "right")) - 1
            self.hint[i] = self.hint[i] or (2 if found[0].lower() == "passphrase" else 1)
        hinted, long = self.hint > 0, n >= 8
        values = {
            "len": np.minimum(n, 64) // 4, "digits": 4 * digits // least(n), "upper": 4 * upper // least(n), "mixed": (digits > 0) * 1 + (upper > 0) + (lower > 0),
            "changes": np.minimum(6, 8 * changes // least(n)), "distinct": np.minimum(8, 8 * distinct // least(n)), "hex": 2 * whole(HEXED, v, b) + (n >= 12), "plain": whole(PLAIN, v, b), "sep": counter(flag(SEPARATOR))(v, b) > 2,
            "at": counter(chars == 64)(a, b) > 0, "url": counter(url)(a, np.maximum(a, b - 2)) > 0, "assigned": counter(cuts)(a, np.maximum(a, b - 1)) > 0, "hinted": 2 * hinted + long, "number": whole(NUMERIC, a, b),
            "consonants": np.minimum(6, runs), "vowels": 2 * (8 * counter(flag(VOWEL))(a, b) // least(m)) + long, "letters": 9 * whole(LETTER, a, b) + np.minimum(n, 32) // 4,
        }
        self.shape = np.stack([values[k].astype(np.int64) for k in SHAPE])
        x, y = trimmed(LOOSE)
        self.side = hinted + 2 * ((y > x) & np.append(cuts, False)[y - 1]) + NOTHING * (y == x)
        self.length = np.minimum(end - start, 32) // 4
        self.odd = counter(flag(ODD))(start, end) > 0

    def codes(self, first: np.ndarray) -> np.ndarray:
        """A row a feature, a column a word; first: the places of the texts' first words."""
        n = len(self.start)
        rank = np.arange(n) - (first[np.searchsorted(first, np.arange(n), "right") - 1] if n else 0)  # place within its text

        def back(x, k, none):
            out = np.full(n, none)
            out[k:] = np.where(rank[k:] >= k, x[: max(0, n - k)], none)
            return out

        place = np.zeros(n, np.int64)
        for k in range(REACH - 1, -1, -1):
            hint = back(self.hint, k + 1, 0)
            place = np.where(hint > 0, 2 * k + hint, place)
        after = np.full(n, NOTHING)
        after[:-1] = np.where(rank[1:] > 0, self.side[1:], NOTHING)
        return np.concatenate((self.shape, [back(self.side, 1, NOTHING), back(self.side, 2, NOTHING), after, place, LENGTHS * (place > 0) + self.length]))


def names_of(feature: int, code: int) -> list[str]:
    """What a code stands for."""
    if feature < len(SHAPE):
        return [f"{list(SHAPE)[feature]}{code}"]
    feature -= len(SHAPE)
    if feature < len(SIDES):
        return [f"{SIDES[feature]}{what}{code >> k & 1}" for k, what in enumerate(("hint", "colon", "none"))]
    return [f"near{code}" if feature == len(SIDES) else f"length{code}"]


SIZES = (*SHAPE.values(), *[8] * len(SIDES), PLACES, 2 * LENGTHS)


def pieces(text: str):
    """(spans, codes, odd) of a long text's words, some at a time, each coded with the REACH words before and the one after."""
    at = back = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE)
        stop = gap.start() if gap else len(text)
        after = WORD.search(text, stop)
        words = Words(text[back : after.end() if after else stop])
        start, end = words.start + back, words.end + back
        own = (start >= at) & (start < stop)
        yield np.stack((start, end), 1)[own], words.codes(np.zeros(1, np.int64))[:, own], words.odd[own]
        upto = np.flatnonzero(start < stop)
        back = int(start[upto[-REACH:][0]]) if len(upto) else stop
        at = stop


def coded(texts: list[str]):
    """(spans, codes, odd) of all words of each text; short texts are coded together."""
    lo = 0
    while lo < len(texts):
        if len(texts[lo]) > PIECE:
            some = list(pieces(texts[lo]))
            yield tuple(np.concatenate(x, axis) for x, axis in zip(zip(*some), (0, 1, 0)))
            lo += 1
            continue
        hi, size = lo, 0
        while hi < len(texts) and size + len(texts[hi]) <= PIECE:
            size += len(texts[hi]) + 1
            hi += 1
        begin = np.cumsum([0, *(len(x) + 1 for x in texts[lo:hi])])
        words = Words("\n".join(texts[lo:hi]))
        bound = np.searchsorted(words.start, begin)
        codes = words.codes(np.unique(bound[:-1]))
        for a, b, offset in zip(bound[:-1].tolist(), bound[1:].tolist(), begin.tolist()):
            yield np.stack((words.start[a:b], words.end[a:b]), 1) - offset, codes[:, a:b], words.odd[a:b]
        lo = hi


def file_features(text: str, odd: int) -> tuple[str, ...]:
    """Features of the whole text: how much of it looks like code or settings, and its words that look like no prose."""
    marks = text.count("=") + text.count("{") + text.count(";")
    return (f"code{min(3, 200 * marks // max(1, len(text)))}", f"odd{min(3, 400 * odd // max(1, len(text)))}")


def viterbi(e: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best tags; the words before and after are outside; of equal paths that with the lower tag last."""
    m = moves.tolist()
    best, back = [a + b for a, b in zip(m[OUT], e[0].tolist())], []
    for row in e[1:].tolist():
        step, now = [], []
        for tag in (OUT, BEGIN, INSIDE):
            x, y, z = best[OUT] + m[OUT][tag], best[BEGIN] + m[BEGIN][tag], best[INSIDE] + m[INSIDE][tag]
            most, source = (x, OUT) if x >= y else (y, BEGIN)
            if z > most:
                most, source = z, INSIDE
            now.append(most + row[tag])
            step.append(source)
        back.append(step)
        best = now
    last = [best[tag] + m[tag][OUT] for tag in (OUT, BEGIN, INSIDE)]
    tags = [last.index(max(last))]
    for step in reversed(back):
        tags.append(step[tags[-1]])
    return tags[::-1]


def settled(d: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Which words every best path has outside, by a bound; d: scores of begin and inside less that of outside, a row a word.

    The best way up to a word with tag s is at most d + max_r(moves[r, s] - moves[r, OUT]) better than that with OUT. The
    best way on from s is better than that from OUT by at most the most of three: over OUT next, over BEGIN next, or moves[s,
    INSIDE] - moves[OUT, OUT] + d of the next word + the same from INSIDE there, a recursion that is a maximum of sums.
    """
    ahead = (moves - moves[:, :1]).max(0)
    least = np.maximum(moves[:, OUT] - moves[OUT, OUT], moves[:, BEGIN] - moves[OUT, BEGIN])
    total = np.cumsum(d[:, 1] + (moves[INSIDE, INSIDE] - moves[OUT, OUT]))
    inside = least[INSIDE] + np.maximum.accumulate(total[::-1])[::-1] - total
    begin = np.full(len(d), least[BEGIN])
    begin[:-1] = np.maximum(begin[:-1], moves[BEGIN, INSIDE] - moves[OUT, OUT] + d[1:, 1] + inside[1:])
    slack = SLACK * (1 + np.abs(total).max() * 1e-6)
    return (ahead[BEGIN] + d[:, 0] + begin < -slack) & (ahead[INSIDE] + d[:, 1] + inside < -slack)


class Field:
    """Linear-chain conditional random field with binary features."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        over = weights[:, 1:] - weights[:, :1]
        #: What features add to the scores of begin and inside, less what they add to that of outside.
        self.gain = lambda feats: over[[names[f] for f in feats if f in names]].sum(0)
        self.tables = [np.array([self.gain(names_of(k, code)) for code in range(size)]) for k, size in enumerate(SIZES)]

    def scores(self, stretch) -> np.ndarray:
        return np.array([self.weights[[self.names[f] for f in feats if f in self.names]].sum(0) for feats in stretch])

    def decode(self, stretch) -> list[int]:
        """Viterbi; the words before and after the stretch are outside."""
        return viterbi(self.scores(stretch), self.moves)

    def found(self, texts: list[str]):
        """Lists of each text's spans of secrets, by Viterbi over all its words."""
        for text, (spans, codes, odd) in zip(texts, coded(texts)):
            out: list = []
            if len(spans):
                d = sum(table[code] for table, code in zip(self.tables, codes)) + self.gain(file_features(text, int(odd.sum())))
                free = np.flatnonzero(~settled(d, self.moves))
                for part in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1) if len(free) else []:
                    for i, tag in zip(part.tolist(), viterbi(np.insert(d[part], 0, 0.0, 1), self.moves)):
                        if tag == BEGIN:
                            out.append([i, i])
                        elif tag == INSIDE and out and out[-1][1] == i - 1:
                            out[-1][1] = i
            yield [(int(spans[a, 0]), int(spans[b, 1])) for a, b in out]

    @classmethod
    def trained(cls, examples: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS) -> Field:
        """Stochastic gradients of the conditional likelihood with AdaGrad steps."""
        names = {f: i for i, f in enumerate(sorted({f for s, _ in examples for feats in s for f in feats}))}
        w, moves = np.zeros((len(names), 3)), np.zeros((3, 3))
        moves[OUT, INSIDE] = -1e4  # inside follows begin or inside only
        gw, gm, rng = np.full(w.shape, 1e-2), np.full((3, 3), 1e-2), random.Random(SEED)
        data = [([[names[f] for f in feats] for feats in s], tags) for s, tags in examples]
        lse = lambda a, axis: (m := a.max(axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis))
        for _ in range(epochs):
            rng.shuffle(data)
            for s, tags in data:
                e = np.array([w[ids].sum(0) for ids in s])
                n = len(s)
                alpha, beta = [moves[OUT] + e[0]], [moves[:, OUT].copy()]
                for row in e[1:]:
                    alpha.append(lse(alpha[-1][:, None] + moves, 0) + row)
                for row in e[:0:-1]:
                    beta.append(lse(moves + (row + beta[-1])[None], 1))
                beta.reverse()
                z = lse(alpha[-1] + beta[-1], 0)
                dm = np.zeros((3, 3))
                for i in range(n):
                    p = np.exp(alpha[i] + beta[i] - z)
                    p[tags[i]] -= 1
                    grad = p + 1e-4 * w[s[i]].sum(0)
                    gw[s[i]] += grad * grad
                    w[s[i]] -= 0.2 * grad / np.sqrt(gw[s[i]])
                    if i:
                        dm += np.exp(alpha[i - 1][:, None] + moves + (e[i] + beta[i])[None] - z)
                        dm[tags[i - 1], tags[i]] -= 1
                dm[OUT, INSIDE] = 0
                gm += dm * dm
                moves -= 0.2 * dm / np.sqrt(gm)
        return cls(names, w, moves)


def made_up(n: int = 1500) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with and without secrets and where those are."""
    rng, out = random.Random(SEED), []
    some = lambda chars, lo, hi: "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret = [lambda: some("0123456789abcdef", 16, 64), lambda: some(alnum, 16, 48), lambda: "AKIA" + some(alnum[:26] + alnum[52:], 16, 16), lambda: some(alnum + "+/", 24, 64) + "==", lambda: "ghp_" + some(alnum, 30, 36), lambda: "sk-" + some(alnum, 24, 48)]
    clean = [lambda: some("0123456789", 1, 6), lambda: f"{some('abcdefgh', 3, 9)}@{some('klmnop', 3, 9)}.com", lambda: f"+{some('0123456789', 2, 3)}-{some('0123456789', 3, 4)}-{some('0123456789', 4, 4)}", lambda: f"https://www.{some('abcdefgh', 4, 9)}.org/{some('abcdefgh', 3, 9)}/{some('klmno', 3, 9)}", lambda: f"20{some('0123456789', 2, 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}", lambda: f"{some('abcdefgh', 3, 9)}/{some('klmno', 3, 9)}", lambda: f"{some('abcdefgh', 3, 9)}_{some('klmno', 3, 9)}", lambda: f"{some('abcdefgh', 3, 9)}:", lambda: f"{some('abcdefghi', 2, 6)}={some('klmno', 2, 6)}", lambda: some("abcdefghijklmnop", 24, 40), lambda: f"{rng.randint(1, 12)}:{rng.randint(10, 59)}", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: "-".join(some("0123456789", 4, 4) for _ in range(4))]
    lead = ["the key is", "Bearer", "password:", "auth", "use credential", "login with", "", "in the", "see", "my private key", "token:", "of the"]
    for _ in range(n):
        plain = lambda: some("etaoinshrdlu", 2, 9)
        text, spans = " ".join(plain() for _ in range(rng.randint(0, 5))), []
        for _ in range(rng.randint(1, 2)):
            hit = rng.random() < 0.45
            text += f" {rng.choice(lead)} " if hit or rng.random() < 0.3 else " "
            word = rng.choice(secret if hit else clean)()
            if hit and rng.random() < 0.25:
                word = f"{rng.choice(['key', 'AUTH', 'pwd', 'value', 'client_secret'])}{rng.choice('=:')}{word}"
            if hit:
                spans.append((len(text), len(text) + len(word)))
            text += word + " " + plain()
        out.append((text, spans))
    return out + made_up_letters()


def made_up_letters(n: int = 1500) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with secrets of letters alone after a hint, and prose around the same hints."""
    rng, out = random.Random(SEED + 1), []
    some = lambda chars, lo, hi: "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))
    lower = "abcdefghijklmnopqrstuvwxyz"
    prose = "the of and to is required please change your reset on for each user with important information management was documentation a in our this that new responsible international must not be shared between necessary development people office".split()
    plain = lambda: rng.choice([rng.choice(prose), some("etaoinshrdlu", 2, 11)])
    camel = lambda: "".join(plain().capitalize() for _ in range(2))
    compound = lambda: (lambda w: rng.choice([w, w.capitalize(), w.upper() + "!!"]))("".join(rng.choice(["schtz", "ungs", "keit", "lich", "erst", "nicht", "chst", "berg", "ver", "ein", "zu", "stung", "sche"]) for _ in range(rng.randint(3, 5))))
    lead = ["password", "app password", "Bearer", "api key", "secret", "access token", "auth", "credential", "login", "pwd", "private key"]
    for _ in range(n):
        text, spans = " ".join(plain() for _ in range(rng.randint(0, 5))) + " ", []
        kind = rng.random()
        if kind < 0.15:
            text += rng.choice(["passphrase: ", "passphrase is ", "the passphrase = "])
            phrase = " ".join(some(lower, 4, 9) if rng.random() < 0.3 else plain() for _ in range(4))
            spans.append((len(text), len(text) + len(phrase)))
            text += phrase + "."
        elif kind < 0.5:
            text += rng.choice(lead) + rng.choice([" ", " is ", ": ", " = "])
            word = rng.choice([lambda: some(lower, 12, 23), lambda: some(lower + lower.upper(), 10, 23), lambda: some(lower.upper(), 12, 23), lambda: "-".join(some(lower, 4, 6) for _ in range(4)), lambda: some(lower[: rng.randint(14, 26)], 14, 20)])()
            spans.append((len(text), len(text) + len(word)))
            text += word + " " + " ".join(plain() for _ in range(rng.randint(0, 3)))
        else:
            text += rng.choice([*lead, "passphrase"]) + " " if kind < 0.75 else ""
            text += " ".join(rng.choice([camel, compound])() if rng.random() < 0.3 else plain() for _ in range(rng.randint(1, 7)))
        out.append((text, spans))
    return out


def tagged(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[int], tuple[str, ...]]:
    """Codes of all words of a text, their tags by the spans in order, and the features of the text."""
    tags, last, at = [], None, 0
    ((words, codes, odd),) = coded([text])
    for a, b in words.tolist():
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        hit = at if at < len(spans) and spans[at][0] < b else None
        tags.append(OUT if hit is None else INSIDE if hit == last else BEGIN)
        last = hit
    return codes, tags, file_features(text, int(odd.sum()))


def stretch(codes: np.ndarray, tags: list[int], file: tuple[str, ...], lo: int, hi: int) -> tuple[list[list[str]], list[int]]:
    return [[*(name for k, code in enumerate(column) for name in names_of(k, code)), *file] for column in codes[:, lo:hi].T.tolist()], tags[lo:hi]


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches that spans in order cover, without overlaps."""
    out: list = []
    for a, _, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """The field from made-up lines and a bounded sample of the corpus."""
    picked = docs.where("text IS NOT NULL").select("text", F.xxhash64("doc_id").alias("h"), "doc_id").where(f"length(text) <= {LONGEST}")
    most = max((r.h for r in picked.select("h").orderBy("h").limit(sample).collect()), default=None)  # sample numbers
    some = picked.where(F.lit(False) if most is None else F.col("h") <= most)
    texts = [r.text for r in some.orderBy("h", "doc_id", F.xxhash64("text")).limit(sample).collect()]  # at most sample x LONGEST characters
    rng, examples = random.Random(SEED), [stretch(*(x := tagged(text, spans)), 0, len(x[1])) for text, spans in made_up()]
    learnt, quiet = [], []
    for k, text in enumerate(texts):
        if rng.random() < 0.5:
            text = ASSIGN.sub(lambda m: m[0].replace(m[1], "x" * len(m[1]), 1), text) if (spans := base_spans(text)) else text
        else:
            spans = base_spans(text)
        learnt.append((text, merged(spans)))
        x = tagged(*learnt[-1])
        hits = np.flatnonzero(x[1])
        for part in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * MARGIN) + 1) if len(hits) else []:
            examples.append(stretch(*x, max(0, int(part[0]) - MARGIN), min(len(x[1]), int(part[-1]) + MARGIN + 1)))
        quiet += [(k, lo) for lo in range(0, len(x[1]), QUIET_WORDS) if not any(x[1][lo : lo + QUIET_WORDS])]
    rng.shuffle(quiet)
    last = None
    for k, lo in sorted(quiet[:QUIET]):
        if k != last:
            x, last = tagged(*learnt[k]), k
        examples.append(stretch(*x, lo, min(len(x[1]), lo + QUIET_WORDS)))
    field = Field.trained(examples)
    del texts, learnt, quiet, examples
    release(docs.sparkSession)
    return field


def scan_texts(texts: list[str], field: Field):
    """Of each text the fixed spans, and all spans with the field's own, as (start, kind number, end) in order."""
    for text, own in zip(texts, field.found(texts)):
        base = base_spans(text)
        taken, at, more = merged(base), 0, []
        for a, b in own:
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if at == len(taken) or taken[at][0] >= b:
                more.append((a, 3, b))
        yield base, sorted(base + more)


def scan_text(text: str, field: Field) -> tuple[list, list]:
    return next(scan_texts([text], field))


def written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list) -> str:
    """The text with every stretch covered by spans replaced by MASK."""
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            out += [text[at:a], MASK] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of the fixed kinds, digest of their spans, all spans, n_crf and the redacted text."""
    shared = docs.sparkSession.sparkContext.broadcast((field.names, field.weights, field.moves))

    def run(batches):
        own = Field(*shared.value)
        for batch in small(batches):
            rows = []
            texts = null_safe_texts(batch.column("text"))
            for text, (base, spans) in zip(texts, scan_texts(texts, own)):
                kinds = [k for _, k, _ in spans]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), redact(text, spans)))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans", "redacted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string, redacted string")


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """docs with every span found in text replaced by MASK; n_chars, where there is one, counts the new text's code points."""
    shared = docs.sparkSession.sparkContext.broadcast((field.names, field.weights, field.moves))

    def run(batches):
        own = Field(*shared.value)
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            texts = [None if t is None else redact(t, spans) for t, (_, spans) in zip(texts, scan_texts([t or "" for t in texts], own))]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs)).drop("redacted")
