"""Secret scans (operator 8): a conditional random field that tags tokens as secret begin, inside or outside.

Patterns give the base spans of assignments, access keys and long hex strings. The field uses
token shape, neighbouring words and features of the whole file, and adds spans of kind
"secret" where it finds a secret that no base span touches. Every token of a text is scored, plain
words too, and the best tags are those of the whole text's chain.

Edge cases: a null text counts as empty and gives no spans; a null doc_id stays null; repeated
rows each give their own row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recollect.llm.common import SPACES, over_batches, table
from recollect.llm.crf import _CLASSES, PIECE, Covered, LinearChainCRF, all_tokens, collapsed

KINDS = ("assign", "access", "hex", "secret")
TAGS = ("O", "B", "I")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_CUES = ("password", "passwd", "secret", "token", "key", "bearer", "credential", "passphrase", "auth", "pwd")
_ANY_CUE = re.compile("|".join(_CUES))
_CODE = "{}=;<>_/"
_QUOTES = "\"'`()[]{},;<>"
_EDGE = "\"'.,:;()="
#: Letters without case in raw shapes: no token holds a space.
_CASELESS = " "
#: The class of each code point that was met, as a code point (0: not met yet).
_MET = np.zeros(0x110000, np.uint32)
WIDTH = 15
#: Tokens decoded at once; words whose scores are held.
TOKENS, WORDS = 1 << 17, 250_000


def base_spans(text: str, longest: int | None = None) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind that the fixed patterns give, in code points, ends exclusive.

    A caller that knows how long the longest token is spares texts without one of 32 characters the search for hex.
    """
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS[:3]}
    low = text.lower()
    if any(n in low for n in _NAMES):
        out["assign"] = [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out["access"] = [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if longest is None or longest >= 32:
        out["hex"] = [m.span() for m in _HEX.finditer(text)]
    return out


def file_features(text: str) -> list[str]:
    """Features of the whole text: how much it looks like code, and whether it names credentials."""
    n = max(1, len(text))
    code = sum(text.count(c) for c in _CODE) / n
    low = text.lower()
    return [f"fc={min(3, int(code * 100))}", f"fn={any(c in low for c in ('password', 'passwd', 'secret', 'api_key', 'credential'))}"]


@lru_cache(100_000)
def _entropy(counts: tuple[int, ...]) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts)


def _tokens(text: str) -> list[tuple[int, int]]:
    return all_tokens(text)


def _words(text: str) -> list[str]:
    """The tokens' texts; their places are only sought where the field finds something."""
    return _cut(text)[0]


def _cut(text: str) -> tuple[list[str], int]:
    """The tokens' texts, and the length of the longest before long ones are cut in pieces."""
    spaced = text
    for c in SPACES[1:]:
        spaced = spaced.replace(c, " ")
    out = list(filter(None, spaced.split(" ")))
    longest = max(map(len, out), default=0)
    return ([text[s:e] for s, e in _tokens(text)] if longest > PIECE else out), longest


def _ends(shape: str) -> str:
    return shape if len(shape) <= 8 else shape[:4] + "~" + shape[-4:]


def _has_small(word: str, shape: str) -> bool:
    return "x" in shape if word.isascii() else any(map(str.islower, word))


def _bits(word: str) -> int:
    return int(_entropy(tuple(sorted(map(word.count, set(word))))) * 2)


def _formed(word: str, shape: str, small: bool) -> list[str]:
    """Features that follow from a word's classes; these may stand for the word."""
    n, classes = len(word), f"{'X' in shape}{small}{'9' in shape}"
    url = f"url={'://' in word}{'@' in word}{word.count('/') > 1}{word.count('-') > 2}"
    return ["s=" + _ends(shape), f"t={min(len(shape), 32) // 4}", f"l={min(n, 48) // 4}", f"c={classes}", f"cl={classes}{n >= 16}", url, "b"]


def _in(cue: bool, word: str) -> str:
    return f"in={cue}{'=' in word}{len(word) > 16}"


def _own(word: str) -> list[str]:
    """What a token shows by itself."""
    shape = collapsed(word)
    return [*_formed(word, shape, _has_small(word, shape)), f"e={_bits(word)}", _in(_cue(word), word), f"pre={word[:3]}"]


def _side(word: str) -> str:
    return word.lower().strip(_EDGE)


def _cue(word: str) -> bool:
    return _ANY_CUE.search(word.lower()) is not None


def _features(words: list[str], whole: list[str]) -> list[list[str]]:
    """Features of all tokens of a text; they are of one word each, but for the cue before a long shape."""
    out = []
    words = [w.strip(_QUOTES) for w in words]
    for i, w in enumerate(words):
        left, right = (words[i - 1] if i else ""), (words[i + 1] if i + 1 < len(words) else "")
        out.append([*_own(w), "p=" + _side(left), "q=" + _side(right), f"cue={_cue(left)}{len(collapsed(w)) > 3}", *whole])
    return out


class Forms(dict):
    """Numbers of raw shapes (words in the classes of `_points`) as they are first met; words of one raw shape share features."""

    def __init__(self, features: dict[str, int]):
        super().__init__()
        self.features = features
        #: Of each new one the numbers of its features by form, of `in` without and with a cue, and whether the shape is long.
        self.new: list[tuple[int, ...]] = []

    def __missing__(self, raw: str) -> int:
        word, small, get = raw.replace(_CASELESS, "x"), any(map(str.islower, raw)), self.features.get
        shape = collapsed(word)
        self.new.append((*[get(f, 0) for f in _formed(word, shape, small)], get(_in(False, word), 0), get(_in(True, word), 0), len(shape) > 3))
        self[raw] = n = len(self)
        return n


def _points(points: np.ndarray) -> np.ndarray:
    """Code points as the classes of a shape, but letters without case as `_CASELESS`; sought once for each that is met."""
    out = _MET[points]
    if not out.all():
        for p in np.unique(points[out == 0]).tolist():
            own = _CLASSES[p]
            _MET[p] = ord(_CASELESS if own == "x" and not chr(p).islower() else own)
        out = _MET[points]
    return out


def _all_bits(words: list[str], points: np.ndarray) -> np.ndarray:
    """`_bits` of words that are given as code points too, each word but the last with a line feed after it."""
    word = np.cumsum(points == 10)
    letters = np.sort((word << 21 | points)[points != 10])
    begins = np.flatnonzero(np.diff(letters, prepend=-1))
    counts = np.diff(begins, append=len(letters))
    size = np.maximum(1, np.bincount(letters >> 21, minlength=len(words)))
    twice = 2 * (np.log2(size) - np.bincount(letters[begins] >> 21, counts * np.log2(counts), len(words)) / size)
    out = np.floor(twice).astype(np.int64)
    for i in np.flatnonzero(np.abs(twice - np.rint(twice)) < 1e-9).tolist():  # where rounding decides
        out[i] = _bits(words[i])
    return out


class Scores(dict):
    """Numbers of tokens' texts as they are first met, with what each adds to the scores of its own, the next and the last token.

    New texts wait until scores are asked for, and are then worked out all at once.
    """

    def __init__(self, model: LinearChainCRF):
        super().__init__()
        self.model, self.forms = model, Forms(model.features)
        self.named = {kind: {f[len(kind) :]: i for f, i in model.features.items() if f.startswith(kind)} for kind in ("pre=", "p=", "q=")}
        self.beside = np.array([[model.weight([f"cue={c}{long}"]) for long in (False, True)] for c in (False, True)])
        self._forget()

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        self.new.append(token)
        return n

    def _forget(self) -> None:
        self.clear()
        self.forms.clear()
        self.forms.new = []
        self.new: list[str] = []
        none, no = np.zeros((0, len(self.model.tags))), np.zeros(0, bool)
        self.own, self.after, self.before, self.cue, self.long = none, none, none, no, no
        #: By form: the weights without a cue and with one, and whether the shape is long.
        self.plain, self.cued, self.far = none, none, no
        self[""]  # number 0: no neighbour

    def trim(self) -> None:
        """Forget all words once they are many."""
        if len(self) > WORDS:
            self._forget()

    def _settle(self) -> None:
        """Work out what the texts that wait add to scores."""
        if not self.new:
            return
        emit = self.model.emit
        words = [token.strip(_QUOTES) for token in self.new]
        text = "\n".join(words)  # no token holds a line feed
        low = text.lower()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        raws = _points(points).tobytes().decode("utf-32-le", "surrogatepass").split("\n")
        forms = np.fromiter(map(self.forms.__getitem__, raws), np.int64, len(words))
        cue, at, word = np.zeros(len(words), bool), 0, 0
        for m in _ANY_CUE.finditer(low):
            word += low.count("\n", at, m.start())
            at = m.start()
            cue[word] = True
        if self.forms.new:
            ids = np.array(self.forms.new)
            shared = emit[ids[:, :-3]].sum(1)
            self._append(plain=shared + emit[ids[:, -3]], cued=shared + emit[ids[:, -2]], far=ids[:, -1] > 0)
            self.forms.new = []
        bits = _all_bits(words, points)
        bit = np.array([self.model.features.get(f"e={b}", 0) for b in range(bits.max() + 1)])
        start, left, right = (self.named[kind].get for kind in ("pre=", "p=", "q="))
        sides = [w.strip(_EDGE) for w in low.split("\n")]
        own = np.where(cue[:, None], self.cued[forms], self.plain[forms]) + emit[bit[bits]] + emit[[start(w[:3], 0) for w in words]]
        after, before = emit[[left(w, 0) for w in sides]], emit[[right(w, 0) for w in sides]]
        self._append(own=own, after=after, before=before, cue=cue, long=self.far[forms])
        self.new = []

    def _append(self, **new: np.ndarray) -> None:
        for name, rows in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), rows]))

    def of(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Scores of tokens in chains laid end to end, but for the features of the whole text."""
        self._settle()
        left, right = np.concatenate([[0], codes[:-1]]), np.concatenate([codes[1:], [0]])
        left[first], right[last] = 0, 0
        return self.own[codes] + self.after[left] + self.before[right] + self.beside[self.cue[left].astype(int), self.long[codes].astype(int)]


def labelled_table(n: int = 900, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """The small labelled table: lines with marked secrets and look-alikes that are none."""
    r = random.Random(seed)
    words = "the of and for set use with new run value line file test item note in on release see build".split()
    up, low, dig = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    s = lambda chars, k: "".join(r.choice(chars) for _ in range(k))

    def secret() -> tuple[str, str]:
        mixed = s(up + low + dig, r.randint(20, 40))
        return r.choice([
            (r.choice(["token = ", "token: ", "secret=", "api_key: ", "apikey="]), f'"{s("abcdef" + dig, 40)}"'), ("", "AKIA" + s(up + dig, 16)), ("Bearer ", mixed), ("ghp ", "ghp_" + s(up + low + dig, 36)), ("key ", "sk-" + s(low + dig, 32)),
            (r.choice(["password is ", "passphrase ", "pwd "]), s(up + low, 5) + s("!#%", 1) + s(dig, 4) + s(low, 3)), ("credential ", s(up + low + dig, 28) + "=="), ("auth ", mixed), ("bearer ", s(up + low, r.randint(24, 40))), (r.choice(["passphrase ", "passphrase is "]), "-".join(s(low, r.randint(4, 8)) for _ in range(4))), ("secret key ", s(up + low + dig + "/+", 40)), ("the ", "xoxb-" + s(dig, 11) + "-" + s(low + up + dig, 20)),
        ])

    def other() -> str:
        return r.choice([s(dig, r.randint(1, 16)), f"20{s(dig, 2)}-0{s('123456789', 1)}-1{s(dig, 1)}", f"v{s(dig, 1)}.{s(dig, 2)}", f"{s(low, 5)}_{s(low, 6)}", f"{s(low, 3)}={s(dig, 2)}", f"https://{s(low, 6)}.com/{s(low, 4)}/{s(dig, 4)}", f"{s(low, 5)}.{s(dig, 2)}@mail{s(dig, 1)}.example.com", s("abcdef" + dig, 7), f"+1 ({s(dig, 3)}) 555-{s(dig, 4)}", ".".join(s("12", 2) for _ in range(4)), f"{s(low, 4)}{s(dig, 2)}", f"#{s('abcdef' + dig, 6)}", f"{s(dig, 2)}:{s(dig, 2)}", f"${s(dig, 3)}", "=" * r.randint(2, 30), "_" * r.randint(2, 30), f"{s(up, 3)}-{s(dig, 4)}", f"src/{s(low, 5)}/{s(low, 6)}_{s(dig, 1)}.py", f"{s(dig, 3)},{s(dig, 3)}", f"{s(up, 1)}{s(low, 4)}{s(up, 1)}{s(low, 4)}", s(low, r.randint(20, 26)), "-".join(s(low, r.randint(2, 6)) for _ in range(r.randint(2, 4))), f"https://{s(low, 8)}.org/{s(low, 7)}", "password policy", "secret " + r.choice(words), "key is " + r.choice(words), "bearer of", "token " + r.choice(words), "the auth module", "credential store", "key " + s(low, r.randint(3, 9)), "password is " + r.choice(["required", "missing", "wrong", "optional"])])

    syllables = "ein ung heit ver lich que elle ent ción mente tion ing the re an er ou eau ai pa con dis".split()

    def long_word() -> str:
        """Plain words of many syllables, as several languages have them, some shouted or before rows of signs."""
        word = "".join(r.choice(syllables) for _ in range(r.randint(5, 9)))
        return r.choice([word, word.title(), word.title(), word.upper()]) + r.choice(["", "", ".", ",", ".%%%", ",###", "!!!", "$$$", "***", ".&&&"])

    out = []
    for _ in range(n):
        text, spans = " ".join(r.choices(words, k=r.randint(1, 4))), []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.15:
                text += " " + long_word()
            if r.random() < 0.4:
                cue, body = secret()
                text += " " + cue
                spans.append((len(text), len(text) + len(body)))
                text += body
            else:
                text += " " + other()
            text += " " + " ".join(r.choices(words, k=r.randint(0, 3)))
        if r.random() < 0.3:
            text += r.choice([" { x = y; } </a>", " password policy", " credential store"])
        out.append((text, spans))
    return out


def train(rows: list[tuple[str, list[tuple[int, int]]]] | None = None) -> LinearChainCRF:
    runs, tags = [], []
    for text, spans in labelled_table() if rows is None else rows:
        tokens, own = _tokens(text), []
        for s, e in tokens:
            hit = next(((a, b) for a, b in spans if a < e and s < b), None)
            own.append("O" if hit is None else "B" if s <= hit[0] else "I")
        if tokens:
            runs.append(_features(_words(text), file_features(text)))
            tags.append(own)
    return LinearChainCRF(TAGS, WIDTH).fit(runs, tags)


def _added(text: str, run: list[tuple[int, int]], tags, taken: Covered) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    last = "O"
    for (s, e), tag in zip(run, tags, strict=True):
        name, before = TAGS[tag], last
        last = name
        if name == "O":
            continue
        while s < e and text[s] in _QUOTES:
            s += 1
        while e > s and text[e - 1] in _QUOTES + ".":
            e -= 1
        if s == e:
            continue
        if name == "I" and before != "O" and out:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if not taken.meets(s, e)]


def find(texts: list[str], model: LinearChainCRF, scores: Scores | None = None) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int]]]]:
    """For each text its base spans and the spans that the field adds; a bounded number of tokens is decoded at once."""
    bases: list[dict[str, list[tuple[int, int]]]] = []
    added: list[list[tuple[int, int]]] = [[] for _ in texts]
    scores = Scores(model) if scores is None else scores
    waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

    def decode() -> None:
        sizes = [len(codes) for _, codes, _ in waiting]
        ends = np.cumsum(sizes)
        first, last = np.zeros(ends[-1], bool), np.zeros(ends[-1], bool)
        first[0], first[ends[:-1]], last[ends - 1] = True, True, True
        score = scores.of(np.concatenate([codes for _, codes, _ in waiting]), first, last)
        score += np.repeat(np.stack([whole for *_, whole in waiting]), sizes, axis=0)
        tags = model.decode_scored(score, first, last)
        for (i, codes, _), end in zip(waiting, ends.tolist(), strict=True):
            own = tags[end - len(codes) : end]
            at = np.flatnonzero(own)
            if len(at):
                tokens, taken = _tokens(texts[i]), Covered(x for spans in bases[i].values() for x in spans)
                for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    added[i] += _added(texts[i], tokens[part[0] : part[-1] + 1], own[part], taken)
        waiting.clear()

    met = 0
    for i, text in enumerate(texts):
        words, longest = _cut(text)
        bases.append(base_spans(text, longest))
        if words:
            waiting.append((i, np.fromiter(map(scores.__getitem__, words), np.int64, len(words)), model.weight(file_features(text))))
            met += len(words)
        if met >= TOKENS:
            decode()
            met = 0
            scores.trim()
    if waiting:
        decode()
    scores.trim()
    return list(zip(bases, added, strict=True))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def secret_spans(docs: DataFrame, model: LinearChainCRF | None = None) -> DataFrame:
    """One row per document with counts of base spans, their digest and all spans."""
    model = model or train()
    scores = Scores(model)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in b.column(1).to_pylist()]
        cols: list[list] = [[] for _ in range(6)]
        for base, added in find(texts, model, scores):
            own = [(k, s, e) for k in KINDS[:3] for s, e in base[k]]
            for j, k in enumerate(KINDS[:3]):
                cols[j].append(len(base[k]))
            cols[3].append(hashlib.sha256(joined(own).encode()).hexdigest())
            cols[4].append(joined(own + [("secret", s, e) for s, e in added]))
            cols[5].append(len(added))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return over_batches(docs.select("doc_id", "text"), batch, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def op8_secrets_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
