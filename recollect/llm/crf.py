"""A linear-chain conditional random field in numpy: trained on the driver, decoded in batches.

A caller may score every token of a text and decode whole chains (`decode_scored`), or give runs: tokens
that cannot be part of an entity (plain words) are then fixed to the outside tag by the lattice, in
training as in decoding, so the chain falls apart into the runs between them; plain neighbours still
count as features, whole. A token of more than `PIECE`
characters is cut at quotes, brackets and separators and into pieces of at most `PIECE`
characters, each a token of the chain, so the whole of it is looked at. Given runs are cut after `RUN`
tokens, which bounds the memory of one text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import numpy as np

#: Characters of a piece, tokens of a run, tokens decoded at once.
PIECE, RUN, AT_ONCE = 64, 4096, 1 << 15
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SEPARATORS = r"""["'`,;{}\[\]<>&|]"""
_CUT = re.compile(rf"(?:{_SEPARATORS}|(?<=[\"'`]):)+|([^{_SEPARATORS[1:]}{{1,%d}})" % PIECE)


class Run(NamedTuple):
    """Tokens as [start, end) in code points, and the plain words before and after them in lower case ("": none)."""

    tokens: list[tuple[int, int]]
    before: str
    after: str


class LinearChainCRF:
    """Weights over string features, transitions between tags, and start and end weights."""

    def __init__(self, tags: Sequence[str], width: int):
        self.tags, self.width = list(tags), width
        self.features: dict[str, int] = {}

    def _ids(self, runs: list[list[list[str]]], grow: bool) -> list[np.ndarray]:
        """Feature numbers per token, padded to `width`; 0 stands for a feature not seen in training."""
        out = []
        get = self.features.get
        for run in runs:
            a = np.zeros((len(run), self.width), np.int32)
            for t, names in enumerate(run):
                for j, name in enumerate(names):
                    a[t, j] = self.features.setdefault(name, len(self.features) + 1) if grow else get(name, 0)
            out.append(a)
        return out

    def fit(self, runs: list[list[list[str]]], tags: list[list[str]], l2: float = 0.02, steps: int = 150, rate: float = 0.25) -> "LinearChainCRF":
        """Maximise the regularised log likelihood by AdaGrad on full batches (the table is small)."""
        x = self._ids(runs, True)
        number = {t: i for i, t in enumerate(self.tags)}
        k, n = len(self.tags), max(1, len(runs))
        self.emit = np.zeros((len(self.features) + 1, k))
        self.move, self.start, self.end = np.zeros((k, k)), np.zeros(k), np.zeros(k)
        groups = []
        for length, at in _by_length(x).items():
            groups.append((length, np.stack([x[i] for i in at]), np.array([[number[t] for t in tags[i]] for i in at])))
        parts = ("emit", "move", "start", "end")
        seen = {p: np.full_like(getattr(self, p), 1e-6) for p in parts}
        for _ in range(steps):
            grad = {p: -l2 * getattr(self, p) for p in parts}
            for length, ids, gold in groups:
                self._gradient(length, ids, gold, grad, 1.0)
            for p in parts:
                g = grad[p] / (1 if p == "emit" else n**0.5)
                seen[p] += g * g
                getattr(self, p).__iadd__(rate * g / np.sqrt(seen[p]))
            self.emit[0] = 0
        return self

    def _gradient(self, length: int, ids: np.ndarray, gold: np.ndarray, grad: dict[str, np.ndarray], weight: float) -> None:
        score = self.emit[ids].sum(2)
        n, _, k = score.shape
        alpha, beta = np.zeros((length, n, k)), np.zeros((length, n, k))
        alpha[0] = self.start + score[:, 0]
        for t in range(1, length):
            alpha[t] = score[:, t] + _lse(alpha[t - 1][:, :, None] + self.move[None], 1)
        beta[-1] = self.end
        for t in range(length - 2, -1, -1):
            beta[t] = _lse(self.move[None] + (score[:, t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1] + self.end, 1)
        every = -np.exp(alpha + beta - z[:, None])
        every[np.arange(length)[:, None], np.arange(n), gold.T] += 1
        seen = ids.transpose(1, 2, 0).ravel()
        for tag in range(k):
            each = np.broadcast_to(every[:, None, :, tag], (length, ids.shape[2], n)).ravel()
            grad["emit"][:, tag] += weight * np.bincount(seen, each, len(grad["emit"]))
        for t in range(length):
            diff = every[t]
            if t == 0:
                grad["start"] += weight * diff.sum(0)
            if t == length - 1:
                grad["end"] += weight * diff.sum(0)
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + self.move[None] + (score[:, t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
                grad["move"] -= weight * pair
                np.add.at(grad["move"], (gold[:, t - 1], gold[:, t]), weight)

    def decode(self, runs: list[list[list[str]]]) -> list[np.ndarray]:
        """The best tag numbers of each run, by Viterbi over all runs of a length at once."""
        return self._best([self.emit[a].sum(1) for a in self._ids(runs, False)], [self.start] * len(runs), [self.end] * len(runs))

    def _best(self, scores: list[np.ndarray], heads: list[np.ndarray], tails: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of runs, given each token's scores and the weights of each run's first and last tag."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
        for length, every in _by_length(scores).items():
            step = max(1, 200_000 // length)
            for i in range(0, len(every), step):
                at = every[i : i + step]
                score = np.stack([scores[i] for i in at])
                n, _, k = score.shape
                best, back = np.stack([heads[i] for i in at]) + score[:, 0], np.zeros((length, n, k), np.int16)
                for t in range(1, length):
                    way = best[:, :, None] + self.move[None]
                    back[t] = way.argmax(1)
                    best = way.max(1) + score[:, t]
                tag = np.zeros((n, length), np.int64)
                tag[:, -1] = (best + np.stack([tails[i] for i in at])).argmax(1)
                for t in range(length - 1, 0, -1):
                    tag[:, t - 1] = back[t][np.arange(n), tag[:, t]]
                for row, i_run in enumerate(at):
                    out[i_run] = tag[row]
        return out

    def weight(self, names: Iterable[str]) -> np.ndarray:
        """What features add to the scores of a token's tags."""
        return self.emit[[self.features.get(n, 0) for n in names]].sum(0)

    def decode_scored(self, score: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The best tags of chains laid end to end; `first` and `last` mark the ends of each.

        The result is that of Viterbi over the whole chains. Where the first tag (outside) beats each
        other one whatever tags the neighbours have, every best path has it; settled tokens
        narrow what their neighbours' neighbours can be, and only what stays open is searched.
        """
        n, k = score.shape
        lead = score[:, :1] - score[:, 1:]
        before, after = self.move[:, :1] - self.move[:, 1:], (self.move[:1] - self.move[1:]).T
        fixed = np.zeros(n, bool)
        for _ in range(8):
            prev = np.where(np.concatenate([[False], fixed[:-1]])[:, None], before[0], before.min(0))
            then = np.where(np.concatenate([fixed[1:], [False]])[:, None], after[0], after.min(0))
            prev[first], then[last] = self.start[0] - self.start[1:], self.end[0] - self.end[1:]
            now = fixed | (lead + prev + then > 1e-9).all(1)
            if (now == fixed).all():
                break
            fixed = now
        open_ = ~fixed
        begins = np.flatnonzero(open_ & (first | np.concatenate([[True], fixed[:-1]])))
        ends = np.flatnonzero(open_ & (last | np.concatenate([fixed[1:], [True]]))) + 1
        runs = list(zip(begins.tolist(), ends.tolist(), strict=True))
        tags = np.zeros(n, np.int64)
        found = self._best([score[a:b] for a, b in runs], [self.start if first[a] else self.move[0] for a, _ in runs], [self.end if last[b - 1] else self.move[:, 0] for _, b in runs])
        for (a, b), own in zip(runs, found, strict=True):
            tags[a:b] = own
        return tags


def _by_length(x: list[np.ndarray]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = defaultdict(list)
    for i, a in enumerate(x):
        if len(a):
            out[len(a)].append(i)
    return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


class _Classes(dict):
    """Code points as digits, capitals, other letters or themselves."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        return self[point]


_CLASSES = _Classes()
_REPEATS = re.compile(r"(.)\1+", re.DOTALL)


def collapsed(word: str) -> str:
    """Shape of a word with repeats collapsed: 'AKIA12' -> 'X9', '(017)' -> '(9)'."""
    return _REPEATS.sub(r"\1", word.translate(_CLASSES))


def _last_word(gap: str, spaces: str) -> str:
    gap = gap.rstrip(spaces)
    return gap[max(gap.rfind(c) for c in spaces) + 1 :].lower()


def pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A token as the chain takes it: whole, or cut if it is long."""
    return [(start, end)] if end - start <= PIECE else [m.span() for m in _CUT.finditer(text, start, end) if m[1]]


def all_tokens(text: str) -> list[tuple[int, int]]:
    """Every token of a text, long ones in pieces."""
    out = [m.span() for m in WORD.finditer(text)]
    if any(e - s > PIECE for s, e in out):
        out = [p for s, e in out for p in pieces(text, s, e)]
    return out


def active_runs(text: str, active: Iterator[tuple[int, int]], spaces: str = " \t\n\x0b\x0c\r") -> list[Run]:
    """Runs of neighbouring active tokens; `active` gives their [start, end) in rising order. Linear in the text."""
    groups: list[tuple[int, list[tuple[int, int]]]] = []  # where the gap before begins, tokens
    done = 0
    for start, end in active:
        near = groups and not text[done:start].strip(spaces)
        for piece in pieces(text, start, end):
            if not near or len(groups[-1][1]) >= RUN:
                groups.append((done, []))
                near = True
            groups[-1][1].append(piece)
            done = piece[1]
    out = []
    for at, tokens in groups:
        after = WORD.search(text, tokens[-1][1])
        out.append(Run(tokens, _last_word(text[at : tokens[0][0]], spaces), after[0].lower() if after else ""))
    return out


class Covered:
    """Spans of a text, sorted once, so that each question costs a binary search."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [s for s, _ in ordered]
        self.tops = list(accumulate((e for _, e in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        """Whether some span shares a character with this one."""
        i = bisect_left(self.starts, end)
        return i > 0 and self.tops[i - 1] > start
