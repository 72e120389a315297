"""Personal data (operator 1): a conditional random field over word shapes beside exact patterns.

Patterns give the base spans of e-mail addresses, IP addresses, cards and telephone numbers.
The field, trained from a small labelled table, adds spans that the patterns miss, such as
telephone numbers without a country code. A base span is never dropped or changed; an added
span never overlaps a base span. Tokens that hold neither a digit nor `@` are plain: their tag is
fixed to outside, so spelled-out forms ("name at host dot com") are never found.

Edge cases: a null text counts as empty and gives no spans; a null doc_id stays null; repeated
rows each give their own row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recollect.llm.common import over_batches, table
from recollect.llm.crf import AT_ONCE, Covered, LinearChainCRF, Run, active_runs, collapsed

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Whole tokens with a digit or @; only token starts are tried, so the scan is linear.
_ACTIVE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_EDGE_LEFT, _EDGE_RIGHT = "\"'<[{,;:!?|*", "\"'>]},;:!?.|*"
WIDTH = 12


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from each '@' outwards, so that long words cost linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind that the fixed patterns give, in code points, ends exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _runs(text: str) -> list[Run]:
    return active_runs(text, (m.span() for m in _ACTIVE.finditer(text)))


def _features(text: str, run: Run) -> list[list[str]]:
    """Word shape features of each token and of its neighbours."""
    words = [text[s:e] for s, e in run.tokens]
    shapes = [collapsed(w) for w in words]
    out = []
    for i, w in enumerate(words):
        digits = "".join(c for c in w if "0" <= c <= "9")
        left, right = (words[i - 1].lower() if i else run.before), (words[i + 1].lower() if i + 1 < len(words) else run.after)
        out.append([
            "s=" + shapes[i], f"n={min(len(digits), 20)}", f"l={min(len(w), 24) // 3}", "p=" + left.strip(".,:;()"), "q=" + right.strip(".,:;()"),
            "ps=" + (shapes[i - 1] if i else "-"), "ns=" + (shapes[i + 1] if i + 1 < len(words) else "-"),
            f"a={'@' in w}{w[:1] == '('}{'.' in w}{'-' in w}{w[:1] == '+'}", f"k={13 <= len(digits) <= 19}{13 <= len(digits) <= 19 and luhn(digits)}",
            f"g={max(map(len, re.findall('[A-Za-z]+', w)), default=0) > 1}", f"pn={min(sum(c.isdigit() for c in words[i - 1]), 9) if i else '-'}", "b",
        ])
    return out


def labelled_table(n: int = 900, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: sentences with marked spans and look-alikes that are not personal data."""
    r = random.Random(seed)
    words = "the of and order call total about from report with under near in a was on page see item line".split()
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = d(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def entity() -> tuple[str, str, str]:
        kind = r.choice(KINDS)
        name = "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
        if kind == "email":
            return r.choice(["mail", "write to", "contact", "from", "the"]), kind, r.choice([f"{name}.{d(2)}@mail{d(1)}.example.com", f"{name}@example.org", f"{name}_{d(3)}@host{d(1)}.net", f"{name}@localhost"])
        if kind == "ip":
            a = ".".join(str(r.randint(0, 255)) for _ in range(4))
            return r.choice(["host", "server", "from", "address", "the"]), kind, a
        if kind == "card":
            c = card()
            return r.choice(["card", "visa", "pay", "number", "the"]), kind, r.choice([c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4)), ".".join(c[i : i + 4] for i in range(0, 16, 4))])
        body = r.choice([f"({d(3)}) 555-{d(4)}", f"{d(3)}-555-{d(4)}", f"{d(3)}.555.{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"])
        return r.choice(["call", "phone", "tel", "fax", "the"]), kind, r.choice(["", "+1 ", "+49 "]) + body

    def other() -> str:
        bad = next(x for x in iter(lambda: d(16), "") if not luhn(x))
        return r.choice([f"{r.randint(1900, 2030)}", f"{d(2)}/{d(2)}/{r.randint(1990, 2030)}", f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"v{d(1)}.{d(2)}.{d(1)}", f"${d(2)}.{d(2)}", f"{d(2)},{d(3)}", d(r.randint(1, 12)), bad, f"{d(2)}:{d(2)}", f"{d(2)}%", f"section {d(1)}.{d(1)}", f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(3)}.{r.randint(256, 999)}.{d(1)}.{d(2)}", f"@{r.choice(words)}", f"{r.choice(words)}{d(2)}", f"#{d(5)}", f"{d(4)}-{d(4)}", '"' + "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))) + '"', "".join(r.choice("0123456789abcdef") for _ in range(40))])

    out = []
    for _ in range(n):
        text, spans = " ".join(r.choices(words, k=r.randint(1, 4))), []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.45:
                cue, kind, body = entity()
                text += f" {cue} "
                spans.append((kind, len(text), len(text) + len(body)))
                text += body + r.choice(["", ".", ","])
            else:
                text += " " + other() + r.choice(["", ".", ","])
            text += " " + " ".join(r.choices(words, k=r.randint(0, 3)))
        out.append((text, spans))
    return out


def train(rows: list[tuple[str, list[tuple[str, int, int]]]] | None = None) -> LinearChainCRF:
    runs, tags = [], []
    for text, spans in labelled_table() if rows is None else rows:
        for run in _runs(text):
            own = []
            for s, e in run.tokens:
                hit = next(((k, a) for k, a, b in spans if a < e and s < b), None)
                own.append("O" if hit is None else ("B-" if s <= hit[1] else "I-") + hit[0])
            runs.append(_features(text, run))
            tags.append(own)
    return LinearChainCRF(TAGS, WIDTH).fit(runs, tags)


def _added(text: str, run: list[tuple[int, int]], tags, taken: Covered) -> list[tuple[str, int, int]]:
    out: list[list] = []
    last = ""
    for (s, e), tag in zip(run, tags, strict=True):
        name, last_kind = TAGS[tag], last
        last = name[2:]
        if name == "O":
            continue
        while s < e and text[s] in _EDGE_LEFT:
            s += 1
        while e > s and text[e - 1] in _EDGE_RIGHT:
            e -= 1
        if s == e:
            continue
        if name[0] == "I" and last_kind == last and out:
            out[-1][2] = e
        else:
            out.append([last, s, e])
    return [(k, s, e) for k, s, e in out if not taken.meets(s, e)]


def find(texts: list[str], model: LinearChainCRF) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """For each text its base spans and the spans that the field adds; a bounded number of tokens is decoded at once."""
    bases = [base_spans(text) for text in texts]
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    waiting: list[tuple[int, Run]] = []

    taken: dict[int, Covered] = {}

    def decode() -> None:
        for (i, run), tags in zip(waiting, model.decode([_features(texts[i], run) for i, run in waiting]), strict=True):
            if tags.any():
                if i not in taken:
                    taken[i] = Covered(x for spans in bases[i].values() for x in spans)
                added[i] += _added(texts[i], run.tokens, tags, taken[i])
        waiting.clear()

    tokens = 0
    for i, text in enumerate(texts):
        for run in _runs(text):
            waiting.append((i, run))
            tokens += len(run.tokens)
            if tokens >= AT_ONCE:
                decode()
                tokens = 0
    decode()
    return list(zip(bases, added, strict=True))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def pii_spans(docs: DataFrame, model: LinearChainCRF | None = None) -> DataFrame:
    """One row per document with counts of base spans, their digest and all spans."""
    model = model or train()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in b.column(1).to_pylist()]
        cols: list[list] = [[] for _ in range(7)]
        for base, added in find(texts, model):
            own = [(k, s, e) for k in KINDS for s, e in base[k]]
            for j, k in enumerate(KINDS):
                cols[j].append(len(base[k]))
            cols[4].append(hashlib.sha256(joined(own).encode()).hexdigest())
            cols[5].append(joined(own + added))
            cols[6].append(len(added))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return over_batches(docs.select("doc_id", "text"), batch, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace each span by its kind in angle brackets; spans that overlap fall together."""
    out, done = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"<{kind}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: LinearChainCRF | None = None, column: str = "text") -> DataFrame:
    """`docs` with personal data masked in `column`; all columns stay, null texts stay null."""
    model = model or train()
    at, schema = docs.columns.index(column), docs.schema

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(at).to_pylist()
        new = [None if t is None else mask(t, [(k, s, e) for k in KINDS for s, e in base[k]] + added) for t, (base, added) in zip(texts, find([t or "" for t in texts], model), strict=True)]
        arrays = list(b.columns)
        arrays[at] = pa.array(new, b.schema.field(at).type)
        return pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return over_batches(docs, batch, schema)


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))
