"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The base spans are those of four fixed patterns, leftmost and non-overlapping per kind, with
their checks. The field labels white-space tokens with the kinds in BIO form; its features
are the shapes of a token and of both neighbours, so it needs no vocabulary. What it finds
has to stand an exact check of its kind (Luhn's sum for cards, parts of addresses, digits). It is trained in
the driver on the small labelled table below (a second or two) and decoded by Viterbi over
numpy batches in the workers. Its spans are added where they touch no base span; base ones stay.

A token is plain if it has none of the characters in ``NOT_PLAIN``. By the model's structure a
plain token between plain ones, or a text's ends, is outside, so only the islands around other
tokens are decoded: two tokens on each side of them are such, and the result is that of decoding
the whole text.

Defined results: a null or empty text has no spans and masks to the empty string; repeated
rows give equal results; texts of any length are read whole, in time linear in their length.
Rows are independent: nothing is shuffled. Extra columns pass; those named like an output
are replaced. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import read, tidied

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# The patterns, written so that no run of characters is scanned twice: a run of digits or
# of blanks is taken whole, and a start inside a run that already failed is not tried again.
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match has one @ with a run of local characters before it that no earlier match has used."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        tail = _EMAIL_TAIL.match(text, at) if begin < at else None
        if tail:
            free = tail.end()
            yield begin, free
        else:
            free = max(free, at)
        at = text.find("@", max(free, at + 1))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the labelled table: fixed values, [kind words] marks an entity ---
LABELLED = """
please write to [email jo.doe@mail.example.org] about it
mail [email anna_k.27@shop7.example.com] or call [phone +1 (415) 555-0132] today
contact us at [email sales@example.co.uk], thanks
the address [email x99@mail.example.com] bounced twice
send it to [email max [at] mail [dot] example [dot] org] soon
reach me: [email lee (at) example (dot) com] any day
write [email kim [at] shop [dot] example [dot] com] for help
the server at [ip 192.168.0.12] was down
traffic came from [ip 10.44.7.201] and [ip 172.16.254.1] all night
blocked [ip 203.0.113.77]. then it stopped
ping [ip 8.8.8.8], then wait
host [ip 192.0.2.17:8080] answered late
she paid with [card 4111 1111 1111 1111] online
card number [card 4012888888881881] was declined
use [card 5500-0000-0000-0004] for the test
his card [card 3714 496353 98431] expired
charge [card 4222222222222222] again, he said
call [phone +49 (30) 5550-1234] for details
my number is [phone +1 (212) 555-0199] at work
phone [phone +44 20 7946 0958] after six
ring [phone +33 1 55 50 12 34] now
dial [phone (415) 555-0132] or come by
the office [phone (212) 555-0148] is closed
try [phone 415-555-0132] in the morning
fax [phone 212-555-0177], please
tel [phone (030) 555-01234] until noon
in 2019 they had 14 houses and 3 dogs
the year 1987 was cold, with 12 storms
page 42 of 311 is missing
it cost 19.99 at the shop, or 25.50 with tax
version 2.0 came after 1.9 and before 3.1.4
about 1,250,000 people live there
order 8841-22 has 7 items in it
room 12-14 is free from 10:30 to 11:45
on 2021-03-14 we met at 9 am
on 14/03/2021 the price rose by 3.5%
section 4.2.1 says so (see page 9)
the score was 3-2 after 90 minutes
he ran 100 metres in 9.8 seconds
a well-known, long-term plan (of sorts) failed
she said "no" and/or left
licensed under the Apache License, Version 2.0.
licensed under CC BY-NC 4.0.
general public license, version 3.
the key = "a9f3c2e17b44d0" was old
token=9f8e7d6c5b4a and id 77123 were logged
A12B3 and X9Y8 are parts of model_7
the quick brown fox jumps over the lazy dog
Words come and go, and none of them matter here.
THESE ARE LOUD WORDS AND NOTHING ELSE
und die Straße war lang, sehr lang
el niño come pan y bebe agua
où est la bibliothèque, monsieur?
twenty people (or more) came in, he thinks
see the notes (part two) for more of it
one two three four five six seven
"""

NOT_PLAIN = "0-9@+()\\[\\]=_/\\\\\"-"
_TRIGGER = re.compile(rf"(?<!\S)[^\s{NOT_PLAIN}]*+[{NOT_PLAIN}]\S*")
_ODD = re.compile(f"[{NOT_PLAIN}]")
_TOKEN = re.compile(r"\S+")
#: The emission of every label of a plain token among plain ones but that of what is outside.
OUTSIDE = -1e9
_EDGE = ".,;:!?\"'"
_CHUNK = re.compile(r"[^\W\d_]+|[0-9]+|.", re.S)


def _bucket(n: int) -> str:
    return str(n) if n < 5 else "5" if n < 9 else "9" if n < 13 else "d" if n < 20 else "z"


def shape(token: str) -> str:
    """The token with runs of letters as a or A and runs of digits as 9 and their length's class."""
    core = token.strip(_EDGE) or token[:1]
    out = []
    for m in _CHUNK.finditer(core):
        s = m.group()
        out.append("9" + _bucket(len(s)) if "0" <= s[0] <= "9" else ("A" if s.isupper() else "a") if s[0].isalpha() else s)
    return "".join(out) + ("~" if token[-1:] in _EDGE else "")


def shape_features(s: str) -> list[str]:
    digits = s.count("9")
    marks = "".join(sorted({c for c in s if not c.isalnum() and c != "~"}))
    kind = "plain" if not re.search(f"[{NOT_PLAIN}]", s) else "other"
    out = [f"kind={kind}", f"marks={marks}", f"digits={min(digits, 5)}", f"end={s.endswith('~')}"]
    if kind != "plain":
        out += [f"shape={s.rstrip('~')}", f"flat={re.sub('9.', '9', s.rstrip('~'))}", f"first={s[:1]}"]
    return out


class Field:
    """The trained model: emissions by shape for a token, the one before and the one after, and transitions."""

    def __init__(self, weights: dict[str, np.ndarray], transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions
        self.by_shape: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.by_token: dict[str, str] = {}
        #: Only what lies around tokens that aren't plain is decoded; the result is that of the whole text.
        self.islands = True

    def _emissions(self, s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = self.by_shape.get(s)
        if got is None:
            f = shape_features(s)
            zero = np.zeros(len(LABELS))
            got = tuple(sum((self.weights.get(f"{at}:{x}", zero) for x in f), zero) for at in ("here", "before", "after"))
            if len(self.by_shape) < 20_000 and len(s) < 200:
                self.by_shape[s] = got
        return got

    def emissions(self, tokens: list[str]) -> np.ndarray:
        seen, known = self.by_token, []
        for t in tokens:
            s = seen.get(t)
            if s is None:
                s = shape(t)
                if len(t) < 40 and len(seen) < 50_000:
                    seen[t] = s
            known.append(self._emissions(s))
        out = np.array([k[0] for k in known])
        out[1:] += np.array([k[1] for k in known[:-1]]).reshape(-1, out.shape[1])
        out[:-1] += np.array([k[2] for k in known[1:]]).reshape(-1, out.shape[1])
        odd = np.array([False, *(_ODD.search(t) is not None for t in tokens), False])
        out[~(odd[:-2] | odd[1:-1] | odd[2:]), 1:] = OUTSIDE
        return out

    def viterbi(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of every sequence, all together: longest first, so that each step handles a prefix."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        result: list[np.ndarray] = [np.zeros(0, np.int8)] * len(sequences)
        order = [i for i in order if len(sequences[i])]
        # few lengths differ much within a block, so padding stays small
        start = 0
        while start < len(order):
            longest, stop = len(sequences[order[start]]), start
            while stop < len(order) and len(sequences[order[stop]]) * 2 >= longest and (stop - start) * longest < 200_000:
                stop += 1
            stop = max(stop, start + 1)
            block = order[start:stop]
            for i, labels in zip(block, self._block([sequences[i] for i in block]), strict=True):
                result[i] = labels
            start = stop
        return result

    def _block(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        n, steps, k = len(seqs), len(seqs[0]), len(LABELS)
        lens = np.array([len(s) for s in seqs])
        pad = np.zeros((steps, n, k))
        for j, s in enumerate(seqs):
            pad[: len(s), j] = s
        back = np.zeros((steps, n, k), np.int8)
        best = self.transitions[0][None, :] + pad[0]
        final = best.copy()
        for t in range(1, steps):
            m = int((lens > t).sum())
            scores = best[:m, :, None] + self.transitions[None, :, :]
            back[t, :m] = scores.argmax(1)
            best = scores.max(1) + pad[t, :m]
            final[:m] = best
        out = np.zeros((steps, n), np.int8)
        last = final.argmax(1).astype(np.int8)
        for j in range(n):
            out[lens[j] - 1, j] = last[j]
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            alive = rows[lens > t]
            out[t - 1, alive] = back[t, alive, out[t, alive]]
        return [out[: lens[j], j] for j in range(n)]


def labelled_rows(table: str = LABELLED) -> list[tuple[list[str], list[int]]]:
    rows = []
    for line in table.strip().splitlines():
        tokens, labels, at = [], [], 0
        for m in re.finditer(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[[^\]]*\])*)\](\S*)", line):
            for t in line[at : m.start()].split():
                tokens.append(t)
                labels.append(0)
            words = m[2].split()
            words[-1] += m[3]
            for i, t in enumerate(words):
                tokens.append(t)
                labels.append(LABELS.index(("I-" if i else "B-") + m[1]))
            at = m.end()
        for t in line[at:].split():
            tokens.append(t)
            labels.append(0)
        rows.append((tokens, labels))
    return rows


def train(rows: list[tuple[list[str], list[int]]] | None = None, steps: int = 300, rate: float = 0.1, penalty: float = 0.01) -> Field:
    """Maximum penalised likelihood by Adam; forward and backward sums over all rows at once."""
    rows = rows or labelled_rows()
    k, n, longest = len(LABELS), len(rows), max(len(t) for t, _ in rows)
    names: dict[str, int] = {}
    feats = []
    for j, (tokens, _) in enumerate(rows):
        shapes = [shape(t) for t in tokens]
        for t in range(len(tokens)):
            for at, d in (("here", 0), ("before", -1), ("after", 1)):
                if 0 <= t + d < len(tokens):
                    feats += [(j, t, names.setdefault(f"{at}:{x}", len(names))) for x in shape_features(shapes[t + d])]
    fj, ft, fi = np.array(feats).T
    y = np.zeros((n, longest), int)
    lens = np.array([len(t) for t, _ in rows])
    for j, (_, labels) in enumerate(rows):
        y[j, : len(labels)] = labels
    mask = np.arange(longest)[None, :] < lens[:, None]
    #: I-x follows only B-x or I-x.
    allowed = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in LABELS] for a in LABELS])
    w, trans = np.zeros((len(names), k)), np.zeros((k, k))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    gold_w, gold_t = np.zeros_like(w), np.zeros_like(trans)
    np.add.at(gold_w, (fi, y[fj, ft]), 1)
    for j in range(n):
        gold_t[0, y[j, 0]] += 1
        np.add.at(gold_t, (y[j, : lens[j] - 1], y[j, 1 : lens[j]]), 1)
    lse = lambda a, axis: a.max(axis) + np.log(np.exp(a - np.expand_dims(a.max(axis), axis)).sum(axis))
    for step in range(1, steps + 1):
        tr = np.where(allowed, trans, -1e9)
        em = np.zeros((n, longest, k))
        np.add.at(em, (fj, ft), w[fi])
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = tr[0][None] + em[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None], lse(alpha[:, t - 1, :, None] + tr[None], 1) + em[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], lse(tr[None] + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = lse(alpha[np.arange(n), lens - 1], 1)
        marg = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        grad_w = gold_w - penalty * n * w / 10
        np.subtract.at(grad_w, fi, marg[fj, ft])
        grad_t = gold_t - penalty * n * trans - np.where(np.arange(k)[:, None] == 0, marg[:, 0].sum(0)[None], 0)
        for t in range(1, longest):
            pair = alpha[:, t - 1, :, None] + tr[None] + (em[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            grad_t -= (np.exp(pair) * mask[:, t, None, None]).sum(0)
        for p, g, a, b in ((w, grad_w, 0, 1), (trans, np.where(allowed, grad_t, 0), 2, 3)):
            state[a] = 0.9 * state[a] + 0.1 * g
            state[b] = 0.999 * state[b] + 0.001 * g * g
            p += rate * (state[a] / (1 - 0.9**step)) / (np.sqrt(state[b] / (1 - 0.999**step)) + 1e-8)
    return Field({name: w[i] for name, i in names.items()}, np.where(allowed, trans, -1e9))


def _regions(text: str) -> list[tuple[int, int]]:
    """Stretches around tokens that aren't plain, two tokens of context on each side, merged."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.start() < out[-1][1]:
            if m.end() <= out[-1][1]:
                # still extend the right context of a token inside the last stretch
                out[-1][1] = max(out[-1][1], _right(text, m.end()))
                continue
        begin, end = _left(text, m.start()), _right(text, m.end())
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


_AFTER = re.compile(r"(?:\s+\S+){0,2}")


def _right(text: str, at: int) -> int:
    return _AFTER.match(text, at).end()


def _left(text: str, at: int) -> int:
    for _ in range(2):
        i = at
        while i and text[i - 1].isspace():
            i -= 1
        if not i:
            break
        while i and not text[i - 1].isspace():
            i -= 1
        at = i
    return at


#: How addresses spell their signs.
_SPELT_AT = re.compile(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+", re.I)
_SPELT_DOT = re.compile(r"\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+", re.I)


def plausible(kind: str, found: str) -> bool:
    """The exact check of a span that the field found: digits and their sums, as the kind has them; an address has a domain of two parts."""
    if kind == "email":
        plain = _SPELT_AT.sub("@", _SPELT_DOT.sub(".", found), count=1)
        return any(_emails(plain))
    d = _digits(found)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 7 <= len(d) <= 15
    if kind == "ip":
        head = re.match(r"[0-9]+(?:\.[0-9]+){3}(?![0-9.])", found)
        return head is not None and all(len(x) < 4 and int(x) <= 255 for x in head.group().split("."))
    return True


def added_spans(texts: list[str], bases: list[list[Span]], field: Field) -> list[list[Span]]:
    """The field's spans of every text that touch no base span."""
    where, tokens, seqs = [], [], []
    for i, t in enumerate(texts):
        for a, b in _regions(t) if field.islands else [(0, len(t))]:
            spans = [m.span() for m in _TOKEN.finditer(t, a, b)]
            if spans:
                where.append((i, spans))
                tokens.append([t[x:y] for x, y in spans])
    if not tokens:
        return [[] for _ in texts]
    seqs = [field.emissions(t) for t in tokens]
    out: list[list[Span]] = [[] for _ in texts]
    for (i, spans), labels in zip(where, field.viterbi(seqs), strict=True):
        if not labels.any():
            continue
        open_, got = None, []
        for (x, y), label in zip(spans, labels.tolist(), strict=True):
            name = LABELS[label]
            if name[0] == "I" and open_ and open_[0] == name[2:]:
                open_[2] = y
                continue
            if open_:
                got.append(open_)
            open_ = [name[2:], x, y] if name[0] == "B" else None
        if open_:
            got.append(open_)
        for kind, x, y in got:
            while y > x and texts[i][y - 1] in _EDGE:
                y -= 1
            while x < y and texts[i][x] in _EDGE:
                x += 1
            if x < y and plausible(kind, texts[i][x:y]) and not any(a < y and x < b for _, a, b in bases[i]):
                out[i].append((kind, x, y))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text: str = "text", mask: bool = False, field: Field | None = None) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base and spans (strings of kind:start:end).

    With mask, text holds the masked text; without, it is left out.
    """
    model = field or train()
    outs = [*(f"n_{k}" for k in KINDS), "base", "spans"]
    rest = [c for c in docs.columns if c not in outs and c != text]
    src = docs.select(*rest, text)
    payload = (model.weights, model.transitions)
    cell: list[Field] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cell:
            cell.append(Field(*payload))
        for batch in batches:
            raw = batch.column(len(rest)).to_pylist()
            texts = [t or "" for t in raw]
            bases = [base_spans(t) for t in texts]
            extra = added_spans(texts, bases, cell[0])
            counts = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in KINDS]
            cols = [*counts, pa.array([listed(b) for b in bases], pa.string()), pa.array([listed(b + e) for b, e in zip(bases, extra, strict=True)], pa.string())]
            names = list(outs)
            if mask:
                cols.append(pa.array([r if r is None else masked(r, b + e) for r, b, e in zip(raw, bases, extra, strict=True)], pa.string()))
                names.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *cols], names=[*rest, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), *(f"n_{k} bigint" for k in KINDS), "base string", "spans string", *([f"`{text}` string"] if mask else [])])
    return src.mapInArrow(tidied("pii", run), schema)


def op4_pii(spark, sf_dir) -> DataFrame:
    from pyspark.sql import functions as F

    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op4_pii": op4_pii}
