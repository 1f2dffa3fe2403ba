"""Personal data in texts: fixed patterns, and a conditional random field for what they miss.

The patterns find mail and network addresses, card and phone numbers in their plain forms. A linear-chain
conditional random field reads the words as word shapes (runs of letters and digits, signs as they are) with
their neighbours' shapes, and finds other forms: numbers without a country code, cards in odd groups,
addresses that are spelled out. It is trained on a small labelled table that is made from templates
and decoded by Viterbi over many stretches of words at once.

Most words have neither digits nor signs that matter, and none of their neighbours has. By the model such a
word is always "none". So every path passes "none" there, and only the stretches around the other
words are decoded, with the same result as decoding the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stagelens.llm.common import IS_SPACE, give_back, is_char, per_text, settle, text_slices, utf8

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
Span = tuple[str, int, int]


# --- patterns -----------------------------------------------------------------------------------

_LOCAL = re.compile(rb"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behinds only spare trying again inside a run of digits that cannot match.
_IP = re.compile(rb"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: bytes) -> bool:
    """Whether a row of ASCII digits passes the check sum."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (2 * d) % 10 + (2 * d) // 10
    return total % 10 == 0


def _only_digits(data: bytes) -> bytes:
    return bytes(b for b in data if 48 <= b <= 57)


def _is_byte(digits: bytes) -> bool:
    """Whether a run of ASCII digits, however long, is a number up to 255."""
    number = digits.lstrip(b"0")
    return digits.isdigit() and len(number) <= 3 and int(number or b"0") <= 255


def _emails(data: bytes) -> Iterator[tuple[int, int]]:
    """Matches around each @; so a long run without one is not tried from each of its places."""
    done = 0
    at = data.find(b"@")
    while at >= 0:
        first = at
        while first > done and data[first - 1] in _LOCAL_BYTES:
            first -= 1
        found = _DOMAIN.match(data, at + 1) if first < at else None
        if found:
            yield first, found.end()
            done = found.end()
        at = data.find(b"@", max(at + 1, done))


def base_spans(data: bytes) -> list[Span]:
    """Spans of the patterns in a text's bytes, as byte places, by kind and start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(data)] if b"@" in data else []
    for m in _IP.finditer(data):
        if all(_is_byte(p) for p in m[0].split(b".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(data):
        digits = _only_digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if b"+" in data:
        out += [("phone", *m.span()) for m in _PHONE.finditer(data) if 8 <= len(_only_digits(m[0])) <= 15]
    return out


# --- features -----------------------------------------------------------------------------------

_RUN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
# Words that announce something. Fixed values.
_CUES = {
    "phone": "phone", "tel": "phone", "tel.": "phone", "call": "phone", "mobile": "phone", "fax": "phone",
    "card": "card", "visa": "card", "mastercard": "card", "email": "mail", "e-mail": "mail", "mail": "mail",
    "ip": "ip", "host": "ip", "(at)": "at", "[at]": "at", "{at}": "at", "(dot)": "dot", "[dot]": "dot",
    "{dot}": "dot", "version": "number", "page": "number", "no.": "number", "order": "number", "isbn": "number",
}


# Numbers and codes are nearly all different: a worker keeps the shapes of so many words of at most
# that length, for one task.
SHAPES, SHAPE_CHARS = 1 << 14, 40


def _shape(word: str) -> tuple[str, str, int]:
    return _kept_shape(word) if len(word) <= SHAPE_CHARS else _made_shape(word)


def _made_shape(word: str) -> tuple[str, str, int]:
    """Shape with the lengths of its runs, shape without, number of digits; signs at the end are left out."""
    word = word.rstrip(".,;:!?\"'")
    exact, rough = [], []
    for run in islice((m[0] for m in _RUN.finditer(word)), 12):
        if run[0].isdigit():
            exact.append(f"d{min(len(run), 20)}")
            rough.append("d")
        elif run[0].isalpha():
            exact.append("a")
            rough.append("a")
        else:
            exact.append(run)
            rough.append(run)
    return "".join(exact), "".join(rough), sum(c.isdigit() for c in word)


_kept_shape = lru_cache(maxsize=SHAPES)(_made_shape)


def forget_shapes() -> None:
    _kept_shape.cache_clear()


def _cue(word: str) -> str:
    return _CUES.get(word.lower().strip(",;:"), "") or _CUES.get(word.lower(), "")


def features(words: list[str], i: int) -> list[str]:
    """Names of the features of the word at ``i``; words beyond the ends have the shape ^."""
    def at(k: int) -> tuple[str, str, int]:
        return _shape(words[k]) if 0 <= k < len(words) else ("^", "^", 0)

    def cue(k: int) -> str:
        return _cue(words[k]) if 0 <= k < len(words) else ""

    exact, rough, digits = at(i)
    out = [f"shape={exact}", f"rough={rough}", f"digits={min(digits, 20)}"]
    for k in (-2, -1, 1, 2):
        e, r, _ = at(i + k)
        if r != "a" and r != "^":
            out.append(f"{k}:rough={r}")
        if abs(k) == 1 and (r not in "a^" or rough != "a"):
            out.append(f"{k}:{e if e != '^' else 'a'}|{exact}")
        if cue(i + k):
            out.append(f"{k}:cue={cue(i + k)}")
    if cue(i):
        out.append(f"cue={cue(i)}")
    return out


# --- the labelled table -------------------------------------------------------------------------

# Templates: plain words are "none"; <kind text> marks words of that kind. # is a digit, @w a made-up word. Fixed values.
_TEMPLATES = (
    "@w @w @w @w @w @w @w", "@w @w. @w @w, @w @w @w.", "@W @w @w of the @w @w.", "@w - @w | @w | @w | @w.",
    "@w @w <phone +# (###) ###-####> @w @w", "@w <phone +## ### ### ####>. @w", "@w @w <phone +############> @w @w",
    "@w @w <phone (###) ###-####> @w @w", "@w call <phone (###) ###-####>, @w", "@w @w <phone ###-###-####> @w @w.",
    "tel: <phone ###.###.####> @w @w", "@w phone <phone ### ### ####> @w", "@w <phone (###) ### ####> @w @w",
    "mobile <phone 0### ######> @w", "@w @w <phone 1-###-###-####> @w @w", "phone: <phone ###-####> @w @w",
    "@w @w <email @w.##@@w#.example.com> @w @w", "@w <email @w@@w.com>, @w @w", "@w @w <email @w_@w@@w.@w.org>. @w @w",
    "@w @w <email @w (at) @w (dot) com> @w @w", "email <email @w [at] @w [dot] org> @w @w", "@w <email @w(at)@w.com> @w @w",
    "@w @w <email @w.@w [at] @w.com> @w @w", "@w <email @w {at} @w {dot} net>, @w @w",
    "@w @w <ip ##.###.##.###> @w @w", "@w host <ip ###.##.#.##>. @w", "ip <ip ###.###.##.#>:## @w @w",
    "@w @w <card ################> @w @w", "@w @w <card #### #### #### ####> @w @w", "card <card ####-####-####-####>, @w @w",
    "@w @w <card ####.####.####.####> @w @w", "visa <card #### #### #### ####>. @w", "@w <card ################> @w @w",
    "@w version # @w @w", "@w version #.#. @w @w", "@w CC @w #.#. @w @w", "@w @w #.#.# @w @w", "@w #### @w @w", "@w ## @w @w",
    "@w #### @w @w ##, @w #", "@w ####-##-## @w", "@w ##:## @w ##:##:## @w", "@w $##.## @w $#,### @w", "@w ##% @w #.#% @w",
    "page ### @w @w", "order ######## @w @w", "no. ##### @w @w", "@w ######## @w @w", "@w ##### @w ###### @w", "@w (####) @w @w",
    "isbn ###-#-##-######-# @w @w", "@w @w=##@w####@w## @w @w", "@w @w = \"#@w####@w##@w#\" @w @w", "@w AKIA##@w#@w### @w @w",
    "@w (@w @w) @w [@w] @w @w", "@w [##] @w (##) @w", "@w @w @@w @w @w", "@w ##@w @w #@w## @w @w", "@w ##x## @w ##/## @w",
    "@w ##/##/#### @w @w", "@w ### @w ### @w", "@w #,###,### @w @w", "@w @w##@w.@w @w", "#. @w @w\t#) @w @w", "@w ############ @w @w",
    "@w ####-#### @w @w", "@w ##-## @w ##-### @w", "@w ######################## @w @w", "@w %%% @w*** @w### @w$$$ @w&&&",
    "@w ### #### @w ## @w", "@w ## ## ## @w @w", "@w (## @w) @w (###) @w @w",
)
REPEATS = 12
SEED = 4


def labelled_table(repeats: int = REPEATS, seed: int = SEED) -> list[tuple[list[str], list[int]]]:
    """Rows of words with their labels, every template filled ``repeats`` times."""
    rng = np.random.default_rng(seed)
    letters = list("abcdefghijklmnopqrstuvwxyz")

    def word(upper: bool = False) -> str:
        made = "".join(rng.choice(letters, rng.integers(1, 10)))
        return made.capitalize() if upper or rng.random() < 0.1 else made

    def fill(text: str) -> str:
        text = re.sub(r"@W", lambda _: word(True), text)
        text = re.sub(r"@w", lambda _: word(), text)
        return re.sub(r"#", lambda _: str(rng.integers(10)), text)

    rows = []
    for template in _TEMPLATES:
        for _ in range(repeats):
            words, labels = [], []
            for kind, marked, plain in re.findall(r"<(\w+) ([^>]*)>|([^<]+)", template):
                for w in (marked or plain).split():
                    if not kind and labels and words and plain and not plain[0].isspace() and w == plain.split()[0]:
                        words[-1] += fill(w)  # what follows a span without a space belongs to its last word
                        continue
                    words.append(fill(w))
                    labels.append(LABELS.index(kind) if kind else 0)
            rows.append((words, labels))
    return rows


# --- the field ----------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of the features (a row each, a column per label) and of neighbouring labels."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, names: list[str]) -> np.ndarray:
        known = [self.index[n] for n in names if n in self.index]
        return self.weights[known].sum(0)


def train(rows: list[tuple[list[str], list[int]]], steps: int = 300, penalty: float = 0.002) -> Field:
    """Maximum likelihood with a quadratic penalty, by gradient ascent with momentum over all rows at once."""
    index: dict[str, int] = {}
    named = [[[index.setdefault(f, len(index)) for f in features(w, i)] for i in range(len(w))] for w, _ in rows]
    k, longest = len(LABELS), max(len(w) for w, _ in rows)
    n = len(rows)
    owner, feature = [], []
    for r, row in enumerate(named):
        for t, fs in enumerate(row):
            owner += [r * longest + t] * len(fs)
            feature += fs
    owner, feature = np.array(owner), np.array(feature)
    real = np.array([[t < len(w) for t in range(longest)] for w, _ in rows])
    gold = np.zeros((n, longest, k))
    for r, (_, labels) in enumerate(rows):
        gold[r, np.arange(len(labels)), labels] = 1
    gold_moves = np.einsum("rta,rtb->ab", gold[:, :-1], gold[:, 1:])
    weights, moves = np.zeros((len(index), k)), np.zeros((k, k))
    speed_w, speed_m, seen_w, seen_m = (np.zeros_like(x) for x in (weights, moves, weights, moves))

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    for step in range(1, steps + 1):
        scores = np.zeros((n * longest, k))
        np.add.at(scores, owner, weights[feature])
        scores = scores.reshape(n, longest, k)
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, longest):
            new = total(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = total(moves[None] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None], new, 0)
        whole = total(ahead[:, -1], 1)
        share = np.exp(ahead + behind - whole[:, None, None]) * real[:, :, None]
        pair = np.exp(
            ahead[:, :-1, :, None] + moves + (scores + behind)[:, 1:, None, :] - whole[:, None, None, None]
        ) * real[:, 1:, None, None]
        diff = (gold - share).reshape(-1, k)
        grad_w = np.zeros_like(weights)
        np.add.at(grad_w, feature, diff[owner])
        grad_w = grad_w / n - penalty * weights
        grad_m = (gold_moves - pair.sum((0, 1))) / n - penalty * moves
        for x, g, speed, seen in ((weights, grad_w, speed_w, seen_w), (moves, grad_m, speed_m, seen_m)):
            speed += 0.1 * (g - speed)
            seen += 0.01 * (g * g - seen)
            x += 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(seen / (1 - 0.99**step)) + 1e-8)
    return Field(index, weights, moves)


@cache
def field() -> Field:
    return train(labelled_table())


def viterbi(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of many stretches, padded to (stretch, word, label), each between words that are "none"."""
    n, longest, _ = scores.shape
    best = scores[:, 0] + moves[0]
    back = np.zeros(scores.shape, np.int8)
    for t in range(1, longest):
        ways = best[:, :, None] + moves
        go = ways.max(1) + scores[:, t]
        on = (t < sizes)[:, None]
        back[:, t] = np.where(on, ways.argmax(1), np.arange(scores.shape[2]))
        best = np.where(on, go, best)
    path = np.zeros((n, longest), np.int8)
    path[:, -1] = (best + moves[:, 0]).argmax(1)
    for t in range(longest - 1, 0, -1):
        path[:, t - 1] = back[np.arange(n), t, path[:, t]]
    return path


# --- texts --------------------------------------------------------------------------------------

_MATTERS = np.zeros(256, bool)
_MATTERS[list(b"0123456789@([{")] = True
REACH = 2  # words that a feature looks to either side
STRETCHES = 4096  # stretches decoded at once


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], int, int]]:
    """(text, places of its words near and in a stretch, first, last word of the stretch in that list)."""
    space = IS_SPACE[data]
    opens, closes = ~space, ~space
    opens[1:] &= space[:-1]
    closes[:-1] &= space[1:]
    heads, tails = offsets[:-1], offsets[1:]
    some = heads < tails
    opens[heads[some]] = ~space[heads[some]]
    closes[tails[some] - 1] = ~space[tails[some] - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    matter = np.append(0, np.cumsum(_MATTERS[data]))
    odd = np.flatnonzero(matter[stops] > matter[starts])
    if not len(odd):
        return
    text = np.searchsorted(offsets, starts[odd], "right") - 1
    first_word, last_word = np.searchsorted(starts, heads), np.searchsorted(starts, tails)
    lo = np.maximum(odd - REACH, first_word[text])
    hi = np.minimum(odd + REACH + 1, last_word[text])
    new = np.ones(len(odd), bool)
    new[1:] = (lo[1:] > hi[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(odd)) - 1
    for a, b, t in zip(lo[begin].tolist(), hi[end].tolist(), text[begin].tolist()):
        near = max(a - REACH, int(first_word[t])), min(b + REACH, int(last_word[t]))
        places = list(zip(starts[near[0] : near[1]].tolist(), stops[near[0] : near[1]].tolist()))
        yield t, places, a - near[0], b - near[0]


def added_spans(data: np.ndarray, offsets: np.ndarray, model: Field) -> list[tuple[int, Span]]:
    """(text, span in bytes of the whole slice) that the field finds."""
    out: list[tuple[int, Span]] = []
    held: list = []
    known: dict[tuple[str, ...], np.ndarray] = {}
    raw = data.tobytes()

    def decode() -> None:
        sizes = np.array([len(s) for _, _, s in held])
        scores = np.zeros((len(held), sizes.max(), len(LABELS)))
        for i, (_, _, s) in enumerate(held):
            scores[i, : len(s)] = s
        for (t, places, _), path, size in zip(held, viterbi(scores, sizes, model.moves), sizes):
            k = 0
            while k < size:
                label, first = path[k], k
                while k < size and path[k] == label:
                    k += 1
                if label:
                    span = _trimmed(raw, LABELS[label], places[first][0], places[k - 1][1])
                    if span:
                        out.append((t, span))
        held.clear()

    cells = longest = 0
    for t, places, a, b in _stretches(data, offsets):
        words = [raw[x:y].decode() for x, y in places]
        scores = []
        for i in range(a, b):
            names = tuple(features(words, i))
            if names not in known:
                if len(known) == SHAPES:
                    known.clear()
                known[names] = model.scores(list(names))
            scores.append(known[names])
        held.append((t, places[a:b], scores))
        longest = max(longest, len(scores))
        cells = longest * len(held)
        if len(held) == STRETCHES or cells > 1 << 18:
            decode()
            longest = 0
    if held:
        decode()
    return out


_LEAD, _TAIL = b"\"'<[{", b".,;:!?\"'>]}"


def _trimmed(raw: bytes, kind: str, a: int, b: int) -> Span | None:
    """A span without signs around it; None if it has not enough of what its kind needs."""
    while a < b and raw[a] in _LEAD:
        a += 1
    while a < b and raw[b - 1] in _TAIL:
        b -= 1
    part = raw[a:b]
    digits = _only_digits(part)
    if kind == "phone" and not 7 <= len(digits) <= 15:
        return None
    if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
        return None
    if kind == "ip" and not (part.count(b".") == 3 and all(_is_byte(p) for p in part.split(b"."))):
        return None
    if kind == "email" and not (b"@" in part or b"at" in part.lower()):
        return None
    return kind, a, b


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_spans(texts: pa.Array, model: Field) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, spans that the field adds) of each text, in code points, end exclusive.

    An added span never touches one of the patterns, which stay as they are.
    """
    data, offsets = utf8(texts)
    matters = np.append(0, np.cumsum(_MATTERS[data]))
    busy = np.flatnonzero(matters[offsets[1:]] > matters[offsets[:-1]])
    chars = np.append(0, np.cumsum(is_char(data)))
    more: dict[int, list[Span]] = {}
    for t, span in added_spans(data, offsets, model):
        more.setdefault(t, []).append(span)
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in range(len(offsets) - 1)]
    for t in busy.tolist():
        first, stop = int(offsets[t]), int(offsets[t + 1])
        base = [(k, a + first, b + first) for k, a, b in base_spans(data[first:stop].tobytes())]
        new = [s for s in more.get(t, []) if all(s[2] <= a or s[1] >= b for _, a, b in base)]
        out[t] = tuple(
            [(k, int(chars[a] - chars[first]), int(chars[b] - chars[first])) for k, a, b in spans] for spans in (base, new)
        )
    return out


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the patterns by kind, a digest of their spans, all spans, the number added.

    A null text is empty and has none; repeated rows each get their row; an empty table gives an empty
    one.
    """
    model = field()  # some hundred weights, trained once and sent along

    def work(texts: pa.Array) -> dict[str, object]:
        found = find_spans(texts, model)
        counts = {f"n_{k}": np.array([sum(s[0] == k for s in base) for base, _ in found], np.int64) for k in KINDS}
        return {
            **counts,
            "base_sha256": [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found],
            "spans": [_joined(base + new) for base, new in found],
            "n_added": np.array([len(new) for _, new in found], np.int64),
        }

    fields = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return per_text(docs.select(key, text), work, fields, forget=forget_shapes)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first names the kind."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask_personal_data(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the spans in their texts replaced, and the length in ``n_chars`` brought up to date."""
    names = docs.columns
    at, model = names.index(text), field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for part in text_slices(batch, at):
                found = [base + new for base, new in find_spans(part.column(at), model)]
                columns = list(part.columns)
                if any(found):
                    old = part.column(at).to_pylist()
                    new = [masked(t, s) if s else t for t, s in zip(old, found)]
                    columns[at] = pa.array(new, part.schema.field(at).type)
                    if n_chars in names:
                        k = names.index(n_chars)
                        was = columns[k].to_pylist()
                        size = [len(t) if s else w for t, s, w in zip(new, found, was)]
                        columns[k] = pa.array(size, part.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)
        forget_shapes()
        give_back()

    return docs.mapInArrow(run, docs.schema)
