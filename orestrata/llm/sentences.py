"""Sentence units in texts of any language and script.

1. Layout: blank lines end a unit, and so does a line of its own (heading, list
   item). A line break inside a wrapped paragraph is white space.
2. Candidates: every sentence mark, with the closing marks after it, outside
   quotations and parentheses; in scripts that part sentences by spaces alone,
   every such space.
3. Each candidate is classified by a maximum-entropy model over the tokens on
   both sides: how often they open or close paragraphs anywhere in the corpus,
   their length, case, digits and script, the mark and what follows it.
4. The model is trained on reliable boundaries: ends of paragraphs and emphatic
   marks before a usual opener, against marks before lower case, before
   punctuation, or after a token that never closes a paragraph.

The token statistics are exact counts over all documents, added up where the
documents are. The counts stay a table: documents are read in groups, and each
group is given the counts of its tokens, all of them, however many the corpus
has.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from orestrata.session import settle, spread

#: Documents the classifier is trained on, at most.
TRAINING_DOCUMENTS = 4000
#: Characters of a group of texts, about; it is read with the counts of its tokens.
GROUP_CHARS = 1 << 23
LEXICAL_SLOTS = 1 << 13

# Marks that may end a sentence. The semicolon does in Greek only.
MARKS = ".!?…。！？．｡։؟۔।॥።፧፨၊။᙮᠃;;"
_HARD = "。！？．｡।॥።፧፨။؟!?"
CLOSERS = "\"'”’»)]}」』》）】〉›“"
_PAIRS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "《": "》", "【": "】", "«": "»", "“": "”", "„": "“”"}
_BRACKETS = re.compile("[" + re.escape("".join(_PAIRS) + "".join(_PAIRS.values()) + '"') + "]")
_BULLET = re.compile(r"[ \t]*(?:[-*•–—‣·◦]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\))[ \t]+\S")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*|\x0c\s*")
_SPACED_SCRIPT = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
_MARK_RUN = re.compile(r"[" + re.escape(MARKS) + r"]+")
_WORD = re.compile(r"[^\W_]+(?:['’.\-][^\W_]+)*")
_NEXT_WORD = re.compile(r"[ \n]+([^\W\d_]+)")
_DIGIT = re.compile(r"\d+")
_SKIP = re.compile(r"\s*")


@lru_cache(maxsize=1 << 16)
def script_of(ch: str) -> str:
    """A coarse script name of a letter; ``digit`` and ``other`` for the rest."""
    o = ord(ch)
    if ch.isdigit():
        return "digit"
    if o < 0x250:
        return "latin" if ch.isalpha() else "other"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x590 <= o < 0x780:
        return "semitic"
    if 0x900 <= o < 0xE00:
        return "indic"
    if 0xE00 <= o < 0xF00 or 0x1000 <= o < 0x10A0 or 0x1780 <= o < 0x1800:
        return "spaced"
    if 0x1200 <= o < 0x13A0:
        return "ethiopic"
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x32000:
        return "han"
    if 0x1100 <= o < 0x1200 or 0xAC00 <= o < 0xD7B0:
        return "hangul"
    return "letter" if ch.isalpha() else "other"


@lru_cache(maxsize=1 << 16)
def _shape(word: str) -> str:
    """A token as the tables know it: digits masked, capitals of codes and initials folded."""
    if word.isdigit():
        return "0"
    if any(c.isdigit() for c in word):
        return "<code>" if word[0].isupper() else _DIGIT.sub("0", word)
    if len(word) == 1 and word.isupper():
        return "<initial>"
    if len(word) > 1 and word.isupper():
        return "<capitals>"
    return word


_AROUND = "\"'“”„‘’«»()[]（）「」『』,;:"


def token_before(text: str, at: int, lo: int) -> str:
    """The token that ends at ``at``, without opening marks; in scripts without spaces its last two characters."""
    raw = text[max(lo, at - 40):at]
    if not raw or raw[-1].isspace():
        return ""
    raw = raw.rsplit(None, 1)[-1]
    if not raw.isascii() and max(raw) >= "\u3040":
        for i in range(len(raw) - 2, -1, -1):
            if script_of(raw[i]) == "han":
                raw = raw[i:]
                break
    return raw.strip(_AROUND)[-12:]


def token_after(text: str, at: int, hi: int) -> str:
    """The token that begins at or after ``at``, white space skipped; of scripts without spaces its first characters."""
    while at < hi and text[at].isspace():
        at += 1
    if at >= hi:
        return ""
    kind = script_of(text[at])
    if kind == "han":
        stop = at
        while stop < min(hi, at + 4) and text[stop].isalnum():
            stop += 1
        return text[at:stop]
    if kind == "spaced":
        return text[at:at + 8]
    m = _WORD.match(text, at)
    if m:
        word = m.group()[:24]
        # A number says little; the word after it tells more.
        more = _NEXT_WORD.match(text, m.end(), hi) if word.isdigit() else None
        return f"0 {more.group(1)[:24]}" if more else word
    return text[at]


@dataclass(slots=True)
class Candidate:
    mark: int  # where the mark begins
    end: int  # where the unit would end
    next: int  # first character after white space
    before: str
    after: str
    lo: int  # where the paragraph begins, -1 if what stands earlier doesn't count
    kind: str


def _depths(text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """Spans (open, close, 1 if a parenthesis), in order, of the outermost quotations and parentheses that are closed within the paragraph.

    One pass: a closing mark ends the innermost span it can end, and what was
    opened inside that span was never closed. Unclosed openings are no spans,
    but closed ones within them are.
    """
    closed: list[tuple[int, int, int]] = []
    stack: list[tuple[int, str, int]] = []
    waiting: dict[str, int] = {}

    def pop() -> tuple[int, str, int]:
        top = stack.pop()
        for c in top[1]:
            waiting[c] -= 1
        return top

    def push(at: int, closers: str, paren: int) -> None:
        stack.append((at, closers, paren))
        for c in closers:
            waiting[c] = waiting.get(c, 0) + 1

    for m in _BRACKETS.finditer(text, lo, hi):
        i, ch = m.start(), m.group()
        opens = ch in _PAIRS or ch == '"' and (i == lo or text[i - 1].isspace() or text[i - 1] in "([（") and i + 1 < hi and not text[i + 1].isspace()
        if stack and ch in stack[-1][1] or not opens and waiting.get(ch, 0) > 0:
            top = pop()
            while ch not in top[1]:
                top = pop()
            closed.append((top[0], i, top[2]))
        elif opens:
            push(i, _PAIRS.get(ch, ch), int(ch in "([（【"))
    out: list[tuple[int, int, int]] = []
    for span in sorted(closed):
        if not out or span[0] > out[-1][1]:
            out.append(span)
    return out


def _end_of(text: str, lo: int, hi: int) -> int:
    """``hi`` without the white space before it."""
    if hi > lo and not text[hi - 1].isspace():
        return hi
    while hi > lo and text[hi - 1].isspace():
        hi -= 1
    return hi


def candidates(text: str, lo: int, hi: int) -> list[Candidate]:
    """All places within a paragraph where a sentence could end before its end."""
    out: list[Candidate] = []
    spans = _depths(text, lo, hi)
    head = lo
    while head < hi and text[head].isspace():
        head += 1
    opened_at = [a for a, _, _ in spans]
    begins = {b: (a, paren) for a, b, paren in spans}

    def inside(i: int) -> bool:
        """Strictly within an outermost quotation or parenthesis."""
        k = bisect_right(opened_at, i - 1) - 1
        return k >= 0 and opened_at[k] < i < spans[k][1]

    at = lo
    for m in _MARK_RUN.finditer(text, lo, hi):
        a, b = m.span()
        if a < at:
            continue
        mark = m.group()
        if mark[0] in ";;" and not (a > lo and script_of(text[a - 1]) in ("greek",) or a > lo and text[a - 1].isdigit() and _greek_near(text, a, lo)):
            continue
        end, closed, standalone = b, False, False
        while end < hi:
            ch = text[end]
            if ch in CLOSERS and not (ch in "“\"'" and (end + 1 < hi and not text[end + 1].isspace() and ch != '"' and end not in begins)):
                if ch == '"' and end not in begins:
                    break
                if end in begins:
                    closed = True
                    opened, paren = begins[end]
                    standalone = bool(paren) and (opened <= head or _opens_next(out, opened))
                end += 1
                continue
            if ch in "   " and end + 1 < hi and text[end + 1] == "»" and end + 1 in begins:
                closed, end = True, end + 2
                continue
            if ch in MARKS and ch not in ";;" and end > b:
                end += 1
                continue
            break
        if spans and not closed and (inside(a) or inside(end - 1) and end - 1 not in begins):
            continue
        at = end
        rest = _SKIP.match(text, end, hi).end()
        if rest >= hi:
            break
        gap = rest > end
        nxt = text[rest]
        if gap:
            before = token_before(text, a, lo)
        elif script_of(nxt) == "han" or nxt in "「『（《" or nxt in "“\"(" and rest + 1 < hi and (text[rest + 1].isupper() or script_of(text[rest + 1]) == "han"):
            before = token_before(text, a, lo)
            if mark[-1] in ".…" and len(mark) == 1 and len(before) < 2 and not before.isdigit():
                continue
        elif mark[-1] in ".…" and not closed:
            # Without a space a full stop ends a sentence only between a word and a capital.
            if not nxt.isupper():
                continue
            before = token_before(text, a, lo)
            if not (len(before) >= 3 and before[-1].isalnum() and "." not in before and not before.isupper() and rest + 1 < hi and not text[rest + 1] == "."):
                continue
            if before[-1].isdigit() and not before.isdigit():
                continue
        elif mark[-1] in "!?;;" and not closed and not nxt.isupper() and script_of(nxt) not in ("han", "hangul", "spaced"):
            continue
        else:
            before = token_before(text, a, lo)
        kind = "standalone" if standalone else "closed" if closed else "plain"
        out.append(Candidate(a, end, rest, before, token_after(text, rest, hi), lo, kind))
    if _SPACED_SCRIPT.search(text, lo, hi):
        taken = {c.next for c in out}
        for m in re.finditer(r"\s+", text[lo:hi]):
            a, b = lo + m.start(), lo + m.end()
            if a <= lo or b >= hi or b in taken or inside(a):
                continue
            titled = script_of(text[b]) == "latin" and text[b].isupper() and b + 1 < hi and text[b + 1].islower()
            if script_of(text[a - 1]) == "spaced" and (script_of(text[b]) == "spaced" or titled or text[b] in "\"“(¿¡«"):
                out.append(Candidate(a, a, b, text[max(lo, a - 8):a], token_after(text, b, hi), -1, "space"))
        out.sort(key=lambda c: c.end)
    return out


def earlier_of(text: str, c: Candidate) -> str:
    """The token before the one that stands before a candidate."""
    if c.lo < 0:
        return ""
    end = _end_of(text, c.lo, c.mark)
    own = text[max(c.lo, c.mark - 80):end].rsplit(None, 1)
    return token_before(text, _end_of(text, c.lo, end - len(own[-1]) if own else end), c.lo)


def _opens_next(out: list[Candidate], opened: int) -> bool:
    """Whether a parenthesis opens right after the last candidate, so that it may be a sentence of its own."""
    return bool(out) and out[-1].next == opened


def _greek_near(text: str, at: int, lo: int) -> bool:
    return any(script_of(c) == "greek" for c in text[max(lo, at - 30):at])


def blocks(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of paragraphs; kind is ``line`` for a heading or list item on a line of its own, else ``text``.

    A first line counts as a heading if it has no mark at its end and the next
    word would have fitted on it, given the widest line of the paragraph.
    """
    out = []
    at = 0
    ends = [(m.start(), m.end()) for m in _BLANK.finditer(text)] + [(len(text), len(text))]
    for stop, after in ends:
        if text[at:stop].strip():
            out.extend(_lines(text, at, stop))
        at = after
    return out


def _lines(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    spans, a = [], lo
    while a < hi:
        b = text.find("\n", a, hi)
        b = hi if b < 0 else b
        if text[a:b].strip():
            spans.append((a, b))
        a = b + 1
    if not spans:
        return []
    width = max(len(text[a:b].rstrip()) for a, b in spans)
    out: list[tuple[int, int, str]] = []
    i, listing = 0, True
    while i < len(spans):
        a, b = spans[i]
        if listing and _BULLET.match(text, a, b) and (len(spans) == 1 or i + 1 == len(spans) or i > 0 or _list_like(text, spans)):
            out.append((a, b, "line"))
            i += 1
            continue
        line = text[a:b].rstrip()
        if i + 1 < len(spans) and i == 0:
            word = text[spans[i + 1][0]:spans[i + 1][1]].split(None, 1)[0]
            first = word[0]
            if script_of(first) == "han" or script_of(line[-1]) == "han":
                word = first
            ended = line[-1] in MARKS or line[-1] in CLOSERS and len(line) > 1 and line[-2] in MARKS
            if not ended and line[-1] not in ",:;—-" and not first.islower() and len(line) + 1 + len(word) <= width and len(line) <= 80:
                out.append((a, b, "line"))
                i += 1
                listing = bool(_BULLET.match(text, spans[i][0], spans[i][1]))
                continue
        listing = False
        # The rest is running text, up to a list that begins inside it.
        j = i
        while j + 1 < len(spans) and not (re.match(r"[ \t]*[-*•–‣◦][ \t]+\S", text[spans[j + 1][0]:spans[j + 1][1]])):
            j += 1
        out.append((a, spans[j][1], "text"))
        i, listing = j + 1, True
    return out


def _list_like(text: str, spans: list[tuple[int, int]]) -> bool:
    """Whether a numbered first line is an item: the next line is one too, or the line is short and unended."""
    if len(spans) > 1 and _BULLET.match(text, *spans[1]):
        return True
    line = text[spans[0][0]:spans[0][1]].rstrip()
    return line.lstrip()[0] in "-*•–‣◦" or line[-1] not in MARKS and len(line) <= 60


# --- statistics and features -------------------------------------------------------------------------------------------

#: Counts of a token: how often it opens a paragraph or stands after a candidate, of how often; the same for closing and standing before.
TABLES = ("opens", "seen_after", "closes", "seen_before")


def token_key(token: str) -> int:
    """A token as the statistics know it: the signed 64-bit hash of its shape."""
    h = xxhash.xxh64_intdigest(_shape(token))
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Statistics:
    """How often tokens open or close paragraphs, of how often they stand after or before a candidate."""

    keys: np.ndarray  # sorted hashes
    counts: np.ndarray  # (tokens, 4)
    sums: np.ndarray  # (4,) over all tokens, those left out included

    def __post_init__(self) -> None:
        self.open_rate = float((self.sums[0] + 1) / (self.sums[1] + 2))
        self.close_rate = float((self.sums[2] + 1) / (self.sums[3] + 2))
        self._memo: dict[tuple[str, int], tuple[float, float]] = {}

    @classmethod
    def of(cls, counters: list[Counter]) -> "Statistics":
        """From counters by table of some texts."""
        keys = np.array(sorted(set().union(*counters)), dtype=np.int64)
        counts = np.array([[c.get(int(k), 0) for c in counters] for k in keys], dtype=np.float32).reshape(-1, 4)
        return cls(keys, counts, counts.sum(axis=0, dtype=np.float64))

    @classmethod
    def held(cls, parts: list, sums: np.ndarray) -> "Statistics":
        """From Arrow tables or batches with the counts of some tokens, and the sums over all."""
        keys = np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(p.column("token")) for p in parts)])
        counts = np.zeros((len(keys), len(TABLES)), dtype=np.float32)
        for i, t in enumerate(TABLES if parts else ()):
            counts[:, i] = np.concatenate([np.asarray(p.column(t)) for p in parts])
        order = np.argsort(keys)
        return cls(keys[order], counts[order], sums)

    def rate(self, token: str, side: int) -> tuple[float, float]:
        """Log of the smoothed rate against the corpus's, and the count behind it."""
        got = self._memo.get((token, side))
        if got is None:
            key = token_key(token)
            at = int(np.searchsorted(self.keys, key))
            known = at < len(self.keys) and self.keys[at] == key
            hit, seen = (float(x) for x in self.counts[at, 2 * side:2 * side + 2]) if known else (0.0, 0.0)
            prior = self.open_rate if side == 0 else self.close_rate
            got = (float(np.log((hit + 2 * prior) / (seen + 2)) - np.log(prior)), seen)
            if len(self._memo) > 100_000:
                self._memo.clear()
            self._memo[token, side] = got
        return got


def _observe(text: str):
    """(paragraphs as (lo, hi, kind, candidates, last candidate-like end))."""
    for lo, hi, kind in blocks(text):
        yield lo, hi, kind, candidates(text, lo, hi) if kind == "text" else []


def _final(text: str, lo: int, hi: int) -> tuple[str, str] | None:
    """Token and mark at the end of a paragraph, if it ends with a mark."""
    end = _end_of(text, lo, hi)
    while end > lo and text[end - 1] in CLOSERS:
        end -= 1
    b = end
    while b > lo and text[b - 1] in MARKS:
        b -= 1
    if b == end:
        if end > lo and script_of(text[end - 1]) == "spaced":
            return text[max(lo, end - 8):end], " "
        return None
    return token_before(text, b, lo), text[b:end]


def count_tokens(texts) -> list[Counter]:
    """The four counters over some texts, by hash of the token; a token that the classifier may only ask for counts 0."""
    opens, after, closes, before = tables = [Counter() for _ in TABLES]
    for text in texts:
        if not text or text.isspace():
            continue
        for lo, hi, kind, found in _observe(text):
            if kind != "text":
                continue
            first = token_after(text, lo, hi)
            opens[first] += 1
            after[first] += 1
            last = _final(text, lo, hi)
            if last:
                closes[last[0]] += last[1][0] not in "!?！？"
                before[last[0]] += last[1][0] not in "!?！？"
            for c in found:
                after[c.after] += 1
                before[c.before] += text[c.mark] not in "!?！？"
    out = []
    for table in tables:
        hashed: Counter = Counter()
        for token, n in table.items():
            hashed[token_key(token)] += n
        out.append(hashed)
    return out


_CLASSES = ("latin", "greek", "cyrillic", "semitic", "indic", "spaced", "ethiopic", "han", "hangul", "digit", "other", "letter")


DENSE = 40
_OPENING = "\"“„«「『(（¿¡["


# Features by what they depend on, as (index, value); each group is scored once for equal arguments.

def _of_before(b: str, stats: Statistics) -> tuple[list[tuple[int, float]], int]:
    closes, n = stats.rate(b, 1)
    dense = [
        (2, closes), (4, closes * min(1.0, n / 10.0)), (8, float(len(b) == 1)), (9, float(b.isdigit() and len(b) <= 2)), (10, float(b[-1:].isdigit())), (11, float("." in b)),
        (12, float(b.isupper() and len(b) > 1)), (13, min(len(b), 10) / 10.0), (22, float(b[:1].isupper()))]
    return dense, xxhash.xxh32_intdigest("b " + _shape(b)) % LEXICAL_SLOTS


def _of_after(a: str, stats: Statistics) -> tuple[list[tuple[int, float]], int]:
    opens, n = stats.rate(a, 0)
    return [(1, opens), (3, opens * min(1.0, n / 10.0))], xxhash.xxh32_intdigest("a " + _shape(a)) % LEXICAL_SLOTS


def _of_earlier(e: str, number: bool) -> int:
    return xxhash.xxh32_intdigest("e " + _shape(e) + " " + ("0" if number else "w")) % LEXICAL_SLOTS


def _of_marks(mark: str, dots: bool, nxt: str, last: str, gap: str, kind: str) -> list[tuple[int, float]]:
    script = script_of(nxt)
    return [
        (0, 1.0), (5, float(mark in _HARD)), (6, float(dots)), (7, float(mark == " ")), (14, float(nxt.isupper())), (15, float(nxt.isdigit())), (16, float(nxt in _OPENING)),
        (17, float(not gap)), (18, float("\n" in gap)), (19, float(len(gap) > 1 and "\n" not in gap)), (20, float(kind == "closed")), (21, float(kind == "standalone")),
        (23 + _CLASSES.index(script), 1.0), (36, float(bool(last) and script_of(last) != script and script not in ("digit", "other")))]


def _marks_of(text: str, c: Candidate) -> tuple[str, bool, str, str, str, str]:
    gap = text[c.end:c.next]
    mark = text[c.mark] if c.kind != "space" else " "
    # Of a gap only its width up to two and a line break matter.
    return mark, mark == "…" or text.startswith("...", c.mark), text[c.next], c.before[-1:], "\n" if "\n" in gap else gap[:2], c.kind


def features(text: str, c: Candidate, stats: Statistics) -> tuple[np.ndarray, list[int]]:
    """Dense values and hashed lexical indices of a candidate."""
    dense = np.zeros(DENSE)
    (one, b), (two, a) = _of_before(c.before, stats), _of_after(c.after, stats)
    for i, v in [*one, *two, *_of_marks(*_marks_of(text, c))]:
        dense[i] = v
    return dense, [b, a, _of_earlier(earlier_of(text, c), c.before.isdigit())]


def continues(text: str, c: Candidate) -> bool:
    """Whether what follows can't open a sentence: a lower-case word without a capital in it, or punctuation."""
    nxt = text[c.next]
    if nxt.islower():
        return c.after[1:] == c.after[1:].lower()
    return nxt in ",;:—–-)]»”…%°/"


def reliable_label(text: str, c: Candidate, stats: Statistics) -> int | None:
    """1 or 0 where a candidate's nature is plain, else None."""
    nxt = text[c.next]
    mark = text[c.mark] if c.kind != "space" else " "
    if continues(text, c):
        return 0
    closes, n_before = stats.rate(c.before, 1)
    opens, n_after = stats.rate(c.after, 0)
    if mark in ".．" and c.kind == "plain" and n_before >= 12 and closes < -1.5:
        return 0
    if n_after >= 12 and opens < -1.8 and not nxt.isdigit() and not (nxt in "\"“„«「『(（¿¡["):
        return 0
    if opens > -0.4 and n_after >= 8 and c.kind != "closed" and (mark in _HARD or closes > -0.4 and n_before >= 8):
        return 1
    return None


class Model:
    """Weights of the classifier, and the statistics its features come from."""

    def __init__(self, dense: np.ndarray, lexical: np.ndarray, stats: Statistics) -> None:
        self.dense, self.lexical, self.stats = dense, lexical, stats
        self._scores: dict[tuple, float] = {}
        # What the token before the last one can change at most.
        self._reach = float(np.abs(lexical).max(initial=0.0))

    def _score(self, key: tuple) -> float:
        """Score of one group of features, remembered."""
        got = self._scores.get(key)
        if got is None:
            kind, *args = key
            if kind == "e":
                got = float(self.lexical[_of_earlier(*args)])
            elif kind == "m":
                got = sum(float(self.dense[i]) * v for i, v in _of_marks(*args))
            else:
                pairs, slot = (_of_before if kind == "b" else _of_after)(args[0], self.stats)
                got = sum(float(self.dense[i]) * v for i, v in pairs) + float(self.lexical[slot])
            if len(self._scores) > 200_000:
                self._scores.clear()
            self._scores[key] = got
        return got

    def ends(self, text: str, c: Candidate) -> bool:
        """Whether the candidate more probably ends a sentence than not."""
        score = self._score
        z = score(("b", c.before)) + score(("a", c.after)) + score(("m", *_marks_of(text, c)))
        if abs(z) > self._reach:
            return z > 0.0
        return z + score(("e", earlier_of(text, c), c.before.isdigit())) >= 0.0

    def knowing(self, parts: list) -> "Model":
        """The same classifier with the counts of other tokens; scores that don't depend on them stay remembered."""
        other = Model(self.dense, self.lexical, Statistics.held(parts, self.stats.sums))
        other._scores = {k: v for k, v in self._scores.items() if k[0] in "em"}
        return other

    def __getstate__(self):
        return {**self.__dict__, "_scores": {}}


def training_rows(texts, stats: Statistics):
    """Labelled feature rows: plain candidates, and paragraph ends with the opening of the next paragraph as right side."""
    dense, lexical, labels = [], [], []
    for text in texts:
        if not text or text.isspace():
            continue
        parts = list(_observe(text))
        for k, (lo, hi, kind, found) in enumerate(parts):
            if kind != "text":
                continue
            for c in found:
                y = reliable_label(text, c, stats)
                if y is not None:
                    d, l = features(text, c, stats)
                    dense.append(d)
                    lexical.append(l)
                    labels.append(y)
            last = _final(text, lo, hi)
            if last and k + 1 < len(parts) and parts[k + 1][2] == "text":
                start = parts[k + 1][0]
                while start < parts[k + 1][1] and text[start].isspace():
                    start += 1
                end = _end_of(text, lo, hi)
                at = end
                while at > lo and text[at - 1] in CLOSERS:
                    at -= 1
                at = max(lo, at - len(last[1].strip()))
                c = Candidate(at, end, start, last[0], token_after(text, start, parts[k + 1][1]), -1, "space" if last[1] == " " else "plain")
                d, l = features(text, c, stats)
                # The blank line itself must not be what tells.
                d[17:20] = 0.0
                dense.append(d)
                lexical.append(l)
                labels.append(1)
    return dense, lexical, labels


def train(texts, stats: Statistics, rounds: int = 60, penalty: float = 1e-3, seed: int = 3) -> Model:
    """Maximum entropy by AdaGrad on minibatches, quadratic penalty; a fixed seed makes it repeatable."""
    d, l, y = training_rows(texts, stats)
    w, v = np.zeros(DENSE), np.zeros(LEXICAL_SLOTS)
    # What holds before any example: a mark between a usual closer and a usual opener ends a sentence.
    w[0], w[1], w[2], w[5], w[14] = 0.5, 1.0, 1.0, 1.0, 0.5
    if not y:
        return Model(w, v, stats)
    x, lex, y = np.array(d), np.array(l), np.array(y, dtype=float)
    weight = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
    gw, gv = np.full(DENSE, 1e-2), np.full(LEXICAL_SLOTS, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for start in range(0, len(y), 2048):
            at = order[start:start + 2048]
            z = x[at] @ w + v[lex[at]].sum(axis=1)
            e = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at]
            g = x[at].T @ e / len(at) + penalty * w
            h = np.bincount(lex[at].ravel(), np.repeat(e, lex.shape[1]), LEXICAL_SLOTS) / len(at) + penalty * v
            gw += g * g
            gv += h * h
            w -= 0.3 * g / np.sqrt(gw)
            v -= 0.3 * h / np.sqrt(gv)
    return Model(w, v, stats)


def segment(text: str, model: Model) -> list[tuple[int, int]]:
    """Spans of the sentence units of a text, without white space at either end."""
    out = []

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))

    for lo, hi, kind, found in _observe(text):
        at = lo
        for c in found:
            if continues(text, c):
                continue
            if c.end > at and model.ends(text, c):
                add(at, c.end)
                at = c.end
        add(at, hi)
    return out


# --- the operator ------------------------------------------------------------------------------------------------------

def _runs(*columns: np.ndarray):
    """(first, end) of the stretches of rows that agree in these columns."""
    breaks = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    edges = [0, *breaks.tolist(), len(columns[0])]
    return zip(edges, edges[1:]) if edges[-1] else ()


def _in_groups(base: DataFrame) -> DataFrame:
    """All texts with their group (part, block), and of every group a row for each of its tokens with the counts within it.

    A group is what a task reads one after the other, so nothing is moved, and
    it is written, so that later passes see the same groups.
    """
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("id", base.schema["id"].dataType), T.StructField("text", T.StringType()),
        T.StructField("token", T.LongType()), *[T.StructField(t, T.LongType()) for t in TABLES]])
    most = GROUP_CHARS

    def run(batches):
        part, block, total, tables = TaskContext.get().partitionId(), 0, 0, [Counter() for _ in TABLES]

        def row_batch(n, ids, texts, tokens, columns):
            place = [pa.array(np.full(n, x, dtype=np.int32)) for x in (part, block)]
            return pa.RecordBatch.from_arrays([*place, ids, texts, tokens, *columns], names=schema.names)

        def counted(kinds):
            keys = np.array(sorted(set().union(*tables)), dtype=np.int64)
            for at in range(0, len(keys), 1 << 16):
                own = keys[at:at + (1 << 16)]
                columns = [pa.array([t[int(k)] for k in own], pa.int64()) for t in tables]
                yield row_batch(len(own), *(pa.nulls(len(own), k) for k in kinds), pa.array(own), columns)

        kinds = None
        for batch in batches:
            kinds = [c.type for c in batch.columns]
            ends = total + np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            blocks = ends // most
            for lo, hi in _runs(blocks):
                if blocks[lo] != block:
                    yield from counted(kinds)
                    block, tables = int(blocks[lo]), [Counter() for _ in TABLES]
                ids, texts = (c.slice(lo, hi - lo) for c in batch.columns)
                for table, found in zip(tables, count_tokens(texts.to_pylist())):
                    table.update(found)
                none = pa.nulls(hi - lo, pa.int64())
                yield row_batch(hi - lo, ids, texts, none, [none] * len(TABLES))
            total = int(ends[-1]) if len(ends) else total
        if kinds:
            yield from counted(kinds)

    return settle(base.mapInArrow(run, schema), "groups")


def learn(grouped: DataFrame) -> tuple[Model, DataFrame]:
    """The classifier from a bounded sample, the same in every run, and the counts of every token, which stay a table.

    Of the counts only the sums and those of the sample's tokens reach the driver.
    """
    counts = settle(grouped.where("token is not null").groupBy("token").agg(*[F.sum(t).alias(t) for t in TABLES]), "tokens")
    row = counts.agg(*[F.sum(t).alias(t) for t in TABLES]).first()
    sums = np.array([row[t] or 0 for t in TABLES], dtype=np.float64)
    texts = grouped.where("text is not null").select("text")
    n = texts.count()
    # Twice what is needed by hash, of which the first by hash are taken. Texts above 20,000 characters are left to the other documents.
    every = max(1, n // (2 * TRAINING_DOCUMENTS))
    hashed = texts.withColumn("h", F.xxhash64("text")).where((F.pmod("h", F.lit(every)) == 0) & (F.length("text") <= 20_000))
    picked = hashed.orderBy("h", "text").limit(TRAINING_DOCUMENTS)
    sample = sorted(picked.select("text").toArrow().column(0).to_pylist())
    tokens = pa.array(sorted(set().union(*count_tokens(sample))), pa.int64())
    held = counts.join(grouped.sparkSession.createDataFrame(pa.table([tokens], names=["token"])), "token")
    return train(sample, Statistics.held([held.toArrow()], sums)), counts


def split_sentences(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, start_pos, end_pos): one row per sentence unit, positions in code points, the end exclusive.

    Null, empty and blank texts give no row. A text without any mark is one
    unit per paragraph. Repeated and null ids are documents of their own; other
    columns are not read.
    """
    base = spread(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.length("text") > 0))
    spark = df.sparkSession
    grouped = _in_groups(base)
    trained, counts = learn(grouped)
    model = spark.sparkContext.broadcast(trained)
    texts = grouped.where("text is not null")
    known = grouped.where("token is not null").select("part", "block", "id", "text", "token").join(counts, "token")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // (8 * GROUP_CHARS)))
    place = F.pmod(F.col("part") + F.col("block") * F.lit(7919), F.lit(parts)).cast("int")
    # In every partition one group after the other, its counts before its texts.
    rows = texts.unionByName(known).repartitionById(parts, place).sortWithinPartitions("part", "block", F.col("text").isNotNull())

    def run(batches):
        known, group, counted, ready = model.value, None, [], False
        for batch in batches:
            part, block = (np.asarray(batch.column(c)) for c in ("part", "block"))
            is_text = np.asarray(batch.column("text").is_valid())
            for lo, hi in _runs(part, block, is_text):
                if (part[lo], block[lo]) != group:
                    group, counted, ready = (part[lo], block[lo]), [], False
                own = batch.slice(lo, hi - lo)
                if not is_text[lo]:
                    counted.append(own)
                    continue
                if not ready:
                    known, counted, ready = known.knowing(counted), [], True
                at, starts, ends = [], [], []
                for i, text in enumerate(own.column("text").to_pylist()):
                    for a, b in segment(text, known):
                        at.append(i)
                        starts.append(a)
                        ends.append(b)
                yield pa.RecordBatch.from_arrays(
                    [own.column("id").take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "start_pos", "end_pos"])

    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
