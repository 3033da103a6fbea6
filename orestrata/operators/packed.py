"""Splitting fields that pack several values into one string.

A field is turned into a lattice: quoted spans and escaped characters are
atomic, every other delimiter occurrence is a possible cut.  How probable a cut
at each kind of delimiter is, and how frequent each value is, is learned from
the whole column by expectation-maximisation; the Viterbi path through the
lattice is the split.

Values and words are counted exactly, where the rows are; only sums travel.  The
counts stay a table: fields in doubt are read in groups, and each group is given
the counts its fields ask for, all of them, however large the column is.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, functions as F, types as T

from orestrata.session import settle, spread

#: Distinct fields in doubt of a group, about; it is read with the counts that it asks for.
GROUP_FIELDS = 512

#: Parts between doubtful delimiters up to which every value of a stretch is looked up; in a longer
#: stretch, values of more than NEAR_PARTS parts are scored by their words, but for the whole stretch.
FULL_PARTS = 48
NEAR_PARTS = 12

#: Kinds of delimiters. Marks are cut points wherever they stand; words and
#: spaced signs only between white space.
_MARKS = {"\n": "break", "\r": "break", "\t": "tab", ";": "semicolon", "|": "pipe", ",": "comma",
          "；": "semicolon", "，": "comma", "、": "comma", "｜": "pipe"}
_SPACED = {"//": "slashes", "/": "slash", "+": "plus", "&": "ampersand", "and": "and", "AND": "and"}
KINDS = ("break", "tab", "semicolon", "pipe", "comma", "slashes", "slash", "plus", "ampersand", "and")
#: Kinds of which one alone may or may not separate: EM decides.
_DOUBTFUL = frozenset({"slash", "plus", "ampersand", "and"})
_QUOTES = {'"': '"', "“": "”", "„": "“”", "'": "'", "‘": "’", "«": "»"}

_DELIMITER = re.compile(r"[\n\r\t;|,；，、｜]|(?<![:/])//(?=\s|$)|(?<=\s)(?:[/+&]|and|AND)(?=\s)|[/+&](?=\s+[/+&]\s)")
_TROUBLE = re.compile(r"[\\\"“„'‘«]")
_DIGITS = re.compile(r"[0-9]+")
_SPACES = re.compile(r"\s+")
_NAMED = re.compile(r"\s*[:=]\s*")
_AFTER_QUOTE = re.compile(r"\s*(?:$|[\n\r\t;|,；，、｜]|(?://|[/+&]|and|AND)(?=\s|$))")
_OPENING = "^"
_RIGHT_QUOTED = re.compile(r"^([^\"“„'‘«:=]*[:=]\s*)([\"“„'‘«].*)$", re.S)
#: Two words with the space before and after each, so that a sign after the first one is seen.
_UP_TO_SPACE = re.compile(r"\s*[\"'“”„]*\s*\S+\s*\S*\s*")
_ESCAPED = re.compile(r"\\([^\w\s])")
#: What the JVM uses to find the fields with a delimiter in doubt; white space is what Python takes for it.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
DOUBTFUL_PATTERN = rf"{_SPACE}(?:/|\+|&|and|AND){_SPACE}"


def _quote_end(text: str, start: int) -> int:
    """Index after the quotation opening at ``start``, or -1 if it isn't closed before a delimiter or the end."""
    closing = _QUOTES[text[start]]
    i, n = start + 1, len(text)
    while i < n:
        ch = text[i]
        if ch == "\\":
            i += 2
            continue
        if ch in closing:
            if i + 1 < n and text[i + 1] == ch and ch in "\"'" and i > start:
                if not (i + 2 >= n and _AFTER_QUOTE.match(text, i + 1)):
                    i += 2
                    continue
            if _AFTER_QUOTE.match(text, i + 1):
                return i + 1
        i += 1
    return -1


def _inner_quote_end(text: str, start: int) -> int:
    """As above for a double quotation within a value: it may be followed by any white space, and stays on its line.

    If it isn't closed, minus the end of the line.
    """
    i, n = start + 1, len(text)
    while i < n and text[i] not in "\n\r\t":
        if text[i] == '"' and (i + 1 >= n or not text[i + 1].isalnum()):
            return i + 1
        i += 1
    return -i


def cut_points(text: str) -> list[tuple[int, int, str]]:
    """All places (start, end, kind) where ``text`` could be cut.

    Quoted spans and characters after a backslash hold none, nor does a comma
    between two digits.
    """
    out = []
    if not _TROUBLE.search(text):
        for m in _DELIMITER.finditer(text):
            ch = m.group()
            kind = _MARKS.get(ch) or _SPACED[ch]
            a, b = m.span()
            if kind == "comma" and 0 < a and b < len(text) and text[a - 1].isdigit() and text[b].isdigit():
                continue
            out.append((a, b, kind))
        return out
    i, n, fresh = 0, len(text), True
    unclosed: set[str] = set()  # what no later mark closes isn't looked for again
    dead = 0
    while i < n:
        ch = text[i]
        if ch == "\\":
            i, fresh = i + 2, False
            continue
        if ch in _QUOTES:
            end = -1
            if fresh and ch not in unclosed:
                end = _quote_end(text, i)
                if end < 0:
                    unclosed.add(ch)
            elif ch == '"' and i >= dead and text[i - 1].isspace():
                end = _inner_quote_end(text, i)
                if end < 0:
                    dead, end = -end, -1  # up to the end of the line none is closed
            if end > 0:
                i, fresh = end, False
                continue
        m = _DELIMITER.match(text, i)
        if m:
            sign = m.group()
            kind = _MARKS.get(sign) or _SPACED[sign]
            a, b = m.span()
            if not (kind == "comma" and 0 < a and b < n and text[a - 1].isdigit() and text[b].isdigit()):
                out.append((a, b, kind))
                fresh = True
            i = b
            continue
        if ch in ":=":
            fresh = True
        elif not ch.isspace():
            fresh = False
        i += 1
    return out


def _strip_quotes(v: str) -> str:
    while len(v) >= 2 and v[0] in _QUOTES and v[-1] in _QUOTES[v[0]]:
        end = _quote_end(v, 0)
        if end != len(v):
            break
        ch = v[-1]
        v = v[1:-1]
        if ch in "\"'":
            v = v.replace(ch + ch, ch)
        v = v.strip()
    return v


def clean_value(raw: str, tagged: bool) -> str:
    """A value without surrounding white space, quoting and escaping; of a tag, the right side alone may be quoted."""
    v = raw.strip()
    if _TROUBLE.search(v):
        v = _strip_quotes(v)
        if tagged:
            m = _RIGHT_QUOTED.match(v)
            if m:
                right = _strip_quotes(m.group(2))
                if right != m.group(2):
                    v = m.group(1) + right
        v = _ESCAPED.sub(r"\1", v).strip()
    return v


def _key(value: str) -> str:
    return _DIGITS.sub("0", _SPACES.sub(" ", _NAMED.sub(": ", value).strip(" \t\r\n\"'“”„").casefold()))


def _hash(text: str) -> int:
    """Signed 64-bit hash, as the counts are keyed by."""
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Counts:
    """Counts by hash, sorted by it, and what all entries come to, those left out included."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    total: float = 0.0
    kinds: float = 0.0  # distinct entries
    single: float = 0.0  # entries seen about once

    def get(self, text: str) -> float:
        key = _hash(text)
        at = int(np.searchsorted(self.keys, key))
        return float(self.counts[at]) if at < len(self.keys) and self.keys[at] == key else 0.0

    @classmethod
    def of(cls, counted: dict[str, float]) -> "Counts":
        """Of counts by text."""
        keys = np.array([_hash(k) for k in counted], dtype=np.int64)
        n = np.array(list(counted.values()), dtype=np.float32)
        order = np.argsort(keys)
        return cls(keys[order], n[order], float(n.sum()), float(len(n)), float((n < 1.5).sum()))


@dataclass
class SplitModel:
    """What one column taught: value and word frequencies, and how often each kind of delimiter cuts."""

    values: Counts = field(default_factory=Counts)
    words: Counts = field(default_factory=Counts)
    cut: dict[str, float] = field(default_factory=lambda: {k: 0.5 if k in _DOUBTFUL else 0.99 for k in KINDS})

    def __post_init__(self) -> None:
        self.value_total, self.word_total = self.values.total, self.words.total
        self.word_kinds = self.words.kinds + 1.0
        self.novel = 2.0 + self.values.single
        self._memo: dict[str, float] = {}
        self._words: dict[str, float] = {}

    def word_count(self, word: str) -> float:
        return self.words.get(word)

    def _log_word(self, word: str) -> float:
        known = self._words.get(word)
        if known is None:
            if len(self._words) > 100_000:
                self._words.clear()
            known = self._words[word] = math.log((self.word_count(word) + 0.1) / (self.word_total + 0.1 * self.word_kinds))
        return known

    def log_value(self, key: str) -> float:
        """Log frequency of a value, backed off to its words and to how often its first word opens a value.

        Values seen once tell how much to leave for new ones.

        One occurrence is discounted, so a field never confirms a reading of its own that occurs nowhere else.
        """
        known = self._memo.get(key)
        if known is not None:
            return known
        first, *rest = key.split(" ")
        base = self._log_word(_OPENING + first) + sum(map(self._log_word, rest))
        seen = max(0.0, self.values.get(key) - 1.0)
        got = math.log((seen + self.novel * math.exp(max(base, -300.0))) / (self.value_total + self.novel))
        if len(self._memo) > 50_000:
            self._memo.clear()
        self._memo[key] = got
        return got


    def log_novel(self, base: np.ndarray) -> np.ndarray:
        """``log_value`` of values never seen, from the log frequencies of their words."""
        return np.log(self.novel) + np.maximum(base, -300.0) - math.log(self.value_total + self.novel)

    def words_before(self, text: str, begins: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log frequencies of words: the first of each part as an opening, all up to each part's end, and all up to its first word's."""
        opening, upto, after, total = [], [], [], 0.0
        for i, (a, b) in enumerate(zip(begins, ends)):
            # The sign before a part is a word of what is joined.
            if i:
                total += sum(map(self._log_word, _key(text[ends[i - 1]:a]).split(" ")))
            first, *rest = _key(text[a:b]).split(" ")
            opening.append(self._log_word(_OPENING + first))
            total += self._log_word(first) if first else 0.0
            after.append(total)
            total += sum(map(self._log_word, rest))
            upto.append(total)
        return np.array(opening), np.array(upto), np.array(after)


def _segments_between(text: str, cuts: list[tuple[int, int, str]]) -> list[str]:
    out, at = [], 0
    for a, b, _ in cuts:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return out


def _log_add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))


def _edge_scores(text: str, begins: list[int], ends: list[int], lc: list[float], lj: list[float], model: SplitModel):
    """A function of i: the scores of all values that begin with part i, shortest first, with the joins in them and the cut after them."""
    n = len(lc)
    joined = np.concatenate([[0.0], np.cumsum(lj)])
    cut = np.array([*lc, 0.0])
    near = n + 1 if n < FULL_PARTS else NEAR_PARTS
    words = model.words_before(text, begins, ends) if near <= n else None

    def row(i: int) -> np.ndarray:
        j = min(n + 1, i + near)
        value = np.array([model.log_value(_key(text[begins[i]:e])) for e in ends[i:j]])
        if j <= n:
            value = np.concatenate([value, model.log_novel(words[0][i] + words[1][j:] - words[2][i])])
            if i == 0:
                value[n] = model.log_value(_key(text[begins[0]:ends[n]]))
        return joined[i:] - joined[i] + value + cut[i:]

    if near <= n:
        return row
    rows = [row(i) for i in range(n + 1)]
    return rows.__getitem__


def _lattice(text: str, sure: list, doubt: list, model: SplitModel) -> tuple[list[str], dict[str, list[float]], list[tuple[str, float]]]:
    """Best split by Viterbi, and by forward-backward the expected cuts of each doubtful kind and expected values.

    ``sure`` cuts bound independent stretches; within one, every set of the
    ``doubt`` cuts is a path.
    """
    best: list[str] = []
    cut_stats: dict[str, list[float]] = {}
    expected: list[tuple[str, float]] = []
    start = at = 0
    for stop, after in [(a, b) for a, b, _ in sure] + [(len(text), len(text))]:
        inner = []
        while at < len(doubt) and doubt[at][1] <= stop:
            if doubt[at][0] >= start:
                inner.append(doubt[at])
            at += 1
        if not inner:
            best.append(text[start:stop])
            expected.append((text[start:stop], 1.0))
            start = after
            continue
        begins = [start] + [c[1] for c in inner]
        ends = [c[0] for c in inner] + [stop]
        n = len(inner)
        lc = [math.log(model.cut[c[2]]) for c in inner]
        lj = [math.log(1.0 - model.cut[c[2]]) for c in inner]
        row = _edge_scores(text, begins, ends, lc, lj, model)  # of the values that begin at i, by how many parts they hold beyond one
        top, back = np.full(n + 2, -np.inf), np.zeros(n + 2, dtype=np.int64)
        fwd, bwd = np.full(n + 2, -np.inf), np.full(n + 2, -np.inf)
        top[0] = fwd[0] = bwd[n + 1] = 0.0
        for i in range(n + 1):
            own = row(i)
            better = top[i] + own > top[i + 1:]
            top[i + 1:][better] = (top[i] + own)[better]
            back[i + 1:][better] = i
            fwd[i + 1:] = np.logaddexp(fwd[i + 1:], fwd[i] + own)
        for i in range(n, -1, -1):
            bwd[i] = np.logaddexp.reduce(row(i) + bwd[i + 1:])
        whole = fwd[n + 1]
        for i in range(n + 1):
            p = np.exp(np.minimum(0.0, fwd[i] + row(i) + bwd[i + 1:] - whole))
            expected.extend((text[begins[i]:ends[i + k]], float(p[k])) for k in np.flatnonzero(p > 1e-4).tolist())
        for c in range(n):
            p = math.exp(min(0.0, fwd[c + 1] + bwd[c + 1] - whole))
            got = cut_stats.setdefault(inner[c][2], [0.0, 0.0])
            got[0] += p
            got[1] += 1.0
        path, j = [], n + 1
        while j > 0:
            i = int(back[j])
            path.append(text[begins[i]:ends[j - 1]])
            j = i
        best.extend(reversed(path))
        start = after
    return best, cut_stats, expected


def segment(text: str, model: SplitModel):
    """Split one field: (values in order, cut statistics, expected values).

    Commas join if any other mark, tab or line break separates; else each one
    outside quotation that isn't between two digits separates. Whether a sign in
    doubt separates is seen between the commas, where values can't run together.
    """
    cuts = cut_points(text)
    if not cuts:
        return [text], {}, [(text, 1.0)]
    marks = [c for c in cuts if c[2] != "comma"]
    doubt = [c for c in marks if c[2] in _DOUBTFUL]
    sure = [c for c in marks if c[2] not in _DOUBTFUL]
    if not doubt:
        if _separates(text, sure):
            segs = _segments_between(text, sure)
            return segs, {}, [(s, 1.0) for s in segs]
        segs = _segments_between(text, sorted(sure + [c for c in cuts if c[2] == "comma"]))
        return segs, {}, [(s, 1.0) for s in segs]
    if not _separates(text, sure):
        commas = [c for c in cuts if c[2] == "comma"]
        found = _lattice(text, sorted(sure + commas), doubt, model)
        if not commas or all(c[2] == "and" for c in doubt):
            return found
        stretches = sum(1 for x in _segments_between(text, sorted(sure + commas)) if x.strip())
        if sum(1 for x in found[0] if x.strip()) <= stretches:
            return found
        over = _lattice(text, sure, doubt, model)
        return over if sum(1 for x in over[0] if x.strip()) > 1 else found
    return _lattice(text, sure, doubt, model)


def _separates(text: str, sure: list) -> bool:
    """Whether these cuts really part two values: a mark at either end doesn't."""
    return sum(1 for s in _segments_between(text, sure) if s.strip()) > 1 if sure else False


def _first_word(text: str, at: int) -> str:
    """What of the text from ``at`` holds its first word, with what may belong to it as a name."""
    m = _UP_TO_SPACE.match(text, at)
    return text[at:m.end()] if m else text[at:]


def _openers(text: str, model: SplitModel) -> dict[str, list[float]]:
    """Of each doubtful kind: how many right sides open as values are known to open, of how many."""
    stats: dict[str, list[float]] = {}
    for _, after, kind in cut_points(text):
        if kind in _DOUBTFUL:
            first = _key(_first_word(text, after)).split(" ", 1)[0]
            got = stats.setdefault(kind, [0.0, 0.0])
            got[0] += float(model.word_count(_OPENING + first) >= 2.0)
            got[1] += 1.0
    return stats


#: What a count is of: a value, a word, cuts of a kind, all delimiters of a kind.
_VALUE, _WORD, _CUT, _ALL = range(4)
_COUNT_SCHEMA = "field int, tab int, entry long, n double"


class Asked(SplitModel):
    """A model that knows nothing and notes what it is asked for."""

    def __post_init__(self) -> None:
        super().__post_init__()
        self.asked: dict[int, set[str]] = {_VALUE: set(), _WORD: set()}

    def word_count(self, word: str) -> float:
        self.asked[_WORD].add(word)
        return 0.0

    def log_value(self, key: str) -> float:
        self.asked[_VALUE].add(key)
        return super().log_value(key)

    def read(self, text: str) -> None:
        """Ask for all that any reading of this field may ask for."""
        _openers(text, self)
        segment(text, self)
        cuts = cut_points(text)
        doubt = [c for c in cuts if c[2] in _DOUBTFUL]
        if doubt:
            # Whether this lattice is read too depends on what the model knows.
            _lattice(text, [c for c in cuts if c[2] not in _DOUBTFUL and c[2] != "comma"], doubt, self)


class _Sums:
    """Counts by field that grow with every reading."""

    def __init__(self) -> None:
        self.of: dict[int, tuple[dict, dict, dict]] = defaultdict(lambda: (defaultdict(float), defaultdict(float), {}))

    def add(self, f: int, expected, cuts: dict, times: float = 1.0) -> None:
        values, words, kinds = self.of[f]
        for value, p in expected:
            key = _key(value)
            if key:
                values[key] += p * times
                words[_OPENING + key.split(" ", 1)[0]] += p * times
        for kind, (cut, all_) in cuts.items():
            k = kinds.setdefault(kind, [0.0, 0.0])
            k[0] += cut * times
            k[1] += all_ * times

    def batches(self):
        for f, (values, words, kinds) in self.of.items():
            parts = [(_VALUE, [_hash(k) for k in values], list(values.values())), (_WORD, [_hash(k) for k in words], list(words.values()))]
            for i, tab in enumerate((_CUT, _ALL)):
                parts.append((tab, [KINDS.index(k) for k in kinds], [kinds[k][i] for k in kinds]))
            for tab, entries, n in parts:
                for at in range(0, len(entries), 1 << 16):
                    size = len(entries[at:at + (1 << 16)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f] * size, pa.int32()), pa.array([tab] * size, pa.int32()), pa.array(entries[at:at + size], pa.int64()), pa.array(n[at:at + size], pa.float64())],
                        names=["field", "tab", "entry", "n"])


def _count(batches):
    """Sums per (field, what, entry) over Arrow batches (number of the field, text): words everywhere, values where the reading is certain."""
    plain, doubtful, sums = SplitModel(), re.compile(DOUBTFUL_PATTERN), _Sums()
    for batch in batches:
        for f, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not doubtful.search(text):
                sums.add(f, segment(text, plain)[2], {})
            words = sums.of[f][1]
            for w in _key(text).split(" "):
                words[w] += 1.0
    yield from sums.batches()


@dataclass
class Totals:
    """What the models of all fields need besides counts: of each (field, what) the total, the distinct and the single entries; of each field how often each kind cuts."""

    of: dict[tuple[int, int], tuple[float, float, float]]
    cut: dict[int, dict[str, float]]

    def models(self, counts: pa.Table) -> dict[int, SplitModel]:
        """Models of the fields that know these counts."""
        fields, tabs, keys, n = (np.asarray(counts.column(c)) for c in ("field", "tab", "entry", "n"))
        models = {}
        for f, cut in self.cut.items():
            held = []
            for tab in (_VALUE, _WORD):
                mine = np.flatnonzero((fields == f) & (tabs == tab))
                order = mine[np.argsort(keys[mine])]
                held.append(Counts(keys[order], n[order].astype(np.float32), *self.of[f, tab]))
            models[f] = SplitModel(held[0], held[1], cut)
        return models


def _tall(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).alias("text")) for i, c in enumerate(columns)]))
    return df.select(*keep, pairs.alias("x")).select(*keep, "x.field", "x.text").where(F.col("text").isNotNull())


def _model(counts: DataFrame, columns: list[str]) -> tuple[Totals, DataFrame]:
    """The M step: totals of the counts, and the counts as they were written on the way.

    What all entries come to is observed while they are written; only that and
    a row for each kind of delimiter reach the driver.
    """
    seen = Observation()
    pairs = [(f, tab) for f in range(len(columns)) for tab in (_VALUE, _WORD)]
    metrics = []
    for f, tab in pairs:
        own = (F.col("field") == f) & (F.col("tab") == tab)
        metrics += [F.sum(F.when(own, F.col("n")).otherwise(0.0)).alias(f"t{f}_{tab}"), F.count_if(own).alias(f"k{f}_{tab}"), F.count_if(own & (F.col("n") < 1.5)).alias(f"s{f}_{tab}")]
    stored = settle(counts.observe(seen, *metrics), "counts")
    totals = {p: tuple(float(seen.get.get(f"{m}{p[0]}_{p[1]}") or 0) for m in "tks") for p in pairs}
    rows = {(r.field, r.entry, r.tab): r.n for r in stored.where(F.col("tab") >= _CUT).collect()}
    cuts = {}
    for f in range(len(columns)):
        cut = cuts[f] = SplitModel().cut
        for i, k in enumerate(KINDS):
            all_ = rows.get((f, i, _ALL), 0.0)
            if k in _DOUBTFUL and all_ > 0:
                cut[k] = float(np.clip((rows.get((f, i, _CUT), 0.0) + 0.01) / (all_ + 0.02), 1e-5, 1 - 1e-5))
    return Totals(totals, cuts), stored


class Doubtful:
    """The distinct fields that hold a delimiter in doubt, in groups, and what each group asks for."""

    def __init__(self, tall: DataFrame) -> None:
        found = tall.where(F.col("text").rlike(DOUBTFUL_PATTERN)).groupBy("field", "text").agg(F.count("*").alias("times"))
        found = settle(found, "doubtful")
        spark = tall.sparkSession
        groups = max(1, -(-found.count() // GROUP_FIELDS))
        # A stated number, or tables that are small in bytes would be read by one task.
        self.parts = min(groups, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self.fields = found.withColumn("grp", F.pmod(F.xxhash64("field", "text"), F.lit(groups)))

        def ask(table: pa.Table) -> pa.Table:
            asked: dict[int, Asked] = defaultdict(Asked)
            for f, text in zip(table.column("field").to_pylist(), table.column("text").to_pylist()):
                asked[f].read(text)
            flat = [(f, tab, _hash(x)) for f, model in asked.items() for tab, entries in model.asked.items() for x in entries]
            columns = np.array(flat, dtype=np.int64).reshape(-1, 3)
            grp = pa.array(np.full(len(flat), table.column("grp")[0].as_py()), pa.int64())
            return pa.table([grp, pa.array(columns[:, 0].astype(np.int32)), pa.array(columns[:, 1].astype(np.int32)), pa.array(columns[:, 2])], names=["grp", "field", "tab", "entry"])

        self.asked = settle(self.fields.repartition(self.parts, "grp").groupBy("grp").applyInArrow(ask, "grp long, field int, tab int, entry long"), "asked")

    def read(self, totals: Totals, counts: DataFrame, what, schema: str) -> DataFrame:
        """``what(fields, models)`` of every group: a table from its (field, text, times) and the models that know what they ask for."""
        # A value seen once counts as new.
        known = self.asked.join(counts.where((F.col("tab") == _WORD) | ((F.col("tab") == _VALUE) & (F.col("n") > 1.0))), ["field", "tab", "entry"])
        known = known.select("grp", "field", "tab", "entry", "n").repartition(self.parts, "grp")
        shared = self.fields.sparkSession.sparkContext.broadcast(totals)

        def run(fields: pa.Table, known: pa.Table) -> pa.Table:
            return what(fields, shared.value.models(known))

        return self.fields.repartition(self.parts, "grp").groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(run, schema)


def _expect(begin: bool):
    """The E step over fields in doubt: expectations over their readings or, to begin with, judgements of each doubtful kind by what follows it."""

    def run(fields: pa.Table, models: dict[int, SplitModel]) -> pa.Table:
        sums = _Sums()
        for f, text, times in zip(*(fields.column(c).to_pylist() for c in ("field", "text", "times"))):
            if begin:
                sums.add(f, (), _openers(text, models[f]), times)
            else:
                _, cuts, expected = segment(text, models[f])
                sums.add(f, expected, cuts, times)
        empty = pa.schema([("field", pa.int32()), ("tab", pa.int32()), ("entry", pa.int64()), ("n", pa.float64())])
        return pa.Table.from_batches(list(sums.batches()), empty)

    return run


def learn_splits(source: DataFrame, columns: list[str], rounds: int = 2) -> tuple[Doubtful, Totals, DataFrame]:
    """EM over whole columns: one pass over all rows, then one to begin and ``rounds`` more over the fields that hold a doubtful delimiter.

    The other fields have one reading each, so their counts of the first pass stand.
    """
    tall = _tall(source, columns)
    summed = [F.sum("n").alias("n")]
    # Whether the signs in doubt cut is for the later passes to say.
    totals, fixed = _model(tall.mapInArrow(_count, _COUNT_SCHEMA).groupBy("field", "tab", "entry").agg(*summed), columns)
    doubtful, counts = Doubtful(tall), fixed
    for step in range(rounds + 1):
        found = doubtful.read(totals, counts, _expect(step == 0), _COUNT_SCHEMA)
        totals, counts = _model(fixed.unionByName(found).groupBy("field", "tab", "entry").agg(*summed), columns)
    return doubtful, totals, counts


def split_packed(df: DataFrame, key: str, columns: list[str], tagged: list[str] = (), rounds: int = 2) -> DataFrame:
    """One row per value: ``(key, field, pos, val)``.

    ``pos`` counts the non-empty values of a field from 1 in reading order;
    repeated values stay.  ``tagged`` names the columns whose values are
    ``name: value`` tags.  Null, empty and blank fields give no row; an
    unclosed quotation mark is an ordinary character; a repeated key gives the
    rows of each of its records.  Other columns of ``df`` are not read.
    """
    source = spread(df.select(F.col(key).alias("__key"), *[F.col(c).cast("string").alias(c) for c in columns]))
    doubtful, totals, counts = learn_splits(source, columns, rounds)
    key_type = df.schema[key].dataType
    tag = frozenset(tagged)

    def values(text: str, model: SplitModel, column: str) -> list[str]:
        return [v for v in (clean_value(raw, column in tag) for raw in segment(text, model)[0]) if v]

    def run(batches):
        plain, doubt = SplitModel(), re.compile(DOUBTFUL_PATTERN)
        for batch in batches:
            ids = batch.column(0)
            at, names, poss, vals = [], [], [], []
            for f, c in enumerate(columns, 1):
                for row, text in enumerate(batch.column(f).to_pylist()):
                    if not text or doubt.search(text):
                        continue
                    for pos, v in enumerate(values(text, plain, c), 1):
                        at.append(row)
                        names.append(c)
                        poss.append(pos)
                        vals.append(v)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(poss, pa.int32()), pa.array(vals, pa.string())],
                names=["__key", "field", "pos", "val"])

    def read(fields: pa.Table, models: dict[int, SplitModel]) -> pa.Table:
        rows = list(zip(fields.column("field").to_pylist(), fields.column("text").to_pylist()))
        return fields.select(["field", "text"]).append_column("vals", pa.array([values(text, models[f], columns[f]) for f, text in rows], pa.list_(pa.string())))

    schema = T.StructType([T.StructField("__key", key_type), T.StructField("field", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("val", T.StringType())])
    certain = source.mapInArrow(run, schema)
    # Fields in doubt were read once each; what was read goes to all rows that hold it.
    readings = doubtful.read(totals, counts, read, "field int, text string, vals array<string>")
    rows = _tall(source, columns, "__key").where(F.col("text").rlike(DOUBTFUL_PATTERN)).join(readings, ["field", "text"])
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("field") + 1).alias("field")
    of_doubt = rows.select("__key", name, F.posexplode("vals").alias("pos", "val")).withColumn("pos", F.col("pos") + 1)
    return certain.unionByName(of_doubt).withColumnRenamed("__key", key)
