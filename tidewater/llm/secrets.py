"""Secret scans: base patterns, and formats that are inferred as probabilistic automata.

One pass over the texts finds the spans of the base patterns and all candidates, which are runs of credential characters. Grammar inference
(ALERGIA): credentials of one kind, labelled by the base patterns, make a prefix tree with counts; states whose outgoing frequencies
are compatible by Hoeffding's bound are merged, with their subtrees, until none are. The tree's alphabet is learned first: characters that
stand in each other's places in a kind's credentials are one symbol, so that a tree of random characters is narrow and its counts tell
where a format ends; and what all of a kind's credentials begin with is learned literally. The automaton that is left gives a string a probability, and within a symbol its characters have theirs. Every
candidate and every base span is scored by its log likelihood under the automata against a background of the corpus's own
unlabelled runs, which are words, names and numbers.
"""

from __future__ import annotations

import math
import re
import warnings
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import zip_longest
from os.path import commonprefix
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, bytes_of, partitions, pieces_of, tidy

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_WORDS = re.compile(rb"passw|secret|token|api_?key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
#: Credential characters for candidates of the inferred grammars.
CREDENTIAL = np.zeros(256, bool)
CREDENTIAL[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True
#: Classes of characters that an alphabet starts from: digits, a-f, g-z, A-F, G-Z, and each mark by itself; the last is all else.
CLASSES = bytes(0 if 48 <= c < 58 else 1 if 97 <= c < 103 else 2 if 103 <= c < 123 else 3 if 65 <= c < 71 else 4 if 71 <= c < 91 else 5 + b"+/_.=-".find(bytes([c])) if bytes([c]) in b"+/_.=-" else 11 for c in range(256))
N_CLASSES = 12
END = 12
#: The state of a prefix tree that words go into beyond its depth.
TAIL = 1


def base_spans(text: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value's start, value's end) in bytes, by start and then kind."""
    found = []
    low = text.lower()  # bytes: folds A-Z alone and keeps every position
    if ASSIGN_WORDS.search(low):
        found += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(data: np.ndarray, offsets: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of at least `least` credential characters, as positions in a whole batch."""
    if not len(data):
        return []
    inside = CREDENTIAL[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    some = ends - starts >= least
    starts, ends = starts[some], ends[some]
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def alphabet(words: list[bytes], alpha: float = 0.01) -> np.ndarray:
    """The symbol of each byte. Classes are merged while what stands before and behind them in the words is compatible by Hoeffding's
    bound, and so are their shares at the words' beginnings: then either may stand where the other does."""
    symbol = np.arange(N_CLASSES)
    coded = [np.frombuffer(w.translate(CLASSES), np.uint8).astype(np.int64) for w in words]
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    while True:
        # N_CLASSES stands for the beginning and the end of a word
        after = np.zeros((N_CLASSES + 1, N_CLASSES + 1))
        for w in coded:
            s = np.concatenate([[N_CLASSES], symbol[w], [N_CLASSES]])
            np.add.at(after, (s[:-1], s[1:]), 1)
        before, total = after.T, after.sum(1)
        used = [c for c in np.unique(symbol) if total[c]]
        best = None
        for i, a in enumerate(used):
            for b in used[i + 1 :]:
                gap = bound * (1 / math.sqrt(total[a]) + 1 / math.sqrt(total[b]))
                worst = 0.0
                for m in (after, before):
                    x, y = m[a] / total[a], m[b] / total[b]
                    worst = max(worst, float(np.abs(x - y).max()))
                if worst <= gap and (best is None or worst / gap < best[0]):
                    best = (worst / gap, a, b)
        if best is None:
            return symbol[np.frombuffer(CLASSES, np.uint8)]
        symbol[symbol == best[2]] = best[1]


@dataclass
class Automaton:
    """A probabilistic deterministic automaton: per state the log probability and target of each symbol, and of the end; symbols are the
    bytes' symbols and chars their log probabilities within their symbols. Its score is against `background`."""

    symbols: bytes
    chars: np.ndarray
    prefix: bytes = b""  # what words begin with, literally; each character that differs costs `floor`
    background: Background | None = None
    steps: list[dict[int, tuple[int, float]]] = field(default_factory=list)
    ends: list[float] = field(default_factory=list)
    floor: float = math.log(1e-6)
    threshold: float = math.inf
    allowed: float = math.inf

    def read(self, word: bytes) -> tuple[float, int]:
        """The word's log probability, and its steps that the automaton doesn't have; an end where none was counted is two, as
        all that a word lacks is behind it. Each costs `floor`, and the state stays."""
        n = len(self.prefix)
        wrong = sum(a != b for a, b in zip_longest(self.prefix, word[:n]))
        state, total = 0, self.floor * wrong
        for c, s in zip(word[n:], word[n:].translate(self.symbols), strict=True):
            if s in self.steps[state]:
                state, p = self.steps[state][s]
            else:
                p, wrong = self.floor, wrong + 1
            total += p + self.chars[c]
        return total + max(self.ends[state], self.floor), wrong + 2 * (self.ends[state] == -math.inf)

    def score(self, word: bytes) -> float:
        """Mean log likelihood ratio per character to the background."""
        return (self.read(word)[0] - (self.background or Background()).likelihood(word)) / (len(word) + 1)

    def margin(self, word: bytes) -> float:
        """By how much a word is above the threshold; it must also be in the format, but for the steps allowed."""
        return self.score(word) - self.threshold if self.read(word)[1] <= self.allowed else -math.inf


@dataclass
class Background:
    """Ordinary runs as a chain of characters, each given the one before, mixed with even odds; 0 stands for the edges."""

    pairs: np.ndarray | None = None

    @staticmethod
    def of(words: list[bytes]) -> Background:
        counts = np.zeros((256, 256))
        for w in words:
            s = np.frombuffer(b"\0" + w + b"\0", np.uint8)
            np.add.at(counts, (s[:-1], s[1:]), 1)
        single = (counts.sum(0) + 0.1) / (counts.sum() + 25.6)
        return Background(np.log((counts + 8 * single) / (counts.sum(1, keepdims=True) + 8)).astype(np.float32)) if words else Background()

    def likelihood(self, word: bytes) -> float:
        if self.pairs is None:
            return -math.log(95) * (len(word) + 1)
        s = np.frombuffer(b"\0" + word + b"\0", np.uint8)
        return float(self.pairs[s[:-1], s[1:]].sum())


def infer(words: list[bytes], alpha: float = 0.01, depth: int = 128, fewest: int = 16) -> Automaton:
    """ALERGIA over the words' symbols. alpha: the confidence of Hoeffding's test; a state of fewer than `fewest` words, where the test
    tells nothing, is merged only with one that ends as it does. Beyond `depth` characters the prefix tree goes
    into one state, TAIL, that loops, so that long words stay within bounds. Merging prefers any other state to
    it. What long words do from there on, and where they end, is counted on the merged states."""
    prefix = commonprefix(words) if len(words) >= 5 else b""
    prefix = prefix if len(prefix) >= 2 and any(len(w) > len(prefix) for w in words) else b""
    words = [w[len(prefix) :] for w in words]
    symbols = alphabet(words, alpha).astype(np.uint8).tobytes()
    step: list[dict[int, int]] = [{}, {}]
    count: list[dict[int, int]] = [defaultdict(int), defaultdict(int)]
    long = []
    for w in sorted(words):
        s = 0
        w = w.translate(symbols)
        for c in w[:depth]:
            count[s][c] += 1
            if c not in step[s]:
                step[s][c] = len(step)
                step.append({})
                count.append(defaultdict(int))
            s = step[s][c]
        if len(w) > depth:
            count[s][w[depth]] += 1
            step[s][w[depth]] = TAIL
            long.append(w)
        else:
            count[s][END] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = sum(count[a].values()), sum(count[b].values())
            if not na or not nb:
                continue
            if min(na, nb) < fewest and (count[a].get(END, 0) == na) != (count[b].get(END, 0) == nb):
                return False
            gap = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            for c in {*count[a], *count[b]}:
                if abs(count[a].get(c, 0) / na - count[b].get(c, 0) / nb) > gap:
                    return False
            todo += [(step[a][c], step[b][c]) for c in step[a].keys() & step[b].keys() if step[a][c] != step[b][c] and TAIL not in (step[a][c], step[b][c])]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            for c, n in count[b].items():
                count[a][c] += n
            for c, t in step[b].items():
                if step[a].get(c, TAIL) == TAIL:
                    step[a][c] = t
                elif t != TAIL:
                    todo.append((step[a][c], t))

    red, settled = [0], {0, TAIL}
    while True:
        blue = sorted((t, s, c) for s in red for c, t in step[s].items() if t not in settled)
        if not blue:
            break
        t, s, c = blue[0]
        for r in red:
            if alike(r, t):
                step[s][c] = r
                fold(r, t)
                break
        else:
            red.append(t)
            settled.add(t)
    red.append(TAIL)
    for w in long:
        s = 0
        for i, c in enumerate(w):
            if i > depth:
                count[s][c] += 1
            s = step[s].setdefault(c, TAIL)
        count[s][END] += 1
    place = {r: i for i, r in enumerate(red)}
    seen = np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=256) + np.isin(np.arange(256), np.flatnonzero(CREDENTIAL)) * 0.01
    per = np.bincount(np.frombuffer(symbols, np.uint8), weights=seen, minlength=256)[np.frombuffer(symbols, np.uint8)]
    out = Automaton(symbols, np.log(np.maximum(seen, 1e-6) / np.maximum(per, 1e-6)), prefix)
    for r in red:
        total = sum(count[r].values()) + 1
        out.steps.append({c: (place[t], math.log(count[r][c] / total)) for c, t in step[r].items() if t in place and count[r][c]})
        out.ends.append(math.log(count[r][END] / total) if count[r].get(END) else -math.inf)
    return out


@dataclass
class Formats:
    """A kind with credentials of several lengths: an automaton per format, and the one that likes a word best decides."""

    parts: list[Automaton]

    def score(self, word: bytes) -> float:
        return max(a.score(word) for a in self.parts)

    def margin(self, word: bytes) -> float:
        return max(a.margin(word) for a in self.parts)


def by_format(words: list[bytes], fewest: int = 20) -> list[list[bytes]]:
    """Lengths that at least `fewest` of the words have are formats of their own, so that merging can't join their ends; the words of all other lengths are
    one more if they are as many, or if there is no other."""
    of = defaultdict(list)
    for w in words:
        of[len(w)].append(w)
    own = [ws for _, ws in sorted(of.items()) if len(ws) >= fewest]
    rest = [w for w in words if len(of[len(w)]) < fewest]
    return own + ([rest] if len(rest) >= fewest or (rest and not own) else [])


def learn(credentials: dict[str, list[bytes]], ordinary: list[bytes] = (), keep: float = 0.02, recall: float = 0.9) -> dict[str, Automaton | Formats]:
    """What recognises each kind that has labelled credentials: an automaton, or Formats if they have several lengths. Of those held out (every fifth of
    a format; of fewer than five, all) an automaton's threshold leaves out the lowest `keep` (or fewer, by their mean and deviation, as a few tell little of
    the lowest), and is positive: a candidate must be likelier than an ordinary run. No step may be wrong if `recall` of those held out have
    none, else one; a format of which that finds less takes nothing (allowed -1) and only scores, with a warning. Runs that are as likely as credentials, against characters drawn evenly, aren't taken for ordinary."""
    groups = [(kind, words, infer([w for i, w in enumerate(words) if i % 5] or words)) for kind, of in credentials.items() for words in by_format(of)]

    def against(background: Background) -> None:
        for _, words, automaton in groups:
            automaton.background = background
            held = [w for i, w in enumerate(words) if i % 5 == 0 or len(words) < 5]
            scores = np.sort([automaton.score(w) for w in held])
            automaton.threshold = max(min(scores[int(len(held) * keep)], scores.mean() + NormalDist().inv_cdf(keep) * scores.std()), 0.05)
            for automaton.allowed in (0, 1, -1):
                if sum(automaton.margin(w) >= 0 for w in held) >= recall * len(held):
                    break

    against(Background())
    against(Background.of([w for w in ordinary if all(a.margin(w) < 0 for _, _, a in groups)]))
    found: dict[str, list[Automaton]] = {}
    for kind, words, automaton in groups:
        found.setdefault(kind, []).append(automaton)
        if automaton.allowed < 0:
            warnings.warn(f"no format was found in {len(words)} credentials of the kind {kind} with {min(map(len, words))} to {max(map(len, words))} characters", stacklevel=2)
    return {kind: parts[0] if len(parts) == 1 else Formats(parts) for kind, parts in found.items()}


FOUND = "id {}, base array<struct<start:int,kind:int,end:int,a:int,value:binary>>, runs array<struct<start:int,end:int,value:binary>>, marks array<int>"


def found_in(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Per row: the base spans with their values, the other candidates, both by bytes, and where characters of several bytes make
    code points fall behind (marks: pairs of a span's edge in bytes and its code point)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("a", pa.int32()), ("value", pa.binary())]))
        others = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())]))
        for batch in pieces_of(batches, 1):
            data, at = bytes_of(batch.column(1))
            more: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for a, b in candidates(data, at, least):
                more[int(np.searchsorted(at, a, "right")) - 1].append((a, b))
            base, runs, marks = [], [], []
            for i in range(batch.num_rows):
                text = data[at[i] : at[i + 1]].tobytes()
                own = base_spans(text)
                free = []
                reach, k = -1, 0  # candidates and base spans come in order: the furthest end of those that begin before
                for a, b in more.get(i, ()):
                    a, b = a - int(at[i]), b - int(at[i])
                    while k < len(own) and own[k][0] <= a:
                        reach, k = max(reach, own[k][2]), k + 1
                    if b > reach:
                        free.append((a, b, text[a:b]))
                base.append([(s, kind, e, a, text[a:b]) for s, kind, e, a, b in own])
                runs.append(free)
                edges = sorted({x for s, _, e, *_ in own for x in (s, e)} | {x for a, b, _ in free for x in (a, b)}) if not text.isascii() else []
                if edges:
                    lead = np.cumsum(np.concatenate([[0], (np.frombuffer(text, np.uint8) & 0xC0) != 0x80]))[edges]
                    marks.append(np.stack([edges, lead], 1).ravel().tolist())
                else:
                    marks.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(runs, others), pa.array(marks, pa.list_(pa.int32()))], ["id", "base", "runs", "marks"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, FOUND.format(kind))


def labelled(found: DataFrame, most: int) -> tuple[dict[str, list[bytes]], list[bytes]]:
    """At most `most` different credentials per kind, and as many other runs, the ones of least hash over all documents: the same on every run."""
    base = found.select(F.explode("base").alias("s")).select("s.kind", "s.value")
    runs = found.select(F.explode("runs").alias("s")).select(F.lit(len(KINDS)).alias("kind"), "s.value")
    every = base.unionByName(runs).withColumn("h", F.xxhash64("value"))
    # A task passes on its own least ones; what it has of one value counts once.
    taken = every.groupBy("kind", "value", "h").agg(F.count("*").alias("n")).drop("n")
    out = [[bytes(r.value) for r in taken.filter(F.col("kind") == k).orderBy("h", "value").limit(most).collect()] for k in range(len(KINDS) + 1)]
    return dict(zip(KINDS, out, strict=False)), out[-1]


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", automata: dict[str, Automaton | Formats] | None = None, most: int = 2000, least: int = 12) -> DataFrame:
    """(id, spans array<struct<kind, start, end, score>>), code points, end exclusive, by start and then kind.

    Base spans stay, with the score of their value under their kind's automaton (null if the kind has none). A run of at least `least`
    credential characters, not within a base span, adds a span `like_<kind>` if the automaton of that kind finds it likely; the
    likeliest kind names it, of equals the first of KINDS. automata: fitted here from at most `most` labelled credentials per kind if not
    given. Null texts count as empty (no spans); null ids are ids; long texts are read whole; equal rows give equal rows; an empty table gives
    none; other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.put(found_in(docs, id_col, text_col, least), "found")
    automata = learn(*labelled(found, most)) if automata is None else automata
    kinds = [k for k in KINDS if k in automata]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        known: dict[bytes, tuple[float, str]] = {}  # repeated runs are scored once
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                out = []
                for base, runs, marks in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    spans = [(s["start"], KINDS[s["kind"]], s["kind"], s["end"], automata[KINDS[s["kind"]]].score(s["value"]) if KINDS[s["kind"]] in automata else None) for s in base]
                    for r in runs if kinds else ():
                        if (best := known.get(r["value"])) is None:
                            score, place = max((automata[k].margin(r["value"]), -KINDS.index(k)) for k in kinds)
                            best = score, KINDS[-place]
                            if len(known) < 100_000:
                                known[r["value"]] = best
                        if best[0] >= 0:
                            spans.append((r["start"], f"like_{best[1]}", 3 + KINDS.index(best[1]), r["end"], best[0]))
                    spans.sort(key=lambda x: (x[0], x[2]))
                    lead = dict(zip(marks[::2], marks[1::2], strict=True))  # bytes to code points
                    out.append([{"kind": n, "start": lead.get(s, s), "end": lead.get(e, e), "score": p} for s, n, _, e, p in spans])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["id", "spans"])
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    # The table is much smaller than the texts, and so would be read by few tasks.
    out = found.repartition(partitions(docs.sparkSession)).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>")
    return out.select(F.col("id").alias(id_col), "spans")
